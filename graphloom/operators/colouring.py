"""Vertex and edge colouring, independent sets and planarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import NoSolutionError
from ..functions.kernels import adjacency, colouring, planarity
from ..scratch import materialise
from .per_component import by_component, key_type


def _near(vertices, edges) -> dict:
    return {v: {w for w, _ in ws} for v, ws in adjacency(vertices, [e[:3] for e in edges]).items()}


def vertex_colouring(g, colours: int) -> DataFrame:
    """``(key, colour)`` with colours 1..n, or NoSolutionError."""

    def kernel(vertices, edges):
        found = colouring.with_colours(_near(vertices, edges), colours)
        return sorted(found.items()) if found is not None else [(vertices[0], None)]

    out = materialise(by_component(g.undirected(), kernel, f"key {key_type(g)}, colour int"), "colours")
    if not out.filter("colour is null").isEmpty():
        raise NoSolutionError(f"{colours} colours are not enough")
    return out


def greedy_vertex_colouring(g) -> DataFrame:
    """``(key, colour)``, first fit in key order, colours from 0."""

    def kernel(vertices, edges):
        near = {v: ws - {v} for v, ws in _near(vertices, edges).items()}
        return sorted(colouring.first_fit(near).items())

    return by_component(g.undirected(), kernel, f"key {key_type(g)}, colour int")


def edge_colouring(g, colours: int) -> DataFrame:
    return vertex_colouring(g.undirected().line_graph(), colours)


def greedy_edge_colouring(g) -> DataFrame:
    return greedy_vertex_colouring(g.undirected().line_graph())


def maximal_independent_set(g) -> DataFrame:
    """``(key)``: rounds in which every vertex whose hash is the least around it enters the set and
    takes its neighbours out. Deterministic; no kernel, so any size."""
    left = materialise(g.vertices.select("key", F.xxhash64("key").alias("h")), "left")
    arcs = materialise(g.both_ways().filter("src <> dst").select("src", "dst").distinct(), "arcs")
    chosen = None
    while not left.isEmpty():
        rank = F.struct("h", "key")
        around = arcs.join(left.select(F.col("key").alias("dst"), rank.alias("r")), "dst").groupBy(F.col("src").alias("key")).agg(F.min("r").alias("least"))
        pick = materialise(left.join(around, "key", "left").filter(F.col("least").isNull() | (F.struct("h", "key") < F.col("least"))).select("key"), "pick")
        chosen = pick if chosen is None else chosen.unionByName(pick)
        out = pick.unionByName(arcs.join(pick.toDF("src"), "src", "left_semi").select(F.col("dst").alias("key")))
        left = materialise(left.join(out, "key", "left_anti"), "left")
    return chosen if chosen is not None else g.vertices.select("key")


def is_planar(g) -> bool:
    """Edge counts settle most graphs; the rest is decided component by component."""
    simple = g.edges.filter("tail <> head").select(F.least("tail", "head").alias("tail"), F.greatest("tail", "head").alias("head")).distinct()
    n, m = g.order(), simple.count()
    if n < 5 or m < 9:
        return True
    if m > 3 * n - 6:
        return False
    found = by_component(g.undirected(), lambda v, e: [(planarity.is_planar(v, [x[:3] for x in e]),)], "planar boolean")
    return found.filter("not planar").isEmpty()
