"""Shortest paths by rounds of relaxation, all pairs by min-plus squaring.

Weights may be negative; a negative cycle that can be reached raises NegativeCycleError. Among
equally short paths the one with fewest edges wins, then the smallest edge keys. An undirected
edge of negative weight is itself a negative cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import NegativeCycleError
from ..scratch import discard, materialise


def lightest_arcs(g) -> DataFrame:
    """``(src, dst, key, weight)``: the lightest of parallel arcs (then the smallest key)."""
    arcs = g.arcs().filter("src <> dst or weight < 0")
    best = arcs.groupBy("src", "dst").agg(F.min(F.struct("weight", "key")).alias("b"))
    return best.select("src", "dst", F.col("b.key").alias("key"), F.col("b.weight").alias("weight"))


def shortest_paths(g, source, with_edges: bool = True) -> DataFrame:
    """``(source, target, weight, edges)`` for every vertex that can be reached, the source with 0.
    ``edges`` lists the path's edge keys from source to target (empty if not ``with_edges``)."""
    g.vertex(source)
    n = g.order()
    arcs = materialise(lightest_arcs(g), "arcs")
    trail = "array<" + dict(g.edges.dtypes)["key"] + ">"
    start = F.struct(F.lit(0.0).alias("weight"), F.lit(0).alias("hops"), F.array().cast(trail).alias("edges"))
    state = materialise(g.vertices.filter(F.col("key") == F.lit(source)).select("key", start.alias("d")), "dist")
    changed, rounds = state, 0
    while True:
        rounds += 1
        extend = F.concat("d.edges", F.array("a.key")) if with_edges else F.col("d.edges")
        sent = changed.alias("c").join(arcs.alias("a"), F.col("c.key") == F.col("a.src")).select(
            F.col("a.dst").alias("key"), F.struct((F.col("d.weight") + F.col("a.weight")).alias("weight"), (F.col("d.hops") + 1).alias("hops"), extend.alias("edges")).alias("d"))
        sent = sent.groupBy("key").agg(F.min("d").alias("new"))
        better = sent.join(state, "key", "left").filter(F.col("d").isNull() | (F.col("new") < F.col("d"))).select("key", F.col("new").alias("d"))
        better = materialise(better, "better")
        if better.isEmpty():
            break
        if rounds >= n:
            raise NegativeCycleError(f"a negative cycle can be reached from {source!r}")
        merged = materialise(state.join(better.select("key"), "key", "left_anti").unionByName(better), "dist")
        discard(state)
        state, changed = merged, better
    return state.select(F.lit(source).alias("source"), F.col("key").alias("target"), F.col("d.weight").alias("weight"), F.col("d.edges").alias("edges"))


def shortest_path(g, source, target) -> DataFrame:
    """One row; weight and edges are null and empty where the target cannot be reached."""
    g.vertex(target)
    found = shortest_paths(g, source).filter(F.col("target") == F.lit(target))
    row = g.vertices.filter(F.col("key") == F.lit(target)).select(F.lit(source).alias("source"), F.col("key").alias("target"))
    out = row.join(found.select("target", "weight", "edges"), "target", "left")
    return out.select("source", "target", "weight", F.coalesce("edges", F.array().cast("array<" + dict(g.edges.dtypes)["key"] + ">")).alias("edges"))


def all_shortest_paths(g) -> DataFrame:
    """``(source, target, weight, hops)`` of all pairs that paths join; log2(longest) squarings."""
    own = g.vertices.select(F.col("key").alias("source"), F.col("key").alias("target"), F.struct(F.lit(0.0).alias("weight"), F.lit(0).alias("hops")).alias("d"))
    arcs = lightest_arcs(g).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.struct("weight", F.lit(1).alias("hops")).alias("d"))
    d = materialise(own.unionByName(arcs).groupBy("source", "target").agg(F.min("d").alias("d")), "pairs")
    while True:
        if not d.filter("source = target and d.weight < 0").isEmpty():
            raise NegativeCycleError("a vertex is nearer to itself than zero")
        a, b = d.select("source", F.col("target").alias("mid"), F.col("d").alias("x")), d.select(F.col("source").alias("mid"), "target", F.col("d").alias("y"))
        step = a.join(b, "mid").select("source", "target", F.struct((F.col("x.weight") + F.col("y.weight")).alias("weight"), (F.col("x.hops") + F.col("y.hops")).alias("hops")).alias("d"))
        new = materialise(step.groupBy("source", "target").agg(F.min("d").alias("d")), "pairs")
        same = new.select("source", "target", F.round("d.weight", 9).alias("w")).exceptAll(d.select("source", "target", F.round("d.weight", 9).alias("w"))).isEmpty()
        discard(d)
        d = new
        if same:
            return d.select("source", "target", F.col("d.weight").alias("weight"), F.col("d.hops").alias("hops"))
