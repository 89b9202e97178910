"""Minimum spanning forests: each round every component takes its lightest edge out (ties by key),
and the components that meet merge. Rounds are logarithmic in the number of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import DisconnectedError
from ..scratch import materialise
from .components import star_components
from .traversal import components


def spanning_forest(g) -> DataFrame:
    """The edges of the minimum spanning forest, ties broken by edge key."""
    e = materialise(g.edges.filter("tail <> head").select("key", "weight", F.col("tail").alias("a"), F.col("head").alias("b")), "mst")
    chosen = None
    while True:
        both = e.select("a", "key", "weight", F.col("b").alias("o")).unionByName(e.select(F.col("b").alias("a"), "key", "weight", F.col("a").alias("o")))
        pick = both.groupBy("a").agg(F.min(F.struct("weight", "key", "o")).alias("m"))
        pick = materialise(pick.select("a", F.col("m.key").alias("key"), F.col("m.o").alias("o")), "pick")
        if pick.isEmpty():
            break
        keys = pick.select("key").distinct()
        chosen = keys if chosen is None else chosen.unionByName(keys)
        comp = materialise(star_components(pick, "a", "o"), "comp")
        e = e.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").filter("ca <> cb")
        # Of parallel edges between two components only the lightest can be chosen.
        e = e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.min(F.struct("weight", "key")).alias("m"))
        e = materialise(e.select(F.col("m.key").alias("key"), F.col("m.weight").alias("weight"), "a", "b"), "mst")
    return g.edges.join(chosen, "key", "left_semi") if chosen is not None else g.edges.limit(0)


def spanning_tree(g) -> tuple[DataFrame, float]:
    """Edges and weight of the minimum spanning tree of a connected graph."""
    if not g.is_connected():
        raise DisconnectedError("the graph has more than one component")
    tree = materialise(spanning_forest(g), "tree")
    return tree, tree.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]


def forest_by_component(g) -> DataFrame:
    """``(comp, vertices, edges, weight)``: counts and weight of each tree of the forest."""
    comp = materialise(components(g), "comp")
    v = comp.groupBy("comp").agg(F.count("*").alias("vertices"))
    e = spanning_forest(g).join(comp.toDF("tail", "comp"), "tail").groupBy("comp").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    return v.join(e, "comp", "left").select("comp", "vertices", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
