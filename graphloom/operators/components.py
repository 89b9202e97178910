"""Connected components by alternating large-star and small-star rounds.

Each round is a partial aggregation and an equi-join on the edge list; the number of rounds grows
with the logarithm of the component size, not with its diameter. Only edges between different
vertices are kept, and each round's edges are written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import discard, materialise


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def star_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(v, comp)`` for every vertex of ``edges``; comp is the smallest vertex of its component."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    e = materialise(e, "edges")
    ends = materialise(e.select(F.col("u").alias("v")).union(e.select("v")).distinct(), "ends")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _nearest(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # After a large-star every edge points to a smaller vertex: small-star sees (u, v < u).
        large = large.filter("u <> v").distinct()
        hub = _nearest(large)
        small = large.join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("own"))
        step = small.select("u", "v").union(small.select(F.col("own").alias("u"), "v")).filter("u <> v").distinct()
        new = materialise(step, "edges")
        stats = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)")) if dict(new.dtypes)["v"] in ("bigint", "int") else F.count("v")).first()
        discard(e)
        e = new
        if tuple(stats) == mark:
            break
        mark = tuple(stats)
    # At the fixpoint every edge joins a vertex with the smallest one of its component.
    return ends.join(e.select(F.col("u").alias("v"), F.col("v").alias("comp")), "v", "left").select("v", F.coalesce("comp", "v").alias("comp"))
