"""Maximum flow and disjoint paths: distributed pruning to what lies between source and sink, then
one exact kernel over the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import ComponentTooLargeError
from ..functions.kernels import flow
from .per_component import MAX_KERNEL_EDGES
from .traversal import breadth_first, require_reachable


def _between(g, source, sink) -> DataFrame:
    """Arcs on some walk from source to sink."""
    on = breadth_first(g, source).select("key").join(breadth_first(g, sink, incoming=True).select("key"), "key", "left_semi")
    arcs = g.arcs().filter("src <> dst")
    return arcs.join(on.toDF("src"), "src", "left_semi").join(on.toDF("dst"), "dst", "left_semi")


def _solve(arcs: DataFrame, source, sink, method):
    """Parallel capacities add up in Spark; the kernel runs where one group lands."""
    merged = arcs.groupBy("src", "dst").agg(F.sum("weight").alias("capacity"))
    n = merged.count()
    if n > MAX_KERNEL_EDGES:
        raise ComponentTooLargeError(f"{n} arcs lie between source and sink; the kernel's limit is {MAX_KERNEL_EDGES}")

    def run(pdf):
        import pandas as pd

        rows = sorted(zip(pdf.src.tolist(), pdf.dst.tolist(), pdf.capacity.tolist(), strict=True))
        return pd.DataFrame({"value": [float(method(rows, source, sink))]})

    out = merged.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "value double").collect()
    return out[0][0] if out else 0.0


def max_flow(g, source, sink, method=flow.max_flow) -> float:
    """Value of a maximum flow with the edge weights as capacities."""
    require_reachable(g, source, sink)
    return _solve(_between(g, source, sink), source, sink, method)


def edge_disjoint_paths(g, source, target) -> int:
    require_reachable(g, source, target)
    return int(_solve(_between(g, source, target).withColumn("weight", F.lit(1.0)), source, target, flow.max_flow))


def vertex_disjoint_paths(g, source, target) -> int:
    """Paths that share no inner vertex: each inner vertex becomes an arc of capacity one."""
    require_reachable(g, source, target)
    arcs = _between(g, source, target).select("src", "dst").distinct()
    name = lambda c, side: F.concat(F.col(c).cast("string"), F.lit(side))
    across = arcs.select(name("src", "|out").alias("src"), name("dst", "|in").alias("dst"), F.lit(1.0).alias("weight"))
    inner = arcs.select(F.explode(F.array("src", "dst")).alias("v")).distinct().filter(~F.col("v").isin(source, target))
    through = inner.select(name("v", "|in").alias("src"), name("v", "|out").alias("dst"), F.lit(1.0).alias("weight"))
    return int(_solve(across.unionByName(through), f"{source}|out", f"{target}|in", flow.max_flow))
