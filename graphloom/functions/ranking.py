"""Global ranks and running sums without a single-partition window.

Rows are range-partitioned and sorted, written once, and each partition's total is added up over
one row per partition; the offsets then join back by partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import materialise


def _sorted_parts(df: DataFrame, order: list) -> DataFrame:
    names = [c for c in order if isinstance(c, str)]
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if names or order else df
    # The id holds the partition in its upper bits and the position in its lower 33.
    out = materialise(out.withColumn("__id", F.monotonically_increasing_id()), "sorted")
    return out.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})


def with_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """1-based positions in the order of the columns."""
    parts = _sorted_parts(df, list(order))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    # One row per partition.
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).select(*df.columns, name)


def running_sum(df: DataFrame, value: str, *order, name: str = "total") -> DataFrame:
    """Sum of ``value`` up to and with each row, in the order of the columns."""
    parts = _sorted_parts(df, list(order))
    sums = parts.groupBy("__part").agg(F.sum(value).alias("__s"))
    before = sums.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + within).select(*df.columns, name)
