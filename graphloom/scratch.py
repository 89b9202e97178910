"""Scratch tables in the shared folder named by ``spark.checkpoint.dir``.

Loops and multi-pass operators cut their lineage by writing a table there: an executor lost later
costs a read, not a replay, and nothing depends on an executor's own disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode, where none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("graphloom.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("graphloom.scratch.dir", root)
    return root


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of :func:`materialise` tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path is not None:
            spark = df.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
