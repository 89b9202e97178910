"""Components and bridges of a graph that grows by a stream of edges.

State is a log of deltas in a folder: for each batch the edges and vertices that are new, the component
renames ``(comp, into)`` it made and, where bridges are kept, the bridges of touched components; a manifest
names the deltas of the batches that are complete. A batch writes what it changes, not what there is:
a vertex's first component is written once, and reading follows its renames, which are folded into one
table from old to last name. After ``COMPACT`` batches the log is written anew as one delta.

With ``state`` set (a shared folder), another object with that folder goes on from the manifest: a batch
that Spark sends again after a restart changes nothing, and one that it does not send again is there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..graph import PropertyGraph, edge_frame
from ..operators.components import star_components
from ..operators.traversal import bridges
from ..scratch import materialise, scratch_root

#: Batches after which the deltas are written as one.
COMPACT = 32


class OnlineConnectivity:
    """Fed by :meth:`apply` or, on a stream, by ``foreachBatch(online.batch)``. A batch that comes
    again (same id after a restart) changes nothing: edges are keyed, and finished ids are known. Frames
    that were handed out stay readable: files of older states are left to the owner of the folder."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None, key: str = "long", with_bridges: bool = True, state: str | None = None):
        self.spark, self.with_bridges = spark, with_bridges
        self._folder = state or f"{scratch_root(spark)}/graphloom/online-{uuid.uuid4().hex}"
        g = graph if graph is not None else PropertyGraph.empty(spark, key=key)
        kind = dict(g.vertices.dtypes)["key"]
        self._kinds = {"vertices": f"key {kind}, comp {kind}", "edges": f"key {dict(g.edges.dtypes)['key']}, tail {kind}, head {kind}", "renames": f"comp {kind}, into {kind}", "bridges": f"key {dict(g.edges.dtypes)['key']}, tail {kind}, head {kind}"}
        self._log = self._read_manifest()
        if self._log is None:
            self._log = {"deltas": [], "renames": None, "bridges": None, "batches": []}
            if not g.vertices.isEmpty():
                e = g.edges.select("key", "tail", "head")
                found = star_components(e, "tail", "head").withColumnRenamed("v", "key")
                v = g.vertices.select("key").join(found, "key", "left").select("key", F.coalesce("comp", "key").alias("comp"))
                self._commit(v, e, None, self._bridges_of(e), None)

    # -- the log ---------------------------------------------------------------------------

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_manifest(self) -> dict | None:
        path, fs = self._file("manifest")
        found = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        found = [n for n in found if n.endswith(".json")]
        return json.loads(self.spark.read.text(f"{self._folder}/manifest/{found[-1]}", wholetext=True).first()[0]) if found else None

    def _write_manifest(self) -> None:
        """Written under another name and renamed, so a manifest is whole or not there."""
        number = self._log["number"] = self._log.get("number", 0) + 1
        part, fs = self._file(f"manifest/.{number}-{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(self._log).encode()))
        out.close()
        final, _ = self._file(f"manifest/{number:012d}.json")
        if not fs.rename(part, final):
            raise OSError(f"the manifest {final} cannot be written")

    def _write(self, df: DataFrame, what: str) -> str:
        name = f"{what}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self._folder}/{name}")
        return name

    def _table(self, what: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self._kinds[what])
        return self.spark.read.schema(self._kinds[what]).parquet(*(f"{self._folder}/{n}" for n in names))

    def _commit(self, vertices: DataFrame, edges: DataFrame, renames: DataFrame | None, found: DataFrame | None, batch_id: int | None) -> None:
        log = dict(self._log)
        log["deltas"] = [*log["deltas"], {"vertices": self._write(vertices, "vertices"), "edges": self._write(edges, "edges")}]
        if renames is not None:
            log["renames"] = self._write(renames, "renames")
        if found is not None:
            log["bridges"] = self._write(found, "bridges")
        if batch_id is not None:
            log["batches"] = [*log["batches"][-1000:], batch_id]
        self._log = log
        if len(log["deltas"]) > COMPACT:
            comp, e = self._write(self.components(), "vertices"), self._write(self._edges, "edges")
            self._log = log | {"deltas": [{"vertices": comp, "edges": e}], "renames": None}
        self._write_manifest()

    @property
    def _edges(self) -> DataFrame:
        return self._table("edges", [d["edges"] for d in self._log["deltas"]])

    @property
    def _vertices(self) -> DataFrame:
        return self._table("vertices", [d["vertices"] for d in self._log["deltas"]])

    @property
    def _renames(self) -> DataFrame:
        return self._table("renames", [self._log["renames"]] if self._log["renames"] else [])

    @property
    def _bridges(self) -> DataFrame:
        return self._table("bridges", [self._log["bridges"]] if self._log["bridges"] else [])

    def _named(self, vertices: DataFrame) -> DataFrame:
        """``(key, comp)`` of some vertices, with the last names of their components."""
        return vertices.join(self._renames, "comp", "left").select("key", F.coalesce("into", "comp").alias("comp"))

    def _bridges_of(self, edges: DataFrame) -> DataFrame:
        if not self.with_bridges or edges.isEmpty():
            return edges.limit(0)
        return bridges(PropertyGraph.from_edges(edges)).select("key", "tail", "head")

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        if batch_id not in self._log["batches"]:
            self.apply(rows, batch_id)

    def apply(self, rows: DataFrame, batch_id: int | None = None) -> None:
        """Add edges ``(key, tail, head)``; their ends become vertices."""
        new = materialise(edge_frame(rows).select("key", "tail", "head").dropDuplicates(["key"]).join(self._edges, "key", "left_anti"), "batch")
        if new.isEmpty():
            return
        ends = new.select(F.explode(F.array("tail", "head")).alias("key")).distinct()
        known = self._named(self._vertices.join(ends, "key", "left_semi"))
        comp = materialise(ends.join(known, "key", "left").select("key", F.coalesce("comp", "key").alias("comp")), "comp")
        fresh = comp.join(known.select("key"), "key", "left_anti")
        pairs = new.join(comp.toDF("tail", "a"), "tail").join(comp.toDF("head", "b"), "head").select("a", "b")
        merged = materialise(star_components(pairs).toDF("comp", "into").filter("comp <> into"), "merged")
        # Older names that led to a merged one lead to its new name.
        older = self._renames.join(merged.toDF("into", "last"), "into", "left").select("comp", F.coalesce("last", "into").alias("into"))
        renames = materialise(older.unionByName(merged), "renames")
        found = None
        if self.with_bridges:
            last = comp.join(renames, "comp", "left").select(F.coalesce("into", "comp").alias("comp")).distinct()
            every = self._vertices.unionByName(fresh).join(renames, "comp", "left").select("key", F.coalesce("into", "comp").alias("comp"))
            inside = materialise(every.join(last, "comp", "left_semi").select(F.col("key").alias("tail")), "inside")
            again = materialise(self._edges.unionByName(new).join(inside, "tail", "left_semi").select("key", "tail", "head"), "again")
            found = self._bridges.join(inside, "tail", "left_anti").select("key", "tail", "head").unionByName(self._bridges_of(again))
        self._commit(fresh, new, renames, found, batch_id)

    def add_vertex(self, key) -> None:
        row = self.spark.createDataFrame([(key, key)], self._kinds["vertices"]).join(self._vertices, "key", "left_anti")
        self._commit(row, self._edges.limit(0), None, None, None)

    def graph(self) -> PropertyGraph:
        return PropertyGraph.of(self._vertices.select("key"), self._edges, validate=False)

    def components(self) -> DataFrame:
        """``(key, comp)`` with comp the smallest vertex of the component."""
        return self._named(self._vertices)

    def component_count(self) -> int:
        return self.components().select("comp").distinct().count()

    def bridges(self) -> DataFrame:
        return self._bridges

    def bridge_count(self) -> int:
        return self._bridges.count()

    def is_bridge(self, edge_key) -> bool:
        return not self._bridges.filter(F.col("key") == F.lit(edge_key)).isEmpty()


def run_stream(online: OnlineConnectivity, edges: DataFrame, checkpoint: str) -> None:
    """Feed what a streaming DataFrame of edges has by now, then stop."""
    query = edges.writeStream.foreachBatch(online.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
