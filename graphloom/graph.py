"""Property graphs as pairs of DataFrames.

``vertices``: key, value, weight, labels. ``edges``: key, tail, head, weight, value, labels; an
edge goes from tail to head, and an undirected graph ignores the order. Graphs are immutable: what
a mutable library does in place gives a new graph here, as one more node of the lazy plan.

Bulk results are unordered DataFrames; where an operator picks one of several answers, the
smallest key wins.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import AlreadyExistsError, NotExistsError
from .operators.algebra import AlgebraMixin
from .operators.lookup import LookupMixin
from .operators.mutation import MutationMixin
from .operators.neighbours import NeighbourMixin
from .operators.properties import PropertyMixin

VERTEX_COLUMNS = {"value": "string", "weight": "double", "labels": "map<string,string>"}
EDGE_COLUMNS = {"weight": "double", "value": "string", "labels": "map<string,string>"}


def vertex_frame(df: DataFrame) -> DataFrame:
    """``df`` with the columns of a vertex table; those it lacks are null (weight 0)."""
    return _completed(df, ("key",), VERTEX_COLUMNS)


def edge_frame(df: DataFrame) -> DataFrame:
    """``df`` with the columns of an edge table. Without a key, edges get a hash of their content."""
    if "key" not in df.columns:
        df = df.withColumn("key", F.xxhash64(*df.columns))
    return _completed(df, ("key", "tail", "head"), EDGE_COLUMNS)


def _completed(df: DataFrame, fixed: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    rest = [F.col(c) if c in df.columns else (F.lit(0.0) if c == "weight" else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
    extra = [c for c in df.columns if c not in fixed and c not in columns]
    return df.select(*fixed, *rest, *extra)


@dataclass(frozen=True)
class PropertyGraph(LookupMixin, MutationMixin, NeighbourMixin, PropertyMixin, AlgebraMixin):
    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    name: str = ""

    @classmethod
    def empty(cls, spark: SparkSession, directed: bool = False, name: str = "", key: str = "long") -> PropertyGraph:
        v = spark.createDataFrame([], f"key {key}")
        e = spark.createDataFrame([], f"key {key}, tail {key}, head {key}")
        return cls(vertex_frame(v), edge_frame(e), directed, name)

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame, directed: bool = False, name: str = "", validate: bool = True) -> PropertyGraph:
        """A graph of two tables; by default repeated keys and missing endpoints are errors."""
        g = cls(vertex_frame(vertices), edge_frame(edges), directed, name)
        return g.validated() if validate else g

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = False, name: str = "") -> PropertyGraph:
        """A graph whose vertices are the endpoints of its edges."""
        edges = edge_frame(edges)
        return cls(vertex_frame(edges.select(F.explode(F.array("tail", "head")).alias("key")).distinct()), edges, directed, name)

    @classmethod
    def of_lists(cls, spark: SparkSession, vertices: Iterable, edges: Iterable[tuple], directed: bool = False, name: str = "") -> PropertyGraph:
        """Small literal graphs: edges are (tail, head) or (tail, head, weight), keyed by position."""
        vertices, edges = list(vertices), list(edges)
        kind = "string" if vertices and isinstance(vertices[0], str) else "long"
        v = spark.createDataFrame([(x,) for x in vertices], f"key {kind}")
        e = spark.createDataFrame([(i, t[0], t[1], float(t[2]) if len(t) > 2 else 0.0) for i, t in enumerate(edges)], f"key long, tail {kind}, head {kind}, weight double")
        return cls.of(v, e, directed, name)

    def validated(self) -> PropertyGraph:
        if self.vertices.groupBy("key").count().filter("count > 1").limit(1).count():
            raise AlreadyExistsError("a vertex key repeats")
        if self.edges.groupBy("key").count().filter("count > 1").limit(1).count():
            raise AlreadyExistsError("an edge key repeats")
        ends = self.edges.select(F.explode(F.array("tail", "head")).alias("key"))
        if ends.join(self.vertices, "key", "left_anti").limit(1).count():
            raise NotExistsError("an edge has an endpoint that is not a vertex")
        return self

    def with_(self, **changes) -> PropertyGraph:
        return replace(self, **changes)

    def renamed(self, name: str) -> PropertyGraph:
        return replace(self, name=name)

    def clone(self) -> PropertyGraph:
        """Graphs are immutable, so a copy is the graph itself."""
        return self

    def slim(self) -> PropertyGraph:
        """Keys and ends only, for algorithms on the bare graph."""
        return replace(self, vertices=self.vertices.select("key"), edges=self.edges.select("key", "tail", "head", "weight"))

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def undirected(self) -> PropertyGraph:
        return replace(self, directed=False)

    def arcs(self) -> DataFrame:
        """``(key, src, dst, weight)``: tail to head, and both ways where undirected (a loop once)."""
        out = self.edges.select("key", F.col("tail").alias("src"), F.col("head").alias("dst"), "weight")
        if self.directed:
            return out
        return out.unionByName(self.edges.filter("tail <> head").select("key", F.col("head").alias("src"), F.col("tail").alias("dst"), "weight"))

    def both_ways(self) -> DataFrame:
        """Arcs in both directions, whatever the graph is."""
        return self.undirected().arcs()
