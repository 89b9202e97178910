"""Hypergraphs: vertices, hyperedges with a sorted array of members, and the exploded incidence."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..errors import AlreadyExistsError, GraphError, NotExistsError
from ..graph import _completed, vertex_frame
from .lookup import LookupMixin, has_labels, same_value
from .mutation import as_value, drop_label, put_label, update


@dataclass(frozen=True)
class HyperGraph:
    vertices: DataFrame
    edges: DataFrame
    name: str = ""

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame, name: str = "", validate: bool = True) -> HyperGraph:
        edges = _completed(edges, ("key", "members"), {"weight": "double", "value": "string", "labels": "map<string,string>"})
        g = cls(vertex_frame(vertices), edges.withColumn("members", F.array_sort(F.array_distinct("members"))), name)
        return g.validated() if validate else g

    @classmethod
    def from_incidence(cls, rows: DataFrame, edge: str, vertex: str, name: str = "") -> HyperGraph:
        """Hyperedges from (edge, vertex) rows."""
        e = rows.groupBy(F.col(edge).alias("key")).agg(F.collect_set(vertex).alias("members"))
        return cls.of(rows.select(F.col(vertex).alias("key")).distinct(), e, name, validate=False)

    def validated(self) -> HyperGraph:
        for table in (self.vertices, self.edges):
            if not table.groupBy("key").count().filter("count > 1").limit(1).isEmpty():
                raise AlreadyExistsError("a key repeats")
        if not self.edges.filter(F.size("members") == 0).limit(1).isEmpty():
            raise GraphError("a hyperedge has no member")
        if not self.incidence().select(F.col("vertex").alias("key")).join(self.vertices, "key", "left_anti").limit(1).isEmpty():
            raise NotExistsError("a hyperedge has a member that is not a vertex")
        return self

    def incidence(self) -> DataFrame:
        """``(edge, vertex)``, one row per membership."""
        return self.edges.select(F.col("key").alias("edge"), F.explode("members").alias("vertex"))

    def renamed(self, name: str) -> HyperGraph:
        return replace(self, name=name)

    def clone(self) -> HyperGraph:
        return self

    def order(self) -> int:
        return self.vertices.count()

    def size(self) -> int:
        return self.edges.count()

    # -- predicates ------------------------------------------------------------------------

    @staticmethod
    def holds(keys: Iterable, exact: bool = False) -> Column:
        """Hyperedges that have all the given members (``exact``: and no other)."""
        keys = sorted(set(keys))
        there = F.size(F.array_except(F.array(*map(F.lit, keys)), F.col("members"))) == 0
        return there & (F.size("members") == len(keys)) if exact else there

    def vertex(self, key) -> Row:
        return LookupMixin._one(self.vertices.filter(same_value("key", key)), f"vertex {key!r}")

    def edge(self, key) -> Row:
        return LookupMixin._one(self.edges.filter(same_value("key", key)), f"hyperedge {key!r}")

    def edges_with(self, keys: Iterable, exact: bool = False) -> DataFrame:
        return self.edges.filter(self.holds(keys, exact))

    def vertices_by_label(self, labels: dict[str, str]) -> DataFrame:
        return self.vertices.filter(has_labels(labels))

    def edges_by_label(self, labels: dict[str, str]) -> DataFrame:
        return self.edges.filter(has_labels(labels))

    def random_vertex(self, seed: int | None = None) -> Row:
        return LookupMixin._one(self.vertices.orderBy(F.rand(seed)), "a vertex")

    def random_edge(self, seed: int | None = None) -> Row:
        return LookupMixin._one(self.edges.orderBy(F.rand(seed)), "a hyperedge")

    # -- neighbourhoods --------------------------------------------------------------------

    def degrees(self) -> DataFrame:
        n = self.incidence().groupBy(F.col("vertex").alias("key")).agg(F.count("*").alias("degree"))
        return self.vertices.select("key").join(n, "key", "left").select("key", F.coalesce("degree", F.lit(0)).alias("degree"))

    def degree(self, key) -> int:
        self.vertex(key)
        return self.incident_edges(key).count()

    def incident_edges(self, key) -> DataFrame:
        return self.edges.filter(F.array_contains("members", key))

    def neighbours(self, key) -> DataFrame:
        """Vertices that share a hyperedge with one, without itself."""
        self.vertex(key)
        keys = self.incident_edges(key).select(F.explode("members").alias("key")).distinct().filter(~same_value("key", key))
        return self.vertices.join(keys, "key", "left_semi")

    def adjacency(self) -> DataFrame:
        """``(v, neighbour)`` for all vertices: pairs within each hyperedge."""
        pairs = self.edges.select(F.explode("members").alias("v"), "members").select("v", F.explode("members").alias("neighbour"))
        return pairs.filter("v <> neighbour").distinct()

    def neighbour_edges_by_key(self, key) -> DataFrame:
        """Other hyperedges that share a member with one."""
        members = self.edge(key).members
        return self.edges.filter(F.arrays_overlap("members", F.array(*map(F.lit, members))) & ~same_value("key", key))

    def neighbour_edges(self, keys: Iterable) -> DataFrame:
        """Hyperedges that touch any of the given vertices."""
        return self.edges.filter(F.arrays_overlap("members", F.array(*map(F.lit, keys))))

    # -- edits -----------------------------------------------------------------------------

    def add_vertex(self, key, value=None, weight: float = 0.0, labels: dict[str, str] | None = None) -> HyperGraph:
        row = self.vertices.sparkSession.createDataFrame([(key, value, float(weight), labels)], f"key {dict(self.vertices.dtypes)['key']}, value string, weight double, labels map<string,string>")
        if not self.vertices.join(row, "key", "left_semi").isEmpty():
            raise AlreadyExistsError(f"vertex {key!r}")
        return replace(self, vertices=self.vertices.unionByName(row, allowMissingColumns=True))

    def add_edge(self, key, members: Iterable, weight: float = 0.0, value=None, labels: dict[str, str] | None = None) -> HyperGraph:
        kinds = dict(self.edges.dtypes)
        row = self.edges.sparkSession.createDataFrame([(key, sorted(set(members)), float(weight), value, labels)], f"key {kinds['key']}, members {kinds['members']}, weight double, value string, labels map<string,string>")
        return replace(self, edges=self.edges.unionByName(row, allowMissingColumns=True)).validated()

    def remove_vertex(self, key) -> HyperGraph:
        """The vertex and every hyperedge that has it go."""
        self.vertex(key)
        return replace(self, vertices=self.vertices.filter(~same_value("key", key)), edges=self.edges.filter(~F.array_contains("members", key)))

    def remove_edge_by_key(self, key) -> HyperGraph:
        self.edge(key)
        return replace(self, edges=self.edges.filter(~same_value("key", key)))

    def remove_edges(self, keys: Iterable, exact: bool = False) -> HyperGraph:
        return replace(self, edges=self.edges.filter(~self.holds(keys, exact)))

    def remove_all_edges(self) -> HyperGraph:
        return replace(self, edges=self.edges.limit(0))

    def _vertex(self, key, column: str, value: Column) -> HyperGraph:
        self.vertex(key)
        return replace(self, vertices=update(self.vertices, same_value("key", key), column, value))

    def _edge(self, where: Column, column: str, value: Column) -> HyperGraph:
        if self.edges.filter(where).limit(1).isEmpty():
            raise NotExistsError("no such hyperedge")
        return replace(self, edges=update(self.edges, where, column, value))

    def set_vertex_value(self, key, value) -> HyperGraph:
        return self._vertex(key, "value", as_value(value))

    def set_vertex_label(self, key, name: str, value: str) -> HyperGraph:
        return self._vertex(key, "labels", put_label(name, value))

    def delete_vertex_label(self, key, name: str) -> HyperGraph:
        return self._vertex(key, "labels", drop_label(name))

    def set_vertex_weight(self, key, weight: float) -> HyperGraph:
        return self._vertex(key, "weight", F.lit(float(weight)))

    def set_edge_weight(self, key, weight: float) -> HyperGraph:
        return self._edge(same_value("key", key), "weight", F.lit(float(weight)))

    def set_edge_value_by_key(self, key, value) -> HyperGraph:
        return self._edge(same_value("key", key), "value", as_value(value))

    def set_edge_label_by_key(self, key, name: str, value: str) -> HyperGraph:
        return self._edge(same_value("key", key), "labels", put_label(name, value))

    def delete_edge_label_by_key(self, key, name: str) -> HyperGraph:
        return self._edge(same_value("key", key), "labels", drop_label(name))

    def set_edge_value(self, keys: Iterable, value, exact: bool = False) -> HyperGraph:
        return self._edge(self.holds(keys, exact), "value", as_value(value))

    def set_edge_label(self, keys: Iterable, name: str, value: str, exact: bool = False) -> HyperGraph:
        return self._edge(self.holds(keys, exact), "labels", put_label(name, value))

    def delete_edge_label(self, keys: Iterable, name: str, exact: bool = False) -> HyperGraph:
        return self._edge(self.holds(keys, exact), "labels", drop_label(name))
