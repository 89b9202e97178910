"""Bipartite graphs: a graph whose vertices say which part they are in (``part_a``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..errors import GraphError
from ..graph import PropertyGraph, vertex_frame
from . import matching


@dataclass(frozen=True)
class Bipartite(PropertyGraph):
    @classmethod
    def of_parts(cls, vertices: DataFrame, edges: DataFrame, directed: bool = False, name: str = "") -> Bipartite:
        return cls.of(vertices, edges, directed, name).checked()

    def checked(self) -> Bipartite:
        """Every edge must join the two parts."""
        part = self.vertices.select("key", "part_a")
        e = self.edges.select("tail", "head").join(part.toDF("tail", "t"), "tail").join(part.toDF("head", "h"), "head")
        if not e.filter("t = h").limit(1).isEmpty():
            raise GraphError("an edge joins two vertices of one part")
        return self

    def add_vertex_to(self, key, part_a: bool, **attributes) -> Bipartite:
        row = vertex_frame(self.spark.createDataFrame([(key, part_a)], f"key {dict(self.vertices.dtypes)['key']}, part_a boolean"))
        return self.add_vertices(row)

    def add_edges(self, rows: DataFrame) -> Bipartite:
        return super().add_edges(rows).checked()

    def part(self, part_a: bool) -> DataFrame:
        return self.vertices.filter(F.col("part_a") == F.lit(part_a))

    def part_order(self, part_a: bool) -> int:
        return self.part(part_a).count()

    def in_part_a(self, key) -> bool:
        return not self.part(True).filter(F.col("key") == F.lit(key)).isEmpty()

    def without_part(self, part_a: bool) -> Bipartite:
        return self.without_vertices(self.part(part_a).select("key"))

    def maximum_matching(self) -> DataFrame:
        return matching.bipartite_matching(self)

    def perfect_matching(self) -> DataFrame:
        return matching.bipartite_perfect_matching(self)

    def weighted_matching(self, maximum: bool) -> DataFrame:
        return matching.weighted_matching(self, maximum)

    def minimum_vertex_cover(self) -> DataFrame:
        return matching.minimum_vertex_cover(self)
