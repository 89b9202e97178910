"""Metadata, filters, projections and point lookups: plain filters, pushed down to the scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..errors import NotExistsError


def same_value(column: str, key) -> Column:
    return F.col(column) == F.lit(key)


def has_labels(labels: dict[str, str], column: str = "labels") -> Column:
    """All items match; rows without labels never do."""
    return reduce(lambda a, b: a & b, (F.col(column)[k] == v for k, v in labels.items()), F.col(column).isNotNull())


class LookupMixin:
    """Lookups of a graph with ``vertices``, ``edges`` and ``directed``."""

    def order(self) -> int:
        return self.vertices.count()

    def size(self) -> int:
        return self.edges.count()

    def vertex(self, key) -> Row:
        return self._one(self.vertices.filter(same_value("key", key)), f"vertex {key!r}")

    def edge(self, key) -> Row:
        return self._one(self.edges.filter(same_value("key", key)), f"edge {key!r}")

    @staticmethod
    def _one(df: DataFrame, what: str) -> Row:
        rows = df.limit(1).collect()
        if not rows:
            raise NotExistsError(what)
        return rows[0]

    def between(self, tail, head) -> Column:
        """Is an edge one from tail to head (either way where undirected)?"""
        there = same_value("tail", tail) & same_value("head", head)
        return there if self.directed else there | (same_value("tail", head) & same_value("head", tail))

    def edges_between(self, tail, head) -> DataFrame:
        return self.edges.filter(self.between(tail, head))

    def vertices_by_label(self, labels: dict[str, str]) -> DataFrame:
        return self.vertices.filter(has_labels(labels))

    def edges_by_label(self, labels: dict[str, str]) -> DataFrame:
        return self.edges.filter(has_labels(labels))

    def random_vertex(self, seed: int | None = None) -> Row:
        return self._one(self.vertices.orderBy(F.rand(seed)), "a vertex")

    def random_edge(self, seed: int | None = None) -> Row:
        return self._one(self.edges.orderBy(F.rand(seed)), "an edge")
