"""Neighbourhoods and cuts as joins. Bulk forms (``adjacency``, ``edge_adjacency``) give all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lookup import same_value


class NeighbourMixin:
    def adjacency(self) -> DataFrame:
        """``(v, neighbour)``: distinct adjacent pairs, in and out; a loop makes v its own."""
        return self.both_ways().select(F.col("src").alias("v"), F.col("dst").alias("neighbour")).distinct()

    def _vertices_of(self, keys: DataFrame) -> DataFrame:
        return self.vertices.join(keys.toDF("key").distinct(), "key", "left_semi")

    def neighbours(self, key) -> DataFrame:
        self.vertex(key)
        return self._vertices_of(self.both_ways().filter(same_value("src", key)).select("dst"))

    def in_neighbours(self, key) -> DataFrame:
        self.vertex(key)
        return self._vertices_of(self.edges.filter(same_value("head", key)).select("tail"))

    def out_neighbours(self, key) -> DataFrame:
        self.vertex(key)
        return self._vertices_of(self.edges.filter(same_value("tail", key)).select("head"))

    def incident_edges(self, key) -> DataFrame:
        self.vertex(key)
        return self.edges.filter(same_value("tail", key) | same_value("head", key))

    def in_edges(self, key) -> DataFrame:
        return self.edges.filter(same_value("head", key))

    def out_edges(self, key) -> DataFrame:
        return self.edges.filter(same_value("tail", key))

    def edge_adjacency(self) -> DataFrame:
        """``(key, other)``: distinct edges that share an endpoint."""
        ends = self.edges.select("key", F.explode(F.array_distinct(F.array("tail", "head"))).alias("v"))
        return ends.join(ends.select(F.col("key").alias("other"), "v"), "v").filter("key <> other").select("key", "other").distinct()

    def neighbour_edges_by_key(self, key) -> DataFrame:
        """The other edges that touch an endpoint of an edge."""
        e = self.edge(key)
        touches = F.col("tail").isin(e.tail, e.head) | F.col("head").isin(e.tail, e.head)
        return self.edges.filter(touches & ~same_value("key", key))

    def neighbour_edges(self, tail, head) -> DataFrame:
        """The same for the edge with the smallest key between two vertices."""
        row = self._one(self.edges_between(tail, head).orderBy("key"), f"an edge from {tail!r} to {head!r}")
        return self.neighbour_edges_by_key(row.key)

    def sources(self) -> DataFrame:
        return self.vertices.join(self.edges.select(F.col("head").alias("key")), "key", "left_anti")

    def sinks(self) -> DataFrame:
        return self.vertices.join(self.edges.select(F.col("tail").alias("key")), "key", "left_anti")

    # -- cuts: ``x`` and ``y`` are one-column DataFrames of vertex keys --------------------------

    def _flagged(self, **sets: DataFrame) -> DataFrame:
        """Edges with a boolean column per set and end, ``x_tail`` ..."""
        e = self.edges
        for name, keys in sets.items():
            for end in ("tail", "head"):
                flag = keys.toDF(end).distinct().withColumn(f"{name}_{end}", F.lit(True))
                e = e.join(flag, end, "left").withColumn(f"{name}_{end}", F.coalesce(f"{name}_{end}", F.lit(False)))
        return e

    def arc_cut(self, x: DataFrame, incoming: bool = False) -> DataFrame:
        """Arcs that leave (or enter) a set of vertices."""
        inside, outside = ("x_head", "x_tail") if incoming else ("x_tail", "x_head")
        return self._flagged(x=x).filter(F.col(inside) & ~F.col(outside)).select(*self.edges.columns)

    def arcs_from_to(self, x: DataFrame, y: DataFrame) -> DataFrame:
        return self._flagged(x=x, y=y).filter("x_tail and y_head").select(*self.edges.columns)

    def coboundary(self, x: DataFrame) -> DataFrame:
        """Edges between a set and the rest."""
        return self._flagged(x=x).filter("x_tail <> x_head").select(*self.edges.columns)

    def edges_across(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """Edges with one end in x and one in y."""
        return self._flagged(x=x, y=y).filter("(x_tail and y_head) or (y_tail and x_head)").select(*self.edges.columns)
