"""Edits of the vertex and edge tables; each gives a new graph. Bulk forms take DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import AlreadyExistsError, NotExistsError
from .lookup import same_value


def put_label(name: str, value: str, column: str = "labels") -> Column:
    return F.map_concat(drop_label(name, column), F.create_map(F.lit(name), F.lit(value)))


def drop_label(name: str, column: str = "labels") -> Column:
    return F.map_filter(F.coalesce(F.col(column), F.expr("map()").cast("map<string,string>")), lambda k, _: k != name)


def as_value(value) -> Column:
    """Untyped values are kept as JSON; strings as they are."""
    return F.lit(value if value is None or isinstance(value, str) else json.dumps(value)).cast("string")


def update(df: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))


class MutationMixin:
    # -- adding ----------------------------------------------------------------------------

    def _fresh(self, table: DataFrame, rows: DataFrame, what: str) -> None:
        if rows.groupBy("key").count().filter("count > 1").limit(1).count() or rows.join(table, "key", "left_semi").limit(1).count():
            raise AlreadyExistsError(f"{what} key")

    def add_vertices(self, rows: DataFrame):
        from ..graph import vertex_frame

        rows = vertex_frame(rows)
        self._fresh(self.vertices, rows, "vertex")
        return self.with_(vertices=self.vertices.unionByName(rows, allowMissingColumns=True))

    def add_vertex(self, key, value=None, weight: float = 0.0, labels: dict[str, str] | None = None):
        row = self.spark.createDataFrame([(key, json.dumps(value) if value is not None and not isinstance(value, str) else value, float(weight), labels)], f"key {dict(self.vertices.dtypes)['key']}, value string, weight double, labels map<string,string>")
        return self.add_vertices(row)

    def add_edges(self, rows: DataFrame):
        from ..graph import edge_frame

        rows = edge_frame(rows)
        self._fresh(self.edges, rows, "edge")
        if rows.select(F.explode(F.array("tail", "head")).alias("key")).join(self.vertices, "key", "left_anti").limit(1).count():
            raise NotExistsError("an endpoint")
        return self.with_(edges=self.edges.unionByName(rows, allowMissingColumns=True))

    def add_edge(self, key, tail, head, weight: float = 0.0, value=None, labels: dict[str, str] | None = None):
        kinds = dict(self.edges.dtypes)
        row = self.spark.createDataFrame([(key, tail, head, float(weight), value, labels)], f"key {kinds['key']}, tail {kinds['tail']}, head {kinds['head']}, weight double, value string, labels map<string,string>")
        return self.add_edges(row)

    # -- removing --------------------------------------------------------------------------

    def without_vertices(self, keys: DataFrame):
        """Drop the vertices in ``keys`` (one column) and their edges."""
        keys = keys.toDF("key").distinct()
        v = self.vertices.join(keys, "key", "left_anti")
        e = self.edges.join(keys.toDF("tail"), "tail", "left_anti").join(keys.toDF("head"), "head", "left_anti")
        return self.with_(vertices=v, edges=e.select(*self.edges.columns))

    def remove_vertex(self, key):
        self.vertex(key)
        return self.with_(vertices=self.vertices.filter(~same_value("key", key)), edges=self.edges.filter(~same_value("tail", key) & ~same_value("head", key)))

    def remove_edge_by_key(self, key):
        self.edge(key)
        return self.with_(edges=self.edges.filter(~same_value("key", key)))

    def remove_edges(self, a, b):
        """All edges between two vertices, in both directions."""
        both = (same_value("tail", a) & same_value("head", b)) | (same_value("tail", b) & same_value("head", a))
        return self.with_(edges=self.edges.filter(~both))

    def remove_all_edges(self):
        return self.with_(edges=self.edges.limit(0))

    # -- updating --------------------------------------------------------------------------

    def _vertex_update(self, key, column: str, value: Column):
        self.vertex(key)
        return self.with_(vertices=update(self.vertices, same_value("key", key), column, value))

    def _edge_update(self, where: Column, column: str, value: Column):
        return self.with_(edges=update(self.edges, where, column, value))

    def set_vertex_value(self, key, value):
        return self._vertex_update(key, "value", as_value(value))

    def set_vertex_label(self, key, name: str, value: str):
        return self._vertex_update(key, "labels", put_label(name, value))

    def delete_vertex_label(self, key, name: str):
        return self._vertex_update(key, "labels", drop_label(name))

    def set_vertex_weight(self, key, weight: float):
        return self._vertex_update(key, "weight", F.lit(weight).cast(dict(self.vertices.dtypes)["weight"]))

    def _edge_key(self, key) -> Column:
        self.edge(key)
        return same_value("key", key)

    def _edge_pair(self, tail, head) -> Column:
        if not self.edges_between(tail, head).limit(1).count():
            raise NotExistsError(f"an edge from {tail!r} to {head!r}")
        return self.between(tail, head)

    def set_edge_weight(self, key, weight: float):
        return self._edge_update(self._edge_key(key), "weight", F.lit(weight).cast(dict(self.edges.dtypes)["weight"]))

    def set_edge_value_by_key(self, key, value):
        return self._edge_update(self._edge_key(key), "value", as_value(value))

    def set_edge_label_by_key(self, key, name: str, value: str):
        return self._edge_update(self._edge_key(key), "labels", put_label(name, value))

    def delete_edge_label_by_key(self, key, name: str):
        return self._edge_update(self._edge_key(key), "labels", drop_label(name))

    def set_edge_value(self, tail, head, value):
        return self._edge_update(self._edge_pair(tail, head), "value", as_value(value))

    def set_edge_label(self, tail, head, name: str, value: str):
        return self._edge_update(self._edge_pair(tail, head), "labels", put_label(name, value))

    def delete_edge_label(self, tail, head, name: str):
        return self._edge_update(self._edge_pair(tail, head), "labels", drop_label(name))

    def patch_vertices(self, patch: DataFrame, column: str):
        """Bulk update: ``patch`` has ``key`` and ``column``."""
        p = patch.select("key", F.col(column).alias("__new"), F.lit(True).alias("__hit"))
        out = self.vertices.join(p, "key", "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column)))
        return self.with_(vertices=out.select(*self.vertices.columns))

    def reversed(self):
        """Every arc turned round; an undirected graph stays as it is."""
        if not self.directed:
            return self
        turned = self.edges.withColumns({"tail": F.col("head"), "head": F.col("tail")})
        return self.with_(edges=turned)
