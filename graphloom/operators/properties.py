"""Degrees, property flags and matrices: partial and final aggregations of the edge table.

All one-pass properties come from a single job (``profile``); those that need components or
peeling run the loops of the traversal module.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Row, functions as F

from ..functions.ranking import with_rank

PROPERTIES = (
    "order", "size", "min_degree", "max_degree", "average_degree", "multiplicity", "simple", "regular", "loop", "negative_weight",
    "complete", "orientation", "acyclic", "connected", "unilateral", "forest", "tree", "name", "directed",
)


class PropertyMixin:
    # -- degrees ---------------------------------------------------------------------------

    def _with_zeros(self, counts: DataFrame, name: str) -> DataFrame:
        return self.vertices.select("key").join(counts, "key", "left").select("key", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def degrees(self) -> DataFrame:
        """``(key, degree)``; a loop counts twice."""
        ends = self.edges.select(F.explode(F.array("tail", "head")).alias("key"))
        return self._with_zeros(ends.groupBy("key").agg(F.count("*").alias("degree")), "degree")

    def in_degrees(self) -> DataFrame:
        return self._with_zeros(self.edges.groupBy(F.col("head").alias("key")).agg(F.count("*").alias("in_degree")), "in_degree")

    def out_degrees(self) -> DataFrame:
        return self._with_zeros(self.edges.groupBy(F.col("tail").alias("key")).agg(F.count("*").alias("out_degree")), "out_degree")

    def degree(self, key) -> int:
        self.vertex(key)
        return self.edges.select(F.sum((F.col("tail") == F.lit(key)).cast("long") + (F.col("head") == F.lit(key)).cast("long"))).first()[0] or 0

    def in_degree(self, key) -> int:
        self.vertex(key)
        return self.in_edges(key).count()

    def out_degree(self, key) -> int:
        self.vertex(key)
        return self.out_edges(key).count()

    # -- properties ------------------------------------------------------------------------

    def profile(self) -> DataFrame:
        """One row with all properties that need no loop."""
        d = self.degrees().agg(F.count("*").alias("order"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
        pairs = self.edges.groupBy(F.least("tail", "head").alias("a"), F.greatest("tail", "head").alias("b")).agg(
            F.count("*").alias("n"), F.min("weight").alias("least"))
        e = pairs.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("size"), F.coalesce(F.max("n"), F.lit(0)).alias("multiplicity"),
            F.coalesce(F.bool_or(F.col("a") == F.col("b")), F.lit(False)).alias("loop"), F.coalesce(F.bool_or(F.col("least") < 0), F.lit(False)).alias("negative_weight"))
        # Two one-row tables.
        out = d.join(F.broadcast(e))
        simple = ~F.col("loop") & (F.col("multiplicity") <= 1)
        return out.select(
            "order", "size", F.coalesce("min_degree", F.lit(0)).alias("min_degree"), F.coalesce("max_degree", F.lit(0)).alias("max_degree"),
            F.when(F.col("order") == 0, 0.0).otherwise(2.0 * F.col("size") / F.col("order")).alias("average_degree"), "multiplicity",
            simple.alias("simple"), (F.coalesce("min_degree", F.lit(0)) == F.coalesce("max_degree", F.lit(0))).alias("regular"), "loop", "negative_weight",
            (simple & (F.coalesce("min_degree", F.lit(0)) == F.greatest(F.col("order") - 1, F.lit(0)))).alias("complete"),
            (simple & F.lit(self.directed)).alias("orientation"),
        )

    @cached_property
    def _profile(self) -> Row:
        return self.profile().first()

    @cached_property
    def _component_count(self) -> int:
        from .traversal import components

        return components(self).select("comp").distinct().count()

    def property(self, name: str):
        """The value of one of PROPERTIES."""
        if name in self._profile.asDict():
            return self._profile[name]
        if name in ("name", "directed"):
            return getattr(self, name)
        if name not in PROPERTIES:
            raise KeyError(name)
        return getattr(self, f"is_{name}")()

    def min_degree(self) -> int:
        return self._profile.min_degree

    def max_degree(self) -> int:
        return self._profile.max_degree

    def average_degree(self) -> float:
        return self._profile.average_degree

    def multiplicity(self) -> int:
        return self._profile.multiplicity

    def is_simple(self) -> bool:
        return self._profile.simple

    def is_regular(self) -> bool:
        return self._profile.regular

    def has_loop(self) -> bool:
        return self._profile.loop

    def has_negative_weight(self) -> bool:
        return self._profile.negative_weight

    def is_complete(self) -> bool:
        return self._profile.complete

    def is_orientation(self) -> bool:
        return self._profile.orientation

    def is_acyclic(self) -> bool:
        """No directed cycle; undirected: no cycle, loop or parallel edges."""
        if not self.directed:
            return self.is_forest()
        from .traversal import cyclic_core

        return not cyclic_core(self).vertices.limit(1).count()

    def is_forest(self) -> bool:
        """The underlying graph has no cycle: edges = vertices - components."""
        return self._profile.size == self._profile.order - self._component_count

    def is_connected(self) -> bool:
        return self._component_count <= 1

    def is_tree(self) -> bool:
        return self._component_count == 1 and self.is_forest()

    def is_unilateral(self) -> bool:
        """Of any two vertices one reaches the other: the condensation has one vertex per layer."""
        if not self.directed:
            return self.is_connected()
        from .traversal import condensation, topological_layers

        layers = topological_layers(condensation(self)).groupBy("layer").count()
        return not layers.filter("count > 1").limit(1).count()

    # -- matrices --------------------------------------------------------------------------

    def matrix_index(self) -> DataFrame:
        """``(i, key)``: rows and columns of the matrices, by key."""
        return with_rank(self.vertices.select("key"), "key").select("key", (F.col("rank") - 1).alias("i"))

    def adjacency_matrix(self) -> DataFrame:
        """``(i, j, x)`` with x = 1, row = tail; symmetric where undirected."""
        return self.arcs().select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).alias("x")).distinct()

    def degree_matrix(self) -> DataFrame:
        return self.degrees().select(F.col("key").alias("i"), F.col("key").alias("j"), F.col("degree").alias("x"))

    def weight_matrix(self) -> DataFrame:
        """``(i, j, x)``: the lightest edge of each pair, zeros on the diagonal."""
        arcs = self.arcs().filter("src <> dst").groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.min("weight").alias("x"))
        return arcs.unionByName(self.vertices.select(F.col("key").alias("i"), F.col("key").alias("j"), F.lit(0.0).alias("x")))

    def dense(self, matrix: DataFrame, absent=None) -> DataFrame:
        """``(i, row)``: dense rows in key order, on request only (n x n cells)."""
        grid = self.vertices.select(F.col("key").alias("i")).crossJoin(self.vertices.select(F.col("key").alias("j")))
        cells = grid.join(matrix, ["i", "j"], "left").withColumn("x", F.coalesce("x", F.lit(absent)))
        return cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda c: c["x"]).alias("row"))
