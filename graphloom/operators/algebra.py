"""Set operations, subgraphs, products, contractions and line graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import AlreadyExistsError


def _merged(first: DataFrame, second: DataFrame) -> DataFrame:
    return second.unionByName(first.join(second, "key", "left_anti"), allowMissingColumns=True)


class AlgebraMixin:
    def union(self, other):
        """Both graphs' keys; attributes of ``other`` win."""
        return self.with_(vertices=_merged(self.vertices, other.vertices), edges=_merged(self.edges, other.edges))

    def intersection(self, other):
        """Keys in both; attributes of ``other``. Edges whose ends are gone go too."""
        v = other.vertices.join(self.vertices.select("key"), "key", "left_semi")
        return other.with_(vertices=v, edges=other.edges.join(self.edges.select("key"), "key", "left_semi"), name=self.name).induced(v.select("key"))

    def difference(self, other):
        """Vertices of the first graph only, with the edges of the first only between them."""
        g = self.with_(edges=self.edges.join(other.edges.select("key"), "key", "left_anti"))
        return g.without_vertices(other.vertices.select("key"))

    def edge_sum(self, other):
        """Symmetric difference of the edges over the union of the vertices."""
        both = self.union(other)
        common = self.edges.select("key").join(other.edges.select("key"), "key", "left_semi")
        return both.with_(edges=both.edges.join(common, "key", "left_anti"))

    def contains(self, other) -> bool:
        """Has every vertex key and every pair of ends of ``other``."""
        if other.vertices.join(self.vertices, "key", "left_anti").limit(1).count():
            return False
        own, theirs = (g.arcs().select("src", "dst").distinct() for g in (self, other))
        return not theirs.join(own, ["src", "dst"], "left_anti").limit(1).count()

    def induced(self, keys: DataFrame):
        """The subgraph of the vertices in ``keys`` (one column)."""
        keys = keys.toDF("key").distinct()
        e = self.edges.join(keys.toDF("tail"), "tail", "left_semi").join(keys.toDF("head"), "head", "left_semi")
        return self.with_(vertices=self.vertices.join(keys, "key", "left_semi"), edges=e.select(*self.edges.columns))

    def spanning_without(self, pairs: DataFrame):
        """All vertices, without the edges between the listed (tail, head) pairs."""
        pairs = pairs.toDF("tail", "head").distinct()
        if not self.directed:
            pairs = pairs.union(pairs.select("head", "tail")).distinct()
        return self.with_(edges=self.edges.join(pairs, ["tail", "head"], "left_anti").select(*self.edges.columns))

    def spanning_with(self, rows: DataFrame):
        return self.add_edges(rows)

    def product(self, other):
        """Cartesian product: vertices "(a,b)" with their coordinates as labels, and an edge for
        each edge of one graph and vertex of the other, keyed by both."""
        from ..graph import PropertyGraph

        a, b = self.vertices.select(F.col("key").alias("a")), other.vertices.select(F.col("key").alias("b"))
        pair = lambda x, y: F.format_string("(%s,%s)", F.col(x).cast("string"), F.col(y).cast("string"))
        # The result itself has one row per pair: this is the operator's meaning, not a join strategy.
        v = a.crossJoin(b).select(pair("a", "b").alias("key"), F.create_map(F.lit("first"), F.col("a").cast("string"), F.lit("second"), F.col("b").cast("string")).alias("labels"))
        e1 = self.edges.select(F.col("key").alias("e"), "tail", "head").crossJoin(b)
        e1 = e1.select(F.concat(F.lit("1:"), pair("e", "b")).alias("key"), pair("tail", "b").alias("tail"), pair("head", "b").alias("head"))
        e2 = other.edges.select(F.col("key").alias("e"), "tail", "head").crossJoin(a)
        e2 = e2.select(F.concat(F.lit("2:"), pair("a", "e")).alias("key"), pair("a", "tail").alias("tail"), pair("a", "head").alias("head"))
        return PropertyGraph.of(v, e1.unionByName(e2), self.directed, f"{self.name} x {other.name}", validate=False)

    def contract(self, a, b, into, **attributes):
        """Merge two vertices; edges between them go, others keep their keys."""
        self.vertex(a), self.vertex(b)
        moved = lambda c: F.when(F.col(c).isin(a, b), F.lit(into)).otherwise(F.col(c)).alias(c)
        kept = self.edges.filter(~(F.col("tail").isin(a, b) & F.col("head").isin(a, b)))
        e = kept.withColumns({"tail": moved("tail"), "head": moved("head")})
        v = self.with_(vertices=self.vertices.filter(~F.col("key").isin(a, b)), edges=e)
        return v.add_vertex(into, **attributes)

    identify = contract

    def split(self, key, edge_key, tail, head):
        """Replace a vertex by an edge whose two ends inherit all its edges; copies get string keys."""
        self.vertex(key)
        touch = (F.col("tail") == F.lit(key)) | (F.col("head") == F.lit(key))
        base = self.edges.withColumn("key", F.col("key").cast("string"))
        copies = base.filter(touch).withColumn("__end", F.explode(F.array(F.lit(tail), F.lit(head))))
        swap = lambda c: F.when(F.col(c) == F.lit(key), F.col("__end")).otherwise(F.col(c))
        copies = copies.withColumns({"key": F.concat_ws(":", "key", F.col("__end").cast("string")), "tail": swap("tail"), "head": swap("head")}).drop("__end")
        g = self.with_(vertices=self.vertices.filter(F.col("key") != F.lit(key)), edges=base.filter(~touch).unionByName(copies))
        return g.add_vertex(tail).add_vertex(head).add_edge(str(edge_key), tail, head)

    def subdivide(self, edge_key, vertex, first_key, second_key):
        """Replace an edge by a path of two through a new vertex."""
        e = self.edge(edge_key)
        if vertex in (e.tail, e.head):
            raise AlreadyExistsError(f"vertex {vertex!r}")
        g = self.remove_edge_by_key(edge_key).add_vertex(vertex)
        return g.add_edge(first_key, e.tail, vertex, e.weight or 0.0).add_edge(second_key, vertex, e.head, e.weight or 0.0)

    def line_graph(self):
        """Vertices are the edges. Undirected: one edge per shared endpoint. Directed: an arc from e
        to f where e's head is f's tail."""
        from ..graph import PropertyGraph

        v = self.edges.select("key", F.create_map(F.lit("tail"), F.col("tail").cast("string"), F.lit("head"), F.col("head").cast("string")).alias("labels"))
        if self.directed:
            pairs = self.edges.select(F.col("key").alias("a"), F.col("head").alias("v")).join(self.edges.select(F.col("key").alias("b"), F.col("tail").alias("v")), "v")
        else:
            ends = self.edges.select("key", F.explode(F.array_distinct(F.array("tail", "head"))).alias("v"))
            pairs = ends.select(F.col("key").alias("a"), "v").join(ends.select(F.col("key").alias("b"), "v"), "v").filter("a < b")
        e = pairs.select(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"), F.col("v").cast("string")).alias("key"), F.col("a").alias("tail"), F.col("b").alias("head"))
        return PropertyGraph.of(v, e, self.directed, f"L({self.name})", validate=False)
