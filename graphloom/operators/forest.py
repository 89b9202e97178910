"""Rooted forests, dynamic trees and disjoint sets as tables.

``Forest``: an undirected forest with at most one root per tree. ``ParentForest``: a table
``(key, parent, value, weight)``, with re-rooting, linking, cutting and path aggregates.
``DisjointSets``: elements with the pairs that have been united. Ancestor chains are found by
pointer doubling: rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import CycleError, NotExistsError
from ..graph import PropertyGraph, edge_frame, vertex_frame
from ..scratch import discard, materialise
from .components import star_components
from .traversal import breadth_first, components


def ancestors(parents: DataFrame) -> DataFrame:
    """``(key, ancestor, distance)`` for a table ``(key, parent)``, each vertex its own at 0."""
    closure = parents.select("key", F.col("key").alias("ancestor"), F.lit(0).alias("distance"))
    jump = materialise(parents.filter("parent is not null").select("key", F.col("parent").alias("up")), "jump")
    length = 1
    closure = materialise(closure, "closure")
    while not jump.isEmpty():
        # All chains shorter than ``length`` are in; a jump of that length before each gives the rest below 2 * length.
        longer = jump.join(closure.select(F.col("key").alias("up"), "ancestor", "distance"), "up").select("key", "ancestor", (F.col("distance") + length).alias("distance"))
        closure = materialise(closure.unionByName(longer), "closure")
        jump = materialise(jump.join(jump.select(F.col("key").alias("up"), F.col("up").alias("upper")), "up").select("key", F.col("upper").alias("up")), "jump")
        length *= 2
    return closure


def to_the_top(nodes: DataFrame) -> DataFrame:
    """``(key, root, total)`` for a table ``(key, parent, weight)``: weights from the root to each vertex, both
    included. Pointer doubling that carries the sums: one row for each vertex in each round."""
    state = materialise(nodes.select("key", F.coalesce("parent", "key").alias("root"), F.col("weight").alias("total"), F.col("parent").isNull().alias("done")), "top")
    while not state.filter("not done").isEmpty():
        up = state.select(F.col("key").alias("root"), F.col("root").alias("next"), F.col("total").alias("more"), F.col("done").alias("last"))
        # A vertex's total goes up to, but not with, the one it points to, until that one's goes to its root.
        step = state.filter("not done").join(up, "root").select("key", F.col("next").alias("root"), (F.coalesce("total", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("total"), F.col("last").alias("done"))
        new = materialise(state.filter("done").unionByName(step), "top")
        discard(state)
        state = new
    return state.drop("done")


def lowest_common_ancestors(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, ancestor)`` of ``pairs (a, b)``; null where they are in different trees."""
    up = materialise(ancestors(parents), "ancestors")
    met = pairs.join(up.select(F.col("key").alias("a"), "ancestor", F.col("distance").alias("d")), "a").join(up.select(F.col("key").alias("b"), "ancestor"), ["b", "ancestor"])
    best = met.groupBy("a", "b").agg(F.min_by("ancestor", "d").alias("ancestor"))
    return pairs.join(best, ["a", "b"], "left")


@dataclass(frozen=True)
class Forest:
    graph: PropertyGraph
    roots: DataFrame  # key, directed

    @classmethod
    def of(cls, graph: PropertyGraph, roots: DataFrame | None = None) -> Forest:
        if not graph.undirected().is_forest():
            raise CycleError("the graph has a cycle")
        kind = dict(graph.vertices.dtypes)["key"]
        return cls(graph.undirected(), roots if roots is not None else graph.spark.createDataFrame([], f"key {kind}, directed boolean"))

    def trees(self) -> DataFrame:
        """``(key, comp)``."""
        return components(self.graph)

    def tree_count(self) -> int:
        return self.graph.order() - self.graph.size()

    def is_tree(self) -> bool:
        return self.tree_count() == 1

    def is_digraph(self) -> bool:
        return not self.roots.filter("directed").isEmpty()

    def _tree_of(self, key) -> DataFrame:
        self.graph.vertex(key)
        return materialise(breadth_first(self.graph, key).select("key"), "tree")

    def tree_vertices(self, key) -> DataFrame:
        return self.graph.vertices.join(self._tree_of(key), "key", "left_semi")

    def tree_edges(self, key) -> DataFrame:
        return self.graph.edges.join(self._tree_of(key).toDF("tail"), "tail", "left_semi")

    def connected(self, a, b) -> bool:
        self.graph.vertex(b)
        return not self._tree_of(a).filter(F.col("key") == F.lit(b)).isEmpty()

    def all_roots(self) -> list:
        return [r.key for r in self.roots.orderBy("key").collect()]

    def root(self, key):
        """The root of a vertex's tree, or None."""
        row = self.roots.join(self._tree_of(key), "key", "left_semi").limit(1).collect()
        return row[0].key if row else None

    def is_directed(self, key) -> bool:
        row = self.roots.join(self._tree_of(key), "key", "left_semi").limit(1).collect()
        return bool(row and row[0].directed)

    def set_root(self, key) -> Forest:
        """Make a vertex the root of its tree; the tree keeps its direction flag."""
        tree, flag = self._tree_of(key), self.is_directed(key)
        row = self.graph.spark.createDataFrame([(key, flag)], self.roots.schema)
        return replace(self, roots=materialise(self.roots.join(tree, "key", "left_anti").unionByName(row), "roots"))

    def cancel_root(self, key) -> Forest:
        return replace(self, roots=self.roots.filter(F.col("key") != F.lit(key)))

    def _flagged(self, key, flag: bool) -> Forest:
        tree = self._tree_of(key).withColumn("__in", F.lit(True))
        roots = self.roots.join(tree, "key", "left").select("key", F.when(F.col("__in"), F.lit(flag)).otherwise(F.col("directed")).alias("directed"))
        return replace(self, roots=materialise(roots, "roots"))

    def set_directed(self, key) -> Forest:
        if self.root(key) is None:
            raise NotExistsError(f"the tree of {key!r} has no root")
        return self._flagged(key, True)

    def cancel_directed(self, key) -> Forest:
        return self._flagged(key, False)

    def add_vertices(self, rows: DataFrame) -> Forest:
        """Vertices that are there already are left alone."""
        new = vertex_frame(rows).dropDuplicates(["key"]).join(self.graph.vertices, "key", "left_anti")
        return replace(self, graph=self.graph.add_vertices(new))

    def add_edges(self, rows: DataFrame) -> Forest:
        """Edges that close no cycle. Of two rooted trees that meet, the head's tree loses its root."""
        rows = edge_frame(rows)
        grown = Forest.of(self.graph.add_edges(rows), self.roots)
        comp = materialise(components(grown.graph), "comp")
        was = materialise(components(self.graph), "comp")
        lost = rows.join(was.toDF("head", "old"), "head").select("old").distinct()
        owner = self.roots.join(was, "key").withColumnRenamed("comp", "old").join(comp, "key")
        twice = owner.groupBy("comp").count().filter("count > 1").select("comp")
        gone = owner.join(lost, "old", "left_semi").join(twice, "comp", "left_semi").select("key")
        return replace(grown, roots=materialise(self.roots.join(gone, "key", "left_anti"), "roots"))

    def without_vertices(self, keys: DataFrame) -> Forest:
        keys = keys.toDF("key")
        return Forest(self.graph.without_vertices(keys), self.roots.join(keys, "key", "left_anti"))

    def without_pairs(self, pairs: DataFrame) -> Forest:
        return replace(self, graph=self.graph.spanning_without(pairs))

    def without_edges(self, keys: DataFrame) -> Forest:
        return replace(self, graph=self.graph.with_(edges=self.graph.edges.join(keys.toDF("key"), "key", "left_anti")))

    def parents(self) -> DataFrame:
        """``(key, parent, depth)`` of all rooted trees, from their roots down."""
        arcs = materialise(self.graph.both_ways().select("src", "dst"), "arcs")
        level = materialise(self.roots.select("key", F.lit(None).cast(dict(self.graph.vertices.dtypes)["key"]).alias("parent"), F.lit(0).alias("depth")), "level")
        out, depth = level, 0
        while not level.isEmpty():
            depth += 1
            down = level.alias("l").join(arcs.alias("a"), F.col("l.key") == F.col("a.src")).filter(F.col("l.parent").isNull() | (F.col("a.dst") != F.col("l.parent")))
            level = materialise(down.select(F.col("a.dst").alias("key"), F.col("l.key").alias("parent"), F.lit(depth).alias("depth")), "level")
            out = out.unionByName(level)
        return out

    def lowest_common_ancestor(self, a, b):
        """Of two vertices of one rooted tree; None where there is none."""
        kind = dict(self.graph.vertices.dtypes)["key"]
        pairs = self.graph.spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
        return lowest_common_ancestors(self.parents().select("key", "parent"), pairs).first().ancestor


@dataclass(frozen=True)
class ParentForest:
    """A forest that trees are linked into and cut from: ``nodes (key, parent, value, weight)``."""

    nodes: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, key: str = "long") -> ParentForest:
        return cls(spark.createDataFrame([], f"key {key}, parent {key}, value string, weight double"))

    def _has(self, key) -> bool:
        return not self.nodes.filter(F.col("key") == F.lit(key)).isEmpty()

    def _with_parent(self, changes: DataFrame) -> ParentForest:
        """``changes (key, parent)`` replace parents."""
        c = changes.select("key", F.col("parent").alias("__p"), F.lit(True).alias("__hit"))
        out = self.nodes.join(c, "key", "left").withColumn("parent", F.when(F.col("__hit"), F.col("__p")).otherwise(F.col("parent")))
        return ParentForest(materialise(out.select("key", "parent", "value", "weight"), "nodes"))

    def make_tree(self, key, value=None, weight: float = 0.0) -> ParentForest:
        """A new single vertex; the forest itself if the key is there."""
        if self._has(key):
            return self
        return ParentForest(self.nodes.unionByName(self.nodes.sparkSession.createDataFrame([(key, None, value, float(weight))], self.nodes.schema)))

    def add_or_update(self, key, value=None, weight: float = 0.0) -> ParentForest:
        return self.update_value(key, value).update_weight(key, weight) if self._has(key) else self.make_tree(key, value, weight)

    def update_value(self, key, value) -> ParentForest:
        return ParentForest(self.nodes.withColumn("value", F.when(F.col("key") == F.lit(key), F.lit(value)).otherwise(F.col("value"))))

    def update_weight(self, key, weight: float) -> ParentForest:
        return ParentForest(self.nodes.withColumn("weight", F.when(F.col("key") == F.lit(key), F.lit(float(weight))).otherwise(F.col("weight"))))

    def get(self, key):
        row = self.nodes.filter(F.col("key") == F.lit(key)).limit(1).collect()
        return row[0] if row else None

    def size(self) -> int:
        return self.nodes.count()

    def tree_count(self) -> int:
        return self.nodes.filter("parent is null").count()

    def is_root(self, key) -> bool:
        row = self.get(key)
        return row is not None and row.parent is None

    def access(self, key) -> bool:
        """Is the vertex there? (Exposing its path has no other visible result.)"""
        return self._has(key)

    def paths(self) -> DataFrame:
        """``(v, key, depth, value, weight)``: for every v the vertices from its root (depth 0) to v."""
        up = ancestors(self.nodes.select("key", "parent"))
        height = up.groupBy(F.col("key").alias("v")).agg(F.max("distance").alias("height"))
        rows = up.withColumnRenamed("key", "v").withColumnRenamed("ancestor", "key").join(height, "v").select("v", "key", (F.col("height") - F.col("distance")).alias("depth"))
        return rows.join(self.nodes.select("key", "value", "weight"), "key")

    def path(self, key) -> DataFrame:
        """The rows of ``paths`` of one vertex, root first."""
        chain, at = [], self.get(key)
        kinds = "depth int, " + ", ".join(f"{c} {k}" for c, k in self.nodes.dtypes if c != "parent")
        if at is None:
            return self.nodes.sparkSession.createDataFrame([], kinds)
        return self.paths().filter(F.col("v") == F.lit(key)).drop("v").orderBy("depth")

    def path_sums(self) -> DataFrame:
        """``(key, total)``: weights from the root to each vertex, both included."""
        return to_the_top(self.nodes).select("key", "total")

    def path_sum(self, key):
        return self.path(key).agg(F.sum("weight")).first()[0]

    def path_aggregate(self, key, start, step):
        """Fold ``step(state, row)`` over the path, root first."""
        state = start
        for row in self.path(key).toLocalIterator():
            state = step(state, row)
        return state

    def roots(self) -> DataFrame:
        """``(key, root)`` of every vertex."""
        return to_the_top(self.nodes).select("key", "root")

    def find_root(self, key):
        row = self.roots().filter(F.col("key") == F.lit(key)).collect()
        return row[0].root if row else None

    def connected(self, a, b) -> bool:
        found = [r.root for r in self.roots().filter(F.col("key").isin(a, b)).collect()]
        return len(found) == (1 if a == b else 2) and len(set(found)) == 1

    def cut(self, key) -> ParentForest:
        """Detach a vertex from its parent."""
        return ParentForest(self.nodes.withColumn("parent", F.when(F.col("key") == F.lit(key), F.lit(None)).otherwise(F.col("parent"))))

    def make_root(self, key) -> ParentForest:
        """Turn the path from the root round."""
        steps = self.path(key).select("key", "depth")
        below = steps.select(F.col("key").alias("below"), (F.col("depth") - 1).alias("depth"))
        return self._with_parent(steps.join(below, "depth", "left").select("key", F.col("below").alias("parent")))

    def split(self, a, b) -> ParentForest:
        """Re-rooted at a, so that the path of b is the path from a to b."""
        return self.make_root(a)

    def link(self, parent, child) -> ParentForest:
        """Make the child's root a child of ``parent``; the forest itself if they are in one tree."""
        if not self._has(parent) or not self._has(child) or self.connected(parent, child):
            return self
        root = self.find_root(child)
        return ParentForest(self.nodes.withColumn("parent", F.when(F.col("key") == F.lit(root), F.lit(parent)).otherwise(F.col("parent"))))

    def lowest_common_ancestor(self, a, b):
        kind = dict(self.nodes.dtypes)["key"]
        pairs = self.nodes.sparkSession.createDataFrame([(a, b)], f"a {kind}, b {kind}")
        return lowest_common_ancestors(self.nodes.select("key", "parent"), pairs).first().ancestor


@dataclass(frozen=True)
class DisjointSets:
    """``elements (key)`` and the pairs ``(a, b)`` that were united."""

    elements: DataFrame
    pairs: DataFrame

    @classmethod
    def singletons(cls, spark: SparkSession, n: int) -> DisjointSets:
        return cls(spark.range(n).toDF("key"), spark.createDataFrame([], "a long, b long"))

    def union(self, pairs: DataFrame) -> DisjointSets:
        return DisjointSets(self.elements, self.pairs.unionByName(pairs.select("a", "b")))

    def sets(self) -> DataFrame:
        """``(key, comp)`` with comp the smallest member."""
        found = star_components(self.pairs, "a", "b").withColumnRenamed("v", "key")
        return self.elements.join(found, "key", "left").select("key", F.coalesce("comp", "key").alias("comp"))

    def find(self, key):
        row = self.sets().filter(F.col("key") == F.lit(key)).collect()
        return row[0].comp if row else None

    def connected(self, a, b) -> bool:
        found = {r.key: r.comp for r in self.sets().filter(F.col("key").isin(a, b)).collect()}
        return a in found and b in found and found[a] == found[b]

    def size(self, key) -> int:
        sets = materialise(self.sets(), "sets")
        return sets.join(sets.filter(F.col("key") == F.lit(key)).select("comp"), "comp", "left_semi").count()

    def count(self) -> int:
        return self.sets().select("comp").distinct().count()
