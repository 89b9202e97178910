"""Graph generators: ranges and joins on expressions, so that sizes beyond a driver work too."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..graph import PropertyGraph
from ..operators.bipartite import Bipartite
from ..operators.forest import Forest

#: Edges of named graphs.
PETERSEN = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (0, 5), (1, 6), (2, 7), (3, 8), (4, 9), (5, 7), (7, 9), (9, 6), (6, 8), (8, 5)]
HAJOS = [(0, 1), (0, 2), (0, 4), (1, 3), (1, 6), (2, 4), (2, 5), (3, 5), (3, 6), (4, 5), (5, 6)]
FANO = [(0, 3), (3, 1), (1, 4), (4, 2), (2, 5), (5, 0), (0, 6), (1, 6), (2, 6), (3, 6), (4, 6), (5, 6), (3, 5), (3, 4), (4, 5)]


def _graph(spark: SparkSession, n: int, edges: DataFrame, directed: bool = False, name: str = "") -> PropertyGraph:
    """Vertices 0..n-1; ``edges (tail, head)`` are keyed by their pair, which is unique."""
    e = edges.select((F.col("tail").cast("long") * n + F.col("head").cast("long")).alias("key"), F.col("tail").cast("long").alias("tail"), F.col("head").cast("long").alias("head"))
    return PropertyGraph.of(spark.range(n).toDF("key"), e, directed, name, validate=False)


def _literal(spark: SparkSession, n: int, pairs, name: str) -> PropertyGraph:
    return _graph(spark, n, spark.createDataFrame(pairs, "tail long, head long"), name=name)


def _pairs(spark: SparkSession, n: int, on: Column | None = None) -> DataFrame:
    """All i < j below n: each i gives its own j by a sequence, without a join."""
    p = spark.range(max(n - 1, 0)).toDF("tail").withColumn("head", F.explode(F.sequence(F.col("tail") + 1, F.lit(n - 1))))
    return p if on is None else p.filter(on)


def complete_tree(spark: SparkSession, k: int, n: int) -> Forest:
    """k-ary tree of n vertices, parent (v - 1) / k, root 0."""
    e = spark.range(1, max(n, 1)).select(F.floor((F.col("id") - 1) / k).alias("tail"), F.col("id").alias("head"))
    return Forest(_graph(spark, n, e, name="complete tree"), spark.createDataFrame([(0, False)] if n else [], "key long, directed boolean"))


def full_tree(spark: SparkSession, k: int, levels: int) -> Forest:
    return complete_tree(spark, k, levels if k == 1 else (k**levels - 1) // (k - 1))


def petersen(spark: SparkSession) -> PropertyGraph:
    return _literal(spark, 10, PETERSEN, "Petersen")


def hajos(spark: SparkSession) -> PropertyGraph:
    return _literal(spark, 7, HAJOS, "Hajos")


def fano_plane(spark: SparkSession) -> PropertyGraph:
    return _literal(spark, 7, FANO, "Fano")


def heawood(spark: SparkSession) -> PropertyGraph:
    """A ring of 14 with chords of five steps from the even vertices."""
    ring = spark.range(14).select(F.col("id").alias("tail"), ((F.col("id") + 1) % 14).alias("head"))
    chords = spark.range(0, 14, 2).select(F.col("id").alias("tail"), ((F.col("id") + 5) % 14).alias("head"))
    return _graph(spark, 14, ring.unionByName(chords), name="Heawood")


def complete_graph(spark: SparkSession, n: int) -> PropertyGraph:
    return _graph(spark, n, _pairs(spark, n), name=f"K{n}")


def complete_bipartite(spark: SparkSession, a: int, b: int) -> Bipartite:
    v = spark.range(a + b).select(F.col("id").alias("key"), (F.col("id") < a).alias("part_a"))
    e = spark.range(a).toDF("tail").withColumn("head", F.explode(F.sequence(F.lit(a).cast("long"), F.lit(a + b - 1).cast("long")))) if b else spark.createDataFrame([], "tail long, head long")
    g = _graph(spark, a + b, e)
    return Bipartite.of(v, g.edges, name=f"K{a},{b}", validate=False)


def complete_kpartite(spark: SparkSession, parts: Sequence[int]) -> PropertyGraph:
    n = sum(parts)
    starts = [sum(parts[:i]) for i in range(len(parts) + 1)]
    part_of = lambda c: reduce(lambda x, i: F.when(F.col(c) >= starts[i], i).otherwise(x), range(1, len(parts)), F.lit(0))
    return _graph(spark, n, _pairs(spark, n, part_of("tail") != part_of("head")), name="complete k-partite")


def hypercube(spark: SparkSession, n: int) -> PropertyGraph:
    bits = spark.range(1 << n).toDF("tail").withColumn("b", F.explode(F.array(*(F.lit(1 << i).cast("long") for i in range(n))))) if n else spark.createDataFrame([], "tail long, b long")
    e = bits.filter(F.col("tail").bitwiseAND(F.col("b")) == 0).select("tail", F.col("tail").bitwiseOR(F.col("b")).alias("head"))
    return _graph(spark, 1 << n, e, name=f"Q{n}")


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 0) -> PropertyGraph:
    """Each pair with probability p; the draw is a hash of the pair and the seed."""
    return _graph(spark, n, _pairs(spark, n, _draw(seed) < p), name=f"G({n},{p})")


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64("tail", "head", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def random_tournament(spark: SparkSession, n: int, seed: int = 0) -> PropertyGraph:
    flip = _draw(seed) < 0.5
    e = _pairs(spark, n).select(F.when(flip, F.col("tail")).otherwise(F.col("head")).alias("tail"), F.when(flip, F.col("head")).otherwise(F.col("tail")).alias("head"))
    return _graph(spark, n, e, True, "tournament")


def cycle(spark: SparkSession, n: int) -> PropertyGraph:
    e = spark.range(n).select(F.col("id").alias("tail"), ((F.col("id") + 1) % max(n, 1)).alias("head"))
    return _graph(spark, n, e, name=f"C{n}")


def wheel(spark: SparkSession, n: int) -> PropertyGraph:
    """n vertices: a ring of n - 1 and a hub, vertex n - 1, joined with all of it."""
    ring = cycle(spark, n - 1).edges.select("tail", "head")
    return _graph(spark, n, ring.unionByName(spark.range(n - 1).select(F.lit(n - 1).cast("long").alias("tail"), F.col("id").alias("head"))), name=f"W{n}")


def queen(spark: SparkSession, rows: int, columns: int) -> PropertyGraph:
    """Squares joined by a queen's move; labels row and column."""
    cells = spark.range(rows * columns).select(F.col("id").alias("tail"), F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"))
    # The four directions that go to larger squares, any number of steps.
    moves = F.explode(F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    steps = cells.withColumn("m", moves).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(max(rows, columns)))))
    to = steps.select("tail", (F.col("r") + F.col("s") * F.col("m.dr")).alias("r"), (F.col("c") + F.col("s") * F.col("m.dc")).alias("c"))
    e = to.filter((F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < columns)).select("tail", (F.col("r") * columns + F.col("c")).alias("head"))
    g = _graph(spark, rows * columns, e, name=f"queen {rows}x{columns}")
    labels = F.create_map(F.lit("row"), F.floor(F.col("key") / columns).cast("string"), F.lit("column"), (F.col("key") % columns).cast("string"))
    return g.with_(vertices=g.vertices.withColumn("labels", labels))


def hadamard(spark: SparkSession, matrix: Sequence[Sequence[int]]) -> PropertyGraph:
    """From an n x n matrix of 1 and -1: vertices 4i and 4i + 1 are row i's plus and minus, 4j + 2
    and 4j + 3 column j's; a 1 joins like signs, a -1 unlike ones."""
    n = len(matrix)
    if any(len(row) != n or set(row) - {1, -1} for row in matrix):
        raise ValueError("a square matrix of 1 and -1 is asked for")
    e = [(4 * i + s, 4 * j + 2 + (s if x == 1 else 1 - s)) for i, row in enumerate(matrix) for j, x in enumerate(row) for s in (0, 1)]
    return _literal(spark, 4 * n, e, "Hadamard")
