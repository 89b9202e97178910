"""Ordered maps and multimaps, difference arrays, segment aggregates and priority queues as sorted
tables. Points and ranges are filters that reach the scan; global ranks use range partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..errors import NotExistsError
from ..functions.ranking import running_sum, with_rank
from ..scratch import materialise


def _first(df: DataFrame) -> Row | None:
    rows = df.limit(1).collect()
    return rows[0] if rows else None


@dataclass(frozen=True)
class OrderedMap:
    """``entries (k, v)`` with unique keys, or a multimap where keys repeat (``unique=False``)."""

    entries: DataFrame
    unique: bool = True

    @classmethod
    def build(cls, rows: DataFrame, key: str = "k", value: str = "v", seq: str | None = None, unique: bool = True) -> OrderedMap:
        """A map from rows; of equal keys the one with the greatest ``seq`` stays."""
        rows = rows.withColumnsRenamed({key: "k", value: "v"})
        if unique:
            rows = rows.groupBy("k").agg(F.max_by("v", seq).alias("v") if seq else F.first("v").alias("v"))
        return cls(rows.select("k", "v"), unique)

    def __len__(self) -> int:
        return self.entries.count()

    def search(self, key):
        row = _first(self.entries.filter(F.col("k") == F.lit(key)))
        if row is None:
            raise NotExistsError(f"key {key!r}")
        return row.v

    def seek(self, key) -> tuple | None:
        """(k, v, exact) of the first key not below; None past the end."""
        row = _first(self.entries.filter(F.col("k") >= F.lit(key)).orderBy("k"))
        return None if row is None else (row.k, row.v, row.k == key)

    def seek_all(self, probes: DataFrame) -> DataFrame:
        """``(probe, k, v, exact)`` for a table ``(probe)``: a forward as-of join. Both sides are
        ranged together, so a partition only needs the first key of those after it."""
        both = self.entries.select("k", "v", F.lit(1).alias("kind"), F.lit(None).cast(dict(self.entries.dtypes)["k"]).alias("probe")).unionByName(probes.select(F.col("probe").alias("k"), F.lit(None).cast(dict(self.entries.dtypes)["v"]).alias("v"), F.lit(0).alias("kind"), "probe"))
        ranged = with_rank(both, "k", "kind", name="at").withColumn("part", F.floor(F.col("at") / 100_000))
        heads = ranged.filter("kind = 1").groupBy("part").agg(F.min(F.struct("at", "k", "v")).alias("head"))
        # The first key after a part: of its own stretch of 10,000 parts, or of the stretches behind it.
        parts = ranged.select("part").distinct().join(heads, "part", "left").withColumn("stretch", F.floor(F.col("part") / 10_000))
        behind = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        stretches = parts.groupBy("stretch").agg(F.min("head").alias("first"))
        stretches = stretches.select("stretch", F.last("first", ignorenulls=True).over(behind(Window.orderBy(F.desc("stretch")))).alias("far"))
        following = parts.withColumn("near", F.last("head", ignorenulls=True).over(behind(Window.partitionBy("stretch").orderBy(F.desc("part"))))).join(stretches, "stretch").select("part", F.coalesce("near", "far").alias("later"))
        # Backwards, as a frame that only grows is linear and one that shrinks is not.
        within = Window.partitionBy("part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
        found = ranged.withColumn("own", F.last(F.when(F.col("kind") == 1, F.struct("at", "k", "v")), ignorenulls=True).over(within)).filter("kind = 0")
        found = found.join(following, "part").withColumn("hit", F.coalesce("own", "later"))
        return found.select("probe", F.col("hit.k").alias("k"), F.col("hit.v").alias("v"), F.coalesce(F.col("hit.k") == F.col("probe"), F.lit(False)).alias("exact"))

    def first(self) -> Row | None:
        return _first(self.entries.orderBy("k"))

    def last(self) -> Row | None:
        return _first(self.entries.orderBy(F.desc("k")))

    minimum, maximum = first, last

    def range(self, low, high) -> DataFrame:
        """Entries with low <= k <= high, in order."""
        return self.entries.filter(F.col("k").between(F.lit(low), F.lit(high))).orderBy("k")

    def scan(self, descending: bool = False) -> DataFrame:
        return self.entries.orderBy(F.desc("k") if descending else F.asc("k"))

    def visit(self, descending: bool = False) -> Iterator[Row]:
        """Rows in order, one partition in memory at a time."""
        return self.scan(descending).toLocalIterator()

    def ranks(self) -> DataFrame:
        """``(k, v, rank)``, 1-based."""
        return with_rank(self.entries, "k")

    def rank(self, key) -> int | None:
        if _first(self.entries.filter(F.col("k") == F.lit(key))) is None:
            return None
        return self.entries.filter(F.col("k") < F.lit(key)).count() + 1

    def nth(self, n: int) -> Row | None:
        return _first(self.ranks().filter(F.col("rank") == n))

    index = nth

    def cursor(self) -> DataFrame:
        """``(k, v, rank, next, prev)``: each entry with its neighbours in order."""
        r = self.ranks()
        after = r.select((F.col("rank") - 1).alias("rank"), F.col("k").alias("next"))
        before = r.select((F.col("rank") + 1).alias("rank"), F.col("k").alias("prev"))
        return r.join(after, "rank", "left").join(before, "rank", "left").select("k", "v", "rank", "next", "prev")

    # -- edits -----------------------------------------------------------------------------

    def upsert(self, rows: DataFrame) -> OrderedMap:
        """Rows ``(k, v)`` replace entries of equal keys; a multimap keeps both."""
        if not self.unique:
            return replace(self, entries=self.entries.unionByName(rows.select("k", "v")))
        return replace(self, entries=self.entries.join(rows, "k", "left_anti").unionByName(rows.select("k", "v")))

    def insert(self, key, value) -> OrderedMap:
        return self.upsert(self.entries.sparkSession.createDataFrame([(key, value)], self.entries.schema))

    def update(self, key, value) -> OrderedMap:
        """Set the value of a key; in a multimap of the entry with the smallest value."""
        return self.delete(key).insert(key, value)

    def delete(self, key) -> OrderedMap:
        """Drop a key; in a multimap one entry, the one with the smallest value."""
        if self.unique:
            self.search(key)
            return self.delete_all(key)
        same = F.col("k") == F.lit(key)
        n = F.row_number().over(Window.partitionBy("k").orderBy("v"))
        kept = self.entries.filter(same).withColumn("n", n).filter("n > 1").drop("n")
        return replace(self, entries=self.entries.filter(~same).unionByName(kept))

    def delete_all(self, key) -> OrderedMap:
        return replace(self, entries=self.entries.filter(F.col("k") != F.lit(key)))

    def cleared(self) -> OrderedMap:
        return replace(self, entries=self.entries.limit(0))

    def split(self, key) -> tuple[OrderedMap, OrderedMap]:
        """Entries below a key, and the others."""
        return replace(self, entries=self.entries.filter(F.col("k") < F.lit(key))), replace(self, entries=self.entries.filter(F.col("k") >= F.lit(key)))

    def merge(self, other: OrderedMap) -> OrderedMap:
        return self.upsert(other.entries)


@dataclass(frozen=True)
class IndexedArray:
    """``cells (i, x)``, i from 0: difference arrays and segment trees."""

    cells: DataFrame

    @classmethod
    def of(cls, spark, values) -> IndexedArray:
        values = list(values)
        return cls(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x " + ("double" if any(isinstance(v, float) for v in values) else "long")))

    def __len__(self) -> int:
        return self.cells.count()

    def append(self, x) -> IndexedArray:
        return IndexedArray(self.cells.unionByName(self.cells.sparkSession.createDataFrame([(len(self), x)], self.cells.schema)))

    def get(self, i: int):
        row = _first(self.cells.filter(F.col("i") == i))
        return None if row is None else row.x

    def set(self, i: int, x) -> IndexedArray:
        return self.update(i, lambda _: F.lit(x))

    def update(self, i: int, f: Callable[[Column], Column]) -> IndexedArray:
        return IndexedArray(self.cells.withColumn("x", F.when(F.col("i") == i, f(F.col("x"))).otherwise(F.col("x"))))

    def add_ranges(self, changes: DataFrame) -> IndexedArray:
        """Add ``amount`` to every cell of each closed interval of ``(low, high, amount)``: two
        events for each, one running sum for all."""
        events = changes.select(F.col("low").alias("i"), F.col("amount").alias("d")).unionByName(changes.select((F.col("high") + 1).alias("i"), (-F.col("amount")).alias("d")))
        both = self.cells.select("i", F.lit(1).alias("cell"), "x", F.lit(0).cast(dict(events.dtypes)["d"]).alias("d"))
        both = both.unionByName(events.groupBy("i").agg(F.sum("d").alias("d")).select("i", F.lit(0).alias("cell"), F.lit(None).cast(dict(self.cells.dtypes)["x"]).alias("x"), F.col("d").cast(dict(events.dtypes)["d"]).alias("d")))
        total = running_sum(both, "d", "i", "cell")
        return IndexedArray(total.filter("cell = 1").select("i", (F.col("x") + F.col("total")).alias("x")))

    def add(self, amount, low: int, high: int) -> IndexedArray:
        return self.add_ranges(self.cells.sparkSession.createDataFrame([(low, high, amount)], f"low long, high long, amount {dict(self.cells.dtypes)['x']}"))

    def differences(self) -> DataFrame:
        """``(i, d)``: each cell less the one before."""
        before = self.cells.select((F.col("i") + 1).alias("i"), F.col("x").alias("b"))
        return self.cells.join(before, "i", "left").select("i", (F.col("x") - F.coalesce("b", F.lit(0))).alias("d"))

    def query(self, low: int, high: int, aggregate: Callable = F.sum):
        """A built-in aggregate over the closed interval; None where it holds no cell."""
        return self.cells.filter(F.col("i").between(low, high)).agg(aggregate("x")).first()[0]

    def sum(self, low: int, high: int):
        return self.query(low, high, F.sum)

    def query_all(self, ranges: DataFrame, block: int = 1024) -> DataFrame:
        """``(q, total, least, most)`` of each closed interval ``(q, low, high)``. Whole blocks are summed up
        first, then pairs of blocks, pairs of pairs and so on: an interval meets at most two nodes of each
        level and the cells of at most two blocks, however long it is."""
        measures = {"total": F.sum, "least": F.min, "most": F.max}
        c = self.cells.withColumn("b", F.floor(F.col("i") / block))
        blocks = materialise(c.groupBy("b").agg(*(f("x").alias(name) for name, f in measures.items())), "blocks")
        first, last = blocks.agg(F.min("b"), F.max("b")).first()
        levels = 1 if first is None else (last - first + 1).bit_length()
        r = ranges.withColumns({"lb": F.floor(F.col("low") / block), "hb": F.floor(F.col("high") / block)}).filter("low <= high")
        # Blocks strictly between the ends, counted from the first block: [at, to).
        at, to = F.greatest(F.col("lb") + 1, F.lit(first)) - F.lit(first), F.least(F.col("hb"), F.lit(last) + 1) - F.lit(first)
        inner = r.select("q", at.alias("at"), to.alias("to")).filter("at < to").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        # At each level an odd start and an odd end stand for nodes of their own; the level above has the rest.
        inner = inner.withColumns({"at": F.expr("-shiftright(-at, level)"), "to": F.expr("shiftright(to, level)")}).filter("at < to")
        ends = F.array(F.when(F.col("at") % 2 == 1, F.col("at")), F.when((F.col("to") % 2 == 1) & (F.col("at") + F.col("at") % 2 < F.col("to")), F.col("to") - 1))
        inner = inner.select("q", "level", F.explode(F.array_compact(ends)).alias("node"))
        nodes = blocks.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).groupBy("level", F.expr(f"shiftright(b - {first or 0}L, level)").alias("node"))
        nodes = nodes.agg(*(f(name).alias(name) for name, f in measures.items()))
        # Sizes before explode say nothing of those after it: no broadcast by them.
        inner = inner.hint("merge").join(nodes.hint("merge"), ["level", "node"]).select("q", *measures)
        edge = r.withColumn("b", F.explode(F.array_distinct(F.array("lb", "hb")))).hint("merge").join(c.hint("merge"), "b")
        edge = edge.filter("i between low and high").select("q", *(F.col("x").alias(name) for name in measures))
        return inner.unionByName(edge).groupBy("q").agg(*(f(name).alias(name) for name, f in measures.items()))


@dataclass(frozen=True)
class PriorityTable:
    """``items (key, value, priority)``: what a heap or priority queue holds, least first."""

    items: DataFrame

    def __len__(self) -> int:
        return self.items.count()

    def push(self, rows: DataFrame) -> PriorityTable:
        """Rows with a key that is there replace it."""
        return PriorityTable(self.items.join(rows, "key", "left_anti").unionByName(rows))

    def update(self, key, priority) -> PriorityTable:
        return PriorityTable(self.items.withColumn("priority", F.when(F.col("key") == F.lit(key), F.lit(priority)).otherwise(F.col("priority"))))

    def top(self, n: int = 1) -> DataFrame:
        return self.items.orderBy("priority", "key").limit(n)

    def pop(self, n: int = 1) -> tuple[DataFrame, PriorityTable]:
        out = self.top(n)
        return out, PriorityTable(self.items.join(out.select("key"), "key", "left_anti"))

    def priority(self, key):
        row = _first(self.items.filter(F.col("key") == F.lit(key)))
        return None if row is None else row.priority


@dataclass(frozen=True)
class SequenceTable:
    """``items (seq, item)`` in the order of ``seq``: a stack (``push``, ``pop``) or a queue (``push``,
    ``take``). Rows keep their place, so neither end moves any other row."""

    items: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, *order: str) -> SequenceTable:
        """All of ``rows (item ...)``, pushed in the given order."""
        return cls(with_rank(rows, *order, name="seq").select(F.col("seq").cast("long").alias("seq"), "item"))

    def __len__(self) -> int:
        return self.items.count()

    def is_empty(self) -> bool:
        return self.items.isEmpty()

    def contains(self, item) -> bool:
        return not self.items.filter(F.col("item") == F.lit(item)).isEmpty()

    def push(self, item) -> SequenceTable:
        after = (self.items.agg(F.max("seq")).first()[0] or 0) + 1
        return SequenceTable(self.items.unionByName(self.items.sparkSession.createDataFrame([(after, item)], self.items.schema)))

    def _end(self, last: bool) -> Row | None:
        return _first(self.items.orderBy(F.desc("seq") if last else F.col("seq")))

    def top(self):
        """The item pushed last, of a stack its top and of a queue its back; None where there is none."""
        row = self._end(True)
        return None if row is None else row.item

    def front(self):
        row = self._end(False)
        return None if row is None else row.item

    def _without(self, row: Row | None) -> tuple:
        if row is None:
            raise NotExistsError("an item")
        return row.item, SequenceTable(self.items.filter(F.col("seq") != row.seq))

    def pop(self) -> tuple:
        """The item pushed last, and the others."""
        return self._without(self._end(True))

    def take(self) -> tuple:
        """The item pushed first, and the others."""
        return self._without(self._end(False))

    def cleared(self) -> SequenceTable:
        return SequenceTable(self.items.limit(0))
