"""Boxes in the plane: window queries, box joins by grid cells, nearest neighbours; and prefix maps.

The grid join gives each box to the cells it covers; two boxes that meet are compared in one cell
only (the one of the lower corner of their overlap), so no pair comes twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import NotExistsError
from ..functions.ranking import with_rank
from ..scratch import materialise

BOX = ("minx", "miny", "maxx", "maxy")


def columns_of(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in BOX)


def literal(box) -> tuple[Column, ...]:
    return tuple(map(F.lit, box))


def intersects(a, b) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def covers(a, b) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def area(a) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def equals(a, b) -> Column:
    return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])


def centre_distance(a, b) -> Column:
    return F.sqrt(F.pow(a[0] + a[2] - b[0] - b[2], 2) + F.pow(a[1] + a[3] - b[1] - b[3], 2)) / 2


#: Probe boxes that are sent to all tasks at once.
PROBES = 10_000

#: Boxes in a tile of nearest_each.
TILE = 512


@dataclass(frozen=True)
class BoxTable:
    """``boxes (id, minx, miny, maxx, maxy, data ...)``."""

    boxes: DataFrame
    distance: Callable[[tuple, tuple], Column] = centre_distance

    def __len__(self) -> int:
        return self.boxes.count()

    def search(self, window) -> DataFrame:
        return self.boxes.filter(intersects(columns_of(), literal(window)))

    def insert(self, rows: DataFrame) -> BoxTable:
        return replace(self, boxes=self.boxes.unionByName(rows))

    def delete(self, box) -> BoxTable:
        """Remove one box with exactly these corners, the one with the smallest id."""
        gone = self.boxes.filter(equals(columns_of(), literal(box))).orderBy("id").limit(1)
        if gone.isEmpty():
            raise NotExistsError(f"box {box}")
        return replace(self, boxes=self.boxes.join(gone.select("id"), "id", "left_anti"))

    def scan(self) -> DataFrame:
        return self.boxes

    def nearest(self, box, k: int) -> DataFrame:
        """The k nearest, nearest first, ties by id."""
        return self.boxes.withColumn("distance", self.distance(columns_of(), literal(box))).orderBy("distance", "id").limit(k)

    def within(self, box, limit) -> DataFrame:
        return self.boxes.withColumn("distance", self.distance(columns_of(), literal(box))).filter(F.col("distance") <= limit)

    def overlaps(self, other: DataFrame, cell: float) -> DataFrame:
        """``(id, other)``: pairs of boxes that meet, by grid cells of the given width."""

        def celled(df: DataFrame, name: str) -> DataFrame:
            c = {x: F.floor(F.col(x) / cell) for x in BOX}
            rows = df.select(F.col("id").alias(name), *(F.col(x).alias(f"{name}_{x}") for x in BOX), F.explode(F.sequence(c["minx"], c["maxx"])).alias("cx"), F.sequence(c["miny"], c["maxy"]).alias("ys"))
            return rows.withColumn("cy", F.explode("ys")).drop("ys")

        both = celled(self.boxes, "a").join(celled(other, "b"), ["cx", "cy"])
        low = (F.col("cx") == F.floor(F.greatest("a_minx", "b_minx") / cell)) & (F.col("cy") == F.floor(F.greatest("a_miny", "b_miny") / cell))
        return both.filter(low & intersects(columns_of("a_"), columns_of("b_"))).select(F.col("a").alias("id"), F.col("b").alias("other"))

    def nearest_each(self, probes: DataFrame, k: int, tile: int = TILE) -> DataFrame:
        """``(probe, id, distance, place)``: the k nearest of each of a stated set of probe boxes
        ``(probe, minx ...)``, ties by id, boxes without a distance last.

        By the distance of centres, boxes are packed into tiles of about ``tile`` neighbours and these
        into groups; a probe meets the groups, then the tiles, then the boxes that may hold one of its
        k nearest. Other distances, and probes or boxes whose centre is not a finite point, are
        compared one by one."""
        p = probes.select("probe", *(F.col(c).alias(f"p_{c}") for c in BOX))
        if self.distance is not centre_distance or k < 1:
            return self._closest(self._met(self.boxes, p), k)
        boxes = _centred(self.boxes.select("id", *BOX), columns_of())
        p = materialise(_centred(p, columns_of("p_")), "probes")
        # Of boxes at one place only the k of the least ids matter.
        same = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("id"))
        placed = materialise(boxes.filter(_finite()).withColumn("same", same).filter(F.col("same") <= k).drop("same"), "boxes")
        tiled = materialise(_tiled(placed, tile), "tiled")
        tiles = materialise(_summary(tiled.groupBy("tile", "group"), F.count("*"), "cx", "cx", "cy", "cy"), "tiles")
        groups = materialise(_summary(tiles.groupBy("group"), F.sum("n"), "x0", "x1", "y0", "y1"), "groups")
        size = reduce(Column.__add__, (F.abs(c) for c in columns_of("p_")))
        probe = p.filter(_finite()).select("probe", F.col("cx").alias("px"), F.col("cy").alias("py"), size.alias("size"))
        near = _may_hold(probe.hint("shuffle_replicate_nl").crossJoin(groups), k).select("probe", "px", "py", "size", "group")
        near = _may_hold(near.hint("merge").join(tiles.hint("merge"), "group"), k).select("probe", "tile")
        near = near.hint("merge").join(tiled.drop("cx", "cy", "group").hint("merge"), "tile").drop("tile")
        near = near.join(p.drop("cx", "cy"), "probe").select("probe", "id", self.distance(columns_of(), columns_of("p_")).alias("distance"))
        odd_probes = p.filter(~_finite()).drop("cx", "cy")
        odd = boxes.filter(~_finite()).drop("cx", "cy")
        # Without a centre there is no distance: of those boxes, too, the k of the least ids.
        lost = odd.filter(~_known()).orderBy("id").limit(k)
        for rows, against in ((odd.filter(_known()).unionByName(lost), p.filter(_finite()).drop("cx", "cy")), (self.boxes, odd_probes)):
            if not (rows.isEmpty() or against.isEmpty()):
                near = near.unionByName(self._met(rows, against))
        return self._closest(near, k)

    def _met(self, boxes: DataFrame, p: DataFrame) -> DataFrame:
        """``(probe, id, distance)`` of all boxes and all probes, these in blocks of about PROBES."""
        blocks = max(1, -(-p.count() // PROBES))
        met = [boxes.crossJoin(F.broadcast(p.filter(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == i))) for i in range(blocks)]
        return reduce(DataFrame.unionByName, met).select("probe", "id", self.distance(columns_of(), columns_of("p_")).alias("distance"))

    @staticmethod
    def _closest(d: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("probe").orderBy(F.asc_nulls_last("distance"), "id"))
        return d.withColumn("place", place).filter(F.col("place") <= k)


def _centred(df: DataFrame, box) -> DataFrame:
    """With ``cx, cy``, twice the centre; -0 as 0, so that one place is one group."""
    return df.withColumns({"cx": (box[0] + box[2]).cast("double") + F.lit(0.0), "cy": (box[1] + box[3]).cast("double") + F.lit(0.0)})


def _finite() -> Column:
    return F.coalesce((F.abs("cx") < F.lit(float("inf"))) & (F.abs("cy") < F.lit(float("inf"))), F.lit(False))


def _known() -> Column:
    return reduce(Column.__and__, (F.col(c).isNotNull() for c in BOX))


def _tiled(boxes: DataFrame, tile: int) -> DataFrame:
    """Strips of neighbours by x, in each strip tiles by y; ``group`` is a square of about 8 by 8 tiles."""
    strip = max(tile, math.isqrt(boxes.count() * tile))
    ranked = with_rank(boxes, "cx", "cy", "id", name="at").withColumn("strip", F.floor((F.col("at") - 1) / strip))
    row = F.floor((F.row_number().over(Window.partitionBy("strip").orderBy("cy", "cx", "id")) - 1) / tile)
    return ranked.withColumn("row", row).select(*boxes.columns, F.struct("strip", "row").alias("tile"), F.struct(F.floor(F.col("strip") / 8).alias("s"), F.floor(F.col("row") / 8).alias("r")).alias("group"))


def _summary(grouped, n: Column, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
    return grouped.agg(n.alias("n"), F.min(x0).alias("x0"), F.max(x1).alias("x1"), F.min(y0).alias("y0"), F.max(y1).alias("y1"))


def _may_hold(pairs: DataFrame, k: int) -> DataFrame:
    """Of pairs of a probe ``(px, py, size)`` and a node ``(n, x0, x1, y0, y1)`` those whose node may hold one
    of the probe's k nearest: its nearest point is no farther than the farthest points of nodes that
    hold k boxes together. ``size``, the sum of the probe's coordinates without their signs, bounds
    what rounding can do to a distance."""
    gap = lambda c, a, b: F.greatest(F.col(a) - F.col(c), F.col(c) - F.col(b), F.lit(0.0))
    span = lambda c, a, b: F.greatest(F.abs(F.col(c) - F.col(a)), F.abs(F.col(b) - F.col(c)))
    length = lambda f: F.sqrt(F.pow(f("px", "x0", "x1"), 2) + F.pow(f("py", "y0", "y1"), 2))
    slack = reduce(Column.__add__, (F.abs(c) for c in ("x0", "x1", "y0", "y1")), F.col("size")) * 1e-14 + 1e-150
    measured = pairs.withColumns({"near": length(gap) - slack, "far": length(span) + slack})
    so_far = F.sum("n").over(Window.partitionBy("probe").orderBy("far").rowsBetween(Window.unboundedPreceding, 0))
    bound = F.min(F.when(F.col("held") >= k, F.col("far"))).over(Window.partitionBy("probe"))
    kept = measured.withColumn("held", so_far).withColumn("bound", bound)
    return kept.filter(F.col("bound").isNull() | ~(F.col("near") > F.col("bound") * (1 + 1e-9))).drop("near", "far", "held", "bound")


@dataclass(frozen=True)
class PrefixMap:
    """``entries (k string, v)``: a trie's keys; prefix queries are pushed to the scan."""

    entries: DataFrame

    def __len__(self) -> int:
        return self.entries.count()

    def search(self, key: str):
        row = self.entries.filter(F.col("k") == key).limit(1).collect()
        return row[0].v if row else None

    def prefix(self, start: str) -> DataFrame:
        return self.entries.filter(F.col("k").startswith(start)).orderBy("k")

    def insert(self, rows: DataFrame) -> PrefixMap:
        return PrefixMap(self.entries.join(rows, "k", "left_anti").unionByName(rows))

    def update(self, key: str, f: Callable[[Column], Column]) -> PrefixMap:
        return PrefixMap(self.entries.withColumn("v", F.when(F.col("k") == key, f(F.col("v"))).otherwise(F.col("v"))))

    def delete(self, key: str) -> PrefixMap:
        return PrefixMap(self.entries.filter(F.col("k") != key))

    def delete_prefix(self, start: str) -> PrefixMap:
        return PrefixMap(self.entries.filter(~F.col("k").startswith(start)))

    def scan(self) -> DataFrame:
        return self.entries.orderBy("k")
