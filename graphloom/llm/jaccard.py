"""N-gram Jaccard join: all pairs of documents whose sets of 5-word shingles overlap by at least
0.8 of their union, as connected components.

1. One pass over the texts gives each document its set size, a 128-bit BLAKE2b digest of its words,
   and a hashed bitmap of parity bits, as wide as the power of two from the set's size (a wider bitmap
   folds to a narrower one, so sizes within a band always compare). Documents with equal digests - the
   same words in the same order - are one class; its smallest member stands for it. The same pass counts
   all shingles in a sketch.
2. Linked sets share at least 0.8 of the larger one, so they share one of their first
   n - ceil(0.8 n) + 1 shingles in any common order. The order puts shingles that the sketch finds
   frequent last, so passages that many documents share rarely get there. Those prefix shingles
   are dealt to buckets, packed; a bucket finds tiles: the classes that share a shingle, in size
   order, so that only sizes within the band [0.8 n, n / 0.8] meet.
3. Round one: small tiles give all their pairs, larger ones the pairs with their smallest member.
   Bitmaps bound the overlap from above - each bit that differs is an element that only one set
   has - and pairs within the bound are verified by exact sorted-array intersection over their words.
4. Round two: within the larger tiles, classes that round one did not bring into one component
   are compared all to all (bitmaps in blocks, then exactly). No link between components is lost,
   and a group of thousands of near copies costs about one verification per member.
5. Star rounds join the links to components.

The sketch only chooses the order; any order gives the same links. Hashes only propose pairs: sizes
count shingles that differ in words, and bitmaps and prefixes hold a hash as often as such shingles have
it, so that two shingles with one hash change no result.

A null or empty text, or one without words, is linked with nothing, not even with its like. A text
with fewer than five words is one shingle. Documents with equal or null doc_ids stay documents of
their own (order: doc_id with nulls first, text); a component that has one with a null id is then
named null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.components import star_components
from .common import FANOUT, arrow_schema, batches, bounded_batches, columns, discard, exact_shingles, from_planes, hold, ids_are_unique, input_bytes, materialise, mix, numbered, planes, raw_windows, redealt, sequence_digests, with_row_key

WIDTH = 5
#: Link when NUMERATOR / DENOMINATOR of the union is shared.
NUMERATOR, DENOMINATOR = 80, 100
#: Bounds of a bitmap's width.
LEAST_BITS, MOST_BITS = 256, 1 << 20
#: Logarithms of the least and greatest number of cells of the count sketch (4 bytes each): one for each MiB
#: of input between them. What is sent to the driver has this size at most.
SKETCH_LOGS = 20, 22
SKETCH_SHARDS = 16
#: Bytes of input files for each bucket of prefix shingles.
BUCKET_BYTES = 32 << 20
#: Tiles of up to this many classes give all their pairs at once.
SMALL_TILE = 4
#: Members of a tile of round two that one piece of work holds; larger tiles are cut into blocks.
TILE_ROWS = 4096
#: Sets compared with one pivot in a piece of work.
PER_PIVOT = 128
#: Bytes of text that are verified at once.
VERIFY_BYTES = 2 << 20

META = "kind int, row_key long, doc_id long, n long, f1 long, f2 long, bits binary"
SENT = "bucket long, docs binary, sizes binary, prints binary, counts binary, hashes binary"
TILES = "lengths binary, docs binary, sizes binary, tokens binary"
PAIRS = "a long, b long"


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def sets_of(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within each; their text numbers; set sizes.
    Shingles are told apart by their words, so a hash that two of a text's shingles have is there twice."""
    w, number, *_ = raw_windows(texts, width)
    order = np.lexsort((w, number))
    w, number = w[order], number[order]
    if len(w):
        again = (w[1:] == w[:-1]) & (number[1:] == number[:-1])
        repeat = np.unique(number[1:][again])
        first = np.r_[True, ~again]
        w, number = w[first], number[first]
        if len(repeat):
            _, text, exact = exact_shingles(texts.take(pa.array(repeat)), width)
            inside = np.isin(number, repeat)
            if len(exact) != inside.sum():
                w, number = np.r_[w[~inside], exact], np.r_[number[~inside], repeat[text]]
                order = np.lexsort((w, number))
                w, number = w[order], number[order]
    return w, number, np.bincount(number, minlength=len(texts)).astype(np.int64)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Each text's words (A-Z lower-cased) in order as two 64-bit halves of a cryptographic digest."""
    return np.frombuffer(b"".join(sequence_digests(texts, lower=True)), "<u8").reshape(-1, 2)


def signatures(w: np.ndarray, number: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set the parity of its elements on each bit, little-endian bits."""
    width = np.clip(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    begin = np.cumsum(width) - width
    at = begin[number] + ((w >> np.uint64(37)).astype(np.int64) & (width[number] - 1))
    packed = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[b // 8 : (b + n) // 8] for b, n in zip(begin.tolist(), width.tolist(), strict=True)]


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (64-bit words in the last axis) at a narrower width."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def within_bound(differ, total):
    """Can sets of together ``total`` elements whose bitmaps differ in ``differ`` bits be linked?
    Each differing bit is an element of one set only: 2 * overlap <= total - differ."""
    return (total - differ) * (NUMERATOR + DENOMINATOR) >= 2 * NUMERATOR * total


def sketch_cells(n_bytes: int) -> int:
    low, high = SKETCH_LOGS
    return 1 << min(high, max(low, (n_bytes >> 20).bit_length()))


def describe(keyed: DataFrame, cells: int) -> DataFrame:
    """Kind 0: one row per document. Kind 1: shards of the partition's count sketch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard")
        schema, sketch = arrow_schema(META), np.zeros(cells, np.uint32)
        for batch in (b for whole in it for b in batches(whole, 2 << 20)):
            n = batch.num_rows
            w, number, sizes = sets_of(batch.column(2))
            f = fingerprints(batch.column(2)).view(np.int64)
            np.add.at(sketch, (w & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
            bits = signatures(w, number, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), pa.array(sizes), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(bits, pa.binary())], schema=schema)
        for shard, part in enumerate(sketch.reshape(SKETCH_SHARDS, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((1, shard, None, 0, 0, 0, part.tobytes()), schema, strict=True)], schema=schema)

    return keyed.mapInArrow(run, META)


def frequent_levels(meta: DataFrame, cells: int) -> np.ndarray:
    """Level of each cell of the summed sketch: 0 where it is near the mean, else by its logarithm.
    What reaches the driver is 8 bytes a cell."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(cells // SKETCH_SHARDS, np.int64)
        for (raw,) in columns(rows, "bits"):
            total += np.frombuffer(raw, np.uint32)
        return pa.table({"shard": rows.column("row_key")[:1], "total": pa.array([total.tobytes()], pa.binary())})

    rows = meta.filter("kind = 1").select("row_key", "bits").groupBy("row_key").applyInArrow(add, "shard long, total binary").collect()
    total = np.zeros((SKETCH_SHARDS, cells // SKETCH_SHARDS), np.int64)
    for shard, raw in rows:
        total[shard] = np.frombuffer(raw, np.int64)
    total = total.ravel()
    limit = max(16.0, 4 * float(total.mean()))
    return np.where(total < limit, 0, np.log2(np.maximum(total, 1) / limit) + 1).astype(np.uint8)


def _packed(bucket: np.ndarray, number: np.ndarray, key: np.ndarray, sizes: np.ndarray, mark: np.ndarray, w: np.ndarray) -> list[tuple]:
    """Rows of SENT from entries sorted by (bucket, set number); key, sizes and mark are by number."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    out = []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(w)], strict=True):
        own, count = np.unique(number[s:e], return_counts=True)
        out.append((int(bucket[s]), key[own].astype("<i8").tobytes(), planes(sizes[own]), mark[own].tobytes(), planes(count), w[s:e].tobytes()))
    return out


def _redeal_shingles(sent: DataFrame, fan: int) -> DataFrame:
    """From coarse buckets to ``fan`` fine ones each, by other bits of the hash."""

    def decode(row: dict):
        w = np.frombuffer(row["hashes"], "<u8")
        return row["bucket"], (np.frombuffer(row["docs"], "<i8"), from_planes(row["sizes"]), np.frombuffer(row["prints"], "<u8").reshape(-1, 2), from_planes(row["counts"]), w), len(w)

    def encode(coarse: int, entries: list) -> list[tuple]:
        key, sizes, mark, count, w = map(np.concatenate, zip(*entries, strict=True))
        number = np.repeat(np.arange(len(key)), count)
        fine = ((w >> np.uint64(33)) % np.uint64(fan)).astype(np.int64)
        order = np.lexsort((number, fine))
        return _packed(coarse * fan + fine[order], number[order], key, sizes, mark, w[order])

    return redealt(sent, "bucket", SENT, decode, encode)


def _send(keyed: DataFrame, levels, buckets: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard")
        schema, level_of = arrow_schema(SENT), levels.value
        for batch in (b for whole in it for b in batches(whole, 2 << 20)):
            n = batch.num_rows
            key = batch.column(0).to_numpy(zero_copy_only=False)
            w, number, sizes = sets_of(batch.column(1))
            if not len(w):
                continue
            f = fingerprints(batch.column(1))
            # One document for each class of the slice is enough; its smallest key stands for it.
            order = np.lexsort((key, f[:, 1], f[:, 0]))
            first = np.r_[True, (f[order][1:] != f[order][:-1]).any(1)]
            keep = np.zeros(n, bool)
            keep[order[first]] = True
            pick = keep[number]
            w, number = w[pick], number[pick]
            order = np.lexsort((w, level_of[(w & np.uint64(len(level_of) - 1)).astype(np.int64)], number))
            w, number = w[order], number[order]
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            rank = np.arange(len(w)) - np.repeat(starts, np.diff(np.r_[starts, len(w)]))
            pick = rank < prefix_length(sizes)[number]
            w, number = w[pick], number[pick]
            bucket = (mix(w) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((number, bucket))
            w, number, bucket = w[order], number[order], bucket[order]
            out = _packed(bucket, number, key, sizes, f, w)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return keyed.select("row_key", "text").mapInArrow(run, SENT)


def _tiles(rows: pa.Table) -> pa.Table:
    """The bucket's tiles of two or more classes: lengths, and members by size then key."""
    token, key, size, mark = [], [], [], []
    for d, n, f, c, h in columns(rows, "docs", "sizes", "prints", "counts", "hashes"):
        count = from_planes(c)
        token.append(np.frombuffer(h, "<u8"))
        key.append(np.repeat(np.frombuffer(d, "<i8"), count))
        size.append(np.repeat(from_planes(n), count))
        mark.append(np.repeat(np.frombuffer(f, "<u8").reshape(-1, 2), count, axis=0))
    token, key, size, mark = map(np.concatenate, (token, key, size, mark))
    order = np.argsort(token, kind="stable")
    same = token[order][1:] == token[order][:-1]
    pick = order[np.r_[False, same] | np.r_[same, False]]
    pick = pick[np.lexsort((key[pick], mark[pick, 1], mark[pick, 0], token[pick]))]
    token, key, size, mark = token[pick], key[pick], size[pick], mark[pick]
    if len(token):  # copies of a class share all their shingles: its smallest member is here
        pick = np.r_[True, (token[1:] != token[:-1]) | (mark[1:] != mark[:-1]).any(1)]
        token, key, size = token[pick], key[pick], size[pick]
    order = np.lexsort((key, size, token))
    token, key, size = token[order], key[order], size[order]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    lengths = np.diff(np.r_[starts, len(token)])
    many = np.repeat(lengths > 1, lengths)
    starts, lengths = starts[lengths > 1], lengths[lengths > 1]
    out = [lengths.astype("<i8").tobytes(), key[many].astype("<i8").tobytes(), size[many].astype("<i8").tobytes(), token[starts].astype("<u8").tobytes()]
    return pa.Table.from_arrays([pa.array([x], pa.binary()) for x in out], schema=arrow_schema(TILES))


def first_pairs(lengths: np.ndarray, key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distinct (a, b), a < b: all pairs of small tiles, and those of others with their smallest key."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    found = []
    for k in range(2, SMALL_TILE + 1):
        at = starts[lengths == k]
        found += [(at + i, at + j) for i in range(k) for j in range(i + 1, k)]
    big = lengths > SMALL_TILE
    if big.any():
        number = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((key, number))
        pivot = np.repeat(order[starts], lengths)
        member = np.repeat(big, lengths)
        found.append((pivot[member], np.flatnonzero(member)))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    fit = (DENOMINATOR * small >= NUMERATOR * large) & (key[i] != key[j])
    a, b = np.minimum(key[i], key[j])[fit], np.maximum(key[i], key[j])[fit]
    return np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)


def _first_round(tiles: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in columns(batch, "lengths", "docs", "sizes"):
                pairs = first_pairs(*(np.frombuffer(x, "<i8") for x in row))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow_schema(PAIRS))

    return tiles.select("lengths", "docs", "sizes").mapInArrow(run, PAIRS).distinct()


def _bound(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs that their bitmaps leave possible."""
    both = pairs.join(meta.select(F.col("row_key").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    both = both.join(meta.select(F.col("row_key").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for n_a, n_b, x, y in columns(batch, "n_a", "n_b", "bits_a", "bits_b"):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                keep.append(within_bound(int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum()), n_a + n_b))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, PAIRS)


def linked(texts: pa.Array, work: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Which texts are linked with the pivot of their piece of ``work`` (one pivot each), by exact
    intersection of their sorted shingles, which are told apart by their words."""
    label, number, _ = exact_shingles(texts, WIDTH)
    sizes = np.bincount(number, minlength=len(texts))
    spread = (int(label.max()) + 1) if len(label) else 1
    place = np.unique(work, return_inverse=True)[1][number] * spread + label
    own = pivot[number]
    base = np.sort(place[own])
    at = np.searchsorted(base, place)
    met = at < len(base)
    met[met] = base[at[met]] == place[met]
    shared = np.bincount(number[met], minlength=len(texts))
    pivot_size = np.zeros(len(texts), np.int64)
    groups, group = np.unique(work, return_inverse=True)
    size_of = np.zeros(len(groups), np.int64)
    size_of[group[pivot]] = sizes[pivot]
    pivot_size = size_of[group]
    return ~pivot & (sizes > 0) & (DENOMINATOR * shared >= NUMERATOR * (sizes + pivot_size - shared))


def _verified(pairs: DataFrame, keyed: DataFrame, groups: int) -> DataFrame:
    """The pairs that are links, by exact intersection. Each pivot's pairs are split into pieces of
    about PER_PIVOT, so that a frequent pivot is many pieces of work."""
    loads = pairs.groupBy("a").agg(F.count("*").alias("load"))
    dealt = pairs.join(loads, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("load") / PER_PIVOT)).alias("piece"))
    dealt = materialise(dealt, "pairs")
    wanted = dealt.select("a", "piece", F.col("b").alias("row_key")).union(dealt.select("a", "piece", F.col("a")).distinct())
    texts = keyed.select("row_key", "text").join(wanted.select("row_key").distinct(), "row_key", "left_semi")
    sent = wanted.join(texts, "row_key").withColumn("work", F.pmod(F.xxhash64("a", "piece"), F.lit(groups)))

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("a", "ascending"), ("piece", "ascending")])
        a, piece, key = (rows.column(c).to_numpy() for c in ("a", "piece", "row_key"))
        text = rows.column("text").cast(pa.large_string()).combine_chunks()
        size = np.cumsum(pc.binary_length(text).to_numpy())
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (piece[1:] != piece[:-1])])
        work = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(a)]))
        found, s = [], 0
        while s < len(a):  # whole pieces of work, some VERIFY_BYTES of text at once
            e = int(np.searchsorted(size, (size[s - 1] if s else 0) + VERIFY_BYTES, "right"))
            e = int(starts[work[e]]) if e < len(a) else len(a)
            if e <= s:
                e = int(starts[work[s] + 1]) if work[s] + 1 < len(starts) else len(a)
            hit = linked(text.slice(s, e - s), work[s:e], key[s:e] == a[s:e])
            found.append(np.stack([a[s:e][hit], key[s:e][hit]], 1))
            s = e
        pairs = np.concatenate(found)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow_schema(PAIRS))

    return sent.select("work", "a", "piece", "row_key", "text").groupBy("work").applyInArrow(verify, PAIRS)


def second_pairs(key: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: list[bytes], own: np.ndarray, block: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of a tile (sorted by size) in different components that their bitmaps leave possible,
    at least one of them of the tile's own band; of a tile of two blocks the pairs across."""
    if len(key) < 2 or (comp == comp[0]).all():
        return
    across = (block != block[0]).any()
    width = np.array([len(b) // 8 for b in bits])
    for words in np.unique(width).tolist():
        # Sizes within a band: the larger set's bitmap is as wide, or wider and folded.
        base = np.flatnonzero(width == words)
        until = int(np.searchsorted(size, DENOMINATOR * size[base[-1]] // NUMERATOR, "right"))
        matrix = np.stack([fold(np.frombuffer(b, np.uint64), words) for b in bits[base[0] : until]])
        for i in base.tolist():
            end = int(np.searchsorted(size, DENOMINATOR * size[i] // NUMERATOR, "right"))
            j = np.arange(i + 1, end)
            fit = (comp[j] != comp[i]) & (own[j] | own[i])
            j = j[fit & (block[j] != block[i])] if across else j[fit]
            if len(j):
                differ = np.bitwise_count(matrix[j - base[0]] ^ matrix[i - base[0]]).sum(1, dtype=np.int64)
                j = j[within_bound(differ, size[j] + size[i])]
                if len(j):
                    yield np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j])], 1)


def _second_round(tiles: DataFrame, comps: DataFrame, meta: DataFrame, groups: int) -> DataFrame:
    def large(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lengths, key, size, token in columns(batch, "lengths", "docs", "sizes", "tokens"):
                lengths, key, size, token = (np.frombuffer(x, "<i8") for x in (lengths, key, size, token))
                many = np.repeat(lengths > SMALL_TILE, lengths)
                out = [np.repeat(token, lengths)[many], key[many], size[many]]
                for s in range(0, len(out[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in out], schema=arrow_schema("token long, row_key long, n long"))

    members = tiles.mapInArrow(large, "token long, row_key long, n long")
    members = members.join(comps.select(F.col("v").alias("row_key"), "comp"), "row_key", "left").withColumn("comp", F.coalesce("comp", "row_key"))
    members = materialise(members, "tiles")
    open_tiles = members.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token")
    members = materialise(members.join(open_tiles, "token"), "open")
    # A member stands in the tile of its own size band, and with the band below, whose sets may be
    # linked with it. Tiles beyond TILE_ROWS are cut into blocks, and each pair of blocks is a tile.
    band = F.floor(F.log("n") / float(np.log(DENOMINATOR / NUMERATOR)) + 1e-9).cast("long")
    banded = members.withColumn("b", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own")))))
    banded = banded.select("token", "row_key", "n", "comp", "b.band", "b.own")
    loads = banded.groupBy("token", "band").agg(F.count("*").alias("load"), F.bool_or("own").alias("some"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    loads = loads.filter("some and low < high").select("token", "band", F.ceil(F.col("load") / TILE_ROWS).cast("int").alias("blocks"))
    dealt = banded.join(loads, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("row_key"), F.col("blocks")).cast("int"))
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j")))
    dealt = dealt.withColumn("p", F.explode(with_each)).join(meta.select("row_key", "bits"), "row_key")
    groups = max(groups, members.count() // TILE_ROWS)
    dealt = dealt.select(F.pmod(F.xxhash64("token", "band", "p.i", "p.j"), F.lit(groups)).alias("work"), F.xxhash64("token", "band", "p.i", "p.j").alias("tile"), "row_key", "n", "comp", "own", "block", "bits")

    def compare(rows: pa.Table) -> pa.Table:
        tile, key, size, comp, block = (rows.column(c).to_numpy() for c in ("tile", "row_key", "n", "comp", "block"))
        own, bits = np.array(rows.column("own").to_pylist(), bool), rows.column("bits").to_pylist()
        order = np.lexsort((key, size, tile))
        tile, key, size, comp, own, block, bits = tile[order], key[order], size[order], comp[order], own[order], block[order], [bits[i] for i in order.tolist()]
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]).tolist()
        found: list[np.ndarray] = []
        for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
            found += second_pairs(key[s:e], size[s:e], comp[s:e], bits[s:e], own[s:e], block[s:e])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow_schema(PAIRS))

    return dealt.groupBy("work").applyInArrow(compare, PAIRS).distinct()


def link_components(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(row_key, doc_id, n_shingles, rep, component_key, component_id)`` per document: ``rep`` is
    its class representative, the component the smallest document reachable by links."""
    bounded_batches(docs)
    keyed, plain = with_row_key(docs)
    spark = keyed.sparkSession
    size = input_bytes(keyed)
    cells = sketch_cells(size)
    described = materialise(describe(keyed, cells), "sets")
    meta = described.filter("kind = 0").drop("kind")
    buckets = max(16, -(-size // bucket_bytes))
    levels = spark.sparkContext.broadcast(frequent_levels(described, cells))
    coarse = min(buckets, FANOUT)
    sent = _send(keyed, levels, coarse)
    if buckets > coarse:
        sent = _redeal_shingles(sent, -(-buckets // coarse))
    tiles = materialise(sent.groupBy("bucket").applyInArrow(_tiles, TILES), "tiles")

    near = materialise(_bound(_first_round(tiles), meta), "near")
    links = materialise(_verified(near, keyed, 4 * buckets), "links")
    comps = materialise(star_components(links), "comps")
    more = materialise(_bound_free(_second_round(tiles, comps, meta, 4 * buckets), near), "near")
    if not more.isEmpty():
        links = links.unionByName(_verified(more, keyed, 4 * buckets))
        comps = materialise(star_components(links), "comps")

    sets = meta.select("row_key", "doc_id", "n", "f1", "f2")
    reps = sets.filter("n > 0").groupBy("f1", "f2").agg(F.min("row_key").alias("rep"))
    # One row per class, written first: the class of a third of all documents then meets it in a
    # plain join, whose large side is split where it is skewed.
    classes = reps.join(comps.select(F.col("v").alias("rep"), "comp"), "rep", "left").select("f1", "f2", F.col("rep"), F.coalesce("comp", "rep").alias("comp"), F.lit(True).alias("some"))
    classes = materialise(classes, "classes")
    discard(tiles, near, links, comps)
    full = sets.withColumn("some", F.col("n") > 0).join(classes, ["f1", "f2", "some"], "left")
    full = full.withColumns({"rep": F.coalesce("rep", "row_key"), "component_key": F.coalesce("comp", "row_key")})
    if plain:
        full = full.withColumn("component_id", F.col("component_key"))
    else:
        full = full.join(sets.select(F.col("row_key").alias("component_key"), F.col("doc_id").alias("component_id")), "component_key")
    return full.select("row_key", "doc_id", F.col("n").alias("n_shingles"), "rep", "component_key", "component_id")


def _bound_free(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that round one has not verified already."""
    return pairs.join(done, ["a", "b"], "left_anti")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns: of each component the document with the smallest doc_id stays (of
    rows with equal or null ids, the first by text; of equal rows one)."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.col("doc_id").cast("long")) if ids_are_unique(docs) else numbered(docs, name)
    found = link_components(rows.select(F.col(name).alias("doc_id"), "text"))
    keep = found.filter("row_key = component_key").select(F.col("row_key").alias(name))
    return rows.join(keep, name, "left_semi").select(*docs.columns)
