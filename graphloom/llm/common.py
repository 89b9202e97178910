"""Shared parts of the corpus operators: table access, scratch tables, word and window hashes.

Conventions that every operator of this subpackage keeps:

* a null text counts as an empty text;
* only ``doc_id`` and ``text`` (or the named columns) are read, so extra columns, whatever their
  names, are never touched;
* an empty table gives an empty result with the same schema;
* every input row is processed: there are no caps, prefixes or samples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import discard, materialise

#: Words are maximal runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bytes of text hashed at once; what a task holds beside its texts is some ten times that.
BLOCK_BYTES = 1 << 20
#: Rabin-Karp bases.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch of whole texts. Spark's default of 10,000 rows is tens of megabytes in the JVM
#: and in Python, in each direction and for each core.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; its session gets batches of BATCH_ROWS rows, unless it has a setting of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == "10000":
        conf.set(_BATCH_KEY, BATCH_ROWS)
    return df


def ids_are_unique(docs: DataFrame) -> bool:
    """Are all doc_ids there and different? (Reads that column only.)"""
    return docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """All columns, and a unique long in the order (doc_id with nulls first, text)."""
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    return materialise(ordered.withColumn(name, F.monotonically_increasing_id()), "keyed")


def with_row_key(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``(row_key, doc_id, text)`` where ``row_key`` is a unique long in doc_id order, and whether
    it is the doc_id itself.

    Normally doc_id is unique and is its own key. Where ids repeat or are null, rows get a key in
    the order (doc_id with nulls first, text), so each row stays a document of its own.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if ids_are_unique(docs):
        return docs.select(F.col("doc_id").cast("long").alias("row_key"), "doc_id", "text"), True
    return numbered(docs, "row_key").select("row_key", "doc_id", "text"), False


def words_of(text: str | None) -> list[str]:
    """The ASCII-white-space words of a text; Unicode spaces are part of words."""
    if not text:
        return []
    return text.split() if text.isascii() and not _ODD.search(text) else WORD.findall(text)


#: ASCII characters that str.split() takes for white space and the word pattern does not.
_ODD = re.compile(r"[\x1c-\x1f]")


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


#: Windows hash as polynomials modulo a Mersenne prime: modulo a power of two there are words and windows
#: that collide under every base.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_1, _30, _31, _61 = (np.uint64(x) for x in (1, 30, 31, 61))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME, for a and b below it."""
    high, low = np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    a_high, a_low = a >> _31, a & _LOW31
    middle = a_high * low + a_low * high
    return _reduced(((a_high * high) << _1) + (middle >> _30) + ((middle & _LOW30) << _31) + a_low * low)


def window_hashes(h: np.ndarray, width: int, base: int = BASE_A) -> np.ndarray:
    """Rabin-Karp hash (modulo PRIME, put together from windows of 1, 2, 4 ... words) of every window of
    ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, size, power = _reduced(h), 1, base % PRIME
    out, done = None, 0
    while True:
        if width & size:
            rest = part[done:]
            out = rest if out is None else _reduced(_times(out[: len(rest)], power) + rest)
            done += size
        if size * 2 > width:
            return mix(out[:n])
        part = _reduced(_times(part[: len(part) - size], power) + part[size:])
        size, power = size * 2, power * power % PRIME


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A random number for each byte at each of 64 places in a word (tabulation); lower-cased in the other.
_PLACES = 64
_table = np.random.Generator(np.random.PCG64(20250101)).integers(1 << 64, dtype=np.uint64, size=(_PLACES, 256))
_lower_table = _table.copy()
_lower_table[:, 65:91] = _table[:, 97:123]
_LENGTH = np.uint64(0xFF51AFD7ED558CCD)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def _block_hashes(a: np.ndarray, begins: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes; no word goes across an offset in ``begins``."""
    inside = np.zeros(len(a) + 2, bool)
    np.logical_not(_space[a], out=inside[1:-1])
    edge = np.zeros(len(a) + 1, bool)
    edge[begins] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    letters = a[inside[1:-1]]
    long = lengths.max() > _PLACES
    value = (_lower_table if lower else _table).ravel()[((place & (_PLACES - 1)) << 8) | letters]
    if long:
        value = np.where(place < _PLACES, value, mix(value + (place >> 6).astype(np.uint64) * _LENGTH))
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _LENGTH), starts


def batch_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string array in a row, and where each text's words begin
    (one more entry than texts). Polynomial hashes of the UTF-8 bytes, from prefix sums."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at, stop = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    hashes, starts = [], []
    while at < stop:
        end = min(at + BLOCK_BYTES, stop)
        if end < stop:  # cut at white space, or at the end of a word longer than a block
            gaps = np.flatnonzero(_space[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(_space[data[end:stop]])
                end = end + int(rest[0]) if len(rest) else stop
        own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        h, s = _block_hashes(data[at:end], own, lower)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def batch_windows(h: np.ndarray, bounds: np.ndarray, width: int, base: int = BASE_A) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and position of every window of ``width`` words inside one text."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    position = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return window_hashes(h, width, base)[position + bounds[:-1][text]] if len(text) else np.empty(0, np.uint64), text, position


def word_hashes(words: list[str], lower: bool = False) -> np.ndarray:
    return batch_hashes(pa.array([" ".join(words)]), lower)[0]


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of the ``width``-word shingles of its words, A-Z
    lower-cased; a text with fewer words has one shingle, a text without words none."""
    h, bounds = batch_hashes(texts, lower=True)
    w = window_hashes(h, width)
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(w[s : e - width + 1]) if e - s >= width else window_hashes(h[s:e], e - s) if e > s else h[:0])
    return out


def word_ids(texts: pa.Array, lower: bool = False) -> np.ndarray:
    """All words of a string array in a row as numbers: equal if and only if the words are, in this array."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower and texts.nbytes:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))
    found = pc.ascii_split_whitespace(texts).flatten()
    return found.filter(pc.not_equal(found, "")).dictionary_encode().indices.to_numpy()


def sequence_digests(texts: pa.Array, lower: bool = False) -> list[bytes]:
    """BLAKE2b (128 bits) of each text's words in order: different for different words."""
    raw = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()
    return [hashlib.blake2b(b" ".join((x.lower() if lower else x).split()), digest_size=16).digest() for x in raw]


def raw_windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every shingle of every text (A-Z lower-cased; one of all its words for a text with fewer): hash,
    text number, number of its first word in the whole array, and words."""
    h, bounds = batch_hashes(texts, lower=True)
    w, number, position = batch_windows(h, bounds, width)
    at, size = bounds[:-1][number] + position if len(number) else number, np.full(len(w), width)
    words = np.diff(bounds)
    few = np.flatnonzero((words > 0) & (words < width))
    if len(few):
        w = np.r_[w, np.concatenate([window_hashes(h[bounds[i] : bounds[i + 1]], int(words[i])) for i in few])]
        number, at, size = np.r_[number, few], np.r_[at, bounds[few]], np.r_[size, words[few]]
    return w, number, at, size


def exact_shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: number (equal if and only if the words are, in this array),
    text number and hash; sorted by text, then hash."""
    w, number, at, size = raw_windows(texts, width)
    if not len(w):
        return number, number, w
    ids = np.r_[word_ids(texts, lower=True), np.zeros(width, np.int32)]
    order = np.argsort(w, kind="stable")
    same_hash = w[order][1:] == w[order][:-1]

    def changes(order: np.ndarray) -> np.ndarray:
        x, y = order[1:][same_hash], order[:-1][same_hash]
        out = ~same_hash
        out[same_hash] = (size[x] != size[y]) | np.any([(ids[at[x] + k] != ids[at[y] + k]) & (k < size[x]) for k in range(width)], axis=0)
        return out

    new = changes(order)
    if (new != ~same_hash).any():  # different shingles with one hash: order them by their words
        order = np.lexsort((*(np.where(k < size, ids[at + k], -1) for k in range(width)), w))
        new = changes(order)
    label = np.empty(len(w), np.int64)
    label[order] = np.r_[0, np.cumsum(new)]
    # Labels ascend with the hash.
    order = np.lexsort((label, number))
    label, number, w = label[order], number[order], w[order]
    first = np.r_[True, (label[1:] != label[:-1]) | (number[1:] != number[:-1])]
    return label[first], number[first], w[first]


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None] | None = None) -> None:
    """Worker processes live on from stage to stage. What an operator keeps in one from task to task
    (``release`` forgets it) goes when another operator's tasks come."""
    for other in [name for name in _held if name != owner]:
        _held.pop(other)()
    if release is not None:
        _held[owner] = release


#: Buckets that one task deals to at most. Beyond it packed rows would hold a few entries each, so data
#: are dealt twice: to FANOUT coarse buckets, and from each of those to its share of the fine ones.
FANOUT = 4096
#: Entries that a task of the second deal holds before it sends them on.
REDEAL_ENTRIES = 4_000_000


def redealt(rows: DataFrame, key: str, schema: str, decode: Callable, encode: Callable) -> DataFrame:
    """The second deal: ``rows`` meet by their coarse ``key`` and go out packed by fine keys.
    ``decode(row dict) -> (coarse, entries, count)``; ``encode(coarse, list of entries) -> rows``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for coarse, entries in held.items():
                if out := encode(coarse, entries):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow_schema(schema), strict=True)], schema=arrow_schema(schema))

        for batch in it:
            for row in batch.to_pylist():
                coarse, entries, n = decode(row)
                held.setdefault(coarse, []).append(entries)
                count += n
                if count >= REDEAL_ENTRIES:
                    yield from flush()
                    held, count = {}, 0
        yield from flush()

    return rows.repartition(key).mapInArrow(run, schema)


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def batches(batch: pa.RecordBatch, limit_bytes: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """Slices of a batch, so that what is built for one slice stays small whatever the rows' length."""
    start, total = 0, 0
    sizes = [n or 0 for n in pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_pylist()]
    for i, n in enumerate(sizes):
        total += n
        if total >= limit_bytes:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` (for a scan, its files' size)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, lowest first: the mostly empty high planes then compress."""
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4 if values.max() < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return np.ascontiguousarray(raw).view(f"<u{width}").ravel().astype(np.int64)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(fields)
