"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (powers of two). The sketch of an item is
its bottom-k MinHash: the k smallest shingle hashes, k = u - ceil(t * u) + 1 for the upper size u
of its partition. A document that holds at least t of an item's shingles misses at most
u - ceil(t * u) of them, so it holds one of the sketch's: no qualifying pair is lost, however
long the document is. Documents look up all their shingle hashes in the sketches; candidates are
verified by exact containment over the shingles' words.

The item side is processed in blocks of bounded size (``BLOCK_SHINGLES``), so what a task holds
does not depend on the size of the benchmark: beyond one block there are more passes, not more memory.

Words are runs without ASCII white space, A-Z lower-cased. An item with fewer than five words is
one shingle of its own length. Null or empty items and documents match nothing. Repeated items or
documents each give their own rows. Very long texts are searched whole; empty tables of either kind give
an empty result, and ``clean`` then keeps all. Other columns are not read, and kept by ``clean``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, ascii_lower, batch_hashes, batch_windows, batches, bounded_batches, hold, window_hashes, word_hashes, words_of

WIDTH = 5
#: Containment from which an item counts as found.
THRESHOLD = 0.8
#: Shingles of the items that one pass holds in each task (about 100 bytes each).
BLOCK_SHINGLES = 500_000

MATCHES = "doc_id long, item_id long, n_item long, n_shared long, containment double"
_FILTER_BITS = 20


class ItemBlock:
    """The sketches of some items, and their shingles for verification."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.items, self.threshold = {}, threshold
        sketch: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for row, (item_id, text) in enumerate(items):
            words = words_of(ascii_lower(text or ""))
            if not words:
                continue
            k = min(width, len(words))
            shingles = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
            hashes = np.unique(window_hashes(word_hashes(words), k))
            self.items[row] = (item_id, k, shingles)
            upper = 1
            while upper < len(hashes):
                upper *= 2
            keep = upper - int(np.ceil(threshold * upper - 1e-9)) + 1
            for h in hashes[:keep].tolist():
                sketch[k][h].append(row)
        self.sketch = {k: dict(v) for k, v in sketch.items()}
        self.keys, self.bits = {}, {}
        for k, v in self.sketch.items():
            self.keys[k] = np.array(sorted(v), np.uint64)
            self.bits[k] = np.zeros(1 << _FILTER_BITS, bool)
            self.bits[k][self.keys[k] & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def candidates(self, texts: pa.Array) -> dict[int, set[int]]:
        """Rows of the items whose sketch has a shingle of the text, by text number."""
        out: dict[int, set[int]] = defaultdict(set)
        h, bounds = batch_hashes(texts, lower=True)
        for k, keys in self.keys.items():
            w, number, _ = batch_windows(h, bounds, k)
            hit = np.flatnonzero(self.bits[k][w & np.uint64((1 << _FILTER_BITS) - 1)])
            hit = hit[np.isin(w[hit], keys)]
            for x, n in zip(w[hit].tolist(), number[hit].tolist(), strict=True):
                out[n].update(self.sketch[k][x])
        return out

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item_id, item's shingles, shared shingles) of each item found in a text."""
        for number, rows in sorted(self.candidates(texts).items()):
            words = words_of(ascii_lower(texts[number].as_py()))
            own = {k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} for k in {self.items[r][1] for r in rows}}
            for r in sorted(rows):
                item_id, k, shingles = self.items[r]
                shared = len(shingles & own[k])
                if shared >= self.threshold * len(shingles) - 1e-9:
                    yield number, item_id, len(shingles), shared


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``limit`` words, read one partition at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") // 6 + 1
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` of each item found in each document."""
    bounded_batches(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(block: list[tuple[int, str]]):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hold("decontamination")
            index, schema = ItemBlock(shared.value, width, threshold), arrow_schema(MATCHES)
            for batch in (b for whole in it for b in batches(whole)):
                doc = batch.column(0)
                rows = [(doc[number].as_py(), i, n, s, s / n) for number, i, n, s in index.find(batch.column(1))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        return slim.mapInArrow(run, MATCHES)

    found = [search(block) for block in _blocks(items, block_shingles)]
    return reduce(DataFrame.unionByName, found) if found else slim.sparkSession.createDataFrame([], MATCHES)


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents in which no item is found, with all their columns: one narrow pass per block."""
    bounded_batches(docs)
    for block in _blocks(items, block_shingles):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hold("decontamination")
            index = ItemBlock(shared.value, width, threshold)
            for batch in (b for whole in it for b in batches(whole)):
                keep = np.ones(batch.num_rows, bool)
                keep[[number for number, *_ in index.find(batch.column(batch.schema.get_field_index("text")))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
