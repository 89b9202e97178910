"""Packing: concatenate and cut.

Pass 1 tokenizes every document inside its input partition and keeps a running token total; the
encoded rows (16-bit ids) are written once. A prefix sum over the partition totals - one row per
partition - turns the running totals into global offsets. Pass 2 cuts the resulting stream into
fixed windows; each piece is a boundary record (document, start, length, sequence, offset).

Edge cases: a null or empty text is one end-of-document id; repeated rows and repeated doc_ids are
packed once per row; an empty table gives no pieces. Only the very last sequence can be short.
"""

from __future__ import annotations

import itertools
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_schema, batches, bounded_batches, columns, hold, materialise

SEQUENCE_TOKENS = 2048
END_OF_DOCUMENT = 1
#: Distinct words, and pieces of words, whose ids a worker keeps before it forgets them
#: (about 200 bytes each).
CACHE_WORDS, CACHE_PIECES = 400_000, 800_000

ENCODED = "part int, off long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordEncoder:
    """Ids of a text by a white-space-insensitive word tokenizer, as little-endian 16-bit bytes.

    The tokenizer never merges across white space, so ids of a text are the ids of its words in a
    row; those are kept per word. Texts of plain Latin characters are cut further, at the
    tokenizer's own boundaries between letters, digits and signs, so that a word is encoded once
    whatever its case and the signs around it. Everything else goes to the tokenizer as it is.
    """

    #: The tokenizer's own split pattern, over the characters of _PLAIN.
    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
    #: Characters on which the pattern above and the tokenizer's normalizer are known to agree.
    _NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba-\xbb\xbf-įı-ɏ]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same vocabulary and merges for pieces, which are normalized and split already.
        self.piece_tokenizer = Tokenizer.from_file(path)
        self.piece_tokenizer.normalizer = normalizers.Sequence([])
        self.piece_tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _cut(self, word: str) -> list[str]:
        """Pieces of a word; the two commonest shapes need no pattern."""
        if word.isalpha():
            return [word]
        if word[:-1].isalpha() and word[-1] in ".,":
            return [word[:-1], word[-1]]
        return self._SPLIT.findall(word)

    def _learn(self, words: list[str]) -> None:
        """Add words that are not known; pieces that are not known are encoded in one batch."""
        cut, pieces = {w: self._cut(w) for w in words}, self.pieces
        needed = set(itertools.chain.from_iterable(cut.values()))
        new = list(needed.difference(pieces))
        if len(pieces) + len(new) > CACHE_PIECES:
            pieces.clear()
            new = list(needed)
        for piece, encoding in zip(new, self.piece_tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            pieces[piece] = _packed(encoding.ids)
        for w, parts in cut.items():
            self.words[w] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._NOT_PLAIN.search(text) or any(s in text for s in self.specials):
            return self._ids(text)
        words, known = text.lower().split(), self.words
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(words)
            self._learn(list(new))
        return b"".join(map(known.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """Pass 1: one row per document with its ids and its offset within its partition."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("packing", _encoders.clear)
        enc, end = encoder(tokenizer), np.array([end_id], "<u2").tobytes()
        part, off, schema = TaskContext.get().partitionId(), 0, arrow_schema(ENCODED)
        for whole in it:
            for batch in batches(whole):
                ids, offs, counts = [], [], []
                for (text,) in columns(batch, "text"):
                    ids.append(enc.encode(text) + end)
                    counts.append(len(ids[-1]) // 2)
                    offs.append(off)
                    off += counts[-1]
                doc = batch.column(batch.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(offs, pa.int64()), doc, pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def pack(docs: DataFrame, tokenizer: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``; ids are
    little-endian unsigned 32-bit."""
    bounded_batches(docs)
    encoded = materialise(encode(docs, tokenizer or default_tokenizer(), end_id), "encoded")
    # One row per input partition: the only global step, and it never sees documents. The broadcast
    # side is as many rows of 16 bytes as there are input partitions.
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("cutting")
        schema = arrow_schema(PIECES)
        for batch in it:
            out: list[list] = [[] for _ in schema]
            size = 0
            for doc_id, at, n, raw in columns(batch, "doc_id", "at", "n", "ids"):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, sequence_tokens)
                    length = min(n - start, sequence_tokens - offset)
                    for column, value in zip(out, (doc_id, start, length, ids[start : start + length].tobytes(), n, sequence, offset), strict=True):
                        column.append(value)
                    size += 4 * length
                    start += length
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                        out, size = [[] for _ in schema], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    placed = encoded.join(F.broadcast(before), "part").select("doc_id", (F.col("off") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


__all__ = ["pack", "encode", "piece_digests", "WordEncoder"]
