"""Substring deduplication: Rabin-Karp hashes of every window of 20 words, counted by bucket.

1. Every window of every document gets two rolling hashes: one that identifies it, and an independent
   one that deals it to a bucket. A task sorts its slice of documents, keeps the first occurrence of
   each window in the slice and marks the others at once (pre-aggregation: however frequent a window
   is, a slice sends it once); marks are dealt by the group of their document. First occurrences go to
   their buckets as packed arrays, one row per slice and bucket.
2. Each bucket finds the hashes that occur more than once; all but the first occurrence (smallest
   document, then position) are marked. A mark names the earlier occurrence it was found equal to.
3. Marks meet by document and become runs: windows in a row that equal windows in a row elsewhere.
4. Verification: a run is cut into chunks at every ``ALIGN`` words of the earlier document, and both
   documents give the 128-bit BLAKE2b digest of a chunk's words. The cuts make chunks of different
   documents equal, so a passage that a third of all documents hold asks its first document once.
5. In the same pass the words inside marked windows, merged into maximal intervals, are removed.

Equal hashes only propose. Where a chunk's digests differ (hashes collide), its windows are judged
again among all windows of the corpus with their hashes, by the digests of their words, and the
documents are cut anew. So windows are equal by their words, to within a cryptographic digest.

A window travels with 48 bits of its hash up to ``FANOUT`` buckets and with 64 beyond, where the packed
arrays are dealt in two steps, so a row always carries many entries. The number of buckets follows the
input size, so what one bucket holds does not grow with the input; a slice is bounded in bytes.

A null or empty text has no words. Documents with equal or null doc_ids stay documents of their
own, in the order (doc_id with nulls first, text). A text below 20 words is never changed. An empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BASE_A, BASE_B, FANOUT, arrow_schema, batch_hashes, batch_windows, batches, bounded_batches, columns, discard, from_planes, hold, input_bytes, materialise, planes, redealt, with_row_key, words_of

WIDTH = 20
#: Bytes of input files per bucket, and per group of documents in the last step.
BUCKET_BYTES = 4 << 20
#: Runs are cut for verification at multiples of this many words of the earlier document.
ALIGN = 128
#: Hashes judged again in one pass over the texts.
BLOCK_HASHES = 1_000_000

SENT = "bucket long, docs binary, refs binary, shifts binary, counts binary, positions binary, hashes binary"
MARKED = "grp long, docs binary, refs binary, shifts binary, counts binary, positions binary"
#: Windows start .. start + n - 1 of a document equal those from rstart on of document rdoc.
RUNS = "grp long, doc long, start long, n long, rdoc long, rstart long"
#: What the last pass gives: kind 0 the result of a document, kind 1 the digest of a chunk.
OUT = "kind int, doc_id long, n_words long, n_removed long, removed string, kept string, doc long, start long, n long, digest binary"
#: What a group of documents gets: kind 0 runs, kind 1 chunks asked for, kind 2 windows not to mark.
ASKED = "grp long, kind int, doc long, start long, n long"


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    n = len(keys[0])
    starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if n else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, n])


def _steps(pos: np.ndarray, starts: np.ndarray) -> bytes:
    step = np.diff(pos, prepend=0)
    step[starts] = pos[starts]
    return planes(step)


def _positions(n: np.ndarray, steps: bytes) -> np.ndarray:
    total = np.cumsum(from_planes(steps))
    ends = np.cumsum(n)
    before = np.r_[0, total[ends[:-1] - 1]] if len(n) else np.empty(0, np.int64)
    return total - np.repeat(before, n)


def pack_windows(doc: np.ndarray, pos: np.ndarray) -> tuple[bytes, None, None, bytes, bytes]:
    """Positions sorted by (doc, pos) as document keys, counts and position steps."""
    starts, counts = _runs(doc)
    return doc[starts].astype("<i8").tobytes(), None, None, planes(counts), _steps(pos, starts)


def pack_marks(doc: np.ndarray, pos: np.ndarray, ref: np.ndarray, rpos: np.ndarray) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """Positions sorted by (doc, pos), and the earlier occurrence of each."""
    shift = rpos - pos
    starts, counts = _runs(doc, ref, shift)
    signed = shift[starts]
    return doc[starts].astype("<i8").tobytes(), ref[starts].astype("<i8").tobytes(), planes(np.where(signed < 0, -2 * signed - 1, 2 * signed)), planes(counts), _steps(pos, starts)


def unpack_windows(docs: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = from_planes(counts)
    return np.repeat(np.frombuffer(docs, "<i8"), n), _positions(n, steps)


def unpack_marks(docs: bytes, refs: bytes, shifts: bytes, counts: bytes, steps: bytes) -> np.ndarray:
    """Rows of doc, position, earlier doc, its position."""
    n, shift = from_planes(counts), from_planes(shifts)
    pos = _positions(n, steps)
    shift = np.where(shift & 1, -(shift + 1) // 2, shift // 2)
    return np.stack([np.repeat(np.frombuffer(docs, "<i8"), n), pos, np.repeat(np.frombuffer(refs, "<i8"), n), pos + np.repeat(shift, n)])


def _bytes_of(a: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each hash."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _hashes_of(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a key belongs to; group_column says the same in SQL."""
    return (doc ^ (doc >> 7) ^ (doc >> 15)) % groups


def group_column(groups: int, name: str = "row_key") -> Column:
    key = F.col(name)
    return F.pmod(key.bitwiseXOR(F.shiftright(key, 7)).bitwiseXOR(F.shiftright(key, 15)), F.lit(groups))


def _first_of(order: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each element the one that is first in ``order`` (sorted by value) among its equals."""
    starts, counts = _runs(value[order])
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(order[starts], counts)
    return out


def _by_group(group: np.ndarray, marks: np.ndarray) -> list[tuple]:
    order = np.lexsort((marks[1], marks[0], group))
    group, marks = group[order], marks[:, order]
    starts, counts = _runs(group)
    return [(int(group[s]), *pack_marks(*marks[:, s : s + n])) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]


def _dealt(bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray, a: np.ndarray, size: int) -> list[tuple]:
    """Rows of SENT from windows sorted by (bucket, doc, position)."""
    starts, counts = _runs(bucket)
    return [(int(bucket[s]), *pack_windows(doc[s : s + n], pos[s : s + n]), _bytes_of(a[s : s + n], size)) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]


def _hashed(batch: pa.RecordBatch, width: int, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Identifying hash, dealing hash, document key and position of each window of ``(row_key, text)``."""
    h, bounds = batch_hashes(batch.column(1), lower=False)
    a, number, pos = batch_windows(h, bounds, width, BASE_A)
    b = batch_windows(h, bounds, width, BASE_B)[0]
    return a & np.uint64(mask), b & np.uint64(mask), batch.column(0).to_numpy(zero_copy_only=False)[number], pos


def _send(docs: DataFrame, width: int, buckets: int, size: int, mask: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("substrings")
        for whole in it:
            for batch in batches(whole):
                a, b, doc, pos = _hashed(batch.sort_by("row_key"), width, mask)
                if not len(a):
                    continue
                first = _first_of(np.argsort(a, kind="stable"), a)
                again = np.flatnonzero(first != np.arange(len(a)))
                out = []
                if len(again):
                    # Later occurrences within the slice are known already and need no hash.
                    marks = np.stack([doc[again], pos[again], doc[first[again]], pos[first[again]]])
                    out = [(g, *row, None) for g, *row in _by_group(_group_of(marks[0], buckets), marks)]
                    keep = first == np.arange(len(a))
                    a, b, doc, pos = a[keep], b[keep], doc[keep], pos[keep]
                bucket = ((b >> np.uint64(16 if mask >> 32 else 0)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                yield _batch(out + _dealt(bucket[order], doc[order], pos[order], a[order], size), SENT)

    return docs.mapInArrow(run, SENT)


def _redeal_windows(sent: DataFrame, fan: int, size: int) -> DataFrame:
    """From coarse buckets to ``fan`` fine ones each, by other bits of the hash."""

    def decode(row: dict):
        if row["hashes"] is None:
            marks = unpack_marks(*(row[c] for c in ("docs", "refs", "shifts", "counts", "positions")))
            return row["bucket"], marks, marks.shape[1]
        doc, pos = unpack_windows(row["docs"], row["counts"], row["positions"])
        return row["bucket"], (doc, pos, _hashes_of(row["hashes"], size)), len(doc)

    def encode(coarse: int, entries: list) -> list[tuple]:
        known = [x for x in entries if isinstance(x, np.ndarray)]
        windows = [x for x in entries if not isinstance(x, np.ndarray)]
        out = []
        if windows:
            doc, pos, a = map(np.concatenate, zip(*windows, strict=True))
            # Of a window that many slices have sent only the first goes on with its hash.
            first = _first_of(np.lexsort((pos, doc, a)), a)
            again = np.flatnonzero(first != np.arange(len(a)))
            known.append(np.stack([doc[again], pos[again], doc[first[again]], pos[first[again]]]))
            keep = np.flatnonzero(first == np.arange(len(a)))
            fine = ((a[keep] >> np.uint64(33)) % np.uint64(fan)).astype(np.int64)
            order = keep[np.lexsort((pos[keep], doc[keep], fine))]
            out = _dealt(coarse * fan + np.sort(fine), doc[order], pos[order], a[order], size)
        marks = np.concatenate(known, axis=1)
        return out + [(coarse * fan + g, *row, None) for g, *row in _by_group(_group_of(marks[0], fan), marks)]

    return redealt(sent, "bucket", SENT, decode, encode)


def _redeal_marks(marked: DataFrame, groups: int) -> DataFrame:
    """From coarse groups of documents to the fine ones."""

    def decode(row: dict):
        marks = unpack_marks(*(row[c] for c in ("docs", "refs", "shifts", "counts", "positions")))
        return row["grp"], marks, marks.shape[1]

    def encode(coarse: int, entries: list) -> list[tuple]:
        marks = np.concatenate(entries, axis=1)
        return _by_group(_group_of(marks[0], groups), marks)

    return redealt(marked, "grp", MARKED, decode, encode)


def _mark(groups: int, coarse: int, size: int):
    def run(rows: pa.Table) -> pa.Table:
        doc, pos, hashes, known = [], [], [], []
        for d, r, x, c, p, h in columns(rows, "docs", "refs", "shifts", "counts", "positions", "hashes"):
            if h is None:
                known.append(unpack_marks(d, r, x, c, p))
            else:
                own = unpack_windows(d, c, p)
                doc.append(own[0])
                pos.append(own[1])
                hashes.append(_hashes_of(h, size))
        if hashes:
            doc, pos, a = (np.concatenate(x) for x in (doc, pos, hashes))
            order = np.argsort(a)
            s = a[order]
            same = s[1:] == s[:-1]
            pick = order[np.r_[False, same] | np.r_[same, False]]
            pick = pick[np.lexsort((pos[pick], doc[pick], a[pick]))]
            starts, counts = _runs(a[pick])
            first = np.repeat(pick[starts], counts)
            later = first != pick
            known.append(np.stack([doc[pick[later]], pos[pick[later]], doc[first[later]], pos[first[later]]]))
        marks = np.concatenate(known, axis=1)
        return pa.Table.from_batches([_batch(_by_group(_group_of(marks[0], groups) % coarse, marks), MARKED)])

    return run


def _gather(rows: pa.Table) -> pa.Table:
    """The runs of a group of documents."""
    found = [unpack_marks(*row) for row in columns(rows, "docs", "refs", "shifts", "counts", "positions")]
    marks = np.concatenate(found, axis=1)
    doc, pos, ref, rpos = marks[:, np.lexsort((marks[1], marks[0]))]
    starts, counts = _runs(doc, ref, rpos - pos, pos - np.arange(len(pos)))
    own = [np.full(len(starts), rows.column("grp")[0].as_py() if len(rows) else 0), doc[starts], pos[starts], counts, ref[starts], rpos[starts]]
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in own], schema=arrow_schema(RUNS))


def chunks(runs: DataFrame, width: int, align: int = ALIGN) -> DataFrame:
    """``(doc, start, n, rdoc, rstart)``: the words of each run, cut where the earlier document's word
    numbers are multiples of ``align``."""
    end = F.col("rstart") + F.col("n") + (width - 1)
    each = runs.withColumn("end", end).withColumn("k", F.explode(F.sequence(F.floor(F.col("rstart") / align), F.floor((end - 1) / align))))
    low, high = F.greatest("rstart", F.col("k") * align), F.least("end", (F.col("k") + 1) * align)
    return each.select("doc", (F.col("start") + low - F.col("rstart")).alias("start"), (high - low).alias("n"), "rdoc", low.alias("rstart"))


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals covered by windows at the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + width)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + width).tolist(), strict=True))


def remove(words: list[str], starts: np.ndarray, width: int) -> tuple[int, int, str, str]:
    """Words, removed words, the intervals as text, and the kept words joined by one space."""
    spans = intervals(starts, width)
    kept, at = [], 0
    for s, e in spans:
        kept += words[at:s]
        at = e
    kept += words[at:]
    return len(words), len(words) - len(kept), ",".join(f"{s}:{e}" for s, e in spans), " ".join(kept)


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _by_doc(asked: pa.Table) -> dict[int, dict[int, list[tuple[int, int]]]]:
    out: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for doc, kind, start, n in columns(asked, "doc", "kind", "start", "n"):
        out.setdefault(doc, {}).setdefault(kind, []).append((start, n))
    return out


def _apply(width: int, texts: bool):
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        of_doc, rows = _by_doc(asked), []
        for key, doc_id, text in columns(docs, "row_key", "doc_id", "text"):
            own, words = of_doc.get(key, {}), words_of(text)
            starts = np.sort(np.concatenate([np.arange(s, s + n) for s, n in own.get(0, ())] or [np.empty(0, np.int64)]))
            if 2 in own:
                starts = starts[~np.isin(starts, [s for s, _ in own[2]])]
            n, gone, spans, kept = remove(words, starts, width)
            rows.append((0, doc_id, n, gone, spans, kept if texts else hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), None, None, None, None))
            rows += [(1, None, None, None, None, None, key, s, m, _digest(words[s : s + m])) for s, m in set(own.get(1, ()))]
        return pa.Table.from_batches([_batch(rows, OUT)])

    return run


def _windows_again(width: int, mask: int):
    """Hash and digest of single windows of the documents."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        of_doc, rows = _by_doc(asked), []
        for batch in docs.select(["row_key", "text"]).to_batches():
            a, _, doc, pos = _hashed(batch, width, mask)
            first = dict(zip(*(x.tolist() for x in np.unique(doc, return_index=True)), strict=True))
            for key, text in columns(batch, "row_key", "text"):
                words = words_of(text) if key in of_doc else []
                rows += [(key, s, int(a[first[key] + s].view(np.int64)), _digest(words[s : s + width])) for s in {s for s, _ in of_doc.get(key, {}).get(2, ())}]
        return pa.Table.from_batches([_batch(rows, "doc long, start long, hash long, digest binary")])

    return run


def _firsts(keyed: DataFrame, suspects: DataFrame, width: int, mask: int, block: int) -> DataFrame:
    """First occurrence of each window whose hash a suspect has: ``(digest, doc, start)``. One pass over
    the texts for each block of hashes."""
    found = None
    held: list[int] = []

    def passed(hashes: list[int]) -> DataFrame:
        shared = keyed.sparkSession.sparkContext.broadcast(np.sort(np.array(hashes, np.int64)).view(np.uint64))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in it:
                for batch in batches(whole):
                    a, _, doc, pos = _hashed(batch, width, mask)
                    keys = batch.column(0).to_pylist()
                    texts = dict(zip(keys, batch.column(1).to_pylist(), strict=True))
                    hit = np.flatnonzero(np.isin(a, shared.value))
                    rows, words = [], (None, [])
                    for key, s in zip(doc[hit].tolist(), pos[hit].tolist(), strict=True):
                        words = words if words[0] == key else (key, words_of(texts[key]))
                        rows.append((_digest(words[1][s : s + width]), key, s))
                    yield _batch(rows, "digest binary, doc long, start long")

        rows = keyed.select("row_key", "text").mapInArrow(run, "digest binary, doc long, start long")
        return rows.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"))

    for (x,) in suspects.select("hash").distinct().toLocalIterator():
        held.append(x)
        if len(held) == block:
            found, held = passed(held) if found is None else found.unionByName(passed(held)), []
    if held:
        found = passed(held) if found is None else found.unionByName(passed(held))
    return found


def deduplicate(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES, texts: bool = True, hash_mask: int = (1 << 64) - 1) -> DataFrame:
    """``(doc_id, n_words, n_removed, removed, kept_text)`` per document; ``removed`` lists the
    maximal removed intervals in words. Without ``texts`` there is ``kept_sha256`` in place of the text.
    Bits outside ``hash_mask`` are not used of hashes (few bits: many collisions, the same result)."""
    bounded_batches(docs)
    keyed, _ = with_row_key(docs)
    buckets = max(16, -(-input_bytes(keyed) // bucket_bytes))
    coarse = min(buckets, FANOUT)
    size = 6 if buckets == coarse else 8
    sent = _send(keyed.select("row_key", "text"), width, coarse, size, hash_mask)
    if buckets > coarse:
        sent = _redeal_windows(sent, -(-buckets // coarse), size)
    marked = sent.groupBy("bucket").applyInArrow(_mark(buckets, coarse, size), MARKED)
    if buckets > coarse:
        marked = _redeal_marks(marked, buckets)
    runs = materialise(marked.groupBy("grp").applyInArrow(_gather, RUNS), "runs")
    grouped = keyed.withColumn("grp", group_column(buckets))

    def asked(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select(group_column(buckets, "doc").alias("grp"), F.lit(kind).alias("kind"), "doc", "start", "n")

    def meet(rows: DataFrame, function, schema: str) -> DataFrame:
        return grouped.groupBy("grp").cogroup(rows.groupBy("grp")).applyInArrow(function, schema)

    cut = chunks(runs, width)
    base = cut.select(F.col("rdoc").alias("doc"), F.col("rstart").alias("start"), "n").distinct()
    out = materialise(meet(asked(runs, 0).union(asked(cut, 1)).union(asked(base, 1)), _apply(width, texts), OUT), "kept")
    digests = out.filter("kind = 1").select("doc", "start", "n", "digest")
    both = cut.join(digests, ["doc", "start", "n"]).join(digests.toDF("rdoc", "rstart", "n", "other"), ["rdoc", "rstart", "n"])
    wrong = materialise(both.filter("digest <> other").select("doc", "start", "n"), "wrong")
    if not wrong.isEmpty():
        # All marked windows that touch such a chunk.
        near = runs.select("doc", F.col("start").alias("s"), F.col("n").alias("m")).join(wrong, "doc")
        low, high = F.greatest("s", F.col("start") - (width - 1)), F.least(F.col("s") + F.col("m"), F.col("start") + F.col("n")) - 1
        suspects = near.filter(low <= high).select("doc", F.explode(F.sequence(low, high)).alias("start")).distinct().withColumn("n", F.lit(1).cast("long"))
        suspects = materialise(meet(asked(suspects, 2), _windows_again(width, hash_mask), "doc long, start long, hash long, digest binary"), "suspects")
        judged = suspects.join(_firsts(keyed, suspects, width, hash_mask, BLOCK_HASHES), "digest")
        spared = judged.filter((F.col("first.doc") == F.col("doc")) & (F.col("first.start") == F.col("start"))).select("doc", "start", F.lit(1).cast("long").alias("n"))
        discard(out)
        out = materialise(meet(asked(runs, 0).union(asked(spared, 2)), _apply(width, texts), OUT), "kept")
        discard(suspects)
    discard(runs, wrong)
    return out.filter("kind = 0").select("doc_id", "n_words", "n_removed", "removed", F.col("kept").alias("kept_text" if texts else "kept_sha256"))


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", "kept_sha256")
