"""Toxicity scores: a learned lexicon as a trie, intersected with Levenshtein automata.

Learning (from labelled rows outside the held-out fold, at most ``TRAIN_ROWS`` of them, taken by
the order of a hash):

* words and word beginnings of 4 to 9 letters that occur in far more toxic than other texts become
  lexicon terms. Support is counted over distinct MinHash keys, so a text copied a thousand times
  counts about once;
* misspellings: a word within one edit (more would reach other words) of a term of five or more letters is a hit too, found by
  walking the trie with the word's automaton. A term whose misspellings turn up in other texts
  loses them;
* a logistic model over the hits, their density and their context gives the score.

Context window: a hit within quotation marks of its line, or with a reporting word within five
words before it, counts as quoted and as nothing else: it adds neither to the evidence nor to the
density. One with a second-person word or another hit within five words counts as aimed.

Scores use the text only - not labels, lang, source or doc_id. Null and empty texts get the score
of a text without hits. Repeated rows and null ids are scored one by one, very long texts whole; an empty
table gives an empty result; a null id is in no fold. Other columns are not read. With no labelled rows at all every
score is 0.5 less a hair, so nothing is rejected.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, batches, bounded_batches, columns, hold, materialise, shingle_sets

#: Bound of the labelled sample that the lexicon and the model are fitted on.
TRAIN_ROWS = 20_000
#: A term needs this support at least, and one in a hundred of the toxic texts: their terms are then at most
#: a hundred times the distinct words and stems of a text, so the lexicon is bounded without a cut.
MIN_SUPPORT, MIN_LIFT = 6, 20.0
STEM_LENGTHS = (4, 5, 6, 7, 8, 9)
FUZZY_LENGTH = 5
WINDOW = 5
#: Words whose hit a worker remembers.
CACHE_WORDS = 200_000
#: Rows of term counts that a worker holds before it sends them on.
FLUSH_ROWS = 20_000

WORD = re.compile(r"[^\W_]+(?:[*@$!][^\W_]+)*")
QUOTES, BREAK = re.compile("[\"“”„«»‹›]"), re.compile("\n")
REPORTING = frozenset("said says called calls wrote quote quoted word term insult sagte nannte schrieb wort dit appelle mot dijo llama palabra".split())
ADDRESS = frozenset("you your youre u are ihr du dich dein sie tu toi vous ton te eres usted".split())

SCORED = "doc_id long, score double"


class Lexicon:
    """Terms by kind: ``word`` and ``stem`` (a beginning), each with a log-odds weight."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.fuzzy = {w: s for w, s in words.items() if len(w) >= FUZZY_LENGTH}
        self._build()

    def _build(self) -> None:
        self.trie: dict = {}
        for term in self.fuzzy:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        # One edit leaves the first two letters of a term as they are, or the last two.
        self.begins, self.ends = {t[:2] for t in self.fuzzy}, {t[-2:] for t in self.fuzzy}
        self.seen: dict[str, tuple[str, str] | None] = {}

    def drop_fuzzy(self, terms: set[str]) -> None:
        self.fuzzy = {w: s for w, s in self.fuzzy.items() if w not in terms}
        self._build()

    def near(self, word: str) -> str | None:
        """The first term within one edit, by walking the trie and the word's automaton together.
        The automaton's states are bit sets: positions reached with no edit and with one."""
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        accept, full = 1 << len(word), (1 << len(word) + 1) - 1
        work = [(self.trie, 1, 3)]
        while work:
            node, exact, edited = work.pop()
            for c, child in node.items():
                if c == "":
                    if (exact | edited) & accept:
                        return child
                    continue
                m = at.get(c, 0)
                e0 = (exact & m) << 1
                e1 = ((edited & m) << 1 | exact | exact << 1 | e0 << 1) & full
                if e0 | e1:
                    work.append((child, e0, e1))
        return None

    def hit(self, word: str) -> tuple[str, str] | None:
        """(kind, term) of a lower-cased word."""
        if word in self.words:
            return "word", word
        if stems := [word[:n] for n in STEM_LENGTHS if n <= len(word) and word[:n] in self.stems]:
            return "stem", max(stems, key=self.stems.__getitem__)
        if len(word) >= FUZZY_LENGTH - 1 and (word[:2] in self.begins or word[-2:] in self.ends) and (term := self.near(word)):
            return "fuzzy", term
        return None

    def hits(self, words: set[str]) -> dict[str, tuple[str, str]]:
        out, seen = {}, self.seen
        if len(seen) > CACHE_WORDS:
            seen.clear()
        for w in words:
            try:
                found = seen[w]
            except KeyError:
                found = seen[w] = self.hit(w)
            if found:
                out[w] = found
        return out


FEATURES = ("word", "stem", "fuzzy", "aimed", "quoted", "density", "evidence")


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    counts = dict.fromkeys(FEATURES, 0.0)
    low = (text or "").lower()
    found = lexicon.hits(set(WORD.findall(low)))
    if found:
        words = [(m.group(), m.start()) for m in WORD.finditer(low)]
        where = [i for i, (w, _) in enumerate(words) if w in found]
        spoken = []
        marks, breaks = ([m.start() for m in p.finditer(low)] for p in (QUOTES, BREAK))
        hit_at = set(where)
        for i in where:
            kind, _ = found[words[i][0]]
            start = words[i][1]
            line = breaks[at - 1] if (at := bisect_left(breaks, start)) else -1
            before = {w for w, _ in words[max(0, i - WINDOW) : i]}
            around = before | {w for w, _ in words[i + 1 : i + 1 + WINDOW]}
            open_quote = (bisect_left(marks, start) - bisect_right(marks, line)) % 2 == 1
            if open_quote or before & REPORTING:
                counts["quoted"] += 1
                continue
            counts[kind] += 1
            spoken.append(i)
            if around & ADDRESS or any(j in hit_at for j in range(i - WINDOW, i + WINDOW + 1) if j != i):
                counts["aimed"] += 1
        weight = {"word": lexicon.words, "stem": lexicon.stems, "fuzzy": lexicon.fuzzy}
        counts["evidence"] = sum(max(0.0, weight[k][t] - 2) for k, t in (found[words[i][0]] for i in spoken))
        counts["density"] = 10 * len(spoken) / len(words)
    return [math.log1p(counts[f]) for f in FEATURES]


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + float(np.dot(self.weights, features(text, self.lexicon)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic model, by damped Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty @ w
        hessian = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id="doc_id"):
    """The fold that labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    chosen = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` rows of two numbers.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def _term_batch(rows: set) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["kind", "term", "toxic", "key"])


def _term_counts(sample: DataFrame) -> DataFrame:
    """(kind, term, toxic, support) over distinct MinHash keys of the sample's texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity terms")
        rows: set = set()
        for batch in (b for whole in it for b in batches(whole, 1 << 20)):
            keys = [int(s[0] >> np.uint64(1)) if len(s) else 0 for s in shingle_sets(batch.column(1))]
            for key, toxic, text in zip(keys, batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(WORD.findall((text or "").lower())):
                    if len(w) >= 3:
                        rows.add((0, w, toxic, key))
                    rows.update((1, w[:n], toxic, key) for n in STEM_LENGTHS if len(w) >= n)
                    if len(rows) >= FLUSH_ROWS:
                        yield _term_batch(rows)
                        rows = set()
        if rows:
            yield _term_batch(rows)

    return sample.mapInArrow(run, "kind int, term string, toxic int, key long").distinct().groupBy("kind", "term").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    bounded_batches(docs)
    sample = materialise(_training_rows(docs, labels, rows), "labelled")
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    t1, t0 = totals.get(1, 0), totals.get(0, 0)
    if not t1 or not t0:
        return Model(Lexicon({}, {}), np.zeros(len(FEATURES)), -1e-3)
    lift = ((F.col("n1") + 0.5) / (t1 + 1)) / ((F.col("n0") + 0.5) / (t0 + 1))
    least = max(MIN_SUPPORT, t1 // 100)
    terms = _term_counts(sample).filter(F.col("n1") >= min(least, max(2, t1 // 4))).withColumn("lift", lift).filter(F.col("lift") >= min(MIN_LIFT, 0.5 * t0)).orderBy(F.desc("n1"), "kind", "term").collect()
    stems = {r.term: math.log(r.lift) for r in terms if r.kind == 1}
    lexicon = Lexicon({r.term: math.log(r.lift) for r in terms if r.kind == 0}, stems)

    def spot(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in it for b in batches(whole)):
            counts: Counter = Counter()
            for toxic, text in columns(batch, "toxic", "text"):
                for term in {t for k, t in lexicon.hits(set(WORD.findall((text or "").lower()))).values() if k == "fuzzy"}:
                    counts[term, toxic] += 1
            rows = [(t, y, n) for (t, y), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["term", "toxic", "n"])

    lexicon.seen = {}
    found: dict[str, list[int]] = {}
    for term, toxic, n in sample.mapInArrow(spot, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n")).collect():
        found.setdefault(term, [0, 0])[toxic] = n
    lexicon.drop_fuzzy({t for t, (n0, n1) in found.items() if (n1 + 0.5) / t1 < 5 * (n0 + 0.5) / t0 and n0 > 0})

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in it for b in batches(whole)):
            rows = [(toxic, *features(text, lexicon)) for toxic, text in columns(batch, "toxic", "text")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i + 1] for r in rows], pa.float64()) for i in range(len(FEATURES)))], names=["toxic", *FEATURES])

    lexicon.seen = {}
    table = np.array([tuple(r) for r in sample.mapInArrow(describe, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).collect()], float)
    weights, bias = _logistic(table[:, 1:], table[:, 0])
    # A misspelling that the sample holds too few of to weigh counts half as much as the word.
    if table[:, 1 + FEATURES.index("fuzzy")].astype(bool).sum() < 20:
        weights[FEATURES.index("fuzzy")] = max(weights[FEATURES.index("fuzzy")], weights[FEATURES.index("word")] / 2)
    lexicon.seen = {}
    return Model(lexicon, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = shared.value, arrow_schema(SCORED)
        hold("toxicity", own.lexicon.seen.clear)
        for batch in (b for whole in it for b in batches(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that score below the threshold."""
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        hold("toxicity", own.lexicon.seen.clear)
        for batch in (b for whole in it for b in batches(whole)):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([own.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
