"""Quality rules as a short-circuit cascade of native column expressions.

A rule is a named boolean column over the measures of a text. The cascade takes a bounded sample by the
order of a hash, estimates each rule's rejection rate and cost there, and orders the rules by rejection
per cost. A cost is counted, not timed - the characters and window words that a rule and the measures it
needs go through, on the sample's mean text - so two runs give one order; ties go by name.
The order is compiled into one CASE expression: evaluation stops at the first rule that rejects,
whose name is the result's ``rejected_by``. The verdict itself does not depend on the order. ``kept``
computes a measure only where the cascade comes to it. Where the measures are asked for as columns
(``judge``), those are computed for every row, and what only rules need (letters, signs, lines) is not.

Everything runs inside Spark SQL expressions. Values that an expression needs more than once are
bound by a one-element ``transform``, so they are computed once for each row.

Measures of a text (words are runs without ASCII white space): ``n_words``, ``word_chars``,
``n_symbols``, ``n_dup_lines`` (lines with a word, equal to an earlier line), ``n_repeat_words``
(words covered by 8-word windows found twice or more in the text). A null or empty text has no
words and fails the base rule; repeated rows and null ids are judged one by one, very long texts whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

REPEAT_WIDTH = 8
MIN_WORDS = 20
#: Rows of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 500

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = "\t\n\x0b\x0c\r "
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null or empty text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, _SPACE, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _repeat_words(w: Column, width: int = REPEAT_WIDTH) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array ``w``."""
    windows = F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(width)))))

    def starts(h: Column) -> Column:
        """Ascending starts of the windows that have an equal: neighbours after sorting by hash."""
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(ordered, lambda s: F.transform(F.filter(F.transform(s, lambda x, i: F.struct(
            x["i"].alias("i"), ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))).alias("again"))), lambda x: x["again"]), lambda x: x["i"]))
        return F.sort_array(again)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(starts(h), covered)))


def _measures(text: Column) -> dict[str, Column]:
    """The measures that rules read, each an expression of its own over the text."""
    return {
        "n_symbols": (F.length(text) - _without(text, _SYMBOLS)).cast("bigint"),
        "n_dup_lines": _dup_lines(text).cast("bigint"),
        "n_repeat_words": let(words(text), lambda x: _repeat_words(x)),
        "word_chars": _without(text, _SPACE).cast("bigint"),
        "n_words": F.size(words(text)).cast("bigint"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the measures of every row."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = slim.withColumn("m", let(words(F.col("text")), lambda x: F.struct(F.size(x).cast("bigint").alias("n_words"), _repeat_words(x).alias("n_repeat_words"))))
    m = _measures(F.col("text")) | {"n_words": F.col("m.n_words"), "n_repeat_words": F.col("m.n_repeat_words")}
    return out.select("doc_id", "text", *(m[name].alias(name) for name in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules(measures: dict[str, Column] | None = None) -> dict[str, Column]:
    """Rules that reject when true, over columns of the measures or the given expressions."""
    m = {name: F.col(name) for name in MEASURES} | (measures or {})
    return {
        "too_short": m["n_words"] < MIN_WORDS,
        "repeated_windows": 100 * m["n_repeat_words"] > 30 * m["n_words"],
        "symbols": 5 * m["n_symbols"] > m["n_words"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]),
        "duplicate_lines": m["n_dup_lines"] * 2 > F.size(F.split("text", "\n")),
        "shouting": F.length(F.regexp_replace("text", "[^!]", "")) * 5 > m["n_words"],
        "no_letters": F.length(F.regexp_replace("text", "\\P{L}", "")) * 2 < m["word_chars"],
    }


#: What a measure costs, in passes over a text's characters; that of n_repeat_words in words for each word.
PASSES = {"n_words": 2, "word_chars": 1, "n_symbols": 1, "n_dup_lines": 3, "text": 2}
WINDOW_PASSES = 3 * REPEAT_WIDTH


def needs(rule: Column) -> set[str]:
    """The measures that a rule reads (``text``: the text itself)."""
    return set(re.findall(r"\b(n_words|word_chars|n_symbols|n_dup_lines|n_repeat_words|text)\b", str(rule)))


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows with the ``rows`` smallest hashes, from anywhere in the table and the same in each run (rows
    equal in id and text come together). Only hashes are sorted and collected; texts stay where they are."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = F.xxhash64("doc_id", "text")
    least = slim.select(hashed.alias("h")).orderBy("h").limit(rows).collect()
    return slim.filter(hashed <= least[-1].h) if least else slim.limit(0)


def order_rules(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """Rules by rejection per cost on a bounded sample: (name, rejection rate, cost of a row). One job."""
    rates = [F.avg(F.coalesce(rule, F.lit(False)).cast("double")) for rule in rules.values()]
    row = measured(sample_of(docs, sample_rows)).agg(F.avg(F.length("text")), F.avg("n_words"), *rates).first()
    chars, words_, *found = (x or 0.0 for x in row)
    out = []
    for (name, rule), rate in zip(rules.items(), found, strict=True):
        wanted = needs(rule)
        cost = 1 + chars * sum(PASSES[m] for m in wanted if m in PASSES)
        if "n_repeat_words" in wanted:
            cost += chars + words_ * WINDOW_PASSES
        out.append((name, rate, cost))
    return sorted(out, key=lambda x: (-(x[1] / x[2]), x[0]))


def cascade(order: list[str], rules: dict[str, Column]) -> Column:
    """The name of the first rule that rejects; null where none does."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(F.coalesce(rules[name], F.lit(False)), name).otherwise(out)
    return out


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, the measures, ``rejected_by``, ``base_failed`` and ``kept`` of every row."""
    rules = rules or default_rules()
    order = [name for name, *_ in order_rules(docs, rules, sample_rows)]
    found = measured(docs).withColumn("rejected_by", cascade(order, rules)).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("text")


def kept(docs: DataFrame, rules: Callable[[dict[str, Column]], dict[str, Column]] = default_rules, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id`` and ``rejected_by`` of every row: a measure stands inside the branch that reads it, so a row
    that an earlier rule rejects never computes a later one's. ``rules`` makes rules of measures; only the
    counts of words and letters, which most rules read, are computed for all rows."""
    order = [name for name, *_ in order_rules(docs, rules({}), sample_rows)]
    m = _measures(F.col("text"))
    shared = {name: m[name] for name in ("n_words", "word_chars")}
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(shared)
    return slim.select("doc_id", cascade(order, rules(m | {name: F.col(name) for name in shared})).alias("rejected_by"))
