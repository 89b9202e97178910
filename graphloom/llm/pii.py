"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors - at-signs, schemes, plus signs, digits and identifier
cues - in one pass over the text; from each anchor a deterministic local parser expands to both
sides, validates, and gives a span. Base kinds (email, ip, card, phone) are leftmost and
non-overlapping within their kind: a parser starts at the first anchor not yet consumed, and a
parse that fails its validation still consumes its characters.

Further kinds: ``url`` (scheme anchors), ``iban`` (cue ``iban``, mod-97), ``ssn`` (cue ``ssn``),
``account`` (cues ``account``, ``acct``, ``konto``, ``cuenta``, ``compte`` before 6 to 17 digits),
``address`` (a house number and one to four capitalised words up to a street word).

Null or empty texts have no spans; offsets count code points, ends exclusive. Every row gives one row,
repeated rows and null ids too; very long texts are read whole, in time linear in their length; an empty
table gives an empty result. Other columns are not read by ``scan`` and are kept by ``redacted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, bounded_batches, columns, hold

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "ssn", "account", "address")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:https?|ftp)://[^\x00-\x20<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[\x20:#.=-]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_SSN = re.compile(r"[\x20:#.=-]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|num))?[\x20:#.=-]{1,4}([0-9]{6,17})(?![0-9])", re.ASCII | re.I)
_ADDRESS = re.compile(r"[0-9]{1,5}[a-z]?(?:\x20[A-Z][a-z]{1,20}){1,4}\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square)\b\.?")
_DIGITS = frozenset("0123456789")
_CUES = {"iban": ("iban", _IBAN), "ssn": ("ssn", _SSN), "account": ("account", _ACCOUNT), "acct": ("account", _ACCOUNT), "konto": ("account", _ACCOUNT), "cuenta": ("account", _ACCOUNT), "compte": ("account", _ACCOUNT)}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for digit in "0123456789":
        a.add_word(digit, ("digit", None))
    a.add_word("@", ("at", None))
    a.add_word("+", ("plus", None))
    a.add_word("://", ("scheme", None))
    for cue in _CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", cue))
    a.make_automaton()
    return a


_anchors = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed in KINDS, then by start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # per kind, the first character not consumed

    def take(kind: str, start: int, end: int, ok: bool = True) -> None:
        free[kind] = end
        if ok:
            out[kind].append((start, end))

    last_digit = -2
    for end, (what, cue) in _anchors.iter(text):
        if what == "digit":
            first, last_digit = end != last_digit + 1, end
            if end >= free["ip"] and (first or end == free["ip"]) and (m := _IP.match(text, end)):
                take("ip", end, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")))
            if end >= free["card"] and (m := _CARD.match(text, end)):
                digits = m.group().replace(" ", "").replace("-", "")
                take("card", end, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
            if first and end >= free["address"] and (end == 0 or not text[end - 1].isalnum()) and (m := _ADDRESS.match(text, end)):
                take("address", end, m.end())
        elif what == "plus":
            if end >= free["phone"] and (m := _PHONE.match(text, end)):
                take("phone", end, m.end(), 8 <= sum(c in _DIGITS for c in m.group()) <= 15)
        elif what == "at":
            start = end
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end)):
                take("email", start, m.end())
        elif what == "scheme":
            start = end - 2
            for scheme in ("https", "http", "ftp"):
                if text.startswith(scheme, start - len(scheme)) and start - len(scheme) >= free["url"]:
                    if m := _URL.match(text, start - len(scheme)):
                        take("url", start - len(scheme), m.end() - (m.group()[-1] in ".,;:!?)"))
                    break
        else:
            kind, pattern = _CUES[cue]
            begin = end + 1 - len(cue)
            if (begin == 0 or not text[begin - 1].isalnum()) and (m := pattern.match(text, end + 1)) and m.start(1) >= free[kind]:
                take(kind, m.start(1), m.end(1), kind != "iban" or _iban_ok(m.group(1)))
    return [(kind, s, e) for kind in KINDS for s, e in out[kind]]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each maximal run of overlapping spans replaced by ``[KIND]`` of its first."""
    if not spans:
        return text
    out, at = [], 0
    runs: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([kind, s, e])
    for kind, s, e in runs:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, base spans and all spans, written
    ``kind:start:end`` and comma-joined."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii")
        schema = arrow_schema(FOUND)
        for batch in it:
            rows = []
            for (text,) in columns(batch, "text"):
                spans = find_spans(text)
                written = [f"{k}:{s}:{e}" for k, s, e in spans]
                n_base = sum(k in BASE_KINDS for k, _, _ in spans)
                rows.append((*(sum(k == b for k, _, _ in spans) for b in BASE_KINDS), ",".join(written[:n_base]), ",".join(written)))
            if rows:
                doc = batch.column(batch.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns stay."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("pii")
        for batch in it:
            at = batch.schema.get_field_index("text")
            texts = [redact(t, find_spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    bounded_batches(docs)
    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


