"""Secret scan with a recursive decoding worklist.

Each layer of a text is scanned with the detectors; then every encoded stretch in it - URL escapes,
``\\u`` escapes, base64 (also over line breaks), hexadecimal bytes - is unwrapped, and decompressed where
the bytes are zlib or gzip with all their members, until no layer gives a new one. Layers are bytes: all
patterns are ASCII, so bytes that are no UTF-8 or not printable hide nothing.

Runs of characters that a pattern can span are rescanned with their URL or ``\\u`` escapes replaced in
place. Base64 over several lines is decoded line by line and as a whole, from the first line of each
alignment modulo 4.

Each layer maps its positions to the layer it came from: escapes by character, base64 by group of 4,
hexadecimal by byte. What was compressed maps to its whole stretch. Base findings are those of the text
itself. Findings of deeper layers have the path of their decoders in front of the kind,
``base64>assign``. One that another layer has shown at the same place with the same text is not
repeated; several in one compressed stretch have equal spans and are listed one by one.

Null or empty texts have no findings. Every row gives one row, repeated rows and null ids too; an empty
table gives an empty result; other columns are not read. Nothing is bounded: a layer beyond ``HELD`` bytes is kept in a
temporary file and scanned from there. A compressed layer equal to one it came from is not taken again.
"""

from __future__ import annotations

import binascii
import mmap
import re
import tempfile
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, bounded_batches, columns, hold

KINDS = ("assign", "access", "hex")
#: Bytes of a layer that are held in memory.
HELD = 8 << 20
#: Bytes that are decoded or decompressed at once.
PIECE = 1 << 16

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: Runs of what a detector or a stretch can go over.
_RUN = re.compile(rb"[A-Za-z0-9+/_.=\"' :\t\r\n%\\-]+")
_PERCENT = re.compile(rb"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(rb"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}")
#: URL-escaped gzip or zlib data.
_PACKED = re.compile(rb"(?:%1[fF]%8[bB]|(?:x|%78)%[0-9A-Fa-f]{2})(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+/=:&!*'()@,;$-]++)*+")
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(rb"[A-Za-z0-9+/_-]+={0,2}")
_HEXBYTES = re.compile(rb"[0-9A-Fa-f]{24,}")
_STANDARD = bytes.maketrans(b"-_", b"+/")

Data = bytes | mmap.mmap
#: Start and end in a layer to those in the layer it came from.
Span = Callable[[int, int], tuple[int, int]]


def _own_findings(data: Data) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of a layer, in order."""
    out = []
    folded = data.lower() if isinstance(data, bytes) else None
    if folded is None or any(k in folded for k in _KEYWORDS):
        # No retries: a match whose value is too short is dropped with what it consumed.
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if data.find(b"AKIA") >= 0:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    return sorted(out)


def _digest(data: Data, start: int, end: int) -> bytes:
    h = xxhash.xxh3_128()
    for at in range(start, end, HELD):
        h.update(data[at : min(at + HELD, end)])
    return h.digest()


def _stored(pieces: Iterable[bytes]) -> Data:
    """All the pieces in a row; beyond HELD bytes in a file that goes when it is let go."""
    held, size, file = [], 0, None
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size > HELD:
            file = file or tempfile.TemporaryFile()
            file.writelines(held)
            held, size = [], 0
    if file is None:
        return b"".join(held)
    with file:
        file.writelines(held)
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def _pieces(data: Data, lines: list[tuple[int, int]]) -> Iterator[bytes]:
    for s, e in lines:
        for at in range(s, e, PIECE):
            yield data[at : min(at + PIECE, e)]


def _from_base64(pieces: Iterable[bytes]) -> Iterator[bytes]:
    rest = b""
    for piece in pieces:
        piece = rest + piece.translate(_STANDARD, b"=")
        whole = len(piece) // 4 * 4
        yield binascii.a2b_base64(piece[:whole])
        rest = piece[whole:]
    if len(rest) > 1:
        yield binascii.a2b_base64(rest + b"=" * (4 - len(rest)))


def _inflated(pieces: Iterable[bytes], wbits: int, used: list[int]) -> Iterator[bytes]:
    """What a compressed stream and the members behind it hold, up to the first error; ``used`` gets
    the number of bytes of input that were good."""
    d, fresh = zlib.decompressobj(wbits), True
    for data in pieces:
        while data:
            if fresh and used[0] and data[0] == 0:  # padding between members
                used[0] += len(data) - len(data := data.lstrip(b"\0"))
                continue
            before = d.copy()
            try:
                out = d.decompress(data, PIECE)
            except zlib.error:
                # What comes before the error.
                for i in range(len(data)):
                    try:
                        out = before.decompress(data[i : i + 1])
                    except zlib.error:
                        return
                    used[0] += 1
                    if out:
                        yield out
                return
            if out:
                yield out
            rest = d.unused_data if d.eof else d.unconsumed_tail
            used[0] += len(data) - len(rest)
            data, fresh = rest, d.eof
            if d.eof:
                d = zlib.decompressobj(wbits)
    if not fresh and (out := d.flush()):
        yield out


def _unpacked(source: Callable[[], Iterable[bytes]], used: list[int]) -> tuple[str, Data] | None:
    """Name of the compression and content of decoded bytes; None where they are not compressed."""
    start = b""
    for piece in source():
        start += piece[:2]
        if len(start) > 1:
            break
    for name, wbits, magic in (("gzip", 31, b"\x1f\x8b"), ("zlib", 15, b"x")):
        if start.startswith(magic):
            used[0] = 0
            if len(data := _stored(_inflated(source(), wbits, used))):
                return name, data
    return None


def _replaced(data: bytes, escape: re.Pattern, decode: Callable[[re.Match], bytes]) -> tuple[bytes, Span]:
    """A run with its escapes replaced, and its span map."""
    out, starts, ends, origins = [], [], [], []
    at = size = 0
    for m in escape.finditer(data):
        new = decode(m)
        size += m.start() - at
        out += (data[at : m.start()], new)
        starts.append(size)
        size += len(new)
        ends.append(size)
        origins.append(m.span())
        at = m.end()
    out.append(data[at:])

    def origin(i: int, end: bool) -> int:
        j = bisect_right(starts, i) - 1
        if j < 0:
            return i + end
        return origins[j][end] if i < ends[j] else origins[j][1] + i - ends[j] + end

    return b"".join(out), lambda s, e: (origin(s, False), origin(e - 1, True))


def _percent(m: re.Match) -> bytes:
    return bytes([int(m.group(1), 16)])


def _unicode(m: re.Match) -> bytes:
    units = bytes.fromhex(m.group().replace(b"\\u", b"").decode())
    return units.decode("utf-16-be", "replace").encode()


def _by_group(lines: list[tuple[int, int]], first: int, limit: int) -> Span:
    """The span map of base64 from line ``first`` on; ``limit`` is the end of the padding."""
    offsets, total = [], 0
    for s, e in lines[first:]:
        offsets.append(total)
        total += e - s

    def origin(i: int) -> int:
        j = bisect_right(offsets, i) - 1
        return lines[first + j][0] + i - offsets[j]

    return lambda s, e: (origin(s // 3 * 4), limit if (last := (e + 2) // 3 * 4) >= total else origin(last - 1) + 1)


def _base64_layers(data: Data, lines: list[tuple[int, int]], limit: int) -> Iterator[tuple[int, int, str, Data, Span | None]]:
    """The layers of base64 lines, which have no padding; ``limit`` is the end of that behind them."""
    firsts: dict[int, int] = {}
    total = taken = 0
    for i, (s, e) in enumerate(lines):
        firsts.setdefault(total % 4, i)
        if total >= taken and e - s >= 4 and (data[s] == 72 or data[s] == 101):  # H, e: gzip, zlib
            used = [0]
            if got := _unpacked(lambda i=i: _from_base64(_pieces(data, lines[i:])), used):
                yield s, limit, f"base64>{got[0]}", got[1], None
                taken = total + used[0] // 3 * 4
        total += e - s
        if len(lines) > 1 and e - s >= 16:
            end = limit if i == len(lines) - 1 else e
            yield s, end, "base64", _stored(_from_base64(_pieces(data, [(s, e)]))), _by_group([(s, e)], 0, end)
    if total >= 16:
        for i in firsts.values():
            yield lines[i][0], limit, "base64", _stored(_from_base64(_pieces(data, lines[i:]))), _by_group(lines, i, limit)


def _layers(data: Data) -> Iterator[tuple[int, int, str, Data, Span | None]]:
    """(start, end, decoder, decoded data, span map into this layer) of the encoded stretches of a
    layer; compressed data have no map."""
    escapes = [(name, pattern, decode) for name, sign, pattern, decode in (("url", b"%", _PERCENT, _percent), ("unicode", b"\\u", _UNICODE, _unicode)) if data.find(sign) >= 0 and pattern.search(data)]
    if escapes:
        for m in _RUN.finditer(data):
            for name, pattern, decode in escapes:
                if pattern.search(data, m.start(), m.end()):
                    inner, span = _replaced(m.group(), pattern, decode)
                    yield m.start(), m.end(), name, inner, lambda s, e, at=m.start(), span=span: tuple(at + x for x in span(s, e))
        if escapes[0][0] == "url":
            for m in _PACKED.finditer(data):
                if got := _unpacked(lambda m=m: [_PERCENT.sub(_percent, m.group())], [0]):
                    yield m.start(), m.end(), f"url>{got[0]}", got[1], None
    wrapped = []
    if data.find(b"\n") >= 0:
        for m in _WRAPPED.finditer(data):
            if m.end() - m.start() > 16:
                wrapped.append(m.span())
                lines = [(x.start(), x.end() - x.group().count(b"=")) for x in _LINE.finditer(data, m.start(), m.end())]
                yield from _base64_layers(data, lines, m.end())
    at = 0
    for m in _BASE64.finditer(data):
        while at < len(wrapped) and wrapped[at][1] <= m.start():
            at += 1
        if at == len(wrapped) or m.start() < wrapped[at][0]:
            stop = m.end()
            while data[stop - 1] == 61:
                stop -= 1
            yield from _base64_layers(data, [(m.start(), stop)], m.end())
    for m in _HEXBYTES.finditer(data):
        s, e = m.start(), m.end() - (m.end() - m.start()) % 2

        def source(s=s, e=e):
            return (bytes.fromhex(x.decode()) for x in _pieces(data, [(s, e)]))

        yield s, e, "hex", _stored(source()), lambda i, j, at=s: (at + 2 * i, at + 2 * j)
        if got := _unpacked(source, [0]):
            yield s, e, f"hex>{got[0]}", got[1], None


def _scan(data: Data, path: str, outer: tuple[int, int] | None, above: frozenset, deep: list) -> list[tuple[int, int, int]]:
    """Own findings of a text or decompressed layer. Those of the layers in it go to ``deep``, and its
    own where there is a ``path``; ``outer`` is the stretch of the text that a decompressed one has."""
    first, seen, known = None, set(), set()
    work = deque([(data, path, None)])
    while work:
        data, how, origin = work.popleft()

        def at(s: int, e: int) -> tuple[int, int]:
            link = origin
            while link:
                span, link = link
                s, e = span(s, e)
            return s, e

        own = _own_findings(data)
        first = own if first is None else first
        for s, k, e in own:
            place = at(s, e)
            mark = k, place, _digest(data, s, e)
            if mark not in known:
                known.add(mark)
                if how:
                    deep.append((f"{how}>{KINDS[k]}", *(outer or place)))
        for s, e, more, inner, span in _layers(data):
            place, content = at(s, e), _digest(inner, 0, len(inner))
            if (place, content) in seen:
                continue
            seen.add((place, content))
            more = f"{how}>{more}" if how else more
            if span is not None:
                work.append((inner, more, (span, origin)))
            elif content not in above:
                _scan(inner, more, outer or place, above | {content}, deep)
    return first


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]:
    """Base findings (start, kind number, end), and those of decoded layers (kind, start, end)."""
    if not text:
        return [], []
    deep: list[tuple[str, int, int]] = []
    # One byte for each character: others than ASCII are in no pattern.
    base = _scan(text.encode("ascii", "replace"), "", None, frozenset(), deep)
    return base, sorted(deep, key=lambda x: (x[1], x[2], x[0]))


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base spans, and all spans (base first), comma-joined."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("secrets")
        schema = arrow_schema(FOUND)
        for batch in it:
            rows = []
            for (text,) in columns(batch, "text"):
                base, deep = find_secrets(text)
                own = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
                rows.append((*(sum(k == n for _, k, _ in base) for n in range(3)), ",".join(own), ",".join(own + [f"{k}:{s}:{e}" for k, s, e in deep])))
            if rows:
                doc = batch.column(batch.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
