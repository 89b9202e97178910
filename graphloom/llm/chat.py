"""Chat formatting: roles of transcript turns by a hidden Markov model, and canonical rendering.

States are the roles; a turn's observation is its speaker marker (``User:``, ``### Assistant`` ...),
its length class, its number of lines and whether it asks. Probabilities are counts with one added,
from labelled turns. The most likely roles of each conversation are found by Viterbi.

A text is first cut before each of its lines that begins with a speaker marker, so a transcript of
several turns in one text gives one row for each (``piece`` counts them). Labelled rows that are learned
from count as one turn each. Any number of roles is learned.

A conversation of any length is one chain, so the chain is cut: turns are sorted by (conv_id, turn,
text) into range partitions and numbered blocks of at most ``BLOCK`` turns and about ``BLOCK_BYTES``. Each block reports, for its first
and last conversation, the best score from each entering to each leaving role (a small matrix);
those matrices are chained per conversation to fix the roles at the cuts; then all blocks decode
on their own. The result is that of one Viterbi pass, with ties going to the role first in order.

Null texts are empty turns. Null conv_ids form one conversation, null turns come first; turns with
equal numbers follow each other by text; repeated rows stay repeated. An empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, bounded_batches, columns, materialise

#: Turns in a block at most, and bytes of their text from which it ends.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
#: Speaker markers of common transcript forms.
MARKERS = {"user": "user", "human": "user", "customer": "user", "me": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "system": "system", "tool": "tool"}
_MARKER = re.compile(r"^[\s#*>\[<|]*(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")[\]>|*]*\s*(?::|\n)[*]*\s*", re.I | re.A)
_MARKER_SQL = r"(?i)^[\s#*>\[<|]*(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")[\]>|*]*\s*(?::|\n)"
_TURN_START = re.compile(r"^[^\S\n]*(?:[#*>\[<|][#*>\[<| \t]*)?(?:" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")[\]>|*]*[^\S\n]*(?::|\n)", re.I | re.M)
LENGTHS, LINES = 20, 4

TURNS = "part int, blk long, idx long, conv_id long, turn long, piece long, text string"
EDGES = "conv_id long, part int, blk long, side int, through array<double>, fresh array<double>"
CUTS = "part int, blk long, side int, enter int, leave int"
DECODED = "conv_id long, turn long, piece long, role string, content string, rendered string"


def observation(text: str | None) -> tuple[str, int, int, int]:
    """Marker's role or '', length class, lines class, asks."""
    text = text or ""
    m = _MARKER.match(text)
    n = len(text)
    return MARKERS[m.group(1).lower()] if m else "", min(LENGTHS - 1, n.bit_length()), min(LINES - 1, text.count("\n")), int(text.rstrip(" ").endswith("?"))


def pieces(text: str | None) -> list[str | None]:
    """A text cut before each line with a speaker marker; what is before the first is a turn if not blank."""
    starts = [m.start() for m in _TURN_START.finditer(text or "")]
    if starts and text[: starts[0]].strip():
        starts.insert(0, 0)
    if len(starts) < 2:
        return [text]
    out = []
    for s, e in zip([0, *starts[1:]], [*starts[1:], len(text)], strict=True):
        piece = text[s:e]
        # The line break before the next turn is of neither, unless a marker ends with it.
        cut = piece.removesuffix("\n") if e < len(text) else piece
        out.append(cut if bool(_MARKER.match(cut)) == bool(_MARKER.match(piece)) else piece)
    return out


class RoleModel:
    """Log probabilities: start[s], move[s, t], and per feature a table by state."""

    def __init__(self, roles: list[str], start: np.ndarray, move: np.ndarray, emit: list[dict]):
        self.roles, self.start, self.move, self.emit = roles, start, move, emit

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.roles)))
        for i, text in enumerate(texts):
            for table, value in zip(self.emit, observation(text), strict=True):
                out[i] += table.get(value, table[None])
        return out


def fit(turns: DataFrame) -> RoleModel:
    """Counts from labelled turns (``conv_id, turn, role, text``): aggregated where the rows are;
    what reaches the driver is a table of the roles by a few classes, and one of their pairs."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("role is not null")
    roles = sorted(r.role for r in rows.select("role").distinct().collect()) or ["assistant", "system", "user"]
    k = len(roles)
    number = {r: i for i, r in enumerate(roles)}
    length = F.when(F.length("text") == 0, 0).otherwise(F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.greatest(F.length("text"), F.lit(1)))) + 1)).cast("int")
    seen = rows.select("role", F.lower(F.regexp_extract("text", _MARKER_SQL, 1)).alias("marker"), length.alias("length"), F.least(F.lit(LINES - 1), F.length(F.regexp_replace("text", "[^\n]", ""))).cast("int").alias("lines"), F.rtrim("text").endswith("?").cast("int").alias("asks"))
    emit = []
    for feature in ("marker", "length", "lines", "asks"):
        counts: dict = {}
        for r in seen.groupBy("role", feature).count().collect():
            value = MARKERS.get(r[feature], "") if feature == "marker" else r[feature]
            counts.setdefault(value, np.zeros(k))[number[r.role]] += r["count"]
        total = sum(counts.values(), np.zeros(k)) + len(counts) + 1
        emit.append({v: np.log((c + 1) / total) for v, c in counts.items()} | {None: np.log(1 / total)})
    # A marker names its speaker whatever the labelled turns look like.
    for role in set(MARKERS.values()) & set(roles):
        row = np.full(k, math.log(1e-4))
        row[number[role]] = math.log(0.997)
        emit[0].setdefault(role, row)
    start, move = np.ones(k), np.ones((k, k))
    first = rows.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"))
    for r in first.groupBy("role").count().collect():
        start[number[r.role]] += r["count"]
    a, b = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before")), rows.select("conv_id", "turn", "role")
    for r in a.join(b, ["conv_id", "turn"]).groupBy("before", "role").count().collect():
        move[number[r.before], number[r.role]] += r["count"]
    return RoleModel(roles, np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), emit)


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns sorted into range partitions and cut into pieces, with partition, block and position."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h", "text").drop("h")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, filled = TaskContext.get().partitionId(), 0, 0.0
        for batch in it:
            cut = [pieces(text) for (text,) in columns(batch, "text")]
            row = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
            n = len(row)
            idx = np.arange(at, at + n, dtype=np.int64)
            at += n
            number = pa.array([i for x in cut for i in range(len(x))], pa.int64())
            share = np.array([max(1 / BLOCK, len(t or "") / BLOCK_BYTES) for x in cut for t in x])
            block = (filled + np.cumsum(share) - share).astype(np.int64)
            filled += float(share.sum())
            conv, turn = (batch.column(i).take(pa.array(row)) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(block), pa.array(idx), conv, turn, number, pa.array([t for x in cut for t in x], pa.string())], schema=arrow_schema(TURNS))

    return materialise(rows.mapInArrow(run, TURNS), "turns")


def _segments(conv: list) -> list[tuple[int, int]]:
    starts = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]]
    return list(zip(starts, [*starts[1:], len(conv)], strict=True))


def _advance(v: np.ndarray, move: np.ndarray, score: np.ndarray) -> np.ndarray:
    return (v[..., :, None] + move).max(-2) + score


def _edges(model: RoleModel):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        conv, scores = rows.column("conv_id").to_pylist(), model.scores(rows.column("text").to_pylist())
        k, out, segments = len(model.roles), [], _segments(rows.column("conv_id").to_pylist())
        for side, (s, e) in ((0, segments[0]), (1, segments[-1])):
            if side and len(segments) == 1:
                break
            through, fresh = np.where(np.eye(k) > 0, 0.0, -np.inf), None
            for i in range(s, e):
                through = _advance(through, model.move, scores[i])
                fresh = model.start + scores[i] if fresh is None else _advance(fresh, model.move, scores[i])
            out.append((conv[s], rows.column("part")[0].as_py(), rows.column("blk")[0].as_py(), side, through.ravel().tolist(), fresh.tolist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow_schema(EDGES), strict=True)], schema=arrow_schema(EDGES))

    return run


def _cuts(model: RoleModel):
    """Chain a conversation's blocks: forward scores at each block's end, then roles backwards."""

    def run(rows: pa.Table) -> pa.Table:
        k = len(model.roles)
        rows = rows.sort_by([("part", "ascending"), ("blk", "ascending"), ("side", "ascending")])
        ends, through = [], [np.array(x).reshape(k, k) for x in rows.column("through").to_pylist()]
        v = np.array(rows.column("fresh")[0].as_py())
        ends.append(v)
        for m in through[1:]:
            v = (v[:, None] + m).max(0)
            ends.append(v)
        state = int(ends[-1].argmax())
        enter, leave = [-1] * len(ends), [0] * len(ends)
        for i in range(len(ends) - 1, -1, -1):
            leave[i] = state
            if i:
                state = enter[i] = int((ends[i - 1] + through[i][:, state]).argmax())
        return pa.Table.from_arrays([rows.column("part"), rows.column("blk"), rows.column("side"), pa.array(enter, pa.int32()), pa.array(leave, pa.int32())], schema=arrow_schema(CUTS))

    return run


def viterbi(scores: np.ndarray, model: RoleModel, enter: int = -1, leave: int = -1) -> list[int]:
    """Best states of a chain; ``enter`` is the state before it (-1: it starts here), ``leave`` the
    state it must end in (-1: free)."""
    v = (model.start if enter < 0 else model.move[enter]) + scores[0]
    back = []
    for row in scores[1:]:
        step = v[:, None] + model.move
        back.append(step.argmax(0))
        v = step.max(0) + row
    state = int(v.argmax()) if leave < 0 else leave
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def render(role: str, text: str | None) -> tuple[str, str]:
    """Content without its speaker marker, and the canonical form of the turn."""
    content = text or ""
    if m := _MARKER.match(content):
        content = content[m.end() :]
    content = content.strip()
    return content, f"<|{role}|>\n{content}\n<|end|>\n"


def _decode(model: RoleModel):
    def run(rows: pa.Table, cuts: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        texts = rows.column("text").to_pylist()
        scores, out = model.scores(texts), []
        segments = _segments(rows.column("conv_id").to_pylist())
        fixed = {side: (enter, leave) for side, enter, leave in columns(cuts, "side", "enter", "leave")}
        for number, (s, e) in enumerate(segments):
            side = 0 if number == 0 else 1 if number == len(segments) - 1 else None
            for i, state in enumerate(viterbi(scores[s:e], model, *fixed.get(side, (-1, -1))), s):
                out.append((model.roles[state], *render(model.roles[state], texts[i])))
        schema = arrow_schema(DECODED)
        return pa.Table.from_arrays([rows.column("conv_id"), rows.column("turn"), rows.column("piece"), *(pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 3))], schema=schema)

    return run


def format_chats(turns: DataFrame, model: RoleModel) -> DataFrame:
    """``(conv_id, turn, piece, role, content, rendered)`` of each turn in the texts of ``(conv_id, turn, text)``."""
    bounded_batches(turns)
    ordered = _ordered(turns)
    edges = ordered.groupBy("part", "blk").applyInArrow(_edges(model), EDGES)
    cuts = edges.groupBy("conv_id").applyInArrow(_cuts(model), CUTS)
    return ordered.groupBy("part", "blk").cogroup(cuts.groupBy("part", "blk")).applyInArrow(_decode(model), DECODED)


def training_fold(conv_id="conv_id"):
    """Conversations whose labels are learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(F.col(conv_id).cast("string"), F.lit("")).cast("binary")) % 5 != 0
