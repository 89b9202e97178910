"""Exact sequential algorithms over one component in memory. All are iterative and deterministic:
vertices and edges are taken in key order."""

from __future__ import annotations

from collections.abc import Iterable

Edge = tuple  # (key, tail, head)


def adjacency(vertices: Iterable, edges: Iterable[Edge], directed: bool = False) -> dict:
    """vertex -> sorted list of (other end, edge key); a loop appears once."""
    out: dict = {v: [] for v in sorted(vertices)}
    for key, tail, head in edges:
        out[tail].append((head, key))
        if not directed and tail != head:
            out[head].append((tail, key))
    for v in out:
        out[v].sort()
    return out
