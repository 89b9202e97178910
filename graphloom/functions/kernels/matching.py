"""Matchings: bipartite by cardinality and by weight, general by blossoms; and vertex covers."""

from __future__ import annotations

from collections import deque

import numpy as np


def bipartite_matching(left: list, near: dict) -> dict:
    """A maximum matching, left -> right, by phases of shortest augmenting paths."""
    mate_l: dict = {}
    mate_r: dict = {}
    while True:
        depth = {v: 0 for v in left if v not in mate_l}
        work, free_at = deque(depth), None
        while work:
            u = work.popleft()
            if free_at is not None and depth[u] >= free_at:
                continue
            for w in near.get(u, ()):
                v = mate_r.get(w)
                if v is None:
                    free_at = depth[u] + 1
                elif v not in depth:
                    depth[v] = depth[u] + 1
                    work.append(v)
        if free_at is None:
            return mate_l
        rest = {u: iter(near.get(u, ())) for u in depth}
        for root in [v for v in left if v not in mate_l]:
            path = [(root, None)]
            while path:
                u = path[-1][0]
                for w in rest[u]:
                    v = mate_r.get(w)
                    if v is None:
                        path[-1] = (u, w)
                        for a, b in path:
                            mate_l[a], mate_r[b] = b, a
                        path = []
                        break
                    if depth.get(v) == depth[u] + 1:
                        path[-1] = (u, w)
                        path.append((v, None))
                        break
                else:
                    depth[u] = -1
                    path.pop()


def cover_of(left: list, near: dict, mate: dict) -> set:
    """A minimum vertex cover from a maximum matching: left vertices that alternating paths from
    free left vertices do not reach, and right ones that they do. Members are ("l", v), ("r", w)."""
    back = {w: v for v, w in mate.items()}
    seen_l, seen_r = {v for v in left if v not in mate}, set()
    work = list(seen_l)
    while work:
        for w in near.get(work.pop(), ()):
            if w not in seen_r:
                seen_r.add(w)
                if w in back and back[w] not in seen_l:
                    seen_l.add(back[w])
                    work.append(back[w])
    return {("l", v) for v in mate if v not in seen_l} | {("r", w) for w in seen_r}


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in a cheapest complete assignment of a square matrix (potentials and
    shortest augmenting paths, one row at a time)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.full(n + 1, n)  # the last place stands for the row being added
    for row in range(n):
        row_of[n] = row
        least, came = np.full(n, np.inf), np.full(n, n)
        done = np.zeros(n + 1, bool)
        column = n
        while row_of[column] != n or column == n:
            done[column] = True
            r = row_of[column]
            slack = cost[r] - u[r] - v[:n]
            better = ~done[:n] & (slack < least)
            least[better], came[better] = slack[better], column
            open_ = np.where(done[:n], np.inf, least)
            nearest = int(open_.argmin())
            delta = open_[nearest]
            taken = np.flatnonzero(done)
            u[row_of[taken]] += delta
            v[taken] -= delta
            least[~done[:n]] -= delta
            column = nearest
            if row_of[column] == n:
                break
        while column != n:
            row_of[column] = row_of[came[column]]
            column = int(came[column])
    out = [0] * n
    for c in range(n):
        out[row_of[c]] = c
    return out


def general_matching(vertices: list, near: dict) -> dict:
    """A maximum matching of any graph, vertex -> mate both ways: breadth-first alternating trees,
    odd cycles shrunk to their base."""
    mate: dict = {}
    for root in vertices:
        if root in mate:
            continue
        base = {v: v for v in vertices}
        via: dict = {}
        outer, work = {root}, deque([root])

        def climb(v):
            path = []
            while True:
                v = base[v]
                path.append(v)
                if v == root:
                    return path
                v = via[mate[v]]

        def shrink(v, w, top, inside):
            while base[v] != top:
                inside |= {base[v], base[mate[v]]}
                via[v] = w
                w = mate[v]
                v = via[w]

        end = None
        while work and end is None:
            v = work.popleft()
            for w in near.get(v, ()):
                if base[v] == base[w] or mate.get(v) == w:
                    continue
                if w in outer:
                    up = set(climb(v))
                    top = next(x for x in climb(w) if x in up)
                    inside: set = set()
                    shrink(v, w, top, inside)
                    shrink(w, v, top, inside)
                    for x in vertices:
                        if base[x] in inside:
                            base[x] = top
                            if x not in outer:
                                outer.add(x)
                                work.append(x)
                elif w not in via:
                    via[w] = v
                    if w not in mate:
                        end = w
                        break
                    outer.add(mate[w])
                    work.append(mate[w])
        while end is not None:
            v = via[end]
            after = mate.get(v)
            mate[v], mate[end] = end, v
            end = after
    return mate
