"""Exact and first-fit colouring."""

from __future__ import annotations


def first_fit(near: dict) -> dict:
    """Colours from 0, vertices in key order, each the least that no neighbour has."""
    colour: dict = {}
    for v in sorted(near):
        used = {colour[w] for w in near[v] if w in colour}
        colour[v] = next(c for c in range(len(used) + 1) if c not in used)
    return colour


def with_colours(near: dict, limit: int) -> dict | None:
    """A proper colouring with colours 1..limit, or None: backtracking on the vertex with the fewest
    colours left; a new colour is tried once only, as colours are alike."""
    colour: dict = {}

    def free(v):
        return [c for c in range(1, min(limit, max(colour.values(), default=0) + 1) + 1) if all(colour.get(w) != c for w in near[v])]

    def pick():
        left = [v for v in near if v not in colour]
        return min(left, key=lambda v: (limit - len({colour[w] for w in near[v] if w in colour}), -len(near[v]), v)) if left else None

    if any(v in near[v] for v in near):
        return None
    stack: list = []
    v = pick()
    if v is None:
        return {}
    stack.append((v, iter(free(v))))
    while stack:
        v, choices = stack[-1]
        colour.pop(v, None)
        for c in choices:
            colour[v] = c
            following = pick()
            if following is None:
                return colour
            stack.append((following, iter(free(following))))
            break
        else:
            stack.pop()
    return None
