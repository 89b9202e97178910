"""Planarity by embedding face by face: a cycle of a block is drawn, then bridges (fragments) are
laid into faces that hold all their contacts, those with one face to go first. A fragment without
a face proves that the block is not planar."""

from __future__ import annotations

from .search import biconnected_edges, depth_first


def _cycle(near: dict) -> list:
    parent, depth = {}, {}
    adj = {v: [(w, None) for w in sorted(ws)] for v, ws in near.items()}
    for v, _, p in depth_first(adj, min(near)):
        parent[v], depth[v] = p, depth[p] + 1 if p is not None else 0
        up = [w for w in near[v] if w in depth and w != p]
        if up:
            top = min(up, key=lambda w: depth[w])
            path = [v]
            while path[-1] != top:
                path.append(parent[path[-1]])
            return path
    raise ValueError("no cycle")


def _fragments(near: dict, drawn: set, done: set) -> list[tuple[frozenset, object]]:
    """(contacts, an undrawn edge or an inner vertex) of each fragment."""
    out = [(frozenset(e), e) for e in {frozenset((u, v)) for u in drawn for v in near[u] if v in drawn} - done]
    seen: set = set()
    for v in near:
        if v in drawn or v in seen:
            continue
        inner, contacts, work = {v}, set(), [v]
        while work:
            for w in near[work.pop()]:
                if w in drawn:
                    contacts.add(w)
                elif w not in inner:
                    inner.add(w)
                    work.append(w)
        seen |= inner
        out.append((frozenset(contacts), frozenset(inner)))
    return out


def _path(near: dict, drawn: set, contacts: frozenset, inner) -> list:
    """A path through the fragment between two of its contacts."""
    a = min(contacts)
    if inner == contacts and len(contacts) == 2 and all(x in drawn for x in inner):
        return [a, max(contacts)]
    via = {w: a for w in near[a] if w in inner}
    work = list(via)
    while work:
        v = work.pop(0)
        for w in sorted(near[v]):
            if w in contacts and w != a:
                path = [w, v]
                while path[-1] != a:
                    path.append(via[path[-1]])
                return path[::-1]
            if w in inner and w not in via:
                via[w] = v
                work.append(w)
    raise ValueError("a block's fragment has two contacts")


def block_is_planar(edges) -> bool:
    near: dict = {}
    for _, u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    n, m = len(near), len(edges)
    if n < 5:
        return True
    if m > 3 * n - 6:
        return False
    cycle = _cycle(near)
    faces = [cycle, cycle[:]]
    drawn = set(cycle)
    done = {frozenset((a, b)) for a, b in zip(cycle, cycle[1:] + cycle[:1], strict=True)}
    while fragments := _fragments(near, drawn, done):
        choices = [(f, [i for i, face in enumerate(faces) if f[0] <= set(face)]) for f in fragments]
        (contacts, inner), fit = min(choices, key=lambda x: len(x[1]))
        if not fit:
            return False
        path = _path(near, drawn, contacts, inner)
        face = faces.pop(fit[0])
        i, j = face.index(path[0]), face.index(path[-1])
        if i > j:
            i, j, path = j, i, path[::-1]
        middle = path[1:-1]
        faces += [face[: i + 1] + middle + face[j:], face[i : j + 1] + middle[::-1]]
        drawn |= set(path)
        done |= {frozenset(e) for e in zip(path, path[1:], strict=False)}
    return True


def is_planar(vertices, edges) -> bool:
    """Of the simple graph beneath: loops and parallel edges do not matter."""
    simple = sorted({(min(t, h), max(t, h)) for _, t, h in edges if t != h})
    return all(block_is_planar(b) for b in biconnected_edges(vertices, [(i, t, h) for i, (t, h) in enumerate(simple)]))
