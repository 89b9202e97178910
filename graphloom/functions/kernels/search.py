"""Search orders, cut vertices, bridges and cycles."""

from __future__ import annotations

from . import adjacency


def depth_first(adj: dict, start) -> list[tuple]:
    """(vertex, order, parent) in preorder, smallest neighbour first."""
    out, seen, stack = [], set(), [(start, None)]
    while stack:
        v, parent = stack.pop()
        if v in seen:
            continue
        seen.add(v)
        out.append((v, len(out), parent))
        stack += [(w, v) for w, _ in reversed(adj[v]) if w not in seen]
    return out


def lexicographic(adj: dict, start, depth_first_labels: bool) -> list:
    """Lexicographic BFS (labels grow at the end) or DFS (at the front) from ``start``; ties by key.

    Vertices of equal labels form a class, in key order; classes stand in the order of their labels. A
    visited vertex splits the classes of its neighbours: for BFS each part goes just before its class,
    for DFS all go to the front. What left a class is skipped when the class is read."""
    classes = [[start], [v for v in sorted(adj) if v != start]]
    of = dict.fromkeys(classes[1], 1) | {start: 0}
    read, place, after, before = [0, 0], [0, 1], [1, None], [None, 0]
    stack, first, out = [1, 0], 0, []  # DFS: the stack's end comes first; BFS: linked from first on
    while stack if depth_first_labels else first is not None:
        c = stack[-1] if depth_first_labels else first
        if read[c] == len(classes[c]):
            if depth_first_labels:
                stack.pop()
            else:
                first = after[c]
                if first is not None:
                    before[first] = None
            continue
        v = classes[c][read[c]]
        read[c] += 1
        if of[v] != c:
            continue
        of[v] = None
        out.append(v)
        parts: dict = {}
        for w in dict.fromkeys(w for w, _ in adj[v]):
            if of[w] is not None:
                parts.setdefault(of[w], []).append(w)
        for c in sorted(parts, key=place.__getitem__, reverse=True) if depth_first_labels else parts:
            new = len(classes)
            classes.append(parts[c])
            of.update(dict.fromkeys(parts[c], new))
            read.append(0)
            place.append(-new)
            after.append(c)
            before.append(before[c])
            if depth_first_labels:
                stack.append(new)
                continue
            if before[c] is None:
                first = new
            else:
                after[before[c]] = new
            before[c] = new
    return out


def low_points(vertices, edges) -> tuple[set, set]:
    """Cut vertices and bridge keys; parallel edges are told apart by key."""
    adj = adjacency(vertices, edges)
    order: dict = {}
    low: dict = {}
    cuts, bridges = set(), set()
    for root in adj:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        children = 0
        stack = [(root, None, iter(adj[root]))]
        while stack:
            v, via, rest = stack[-1]
            for w, key in rest:
                if key == via or w == v:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    stack.append((w, key, iter(adj[w])))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > order[u]:
                        bridges.add(via)
                    if u == root:
                        children += 1
                    elif low[v] >= order[u]:
                        cuts.add(u)
        if children > 1:
            cuts.add(root)
    return cuts, bridges


def biconnected_edges(vertices, edges) -> list[list]:
    """Edge lists of the blocks of a simple graph."""
    adj = adjacency(vertices, edges)
    ends = {key: (t, h) for key, t, h in edges}
    order: dict = {}
    low: dict = {}
    blocks, used, trail = [], set(), []
    for root in adj:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(adj[root]))]
        while stack:
            v, via, rest = stack[-1]
            for w, key in rest:
                if w == v or key in used:
                    continue
                used.add(key)
                trail.append(key)
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    stack.append((w, key, iter(adj[w])))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= order[u]:
                        at = len(trail) - 1 - trail[::-1].index(via)
                        blocks.append([(k, *ends[k]) for k in trail[at:]])
                        del trail[at:]
    return blocks


def simple_cycles(vertices, edges, length: int, directed: bool) -> int:
    """Number of simple cycles of a length of three or more: each is found from its smallest vertex."""
    adj = adjacency(vertices, edges, directed)
    found = 0
    for start in adj:
        stack = [(start, 1, frozenset([start]))]
        while stack:
            v, n, seen = stack.pop()
            for w, _ in adj[v]:
                if w == start and n == length:
                    found += 1
                elif w > start and n < length and w not in seen:
                    stack.append((w, n + 1, seen | {w}))
    return found if directed else found // 2


def one_cycle(adj: dict) -> list:
    """The vertices of some directed cycle of a graph in which every vertex has a successor."""
    v, seen, path = min(adj), {}, []
    while v not in seen:
        seen[v] = len(path)
        path.append(v)
        v = next(w for w, _ in adj[v])
    cycle = path[seen[v] :]
    at = cycle.index(min(cycle))
    return cycle[at:] + cycle[:at]
