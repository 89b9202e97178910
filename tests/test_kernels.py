"""Sequential kernels against brute force on random small graphs (fixed seeds)."""

import itertools
import random
import time

import numpy as np
import pytest

from graphloom.functions.kernels import adjacency, colouring, flow, matching, planarity, search


def components(vertices, edges):
    top = {v: v for v in vertices}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for _, a, b in edges:
        if a in top and b in top:
            top[find(a)] = find(b)
    return len({find(v) for v in vertices})


def graphs():
    rng = random.Random(7)
    for _ in range(120):
        n = rng.randint(2, 8)
        yield rng, list(range(n)), [(i, rng.randrange(n), rng.randrange(n)) for i in range(rng.randint(0, 14))]


def best_matching(edges):
    if not edges:
        return 0
    (a, b), rest = edges[0], edges[1:]
    return max(best_matching(rest), 1 + best_matching([e for e in rest if a not in e and b not in e]))


def test_low_points():
    for _, v, e in graphs():
        cuts, bridges = search.low_points(v, e)
        assert bridges == {k for k, *_ in e if components(v, [x for x in e if x[0] != k]) > components(v, e)}
        assert cuts == {x for x in v if components([y for y in v if y != x], [y for y in e if x not in y[1:]]) > components(v, e)}


def test_matchings_and_covers():
    for _, v, e in graphs():
        near = {x: {w for w, _ in ws if w != x} for x, ws in adjacency(v, e).items()}
        simple = sorted({tuple(sorted(x[1:])) for x in e if x[1] != x[2]})
        mate = matching.general_matching(v, near)
        assert all(mate[mate[x]] == x and mate[x] in near[x] for x in mate) and len(mate) // 2 == best_matching(simple)
        left = [x for x in v if x % 2]
        right = {x: sorted(w for w in near[x] if w % 2 == 0) for x in left}
        pairs = [(x, w) for x in left for w in right[x]]
        m = matching.bipartite_matching(left, right)
        cover = matching.cover_of(left, right, m)
        assert len(m) == best_matching(pairs) == len(cover) and all(("l", a) in cover or ("r", b) in cover for a, b in pairs)


def test_assignment():
    rng = random.Random(3)
    for n in range(1, 7):
        for _ in range(15):
            w = np.array([[rng.randint(-9, 9) for _ in range(n)] for _ in range(n)], float)
            got = matching.assignment(w)
            assert sorted(got) == list(range(n))
            assert sum(w[i, j] for i, j in enumerate(got)) == min(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_flow_equals_least_cut():
    for rng, v, e in graphs():
        arcs = [(a, b, rng.randint(1, 5)) for _, a, b in e]
        inner = [x for x in v if x > 1]
        cuts = [{0, *s} for r in range(len(inner) + 1) for s in itertools.combinations(inner, r)]
        least = min(sum(c for a, b, c in arcs if a in s and b not in s) for s in cuts)
        assert flow.max_flow(arcs, 0, 1) == flow.augmenting_flow(arcs, 0, 1) == least


def test_colouring():
    for rng, v, e in graphs():
        e = [x for x in e if x[1] != x[2]]
        near = {x: {w for w, _ in ws} for x, ws in adjacency(v, e).items()}
        k = rng.randint(1, 4)
        found = colouring.with_colours(near, k)
        able = any(all(c[a] != c[b] for _, a, b in e) for c in itertools.product(range(k), repeat=len(v)))
        assert (found is not None) == able
        for c in (found, colouring.first_fit(near)):
            assert c is None or len(c) == len(v) and all(c[a] != c[b] for _, a, b in e)


@pytest.mark.parametrize("directed", [False, True])
def test_cycles(directed):
    for _, v, e in graphs():
        pairs = {(a, b) if directed else tuple(sorted((a, b))) for _, a, b in e if a != b}
        there = pairs | (set() if directed else {(b, a) for a, b in pairs})
        for n in (3, 4):
            want = sum(1 for p in itertools.permutations(v, n) if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in there for i in range(n)))
            assert search.simple_cycles(v, [(i, *p) for i, p in enumerate(sorted(pairs))], n, directed) == (want if directed else want // 2)


def stacked_triangles(rng, n):
    faces, edges = [(0, 1, 2), (0, 2, 1)], {(0, 1), (1, 2), (0, 2)}
    for v in range(3, n):
        a, b, c = faces.pop(rng.randrange(len(faces)))
        edges |= {(a, v), (b, v), (c, v)}
        faces += [(a, b, v), (b, c, v), (c, a, v)]
    return edges


def test_planarity():
    rng = random.Random(2)
    numbered = lambda es: [(i, *e) for i, e in enumerate(sorted(es))]
    for n in (5, 6, 9, 14, 30):
        full = stacked_triangles(rng, n)
        assert planarity.is_planar(range(n), numbered(full))
        assert planarity.is_planar(range(n), numbered(rng.sample(sorted(full), len(full) * 2 // 3)))
        missing = [(a, b) for a, b in itertools.combinations(range(n), 2) if (a, b) not in full]
        if missing:
            assert not planarity.is_planar(range(n), numbered(full | {rng.choice(missing)}))
    for base in (list(itertools.combinations(range(5), 2)), [(a, b) for a in range(3) for b in range(3, 6)]):
        split = [p for i, (a, b) in enumerate(base) for p in ((a, 100 + i), (b, 100 + i))]
        v = {x for e in split for x in e}
        assert not planarity.is_planar(v, numbered(split)) and planarity.is_planar(v, numbered(split[1:]))


def by_labels(adj, start, depth_first_labels):
    near = {v: {w for w, _ in ws if w != v} for v, ws in adj.items()}
    labels, left, out = dict.fromkeys(adj, ()) | {start: (len(adj) + 1,)}, set(adj), []
    while left:
        v = min(left, key=lambda x: (tuple(-i for i in labels[x]) + (1,), x))
        left.discard(v)
        step = len(out) + 1 if depth_first_labels else len(adj) - len(out)
        out.append(v)
        for w in near[v] & left:
            labels[w] = (step, *labels[w]) if depth_first_labels else (*labels[w], step)
    return out


def test_lexicographic_orders_equal_labels_and_take_linear_time():
    for rng, v, e in graphs():
        adj, start = adjacency(v, e), rng.choice(list(v))
        for down in (False, True):
            assert search.lexicographic(adj, start, down) == by_labels(adj, start, down)
    n = 40_000  # a star, whose leaves stay in one class; picking the least label each time took n * n steps
    adj = adjacency(range(n), [(i, 0, i) for i in range(1, n)])
    began = time.process_time()
    assert search.lexicographic(adj, 0, False) == search.lexicographic(adj, 0, True) == list(range(n))
    assert time.process_time() - began < 20


def test_lexicographic_bfs_of_a_chordal_graph_gives_perfect_elimination():
    edges = [(0, 0, 1), (1, 0, 2), (2, 1, 2), (3, 1, 3), (4, 2, 3), (5, 3, 4)]
    order = search.lexicographic(adjacency(range(5), edges), 0, False)
    near = {v: {w for w, _ in ws} for v, ws in adjacency(range(5), edges).items()}
    for i, v in enumerate(order):
        before = [w for w in order[:i] if w in near[v]]
        assert all(b in near[a] for a, b in itertools.combinations(before, 2))
    assert order[0] == 0
