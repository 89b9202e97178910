"""The graph engine on small literal graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom import errors
from graphloom.graph import PropertyGraph
from graphloom.operators import colouring, flow, matching, paths, spanning, traversal
from graphloom.operators.bipartite import Bipartite
from graphloom.operators.forest import DisjointSets, Forest, ParentForest
from graphloom.operators.hyper import HyperGraph
from graphloom.operators.ordered import IndexedArray, OrderedMap, PriorityTable, SequenceTable
from graphloom.operators.per_component import rows_by_component
from graphloom.operators.spatial import BoxTable, PrefixMap, _may_hold, _summary, _tiled, centre_distance
from graphloom.plans.jobs import JobGraph, State
from graphloom.plans.workflow import Parameter, Task, Workflow
from graphloom.sources import documents, drawing, generators
from graphloom.streaming.connectivity import OnlineConnectivity, run_stream


def keys(df, column="key"):
    return sorted(r[column] for r in df.select(column).collect())


@pytest.fixture(scope="module")
def basic(spark):
    return PropertyGraph.of_lists(spark, range(1, 7), [(1, 2), (1, 3), (2, 3), (4, 5), (5, 6)], name="basic")


@pytest.fixture(scope="module")
def arrows(spark):
    return PropertyGraph.of_lists(spark, range(1, 7), [(2, 1), (3, 2), (6, 5), (5, 4), (5, 2)], directed=True)


def rolled(seed, n, m, top=20):
    """A seeded connected graph without parallel edges: (tail, head, weight)."""
    rng = random.Random(seed)
    pairs = {(rng.randrange(b), b) for b in range(1, n)}
    while len(pairs) < m:
        pairs.add(tuple(sorted(rng.sample(range(n), 2))))
    return [(a, b, rng.randrange(1, top)) for a, b in sorted(pairs)]


def parts_of(n, edges):
    """Components by brute force."""
    comp = list(range(n))
    for _ in range(n):
        for a, b, *_ in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return len(set(comp))


ROLLED = rolled(11, 8, 14)


def distances():
    d = {(i, j): 0 if i == j else float("inf") for i in range(8) for j in range(8)}
    for a, b, w in ROLLED:
        d[a, b] = d[b, a] = min(w, d[a, b])
    for k, i, j in itertools.product(range(8), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return d


@pytest.fixture(scope="module")
def weighted(spark):
    return PropertyGraph.of_lists(spark, range(8), ROLLED)


def test_properties(basic, arrows, spark):
    assert (basic.order(), basic.size(), basic.is_simple(), basic.is_connected(), basic.is_acyclic(), basic.is_regular()) == (6, 5, True, False, False, False)
    assert (arrows.order(), arrows.size(), arrows.is_connected(), arrows.is_unilateral(), arrows.is_acyclic(), arrows.is_tree()) == (6, 5, True, False, True, True)
    assert (basic.min_degree(), basic.max_degree(), basic.average_degree(), basic.multiplicity()) == (1, 2, 10 / 6, 1)
    odd = PropertyGraph.of_lists(spark, [1, 2], [(1, 1, -1), (1, 2), (2, 1)], directed=True)
    assert (odd.has_loop(), odd.has_negative_weight(), odd.multiplicity(), odd.degree(1), odd.in_degree(1), odd.out_degree(1), odd.is_simple()) == (True, True, 2, 4, 2, 2, False)
    assert odd.property("multiplicity") == 2 and odd.property("acyclic") is False and odd.property("directed") is True
    k4 = generators.complete_graph(spark, 4)
    assert k4.is_complete() and not basic.is_complete() and k4.is_regular()
    empty = PropertyGraph.empty(spark)
    assert (empty.order(), empty.average_degree(), empty.is_regular(), empty.is_connected(), empty.is_acyclic()) == (0, 0.0, True, True, True)


def test_validation(spark, basic):
    with pytest.raises(errors.AlreadyExistsError):
        basic.add_vertex(1)
    with pytest.raises(errors.NotExistsError) as e:
        basic.add_edge(99, 1, 77)
    assert errors.is_not_exists(e.value) and not errors.is_already_exists(e.value)
    with pytest.raises(errors.AlreadyExistsError):
        basic.add_edge(0, 1, 2)
    with pytest.raises(errors.NotExistsError):
        basic.remove_vertex(77)
    with pytest.raises(errors.NotExistsError):
        PropertyGraph.of_lists(spark, [1], [(1, 2)])


def test_edits_and_lookups(basic):
    g = basic.add_vertex(7, {"a": 1}, 2.0, {"c": "x"}).add_edge(10, 7, 1, 3.0).set_edge_label_by_key(10, "k", "v").set_edge_value_by_key(10, "w")
    assert g.vertex(7).value == '{"a": 1}' and g.vertex(7).weight == 2.0 and g.edge(10).labels == {"k": "v"}
    assert keys(g.vertices_by_label({"c": "x"})) == [7] and keys(g.edges_by_label({"k": "v"})) == [10]
    assert g.delete_edge_label_by_key(10, "k").edge(10).labels == {} and keys(g.neighbours(1)) == [2, 3, 7]
    assert keys(g.incident_edges(1)) == [0, 1, 10] and keys(g.neighbour_edges_by_key(0)) == [1, 2, 10] and keys(g.neighbour_edges(2, 1)) == [1, 2, 10]
    assert keys(g.edges_between(3, 1)) == [1] and g.remove_edges(3, 1).size() == 5 and g.remove_all_edges().size() == 0
    assert g.set_edge_value(1, 2, 5).edge(0).value == "5" and g.set_edge_label(2, 1, "m", "n").edge(0).labels == {"m": "n"} and g.set_edge_weight(0, 9).edge(0).weight == 9
    assert g.delete_edge_label(1, 2, "m").edge(0).labels == {} and g.random_vertex(1).key in range(1, 8) and g.random_edge(1).key is not None
    patch = g.spark.createDataFrame([(1, 5.5)], "key long, weight double")
    assert g.patch_vertices(patch, "weight").vertex(1).weight == 5.5 and g.renamed("z").name == "z" and g.clone() is g


def test_cuts_and_ends(arrows):
    assert keys(arrows.sources()) == [3, 6] and keys(arrows.sinks()) == [1, 4] and keys(arrows.in_neighbours(2)) == [3, 5] and keys(arrows.out_neighbours(5)) == [2, 4]
    x = arrows.spark.createDataFrame([(2,), (1,)], "key long")
    assert keys(arrows.arc_cut(x)) == [] and keys(arrows.arc_cut(x, True)) == [1, 4] and keys(arrows.coboundary(x)) == [1, 4]
    assert keys(arrows.reversed().out_edges(2)) == [1, 4] and keys(arrows.in_edges(2)) == [1, 4]


def test_algebra(spark, basic):
    other = PropertyGraph.of_lists(spark, [1, 2, 9], [(1, 2), (2, 9)])
    assert basic.union(other).order() == 7 and keys(basic.intersection(other).vertices) == [1, 2] and basic.contains(basic.induced(spark.range(1, 4))) and not basic.contains(other)
    pairs = spark.createDataFrame([(2, 1)], "a long, b long")
    assert keys(basic.spanning_without(pairs).edges) == [1, 2, 3, 4]
    sub = basic.subdivide(0, 50, 100, 101)
    assert (sub.order(), sub.size()) == (7, 6) and keys(sub.neighbours(50)) == [1, 2]
    con = basic.contract(1, 2, 60)
    assert keys(con.neighbours(60)) == [3] and con.size() == 4 and basic.identify(1, 2, 60).order() == 5
    sp = basic.split(1, "new", 70, 71)
    assert sp.size() == 8 and keys(sp.neighbours(70)) == [2, 3, 71]
    line = generators.complete_graph(spark, 4).line_graph()
    assert (line.order(), line.size()) == (6, 12)
    product = generators.cycle(spark, 4).product(generators.complete_graph(spark, 2))
    assert (product.order(), product.size(), product.is_regular()) == (8, 12, True)


def test_traversal(basic, arrows, spark):
    assert {r.key: r.depth for r in traversal.breadth_first(basic, 1).collect()} == {1: 0, 2: 1, 3: 1}
    assert keys(traversal.breadth_first(arrows, 2, incoming=True)) == [2, 3, 5, 6] and traversal.reaches(arrows, 6, 1) and not traversal.reaches(arrows, 1, 6)
    assert [r.key for r in traversal.depth_first(basic, 1).orderBy("position").collect()] == [1, 2, 3]
    assert traversal.topological_sort(arrows) == [3, 6, 5, 2, 4, 1]
    ring = PropertyGraph.of_lists(spark, range(6), [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5)], directed=True)
    with pytest.raises(errors.CycleError):
        traversal.topological_layers(ring)
    assert {r.key: r.comp for r in traversal.strong_components(ring).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert traversal.detect_cycle(ring) == [0, 1, 2] and traversal.detect_cycle(arrows) == [] and keys(traversal.condensation(ring).edges) == ["0:3", "3:5"]
    assert traversal.is_bipartite(generators.cycle(spark, 8)) and not traversal.is_bipartite(generators.cycle(spark, 9)) and traversal.is_bipartite(PropertyGraph.empty(spark))
    assert sorted(map(tuple, traversal.sides(generators.cycle(spark, 4)).collect())) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_detect_cycle_beyond_the_kernel(spark, monkeypatch):
    graphs = [[(0, 7), (7, 5), (5, 6), (6, 4), (4, 5), (1, 2), (2, 3), (3, 1), (3, 0)], [(0, 9), (9, 9), (1, 2), (2, 1), (2, 0)], [(3, 4), (4, 5), (5, 3), (1, 2)], [(1, 2), (2, 3)]]
    graphs = [PropertyGraph.of_lists(spark, range(10), arcs, directed=True) for arcs in graphs]
    want = [traversal.detect_cycle(g) for g in graphs]
    assert want == [[4, 5, 6], [9], [3, 4, 5], []]
    monkeypatch.setattr("graphloom.operators.per_component.MAX_KERNEL_EDGES", 2)
    assert [traversal.detect_cycle(g) for g in graphs] == want


def test_bridges_and_cut_vertices(spark):
    edges = [(a, b) for a, b, _ in rolled(5, 11, 13)]
    g = PropertyGraph.of_lists(spark, range(11), edges)
    bridges = [k for k in range(len(edges)) if parts_of(11, edges[:k] + edges[k + 1 :]) > 1]
    cuts = [v for v in range(11) if parts_of(11, [e for e in edges if v not in e]) > 2]
    assert 0 < len(bridges) < len(edges) and 0 < len(cuts) < 11
    assert keys(traversal.bridges(g)) == bridges and keys(traversal.cut_vertices(g)) == cuts
    assert traversal.is_bridge(g, bridges[0]) and not traversal.is_bridge(g, min(set(range(len(edges))) - set(bridges)))
    assert traversal.is_cut_vertex(g, cuts[0]) and not traversal.is_cut_vertex(g, min(set(range(11)) - set(cuts)))
    twin = PropertyGraph.of_lists(spark, [1, 2, 3], [(1, 2), (1, 2), (2, 3)])
    assert keys(traversal.bridges(twin)) == [2] and not traversal.is_bridge(twin, 0) and traversal.count_cycles(twin, 2) == 1


@pytest.mark.parametrize("with_edges", [True, False])
def test_shortest_paths(weighted, with_edges):
    got = {r.target: (r.weight, r.edges) for r in paths.shortest_paths(weighted, 1, with_edges).collect()}
    assert {k: w for k, (w, _) in got.items()} == {j: w for (i, j), w in distances().items() if i == 1}
    for target, (weight, edges) in got.items():
        at = 1
        for k in edges or []:
            a, b, _ = ROLLED[k]
            at = b if at == a else a
        assert (at, sum(ROLLED[k][2] for k in edges)) == (target, weight) if with_edges else edges == []


def test_path_edges(weighted, spark, arrows):
    row = paths.shortest_path(arrows, 6, 1).first()
    assert row.weight == 0 and row.edges == [2, 4, 0] and paths.shortest_path(arrows, 1, 6).first().weight is None
    negative = PropertyGraph.of_lists(spark, range(4), [(0, 1, 4), (0, 2, 2), (1, 3, -5), (2, 1, -1), (3, 2, 7)], directed=True)
    assert {r.target: r.weight for r in paths.shortest_paths(negative, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: -4}
    with pytest.raises(errors.NegativeCycleError):
        paths.shortest_paths(PropertyGraph.of_lists(spark, [0, 1], [(0, 1, -1)]), 0)
    pairs = {(r.source, r.target): r.weight for r in paths.all_shortest_paths(weighted).collect()}
    assert pairs == distances()


def test_spanning(weighted, basic):
    tree, weight = spanning.spanning_tree(weighted)
    chosen = []
    for w, k in sorted((w, k) for k, (_, _, w) in enumerate(ROLLED)):
        if parts_of(8, [ROLLED[i] for i in [*chosen, k]]) < parts_of(8, [ROLLED[i] for i in chosen]):
            chosen.append(k)
    assert keys(tree) == sorted(chosen) and weight == sum(ROLLED[k][2] for k in chosen)
    with pytest.raises(errors.DisconnectedError):
        spanning.spanning_tree(basic)
    assert sorted((r.comp, r.vertices, r.edges) for r in spanning.forest_by_component(basic).collect()) == [(1, 3, 2), (4, 3, 2)]


def test_flow(spark):
    g = PropertyGraph.of_lists(spark, range(6), [(0, 1, 16), (0, 2, 13), (1, 3, 12), (2, 1, 4), (3, 2, 9), (2, 4, 14), (4, 3, 7), (3, 5, 20), (4, 5, 4)], directed=True)
    assert flow.max_flow(g, 0, 5) == 23 and flow.edge_disjoint_paths(g, 0, 5) == 2 and flow.vertex_disjoint_paths(g, 0, 5) == 2 and flow.max_flow(g, 5, 0) == 0


def test_bipartite(spark):
    v = spark.range(1, 9).select(F.col("id").alias("key"), (F.col("id") < 5).alias("part_a"))
    e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(1, 5), (1, 7), (2, 5), (3, 5), (3, 6), (4, 7), (4, 8)])], "key long, tail long, head long")
    g = Bipartite.of_parts(v, e)
    assert g.maximum_matching().count() == 4 == g.minimum_vertex_cover().count() and g.perfect_matching().count() == 4
    assert g.in_part_a(1) and g.part_order(False) == 4 and g.without_part(True).order() == 4 and g.add_vertex_to(9, True).part_order(True) == 5
    with pytest.raises(errors.GraphError):
        g.add_edge(50, 1, 2)
    with pytest.raises(errors.NoSolutionError):
        g.add_vertex_to(9, True).perfect_matching()
    with pytest.raises(errors.NoSolutionError):
        g.without_vertices(spark.range(5, 6)).weighted_matching(False)
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(8), 8 + rng.randrange(6)) for _ in range(22)})
    big = Bipartite.of_parts(spark.range(14).select(F.col("id").alias("key"), (F.col("id") < 8).alias("part_a")), spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "key long, tail long, head long"))
    least = min(len(x) + len({b for a, b in pairs if a not in x}) for n in range(9) for x in itertools.combinations(range(8), n))
    assert big.minimum_vertex_cover().count() == least == big.maximum_matching().count()


def test_bipartite_matching_beyond_the_kernel(spark):
    rng, n = random.Random(4), 9
    # A path with greedy traps, a star and random pairs: with few edges, paths must be turned over.
    pairs = sorted({(2 * i, 2 * j + 1) for i in range(n) for j in (i, i + 1)} | {(100 + 2 * i, 101) for i in range(4)} | {(2 * rng.randrange(n), 2 * rng.randrange(n) + 1) for _ in range(3)})
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(999, *pairs[0])], "key long, tail long, head long")
    vertices = spark.createDataFrame([(v, v % 2 == 0) for v in sorted({x for p in pairs for x in p} | {998})], "key long, part_a boolean")
    g = Bipartite.of_parts(vertices, edges)
    want, cover = matching.matching_and_cover(g)
    got, found = matching.matching_and_cover(g, limit=0)
    rows = [(r.key, r.a, r.b) for r in got.collect()]
    assert len(rows) == len({a for _, a, _ in rows}) == len({b for *_, b in rows}) == want.count() == n + 1 and all(pairs[k] == (a, b) for k, a, b in rows)
    kept = keys(found)
    assert kept == keys(cover) and len(kept) == n + 1 and all(a in kept or b in kept for a, b in pairs)
    # Ends are turned in either direction: the path 1 - 0 - 3 - 2 from its inner pair.
    path = spark.createDataFrame([(0, 1), (0, 3), (2, 3)], "a long, b long")
    m, cover = matching._in_rounds(path, spark.createDataFrame([(0, 3)], "a long, b long"))
    assert sorted(map(tuple, m.collect())) == [(0, 1), (2, 3)] and keys(cover) == [0, 2]


def test_general_matching_and_colouring(spark):
    p = generators.petersen(spark)
    assert matching.perfect_matching(p).count() == 5 and colouring.vertex_colouring(p, 3).select("colour").distinct().count() == 3
    with pytest.raises(errors.NoSolutionError):
        colouring.vertex_colouring(p, 2)
    with pytest.raises(errors.NoSolutionError):
        colouring.edge_colouring(p, 3)
    assert colouring.greedy_edge_colouring(p).count() == 15 and not colouring.is_planar(p) and colouring.is_planar(generators.wheel(spark, 9))
    with pytest.raises(errors.ComponentTooLargeError):
        rows_by_component(p, limit=3)


def test_hypergraph(spark):
    v = spark.range(1, 6).toDF("key")
    g = HyperGraph.of(v, spark.createDataFrame([(1, [3, 1, 2]), (2, [2, 4]), (3, [1, 2])], "key long, members array<long>"))
    assert keys(g.edges_with([1, 2])) == [1, 3] and keys(g.edges_with([1, 2], exact=True)) == [3] and keys(g.neighbours(2)) == [1, 3, 4] and g.degree(2) == 3
    assert keys(g.neighbour_edges_by_key(2)) == [1, 3] and keys(g.neighbour_edges([4])) == [2] and keys(g.incident_edges(1)) == [1, 3] and g.edge(1).members == [1, 2, 3]
    assert keys(g.remove_vertex(1).edges) == [2] and g.remove_edges([1, 2], True).size() == 2 and g.remove_edge_by_key(1).size() == 2 and g.remove_all_edges().size() == 0
    h = g.add_vertex(9).add_edge(7, [9, 1]).set_edge_label([9], "a", "b").set_edge_value_by_key(7, "q").set_edge_weight(7, 3).set_vertex_label(9, "x", "y").set_vertex_weight(9, 2).set_vertex_value(9, 1)
    assert h.edge(7).labels == {"a": "b"} and h.edge(7).weight == 3 and keys(h.vertices_by_label({"x": "y"})) == [9] and keys(h.edges_by_label({"a": "b"})) == [7]
    assert h.delete_edge_label([9], "a").edge(7).labels == {} and h.delete_vertex_label(9, "x").vertex(9).labels == {} and h.order() == 6 and h.clone() is h
    with pytest.raises(errors.GraphError):
        g.add_edge(8, [])
    with pytest.raises(errors.NotExistsError):
        g.add_edge(8, [77])


_RNG = random.Random(4)
UP = {v: _RNG.randrange(max(1, v // 3), v) for v in range(2, 31)}
TREE = [(p, v) for v, p in UP.items()]


def chain(v):
    return [v, *chain(UP[v])] if v in UP else [v]


def meeting(a, b):
    return next(x for x in chain(a) if x in chain(b))


ANCESTORS = [(a, b, meeting(a, b)) for a, b in ((2, 3), (6, 10), (13, 7), (24, 26), (22, 16), (30, 28), (9, 30), (17, 4))]


def test_forest(spark):
    f = Forest.of(PropertyGraph.of_lists(spark, range(1, 31), TREE)).set_root(1)
    assert f.is_tree() and f.root(30) == 1 and f.all_roots() == [1] and not f.is_digraph()
    from graphloom.operators.forest import lowest_common_ancestors

    pairs = spark.createDataFrame([t[:2] for t in ANCESTORS], "a long, b long")
    assert {tuple(r) for r in lowest_common_ancestors(f.parents().select("key", "parent"), pairs).collect()} == set(ANCESTORS)
    assert f.lowest_common_ancestor(24, 26) == meeting(24, 26)
    d = f.set_directed(5)
    assert d.is_directed(30) and not d.cancel_directed(2).is_digraph() and f.cancel_root(1).root(2) is None
    cut = f.without_pairs(spark.createDataFrame([(UP[2], 2)], "a long, b long"))
    below = [v for v in range(1, 31) if 2 in chain(v)]
    assert cut.tree_count() == 2 and not cut.connected(1, 2) and cut.connected(2, max(below)) and keys(cut.tree_vertices(2)) == below and cut.tree_edges(2).count() == len(below) - 1
    two = cut.set_root(2)
    joined = two.add_edges(spark.createDataFrame([(99, 1, 2)], "key long, tail long, head long"))
    assert joined.is_tree() and joined.all_roots() == [1] and f.add_vertices(spark.range(30, 33).toDF("key")).graph.order() == 32
    with pytest.raises(errors.CycleError):
        f.add_edges(spark.createDataFrame([(99, 2, 3)], "key long, tail long, head long"))
    assert f.without_vertices(spark.range(30, 31)).graph.order() == 29 and f.without_edges(spark.range(0, 1)).tree_count() == 2


def test_parent_forest(spark):
    edges = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (1, 6), (2, 7), (3, 8), (3, 9), (3, 10), (4, 11), (7, 12), (11, 13), (11, 14), (11, 15)]
    up = {c: p for p, c in edges}
    f = ParentForest(spark.createDataFrame([(i, up.get(i), None, float(i)) for i in range(16)], "key long, parent long, value string, weight double"))
    assert f.size() == 16 and f.tree_count() == 1 and all(f.connected(a, b) for a, b in ((1, 12), (3, 8)))
    assert f.path_sum(13) == 28 and f.find_root(12) == 0 and f.lowest_common_ancestor(13, 15) == 11 and f.path_aggregate(12, [], lambda s, r: [*s, r.key]) == [0, 2, 7, 12]
    turned = f.make_root(13)
    assert turned.find_root(0) == 13 and turned.is_root(13) and [r.key for r in turned.path(0).collect()] == [13, 11, 4, 0] and [r.key for r in f.split(12, 9).path(9).collect()] == [12, 7, 2, 0, 3, 9]
    c = f.cut(4)
    assert c.tree_count() == 2 and not c.connected(0, 13) and c.link(9, 13).connected(0, 13) and c.link(9, 4).path_sum(13) == 0 + 3 + 9 + 4 + 11 + 13 and f.link(0, 1) is f
    g = ParentForest.empty(spark).make_tree(1, "a", 2.0).make_tree(2)
    assert g.tree_count() == 2 and g.link(1, 2).find_root(2) == 1 and g.get(1).value == "a" and g.add_or_update(1, "b", 3.0).get(1).weight == 3 and g.access(1) and not g.access(5) and g.get(5) is None


def test_disjoint_sets(spark):
    s = DisjointSets.singletons(spark, 6).union(spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a long, b long"))
    assert s.count() == 3 and s.connected(0, 2) and not s.connected(0, 3) and s.find(2) == 0 and s.find(9) is None and s.size(2) == 3


def test_ordered_map(spark):
    m = OrderedMap(spark.createDataFrame([(k * 10, f"v{k}") for k in range(1, 8)], "k long, v string"))
    assert len(m) == 7 and m.search(30) == "v3" and m.seek(31) == (40, "v4", False) and m.seek(30)[2] and m.seek(99) is None
    assert m.first().k == 10 and m.last().k == 70 and [r.k for r in m.range(15, 40).collect()] == [20, 30, 40] and [r.k for r in m.visit(True)][0] == 70
    assert m.rank(30) == 3 and m.rank(31) is None and m.nth(2).k == 20 and len(m.insert(30, "x")) == 7 and m.insert(30, "x").search(30) == "x" and len(m.delete(30)) == 6
    row = m.cursor().filter("k = 30").first()
    assert (row.rank, row.next, row.prev) == (3, 40, 20)
    low, high = m.split(40)
    assert len(low) == 3 and len(low.merge(high)) == 7 and len(m.cleared()) == 0
    with pytest.raises(errors.NotExistsError):
        m.delete(31)
    many = OrderedMap(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string"), unique=False)
    assert len(many.insert(1, "z")) == 4 and sorted(r.v for r in many.delete(1).entries.collect()) == ["b", "c"] and len(many.delete_all(1)) == 1 and sorted(r.v for r in many.update(1, "q").entries.collect()) == ["b", "c", "q"]
    probes = spark.createDataFrame([(5,), (30,), (31,), (71,)], "probe long")
    assert sorted((r.probe, r.k, r.exact) for r in m.seek_all(probes).collect()) == [(5, 10, False), (30, 30, True), (31, 40, False), (71, None, False)]


def test_arrays_and_queues(spark):
    a = IndexedArray.of(spark, [1, 2, 3, 4, 5])
    assert len(a.append(6)) == 6 and a.add(10, 1, 3).sum(0, 4) == 45 and a.add(10, 1, 3).get(3) == 14 and a.get(9) is None and a.set(2, 9).query(0, 4, F.max) == 9
    assert [r.d for r in a.differences().orderBy("i").collect()] == [1, 1, 1, 1, 1] and a.update(0, lambda x: x * 7).get(0) == 7 and a.query(7, 9) is None
    q = spark.createDataFrame([(0, 1, 3), (1, 0, 4), (2, 4, 4)], "q long, low long, high long")
    for block in (1, 2, 100):
        assert sorted(map(tuple, a.query_all(q, block).collect())) == [(0, 9, 2, 4), (1, 15, 1, 5), (2, 5, 5, 5)]
    p = PriorityTable(spark.createDataFrame([(1, "a", 5), (2, "b", 3), (3, "c", 9)], "key long, value string, priority long"))
    top, rest = p.pop()
    assert top.first().key == 2 and len(rest) == 2 and p.update(3, 1).top().first().key == 3 and p.priority(1) == 5 and len(p.push(spark.createDataFrame([(2, "z", 8)], "key long, value string, priority long"))) == 3


def test_interval_queries_meet_few_nodes(spark):
    rng = random.Random(6)
    cells = {i: rng.randrange(-50, 50) for i in range(-40, 150) if i % 7}
    a = IndexedArray(spark.createDataFrame(list(cells.items()), "i long, x long"))
    ranges = [(q, *sorted((rng.randrange(-60, 170), rng.randrange(-60, 170)))) for q in range(60)] + [(60, -(1 << 62), 1 << 62), (61, 9, 8), (62, 160, 170), (63, 7, 7)]
    q = spark.createDataFrame(ranges, "q long, low long, high long")
    inside = {n: [x for i, x in cells.items() if low <= i <= high] for n, low, high in ranges}
    want = [(n, sum(xs), min(xs), max(xs)) for n, xs in inside.items() if xs]
    for block in (1, 4, 64):
        assert sorted(map(tuple, a.query_all(q, block).collect())) == want
    assert a.query_all(q.limit(0)).isEmpty() and IndexedArray(a.cells.limit(0)).query_all(q).isEmpty()


def test_spatial_and_prefix(spark):
    b = BoxTable(spark.createDataFrame([(i, float(i), 0.0, float(i + 1), 1.0, str(i)) for i in range(10)], "id long, minx double, miny double, maxx double, maxy double, data string"))
    assert keys(b.search((2.5, 0, 4, 1)), "id") == [2, 3, 4] and [r.id for r in b.nearest((0, 0, 1, 1), 3).collect()] == [0, 1, 2] and keys(b.within((0, 0, 1, 1), 1.5), "id") == [0, 1]
    assert len(b.delete((3, 0, 4, 1))) == 9 and len(b.insert(b.boxes)) == 20 and b.overlaps(b.boxes, 0.7).count() == 28 == b.overlaps(b.boxes, 100.0).count()
    with pytest.raises(errors.NotExistsError):
        b.delete((0, 0, 0, 0))
    words = "m n sun sung sunlit sunlitness sail sails sailcloth tint tinted ti tidal sungrazer sunlight".split()
    t = PrefixMap(spark.createDataFrame(list(zip(words, range(15), strict=True)), "k string, v int"))
    assert len(t) == 15 and t.prefix("sun").count() == sum(w.startswith("sun") for w in words) and len(t.delete_prefix("sail")) == 12 and t.search("ti") == words.index("ti") and t.search("x") is None and len(t.delete("m")) == 14
    assert t.update("m", lambda v: v + 7).search("m") == 7 and t.scan().first().k == "m" and len(t.insert(spark.createDataFrame([("m", 5)], "k string, v int"))) == 15


def test_nearest_each_meets_few_boxes(spark):
    rng = random.Random(8)
    inf, schema = float("inf"), "id long, minx double, miny double, maxx double, maxy double"
    rows = [(i, float(rng.randrange(9)), float(rng.randrange(40)), float(9 + rng.randrange(3)), 50.0) for i in range(700)] + [(i, 500.0, 500.0, 501.0, 501.0) for i in range(700, 760)]
    rows += [(760, None, 0.0, 1.0, 1.0), (761, inf, 0.0, inf, 1.0), (762, 1e200, 0.0, 1e200, 1.0), (763, None, None, None, None), (764, -0.0, -0.0, -0.0, -0.0), (765, 0.0, 0.0, 0.0, 0.0)] + [(i, 1e9, 1e9, 1e9 + (i % 7) * 1e-6, 1e9 + i * 1e-7) for i in range(770, 830)]
    probes = [(q, *(float(rng.randrange(-5, 60)) for _ in range(4))) for q in range(25)] + [(25, 499.0, 501.0, 502.0, 500.0), (26, None, 0.0, 0.0, 0.0), (27, -0.0, 0.0, 0.0, 0.0), (28, 1e9, 1e9, 1e9 + 2e-6, 1e9 + 8e-5), (29, -1e15, 7.0, 1e15, 9.0)]
    boxes, p = spark.createDataFrame(rows, schema), spark.createDataFrame(probes, schema.replace("id", "probe", 1))
    found = lambda df: sorted((r.probe, r.place, r.id, r.distance) for r in df.collect())
    plain = BoxTable(boxes, lambda a, b: centre_distance(a, b))
    for k, tile in ((4, 8), (1, 512)):
        assert found(BoxTable(boxes).nearest_each(p, k, tile)) == found(plain.nearest_each(p, k))
    few = BoxTable(boxes.filter("id between 758 and 763"))
    assert found(few.nearest_each(p.filter("probe < 3"), 9)) == found(BoxTable(few.boxes, plain.distance).nearest_each(p.filter("probe < 3"), 9))
    assert few.nearest_each(p.limit(0), 3).isEmpty() and BoxTable(boxes.limit(0)).nearest_each(p, 3).isEmpty()


def test_nearest_each_leaves_far_tiles(spark):
    grid = spark.range(10_000).select(F.col("id"), (F.col("id") % 100).cast("double").alias("px"), F.floor(F.col("id") / 100).cast("double").alias("py"), F.lit(200.0).alias("size"))
    tiles = _summary(_tiled(grid.withColumnsRenamed({"px": "cx", "py": "cy"}), 25).groupBy("tile"), F.count("*"), "cx", "cx", "cy", "cy")
    kept = _may_hold(grid.filter("id % 50 = 0").withColumnRenamed("id", "probe").crossJoin(tiles), 5)
    assert tiles.count() == 400 and kept.groupBy("probe").count().agg(F.max("count")).first()[0] < 30


def test_documents(spark, basic, tmp_path):
    g = basic.set_vertex_label(1, "name", 'q"x').set_edge_weight(0, 2.5)
    text = documents.to_json(g).first().value
    for source in (text, documents.to_yaml(g)):
        back = documents.from_document(spark, source)
        assert (back.name, back.directed) == ("basic", False) and sorted(map(str, back.vertices.collect())) == sorted(map(str, g.vertices.collect()))
        columns = ["key", "tail", "head", "weight"]
        assert sorted(map(tuple, back.edges.select(columns).collect())) == sorted(map(tuple, g.edges.select(columns).collect()))
    block = "name: g\ndigraph: true\nvertexes:\n- key: 1\n  labels:\n    a: b\n- key: 2\nedges:\n- key: 5\n  head: 1\n  tail: 2\n"
    for parser in (documents.parse, documents._block_yaml):
        assert parser(block) == {"name": "g", "digraph": True, "vertexes": [{"key": 1, "labels": {"a": "b"}}, {"key": 2}], "edges": [{"key": 5, "head": 1, "tail": 2}]}
    (tmp_path / "g.json").write_text(text)
    assert documents.read_document(spark, f"file://{tmp_path}/g.json", directed=True).directed and len(list(documents.rows_of(g))) == 5
    documents.write_pair(g, f"file://{tmp_path}/pair")
    assert documents.read_pair(spark, f"file://{tmp_path}/pair").size() == 5


def test_drawing(spark, basic, arrows):
    assert "1 -- {2,3};" in drawing.tikz_graph(basic) and "5 -> {2,4};" in drawing.tikz_graph(arrows) and drawing.tikz_document("x").startswith("\\usetikzlibrary")
    text = drawing.dot(arrows, weights=True)
    assert text.startswith("digraph") and '"2" -> "1" [label="0.0"];' in text and '"1" [shape=circle];' in text
    assert '"nodes"' in drawing.html(basic) and "$payload" not in drawing.html(arrows, True)
    assert "0 -- {1, 2};" in drawing.tikz_forest(generators.complete_tree(spark, 2, 3)) or "0 -> {1, 2}" in drawing.tikz_forest(generators.complete_tree(spark, 2, 3))


def test_generators(spark):
    assert generators.random_graph(spark, 20, 0.0).size() == 0 and generators.random_graph(spark, 20, 1.0).size() == 190 and 50 < generators.random_graph(spark, 20, 0.5, 3).size() < 140
    assert generators.random_tournament(spark, 7).is_orientation() and generators.full_tree(spark, 3, 3).graph.order() == 13 and generators.hypercube(spark, 4).is_regular()


def test_jobs(spark):
    done, lock = [], __import__("threading").Lock()

    def job(key, fail=0):
        tries = []

        def run():
            tries.append(1)
            if len(tries) <= fail:
                raise ValueError(f"{key} fails")
            with lock:
                done.append(key)

        return run

    g = JobGraph("t")
    for k in range(1, 6):
        g.add_job(k, job(k, fail=2 if k == 3 else 0), retries=2)
    for a, b in ((1, 3), (2, 3), (3, 4), (3, 5), (4, 5)):
        g.add_dependency(a, b)
    with pytest.raises(errors.AlreadyExistsError):
        g.add_dependency(1, 3)
    g.start()
    g.wait(30)
    assert g.status is State.SUCCESS and done[-1] == 5 and done.index(1) < done.index(3) and {r.status for r in g.table(spark).collect()} == {"success"}
    g.reset()
    assert g.status is State.WAITING and g.job(1).state is State.WAITING
    g.add_job(4, job(4, fail=9))
    done.clear()
    g.start()
    with pytest.raises(ValueError):
        g.wait(30)
    assert g.status is State.FAILED and g.job(5).state is State.WAITING and 2 in done and len(g.all_jobs()) == 5
    slow = JobGraph("s")
    slow.add_job("a", lambda: __import__("time").sleep(5), timeout=0.2)
    slow.start()
    with pytest.raises(TimeoutError):
        slow.wait(5)
    loop = JobGraph("l")
    for k in "ab":
        loop.add_job(k, print)
    loop.add_dependency("a", "b"), loop.add_dependency("b", "a")
    assert loop.detect_cycle() == ["a", "b"]
    with pytest.raises(errors.CycleError):
        loop.start()
    loop.remove_dependency("b", "a"), loop.remove_job("b")
    loop.pause()
    loop.start()
    loop.wait(5)
    assert loop.status is State.SUCCESS


def test_jobs_stop_and_pause(spark):
    import threading

    gate, seen = threading.Event(), []
    g = JobGraph("p")
    g.add_job("a", lambda: gate.wait(10))
    g.add_job("b", lambda: seen.append("b"))
    g.add_dependency("a", "b")
    g.start()
    g.pause()
    gate.set()
    g.wait(10)
    assert g.status is State.PAUSED and not seen
    g.start()
    g.wait(10)
    assert seen == ["b"] and g.status is State.SUCCESS
    h = JobGraph("q", spark)
    h.add_job("long", lambda: spark.range(10**12).selectExpr("sum(sqrt(id))").collect())
    h.start()
    __import__("time").sleep(1.0)
    h.stop()
    assert h.status is State.STOPPED
    dag = JobGraph.from_graph(PropertyGraph.of_lists(spark, [1, 2], [(1, 2)], directed=True))
    with pytest.raises(errors.NotExistsError):
        dag.start()
    dag.add_job(1, lambda: None), dag.add_job(2, lambda: None)
    dag.run_job(1)
    dag.start()
    dag.wait(10)
    assert dag.status is State.SUCCESS


def test_workflow(spark):
    wf = Workflow("w", "* * * * *", spark)
    wf.add_task(Task("a", lambda i: {"x": i["n"] * 2}), Task("b", lambda i: {"y": i["x"] + 1}), Task("c", lambda i: {}))
    wf.set_input("a", Parameter("n", 20))
    wf.set_input("b", Parameter("x", ref="w.a.output.x"))
    wf.set_output("b", Parameter("y"))
    wf.add_dependency("a", "b"), wf.add_dependency("b", "c"), wf.remove_dependency("b", "c"), wf.remove_task("c")
    wf.start()
    wf.wait(20)
    assert wf.output("b") == {"y": 41} and wf.status is State.SUCCESS and wf.info().count() == 2
    wf.set_input("b", Parameter("x", ref="a.output.missing"))
    wf.start()
    with pytest.raises(errors.NotExistsError):
        wf.wait(20)


def test_online_bridges(spark, tmp_path):
    edges = [(k, a, b) for k, (a, b, _) in enumerate(rolled(5, 11, 13))]
    want = [k for k, _, _ in edges if parts_of(11, [(a, b) for i, a, b in edges if i != k]) > 1]
    online = OnlineConnectivity(spark)
    for part in (edges[:6], edges[6:], edges[:2]):
        online.apply(spark.createDataFrame(part, "key long, tail long, head long"))
    online.add_vertex(50)
    assert keys(online.bridges()) == want and online.bridge_count() == len(want) and online.is_bridge(want[0]) and online.component_count() == 2 and online.graph().size() == 13
    folder = str(tmp_path / "in")
    for part in (edges[:7], edges[7:]):
        spark.createDataFrame(part, "key long, tail long, head long").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("key long, tail long, head long").option("maxFilesPerTrigger", 1).parquet(folder)
    other = OnlineConnectivity(spark)
    run_stream(other, stream, str(tmp_path / "checkpoint"))
    assert keys(other.bridges()) == want and other.component_count() == 1


def test_state_outlives_its_object(spark, tmp_path):
    """A driver that ends between two batches: another object goes on from the manifest."""
    edges = [(k, a, b) for k, (a, b, _) in enumerate(rolled(5, 11, 13))]
    folder = f"file://{tmp_path}/state"
    frame = lambda part: spark.createDataFrame(part, "key long, tail long, head long")
    OnlineConnectivity(spark, with_bridges=False, state=folder).batch(frame(edges[:7]), 0)
    again = OnlineConnectivity(spark, with_bridges=False, state=folder)
    seen = again.components()
    again.batch(frame(edges[:7]), 0)
    again.batch(frame(edges[7:]), 1)
    assert again.component_count() == 1 and again.graph().size() == 13 and seen.count() > 0
    assert OnlineConnectivity(spark, with_bridges=False, state=folder).component_count() == 1


def test_stacks_queues_and_due_times(spark):
    s = SequenceTable.of(spark.createDataFrame([(3,), (1,), (2,)], "item long"), "item").push(9)
    item, rest = s.pop()
    assert (len(s), s.top(), s.front(), item, rest.top(), s.contains(2), s.contains(5), s.is_empty()) == (4, 9, 1, 9, 3, True, False, False)
    first, others = s.take()
    assert first == 1 and others.front() == 2 and s.cleared().is_empty() and s.cleared().top() is None and len(s.cleared().push(4)) == 1
    with pytest.raises(errors.NotExistsError):
        s.cleared().pop()
    from datetime import datetime

    at = datetime(2024, 2, 28, 23, 50)
    due = lambda text, n=1: [str(x) for x in Workflow("w", text).due(at, n)]
    assert due("*/20 * * * *", 2) == ["2024-02-29 00:00:00", "2024-02-29 00:20:00"] and due("5 4 * * 1-5") == ["2024-02-29 04:05:00"] and due("0 0 1 * 0", 2) == ["2024-03-01 00:00:00", "2024-03-03 00:00:00"]
    with pytest.raises(ValueError):
        due("61 * * * *")
    with pytest.raises(ValueError):
        due("")


def test_a_long_chain_keeps_one_row_a_vertex(spark):
    n = 20_000
    f = ParentForest(spark.range(n).select(F.col("id").alias("key"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(None).cast("string").alias("value"), F.lit(1.0).alias("weight")))
    assert f.roots().filter("root = 0").count() == n and f.path_sums().filter("total = key + 1").count() == n
