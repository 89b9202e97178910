"""Traversal, components, layers, strongly connected components, cuts, bridges and cycles.

Loops are rounds of equi-joins on frontier tables; each round's result is written to the scratch
folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import CycleError, NotExistsError
from ..functions.kernels import adjacency, search
from ..scratch import discard, materialise
from .components import star_components


def components(g) -> DataFrame:
    """``(key, comp)``: the smallest key of each vertex's (weak) component."""
    found = star_components(g.edges, "tail", "head")
    return g.vertices.select("key").join(found.withColumnRenamed("v", "key"), "key", "left").select("key", F.coalesce("comp", "key").alias("comp"))


def breadth_first(g, start, incoming: bool = False, until=None, max_rounds: int | None = None) -> DataFrame:
    """``(key, depth)`` of the vertices that can be reached; ``incoming`` follows arcs backwards."""
    g.vertex(start)
    arcs = g.arcs().select("src", "dst").distinct()
    if incoming:
        arcs = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    arcs = materialise(arcs, "arcs")
    first = g.vertices.filter(F.col("key") == F.lit(start)).select("key", F.lit(0).alias("depth"))
    seen = materialise(first, "seen")
    frontier, depth, layers = seen, 0, [seen]
    while max_rounds is None or depth < max_rounds:
        depth += 1
        step = frontier.join(arcs, frontier["key"] == arcs["src"]).select(F.col("dst").alias("key")).distinct()
        for layer in layers[-2:] if not g.directed else layers:
            step = step.join(layer.select("key"), "key", "left_anti")
        frontier = materialise(step.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        layers.append(frontier)
        if g.directed and len(layers) > 8:  # keep the anti-joins few
            layers = [materialise(_union(layers), "seen")]
        if until is not None and not frontier.filter(F.col("key") == F.lit(until)).isEmpty():
            break
    return _union(layers)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def reaches(g, start, end) -> bool:
    """Is there a path from start to end?"""
    g.vertex(end)
    return not breadth_first(g, start, until=end).filter(F.col("key") == F.lit(end)).isEmpty()


def _peel(g, both_sides: bool) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Take off vertices without incoming (``both_sides``: or outgoing) arcs, layer by layer. Gives
    the layers, and the vertices and arcs that are left."""
    v = materialise(g.vertices.select("key"), "peel")
    e = materialise(g.edges.select("tail", "head").distinct(), "peel")
    layers, layer = None, 0
    while True:
        gone = v.join(e.select(F.col("head").alias("key")), "key", "left_anti")
        if both_sides:
            gone = gone.union(v.join(e.select(F.col("tail").alias("key")), "key", "left_anti")).distinct()
        gone = materialise(gone.withColumn("layer", F.lit(layer)), "layer")
        if gone.isEmpty():
            return layers, v, e
        layers = gone if layers is None else layers.unionByName(gone)
        keys = gone.select("key")
        old = v, e
        v = materialise(v.join(keys, "key", "left_anti"), "peel")
        e = materialise(e.join(keys.toDF("tail"), "tail", "left_anti").join(keys.toDF("head"), "head", "left_anti").select("tail", "head"), "peel")
        discard(*old)
        layer += 1


def topological_layers(g) -> DataFrame:
    """``(key, layer)``; every arc goes to a later layer. Order by (layer, key) for one sort."""
    layers, v, _ = _peel(g, both_sides=False)
    if not v.isEmpty():
        raise CycleError("the graph has a cycle")
    return layers if layers is not None else g.vertices.select("key", F.lit(0).alias("layer")).limit(0)


def topological_sort(g) -> list:
    return [r.key for r in topological_layers(g).orderBy("layer", "key").collect()]


def cyclic_core(g):
    """What is left when vertices on no directed cycle's way in or out are taken off."""
    _, v, e = _peel(g, both_sides=True)
    return g.with_(vertices=g.vertices.join(v, "key", "left_semi"), edges=g.edges.join(e, ["tail", "head"], "left_semi").select(*g.edges.columns))


def detect_cycle(g) -> list:
    """The vertices of one directed cycle, from its smallest; empty where there is none. Beyond
    MAX_KERNEL_EDGES vertices on cycles or between them, only the cycle itself comes to the driver."""
    core = cyclic_core(g)
    arcs = materialise(core.edges.groupBy("tail").agg(F.min("head").alias("head")), "arcs")
    # One arc per vertex of the core: a functional graph; every component of it has one cycle.
    from .per_component import MAX_KERNEL_EDGES

    n = arcs.count()
    if not n:
        return []
    rows = (arcs if n <= MAX_KERNEL_EDGES else _cycle_from_smallest(arcs, n)).collect()
    step = {r.tail: r.head for r in rows}
    return search.one_cycle({v: [(w, None)] for v, w in step.items()})


def _cycle_from_smallest(arcs: DataFrame, n: int) -> DataFrame:
    """Of ``n`` arcs, one from each vertex, those of the cycle that the smallest vertex leads to."""
    jump, steps = arcs, 1
    while steps < n:  # doubling: after n steps or more every vertex has come to its cycle
        on = jump.select(F.col("tail").alias("head"), F.col("head").alias("far"))
        new = materialise(jump.join(on, "head").select("tail", F.col("far").alias("head")), "jump")
        if jump is not arcs:
            discard(jump)
        jump, steps = new, 2 * steps
    on_cycles = arcs.join(jump.select(F.col("head").alias("tail")).distinct(), "tail", "left_semi")
    comp = materialise(star_components(on_cycles, "tail", "head"), "cycles")
    end = jump.orderBy("tail").first()["head"]
    # A cycle of one vertex has no link to another.
    own = comp.filter(F.col("v") == F.lit(end)).select("comp").join(comp, "comp").select(F.col("v").alias("tail"))
    return on_cycles.filter(F.col("tail") == F.lit(end)).unionByName(on_cycles.filter(F.col("tail") != F.lit(end)).join(own, "tail", "left_semi"))


def strong_components(g) -> DataFrame:
    """``(key, comp)``: the smallest key of each vertex's strongly connected component.

    Rounds: trim what is on no cycle; spread the smallest key forwards to a fixpoint; what reaches
    that key back within its colour is a component; go on with the rest."""
    names = g.vertices.select("key")
    left = cyclic_core(g)
    found = None
    while not left.vertices.isEmpty():
        arcs = materialise(left.edges.select("tail", "head").filter("tail <> head").distinct(), "arcs")
        colour = _spread(left.vertices.select("key", F.col("key").alias("c")), arcs, "tail", "head")
        inside = arcs.join(colour.toDF("tail", "ct"), "tail").join(colour.toDF("head", "ch"), "head").filter("ct = ch").select("tail", "head", F.col("ct").alias("c"))
        inside = materialise(inside, "inside")
        back = colour.filter("key = c")
        wave = back
        while True:
            step = wave.join(inside, (wave["key"] == inside["head"]) & (wave["c"] == inside["c"])).select(F.col("tail").alias("key"), inside["c"]).distinct()
            wave = materialise(step.join(back, "key", "left_anti"), "wave")
            if wave.isEmpty():
                break
            back = materialise(back.unionByName(wave), "back")
        done = back.select("key", F.col("c").alias("comp"))
        found = done if found is None else found.unionByName(done)
        rest = left.without_vertices(done.select("key"))
        left = cyclic_core(rest.with_(vertices=materialise(rest.vertices, "rest"), edges=materialise(rest.edges, "rest")))
    if found is None:
        return names.select("key", F.col("key").alias("comp"))
    return names.join(found, "key", "left").select("key", F.coalesce("comp", "key").alias("comp"))


def _spread(state: DataFrame, arcs: DataFrame, src: str, dst: str) -> DataFrame:
    """The smallest value that reaches each vertex along the arcs. Each round also jumps: a vertex
    takes the colour of its colour's vertex."""
    state = materialise(state, "spread")
    while True:
        sent = state.join(arcs, state["key"] == arcs[src]).select(F.col(dst).alias("key"), "c")
        step = state.unionByName(sent).groupBy("key").agg(F.min("c").alias("c"))
        jump = step.join(step.select(F.col("key").alias("c"), F.col("c").alias("cc")), "c").select("key", F.least("c", "cc").alias("c"))
        new = materialise(jump, "spread")
        changed = not new.join(state, ["key", "c"], "left_anti").isEmpty()
        discard(state)
        state = new
        if not changed:
            return state


def condensation(g):
    """The digraph of strong components: one arc for each pair that an arc joins."""
    from ..graph import PropertyGraph

    comp = materialise(strong_components(g), "scc")
    e = g.edges.select("tail", "head").join(comp.toDF("tail", "a"), "tail").join(comp.toDF("head", "b"), "head").filter("a <> b")
    e = e.select(F.col("a").alias("tail"), F.col("b").alias("head")).distinct()
    v = comp.select(F.col("comp").alias("key")).distinct()
    return PropertyGraph.of(v, e.withColumn("key", F.concat_ws(":", F.col("tail").cast("string"), F.col("head").cast("string"))), True, f"{g.name} condensed", validate=False)


# -- bipartiteness ---------------------------------------------------------------------------


def two_colours(g) -> DataFrame:
    """``(key, side)`` with side 0 for the smallest vertex of each component: components of the
    double cover, in which each vertex stands once for each side."""
    doubled = g.edges.select(F.explode(F.array(F.struct(F.struct("tail", F.lit(0)).alias("a"), F.struct("head", F.lit(1)).alias("b")), F.struct(F.struct("tail", F.lit(1)).alias("a"), F.struct("head", F.lit(0)).alias("b")))).alias("x"))
    pack = lambda c: F.struct(F.col(f"x.{c}").getField("tail" if c == "a" else "head").alias("key"), F.col(f"x.{c}").getField("col2").alias("side"))
    comp = star_components(doubled.select(pack("a").alias("a"), pack("b").alias("b")), "a", "b")
    return comp.select(F.col("v.key").alias("key"), F.col("v.side").alias("side"), F.col("comp.key").alias("root"), F.col("comp.side").alias("root_side"))


def is_bipartite(g) -> bool:
    """No vertex is joined with its own copy on the other side."""
    cover = two_colours(g)
    return cover.groupBy("key").agg(F.countDistinct("root", "root_side").alias("n")).filter("n < 2").isEmpty()


def sides(g) -> DataFrame:
    """``(key, side)`` of a bipartite graph; isolated vertices are on side 0."""
    cover = two_colours(g).filter("side = 0").select("key", F.col("root_side").alias("side"))
    return g.vertices.select("key").join(cover, "key", "left").select("key", F.coalesce("side", F.lit(0)).alias("side"))


# -- orders from kernels -------------------------------------------------------------------


def _reachable(g, start, incoming: bool):
    keys = materialise(breadth_first(g, start, incoming).select("key"), "reachable")
    return g.induced(keys)


def depth_first(g, start, incoming: bool = False) -> DataFrame:
    """``(key, position, parent)`` in depth-first preorder, smallest neighbour first."""
    from .per_component import by_component, key_type

    part, kind, directed = _reachable(g, start, incoming), key_type(g), g.directed

    def kernel(vertices, edges):
        pairs = [(k, h, t) if incoming else (k, t, h) for k, t, h, _ in edges]
        return search.depth_first(adjacency(vertices, pairs, directed), start)

    return by_component(part, kernel, f"key {kind}, position long, parent {kind}", connected=True)


def lexicographic_order(g, start, depth_first_labels: bool = False) -> DataFrame:
    """``(key, position)`` by lexicographic BFS, or DFS."""
    from .per_component import by_component, key_type

    part = _reachable(g.undirected(), start, False)

    def kernel(vertices, edges):
        return [(v, i) for i, v in enumerate(search.lexicographic(adjacency(vertices, [e[:3] for e in edges]), start, depth_first_labels))]

    return by_component(part, kernel, f"key {key_type(g)}, position long", connected=True)


# -- cut vertices and bridges ----------------------------------------------------------------


def _two_core(g):
    """The graph without vertices of degree one, again and again: what is cut off is all bridges."""
    e = materialise(g.edges.select("key", "tail", "head").filter("tail <> head"), "core")
    while True:
        leaves = e.select(F.explode(F.array("tail", "head")).alias("v")).groupBy("v").count().filter("count = 1").select("v")
        leaves = materialise(leaves, "leaves")
        if leaves.isEmpty():
            return e
        new = materialise(e.join(leaves.toDF("tail"), "tail", "left_anti").join(leaves.toDF("head"), "head", "left_anti").select("key", "tail", "head"), "core")
        discard(e)
        e = new


def _low_points(g, what: int, kind: str) -> DataFrame:
    from .per_component import by_component

    return by_component(g.undirected(), lambda vertices, edges: [(x,) for x in sorted(search.low_points(vertices, [e[:3] for e in edges])[what])], f"key {kind}")


def cut_vertices(g) -> DataFrame:
    from .per_component import key_type

    return _low_points(g, 0, key_type(g))


def bridges(g) -> DataFrame:
    """The edges whose removal separates their ends. Trees hanging off the cycles are peeled first,
    as all their edges are bridges; the kernel sees the 2-core only."""
    from ..graph import PropertyGraph
    from .per_component import edge_key_type

    loops = g.edges.filter("tail = head").select("key")
    core = _two_core(g)
    inner = PropertyGraph.from_edges(core)
    hanging = g.edges.select("key").join(core.select("key"), "key", "left_anti").join(loops, "key", "left_anti")
    keys = hanging.unionByName(_low_points(inner, 1, edge_key_type(g)))
    return g.edges.join(keys, "key", "left_semi")


def is_cut_vertex(g, key) -> bool:
    """Do the neighbours of a vertex fall apart without it?"""
    near = [r[0] for r in g.undirected().neighbours(key).select("key").filter(F.col("key") != F.lit(key)).limit(2).collect()]
    if len(near) < 2:
        return False
    rest = materialise(components(g.undirected().remove_vertex(key)), "rest")
    around = g.undirected().neighbours(key).select("key").filter(F.col("key") != F.lit(key))
    return rest.join(around, "key", "left_semi").select("comp").distinct().limit(2).count() > 1


def is_bridge(g, edge_key) -> bool:
    e = g.edge(edge_key)
    return e.tail != e.head and not reaches(g.undirected().remove_edge_by_key(edge_key), e.tail, e.head)


# -- cycles of a length ------------------------------------------------------------------------


def count_cycles(g, length: int) -> int:
    """Simple cycles of a length: 1 loops, 2 pairs of parallel (antiparallel, where directed) edges,
    then by extending paths that start at their smallest vertex."""
    if length < 1:
        raise ValueError("a cycle has a length of at least 1")
    if length == 1:
        return g.edges.filter("tail = head").count()
    if length == 2:
        pairs = g.edges.filter("tail <> head")
        if g.directed:
            n = pairs.groupBy("tail", "head").count()
            back = n.select(F.col("head").alias("tail"), F.col("tail").alias("head"), F.col("count").alias("other"))
            return n.filter("tail < head").join(back, ["tail", "head"]).agg(F.sum(F.col("count") * F.col("other"))).first()[0] or 0
        n = pairs.groupBy(F.least("tail", "head"), F.greatest("tail", "head")).count()
        return n.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).cast("long")).first()[0] or 0
    arcs = materialise(g.arcs().filter("src <> dst").select("src", "dst").distinct(), "arcs")
    paths = arcs.filter("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    for _ in range(length - 2):
        step = paths.join(arcs, (paths["last"] == arcs["src"]) & (arcs["dst"] > paths["first"]) & ~F.array_contains("path", arcs["dst"]))
        paths = materialise(step.select("first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path")), "paths")
    closed = paths.join(arcs.select(F.col("src").alias("last"), F.col("dst").alias("first")), ["first", "last"]).count()
    return closed if g.directed else closed // 2


def require_reachable(g, *keys) -> None:
    missing = set(keys) - {r[0] for r in g.vertices.filter(F.col("key").isin(*keys)).select("key").collect()}
    if missing:
        raise NotExistsError(f"vertices {sorted(missing)}")
