"""Queries over the calls that the other queries leave out, several to a query: rows ``(what, value)``
name the call and give its result as text. Graphs are written once, so each call reads a small table."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import errors
from ..functions.kernels import flow as flow_kernels
from ..graph import PropertyGraph
from ..operators import colouring, flow, matching, paths, spanning, traversal
from ..operators.bipartite import Bipartite
from ..operators.forest import DisjointSets, Forest, ParentForest
from ..operators.ordered import IndexedArray, OrderedMap, PriorityTable, SequenceTable
from ..operators.spatial import BoxTable, PrefixMap, area, covers, equals
from ..scratch import materialise, scratch_root
from ..sources import documents, drawing, generators
from ..streaming.connectivity import OnlineConnectivity
from . import projections as P
from .jobs import JobGraph, State
from .registry import _ARCS, _BOXES, HIERARCHY, SEQUENCE, TRADE, TRANSITIONS, _bottleneck, _boxes, query, squared
from .workflow import Parameter, Task, Workflow


def held(g):
    """The graph with its tables written once."""
    return g.with_(vertices=materialise(g.vertices, "held"), edges=materialise(g.edges, "held"))


def answer(spark: SparkSession, frames: dict[str, DataFrame], facts: dict[str, object] | None = None) -> DataFrame:
    """Rows (what, value): of each frame all columns joined by a bar, of each fact its text."""
    parts = [df.select(F.lit(name).alias("what"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns)).alias("value")) for name, df in frames.items()]
    text = lambda x: str(x).lower() if isinstance(x, bool) else "-" if x is None else str(x)
    if facts:
        parts.append(spark.createDataFrame([(k, text(v)) for k, v in facts.items()], "what string, value string"))
    return traversal._union(parts)


def rows(with_: str, **parts: str) -> str:
    """SQL for such rows, from selects of one column."""
    each = (f"SELECT '{name}' AS what, coalesce(CAST(value AS VARCHAR), '-') AS value FROM ({sql}) t(value)" for name, sql in parts.items())
    return f"WITH {with_} " + " UNION ALL ".join(each)


# -- reads and edits -------------------------------------------------------------------------

_PICK = TRADE + ", a AS (SELECT min(tail) AS v FROM e), k AS (SELECT * FROM e WHERE tail <> head ORDER BY key DESC LIMIT 1)"
_NEAR = "SELECT e.key FROM e, k WHERE (e.tail IN (k.tail, k.head) OR e.head IN (k.tail, k.head)) AND e.key <> k.key"


def _trade(spark, sf):
    """The trade graph, its least tail, and its last edge between two nations."""
    g = held(P.trade(spark, sf))
    return g, g.edges.agg(F.min("tail")).first()[0], g.edges.filter("tail <> head").orderBy(F.desc("key")).first()


@query(rows(_PICK, neighbours="SELECT head FROM e, a WHERE tail = v UNION SELECT tail FROM e, a WHERE head = v", in_neighbours="SELECT DISTINCT tail FROM e, a WHERE head = v", out_neighbours="SELECT DISTINCT head FROM e, a WHERE tail = v",
    incident="SELECT key FROM e, a WHERE tail = v OR head = v", in_edges="SELECT key FROM e, a WHERE head = v", out_edges="SELECT key FROM e, a WHERE tail = v", near_key=_NEAR, near_pair=_NEAR, between="SELECT key FROM k",
    by_label="SELECT n_nationkey FROM nation WHERE n_regionkey = 1", edges_by_label="SELECT key FROM k", slim="SELECT key || '|' || tail || '|' || head || '|' || CAST(weight AS BIGINT) FROM e",
    names="SELECT 'trade,other,true'", counts="SELECT (SELECT count(*) FROM nation) || ',' || (SELECT count(*) FROM e)", vertex="SELECT n_name FROM nation, a WHERE n_nationkey = v", edge="SELECT tail || '>' || head || ' ' || CAST(weight AS BIGINT) FROM k",
    copy="SELECT count(*) FROM e", random="SELECT (SELECT count(*) FROM nation) > 0 AND (SELECT count(*) FROM e) > 0"))
def graph_reads(spark, sf):
    g, v, e = _trade(spark, sf)
    labelled = g.set_edge_label_by_key(e.key, "seen", "yes")
    v_row, e_row = g.random_vertex(7), g.random_edge(7)
    drawn = not g.vertices.filter(F.col("key") == v_row.key).isEmpty() and not g.edges.filter(F.col("key") == e_row.key).isEmpty()
    frames = {"neighbours": g.neighbours(v), "in_neighbours": g.in_neighbours(v), "out_neighbours": g.out_neighbours(v), "incident": g.incident_edges(v), "in_edges": g.in_edges(v), "out_edges": g.out_edges(v), "near_key": g.neighbour_edges_by_key(e.key), "near_pair": g.neighbour_edges(e.tail, e.head), "between": g.edges_between(e.tail, e.head), "by_label": g.vertices_by_label({"region": "1"}), "edges_by_label": labelled.edges_by_label({"seen": "yes"})}
    frames = {n: df.select("key") for n, df in frames.items()} | {"slim": g.slim().edges.withColumn("weight", F.col("weight").cast("long"))}
    found = g.edge(e.key)
    return answer(spark, frames, {"names": f"{g.name},{g.renamed('other').name},{str(g.directed).lower()}", "counts": f"{g.order()},{g.size()}", "vertex": g.vertex(v).value, "edge": f"{found.tail}>{found.head} {int(found.weight)}", "copy": g.clone().size(), "random": drawn})


@query(rows(_PICK, edges="""SELECT e.key || '|' || e.tail || '|' || e.head || '|' || CASE WHEN e.key = k.key THEN 9 ELSE CAST(e.weight AS BIGINT) END || '|' || CASE WHEN e.key = k.key THEN 'r' ELSE '-' END || '|' ||
    CASE WHEN e.key = k.key THEN 'd' ELSE '-' END || '|-' FROM e, k WHERE NOT (e.tail = e.head)""", added="SELECT '-5|100|' || v || '|3|x|-|m' FROM a", emptied="SELECT 0", less="SELECT count(*) FROM e, k WHERE NOT ((e.tail = k.tail AND e.head = k.head) OR (e.tail = k.head AND e.head = k.tail))", least="SELECT n_nationkey FROM nation"))  # fmt: skip
def edge_changes(spark, sf):
    g, v, e = _trade(spark, sf)
    loops = [r.key for r in g.edges.filter("tail = head").select("key").collect()]
    h = g.add_vertex(100).add_edge(-5, 100, v, 3.0, "x", {"l": "m", "c": "q"})
    h = h.set_edge_weight(e.key, 9).set_edge_value_by_key(e.key, "q").set_edge_value(e.tail, e.head, "r").set_edge_label_by_key(e.key, "c", "d").set_edge_label(e.tail, e.head, "l", "z").delete_edge_label(e.tail, e.head, "l").delete_edge_label_by_key(-5, "c")
    for key in loops:
        h = h.remove_edge_by_key(key)
    out = h.edges.select("key", "tail", "head", F.col("weight").cast("long"), "value", F.col("labels")["c"].alias("c"), F.col("labels")["l"].alias("l"))
    patch = g.vertices.select("key", F.lit(4.5).alias("weight"))
    return answer(spark, {"edges": out.filter("key <> -5"), "added": out.filter("key = -5"), "least": g.patch_vertices(patch, "weight").vertices.filter("weight = 4.5").select("key")}, {"emptied": g.remove_all_edges().size(), "less": g.remove_edges(e.tail, e.head).size()})


@query("""SELECT n_nationkey::BIGINT AS key, 'there already' AS found FROM nation WHERE n_nationkey < 3 UNION ALL
SELECT k, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = k) THEN 'there' ELSE 'missing' END FROM (VALUES (77), (78)) t(k)""")
def error_kinds(spark, sf):
    g, _, _ = _trade(spark, sf)
    out = []
    for key, call in [(k, lambda k=k: g.add_vertex(k)) for k in range(3)] + [(k, lambda k=k: g.vertex(k)) for k in (77, 78)]:
        try:
            call()
            out.append((key, "there"))
        except errors.GraphError as error:
            out.append((key, "there already" if errors.is_already_exists(error) else "missing" if errors.is_not_exists(error) else "other"))
    return spark.createDataFrame(out, "key long, found string")


# -- properties, matrices, algebra -------------------------------------------------------------


@query(rows(HIERARCHY + "," + TRADE, degree="SELECT k || '|' || k || '|' || count(*) FROM (SELECT tail AS k FROM e UNION ALL SELECT head FROM e) GROUP BY k UNION ALL SELECT n_nationkey || '|' || n_nationkey || '|0' FROM nation WHERE n_nationkey NOT IN (SELECT tail FROM e UNION SELECT head FROM e)",
    columns="SELECT n_nationkey || '|' || (row_number() OVER (ORDER BY n_nationkey) - 1) FROM nation", acyclic="SELECT true FROM (SELECT count(*) AS n FROM h) WHERE n > 0", forest="SELECT (SELECT count(*) FROM h WHERE parent IS NOT NULL) = (SELECT count(*) FROM h) - (SELECT count(*) FROM region)",
    connected="SELECT count(*) <= 1 FROM region", tree="SELECT count(*) = 1 FROM region", trade_acyclic="SELECT count(*) = 0 FROM e x JOIN e y ON x.head = y.tail AND y.head = x.tail"))
def properties_and_matrices(spark, sf):
    g, h = held(P.trade(spark, sf)), held(P.hierarchy(spark, sf))
    return answer(spark, {"degree": g.degree_matrix(), "columns": g.matrix_index()}, {"acyclic": h.is_acyclic(), "forest": h.is_forest(), "connected": h.is_connected(), "tree": h.is_tree(), "trade_acyclic": g.is_acyclic()})


@query(rows(_PICK, identify="SELECT e.key || '|' || CASE WHEN e.tail IN (k.tail, k.head) THEN 99 ELSE e.tail END || '|' || CASE WHEN e.head IN (k.tail, k.head) THEN 99 ELSE e.head END FROM e, k WHERE NOT (e.tail IN (k.tail, k.head) AND e.head IN (k.tail, k.head))",
    subdivide="SELECT e.key || '|' || e.tail || '|' || e.head FROM e, k WHERE e.key <> k.key UNION ALL SELECT '-1|' || tail || '|500' FROM k UNION ALL SELECT '-2|500|' || head FROM k", without="SELECT e.key FROM e, k WHERE e.key <> k.key",
    with_more="SELECT key FROM e UNION ALL SELECT -7", line="SELECT a.key || '|' || b.key FROM (SELECT key, unnest(list_distinct([tail, head])) AS v FROM e) a JOIN (SELECT key, unnest(list_distinct([tail, head])) AS v FROM e) b ON a.v = b.v AND a.key < b.key",
    whole="SELECT true", reverse="SELECT count(*) = 0 FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.tail = x.head AND y.head = x.tail)"))
def algebra_calls(spark, sf):
    g, _, e = _trade(spark, sf)
    ends = ("key", "tail", "head")
    frames = {
        "identify": g.identify(e.tail, e.head, 99).edges.select(*ends), "subdivide": g.subdivide(e.key, 500, -1, -2).edges.select(*ends), "line": g.undirected().line_graph().edges.select("tail", "head"),
        "without": g.spanning_without(spark.createDataFrame([(e.tail, e.head)], "tail long, head long")).edges.select("key"), "with_more": g.spanning_with(spark.createDataFrame([(-7, e.tail, e.head)], "key long, tail long, head long")).edges.select("key"),
    }
    return answer(spark, frames, {"whole": g.contains(g.induced(g.vertices.filter("key % 2 = 0").select("key"))), "reverse": g.contains(g.reversed())})


# -- traversal, paths, flow, matching ------------------------------------------------------------

_TREE = "RECURSIVE " + HIERARCHY + ", top AS (SELECT min(key) AS r FROM h WHERE parent IS NULL), p(key, path, depth) AS (SELECT r, [r], 0 FROM top UNION ALL SELECT h.key, list_append(p.path, h.key), p.depth + 1 FROM p JOIN h ON h.parent = p.key)"
_PREORDER = "SELECT key || '|' || (row_number() OVER (ORDER BY path) - 1) FROM p"


@query(rows(_TREE, breadth="SELECT key || '|' || depth FROM p", depth_down=_PREORDER, lex_depth=_PREORDER, lex_breadth="SELECT key || '|' || (row_number() OVER (ORDER BY depth, path) - 1) FROM p", reached="SELECT count(*) > 0 FROM p WHERE key = 'n:0' OR depth = 1",
    cycle="SELECT count(*) FROM h WHERE parent IS NULL AND parent IS NOT NULL", cut="SELECT count(*) > 0 FROM h, top WHERE parent = (SELECT min(key) FROM h WHERE parent = r)",
    bridge="SELECT count(*) = 1 FROM h WHERE key = (SELECT max(key) FROM p WHERE depth = 2)", trade_cycle="SELECT 'closed'"))
def searches(spark, sf):
    """On the tree of the least region; a tree's orders follow its paths in key order."""
    h = held(P.hierarchy(spark, sf))
    u, top = h.undirected(), h.sources().agg(F.min("key")).first()[0]
    found = materialise(traversal.breadth_first(u, top).select("key", "depth"), "found")
    nation, leaf = found.filter("depth = 1").agg(F.min("key")).first()[0], found.filter("depth = 2").agg(F.max("key")).first()[0]
    trade = held(P.trade(spark, sf))
    ring = traversal.detect_cycle(trade)
    arcs = {(r.tail, r.head) for r in trade.edges.select("tail", "head").collect()}
    closed = bool(ring) and all((a, b) in arcs for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
    frames = {"breadth": found, "depth_down": traversal.depth_first(h, top).select("key", "position"), "lex_depth": traversal.lexicographic_order(u, top, True).select("key", "position"), "lex_breadth": traversal.lexicographic_order(u, top).select("key", "position")}
    facts = {"reached": traversal.reaches(h, top, nation), "cycle": len(traversal.detect_cycle(h)), "cut": traversal.is_cut_vertex(u, nation), "bridge": traversal.is_bridge(u, leaf), "trade_cycle": "closed" if closed else "broken"}
    return answer(spark, frames, facts)


@query(rows(f"{TRADE}, {squared(_ARCS, 5)}, {_bottleneck(5).replace('d0 ', 'b0 ').replace('d1 ', 'b1 ').replace('d2 ', 'b2 ').replace('d3 ', 'b3 ').replace('d4 ', 'b4 ').replace('d5 ', 'b5 ')}, x AS (SELECT min(tail) AS s, max(head) AS t FROM e)",
    path="SELECT CAST(w AS BIGINT) FROM d5, x WHERE d5.s = x.s AND d5.t = x.t", walked="SELECT CAST(w AS BIGINT) FROM d5, x WHERE d5.s = x.s AND d5.t = x.t", tree="SELECT CAST(sum(e.weight) AS BIGINT) FROM e JOIN b5 ON b5.s = e.tail AND b5.t = e.head WHERE e.tail <> e.head AND b5.m = (e.weight, e.key)",
    tree_edges="SELECT count(*) - 1 FROM (SELECT tail FROM e UNION SELECT head FROM e)"))
def path_and_tree(spark, sf):
    g = held(P.trade(spark, sf))
    s, t = g.edges.agg(F.min("tail"), F.max("head")).first()
    row = paths.shortest_path(g, s, t).first()
    walked = {r.key: r for r in g.edges.filter(F.col("key").isin(row.edges or [-1])).collect()}
    at, total = s, 0.0
    for key in row.edges:
        if walked[key].tail != at:
            raise errors.GraphError("the path is broken")
        at, total = walked[key].head, total + walked[key].weight
    tree, weight = spanning.spanning_tree(PropertyGraph.from_edges(g.edges))
    return answer(spark, {}, {"path": int(row.weight), "walked": int(total) if at == t else None, "tree": int(weight), "tree_edges": (tree if isinstance(tree, DataFrame) else tree.edges).count()})


_CUTS = TRANSITIONS + """, n AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM (SELECT tail AS key FROM e UNION SELECT head FROM e)), z AS (SELECT max(n)::INT AS n FROM n),
a AS (SELECT DISTINCT x.i AS t, y.i AS h, weight FROM e JOIN n x ON x.key = e.tail JOIN n y ON y.key = e.head WHERE e.tail <> e.head),
m AS (SELECT r.m, i, CASE WHEN i = 0 THEN 0 WHEN i = z.n - 1 THEN 1 ELSE (r.m // (3 ** (i - 1))::BIGINT) % 3 END AS side FROM z, range((3 ** (z.n - 2))::BIGINT) r(m), range(z.n) q(i)),
bad AS (SELECT DISTINCT x.m FROM a JOIN m x ON x.i = a.t AND x.side = 0 JOIN m y ON y.m = x.m AND y.i = a.h AND y.side = 1, z WHERE NOT (a.t = 0 AND a.h = z.n - 1)),
c AS (SELECT x.m, sum(weight) AS v, count(*) AS k FROM a JOIN m x ON x.i = a.t AND x.side = 0 JOIN m y ON y.m = x.m AND y.i = a.h AND y.side = 1 WHERE x.m NOT IN (SELECT m FROM m WHERE side = 2) GROUP BY x.m)"""


@query(rows(_CUTS, flow="SELECT CAST(min(v) AS BIGINT) FROM c", edge_disjoint="SELECT min(k) FROM c",
    vertex_disjoint="SELECT min(r) + (SELECT count(*) FROM a, z WHERE t = 0 AND h = z.n - 1) FROM (SELECT m, count(*) FILTER (side = 2) AS r FROM m GROUP BY m) WHERE m NOT IN (SELECT m FROM bad)"))
def flows_and_disjoint_paths(spark, sf):
    """Least cuts by enumeration on the SQL side: each event type is on one side or the other, or removed."""
    g = held(P.transitions(spark, sf))
    low, high = g.vertices.agg(F.min("key"), F.max("key")).first()
    return answer(spark, {}, {"flow": int(flow.max_flow(g, low, high, flow_kernels.augmenting_flow)), "edge_disjoint": flow.edge_disjoint_paths(g, low, high), "vertex_disjoint": flow.vertex_disjoint_paths(g, low, high)})


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation UNION ALL SELECT 25 + r_regionkey FROM region), e AS (SELECT a.k AS t, b.k AS h FROM n a JOIN n b ON a.k < b.k AND (a.k + b.k) % 3 <> 0)
SELECT 'bipartite' AS kind, (SELECT count(*) // 2 FROM n) AS pairs, 0::BIGINT AS wrong UNION ALL SELECT 'general', (SELECT count(*) // 2 FROM n), 0 UNION ALL SELECT 'edge colours', (SELECT count(*) FROM e), 0""")
def perfect_matchings(spark, sf):
    """Nations and regions (numbered on after them) whose numbers' sum is no multiple of 3; pairs that are matched (edges that are coloured), and how many of them are wrong."""
    n = P.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key")).union(P.read(spark, sf, "region").select((F.col("r_regionkey") + 25).cast("long")))
    e = n.toDF("tail").join(n.toDF("head"), F.expr("tail < head and (tail + head) % 3 <> 0")).withColumn("key", F.col("tail") * 100 + F.col("head"))
    g = held(PropertyGraph.of(n, e, validate=False))
    across = g.edges.filter("tail < 15 and head >= 15")
    b = Bipartite.of_parts(g.vertices.withColumn("part_a", F.col("key") < 15), across)

    def checked(kind, m):
        m = [(min(r.a, r.b), max(r.a, r.b)) for r in m.select("a", "b").collect()]
        pairs = {(r.tail, r.head) for r in g.edges.select("tail", "head").collect()}
        return kind, len(m), sum(p not in pairs for p in m) + 2 * len(m) - len({v for p in m for v in p})

    c = {r.key: r.colour for r in colouring.greedy_edge_colouring(g).select("key", "colour").collect()}
    at: dict = {}
    for r in g.edges.select("key", "tail", "head").collect():
        for v in (r.tail, r.head):
            at.setdefault(v, []).append(c.get(r.key))
    clash = sum(len(x) - len(set(x)) for x in at.values())
    return spark.createDataFrame([checked("bipartite", b.perfect_matching()), checked("general", matching.perfect_matching(g)), ("edge colours", len(c), clash)], "kind string, pairs long, wrong long")


# -- bipartite, hypergraphs ----------------------------------------------------------------------

_PARTS = """e AS (SELECT l_suppkey * 1000000 + l_partkey AS key, l_suppkey * 10 + 1 AS tail, l_partkey * 10 AS head, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL), s AS (SELECT min(tail) AS s FROM e), k AS (SELECT * FROM e, s WHERE tail = s ORDER BY key LIMIT 1)"""
_PART_NEAR = "SELECT e.key FROM e, k WHERE (e.tail = k.tail OR e.head = k.head) AND e.key <> k.key"


@query(rows(_PARTS, part_a="SELECT DISTINCT tail FROM e", orders="SELECT (SELECT count(DISTINCT tail) FROM e) || ',' || (SELECT count(DISTINCT head) FROM e)", name="SELECT 'supply,renamed,true'", inside="SELECT true", outside="SELECT false", one_part="SELECT count(DISTINCT head) || ',0' FROM e",
    grown="SELECT count(DISTINCT tail) + 1 FROM e", more="SELECT count(*) + 1 FROM e", refused="SELECT true", less_vertex="SELECT count(*) FROM e, s WHERE tail <> s", less_edge="SELECT count(*) - 1 FROM e", less_pair="SELECT count(*) - 1 FROM e", neighbours="SELECT head FROM e, s WHERE tail = s",
    in_neighbours="SELECT e.tail FROM e, k WHERE e.head = k.head", out_neighbours="SELECT head FROM e, s WHERE tail = s", in_edges="SELECT e.key FROM e, k WHERE e.head = k.head", out_edges="SELECT key FROM e, s WHERE tail = s", sources="SELECT DISTINCT tail FROM e", sinks="SELECT DISTINCT head FROM e",
    near_key=_PART_NEAR, near_pair=_PART_NEAR, incident="SELECT key FROM e, s WHERE tail = s", degrees="SELECT (SELECT count(*) FROM e, s WHERE tail = s) || ',0'", found="SELECT key || ' ' || CAST(weight AS BIGINT) FROM k", vertex="SELECT s FROM s", cycle="SELECT 0",
    labelled="SELECT key || '|v|y|-' FROM k", labelled_vertex="SELECT s || '|w|b' FROM s", turned="SELECT head || '|' || tail || '|true' FROM k", random="SELECT true", copy="SELECT count(*) FROM e"))
def bipartite_calls(spark, sf):
    """The calls of a plain graph on a two-part one, which stays one."""
    e = P.read(spark, sf, "lineitem").groupBy((F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("key"), (F.col("l_suppkey") * 10 + 1).alias("tail"), (F.col("l_partkey") * 10).alias("head")).agg(F.sum("l_quantity").alias("weight"))
    v = e.select(F.explode(F.array("tail", "head")).alias("key")).distinct().withColumn("part_a", F.col("key") % 10 == 1)
    g = held(Bipartite.of(v, e, True, "supply", validate=False))
    s = g.part(True).agg(F.min("key")).first()[0]
    k = g.out_edges(s).orderBy("key").first()
    try:
        g.add_edge(-1, k.head, k.head)
        refused = False
    except errors.GraphError:
        refused = True
    key = lambda df: df.select("key")
    frames = {n: key(df) for n, df in {"part_a": g.part(True), "neighbours": g.neighbours(s), "in_neighbours": g.in_neighbours(k.head), "out_neighbours": g.out_neighbours(s), "in_edges": g.in_edges(k.head), "out_edges": g.out_edges(s), "sources": g.sources(), "sinks": g.sinks(), "near_key": g.neighbour_edges_by_key(k.key), "near_pair": g.neighbour_edges(k.tail, k.head), "incident": g.incident_edges(s)}.items()}
    h = g.set_edge_value_by_key(k.key, "u").set_edge_value(k.tail, k.head, "v").set_edge_label_by_key(k.key, "a", "x").set_edge_label(k.tail, k.head, "a", "y").set_edge_label_by_key(k.key, "n", "1").delete_edge_label_by_key(k.key, "n").set_edge_label_by_key(k.key, "n", "1").delete_edge_label(k.tail, k.head, "n")
    h = h.set_vertex_value(s, "w").set_vertex_label(s, "a", "b").set_vertex_label(s, "c", "d").delete_vertex_label(s, "c")
    frames["labelled"] = h.edges_by_label({"a": "y"}).select("key", "value", F.col("labels")["a"], F.col("labels")["n"])
    frames["labelled_vertex"] = h.vertices_by_label({"a": "b"}).select("key", "value", F.col("labels")["a"])
    r = g.clone().reversed()
    frames["turned"] = r.edges.filter(F.col("key") == k.key).select("tail", "head").withColumn("part", F.lit(r.in_part_a(s)))
    found, alone = g.edge(k.key), g.without_part(True)
    facts = {"orders": f"{g.part_order(True)},{g.part_order(False)}", "name": f"{g.name},{g.renamed('renamed').name},{str(g.directed).lower()}", "inside": g.in_part_a(s), "outside": g.in_part_a(k.head), "one_part": f"{alone.order()},{alone.size()}", "grown": g.add_vertex_to(-3, True).part_order(True), "more": g.add_edge(-1, s, k.head).size(), "refused": refused,
             "less_vertex": g.remove_vertex(s).size(), "less_edge": g.remove_edge_by_key(k.key).size(), "less_pair": g.remove_edges(k.tail, k.head).size(), "degrees": f"{g.out_degree(s)},{g.in_degree(s)}", "found": f"{found.key} {int(found.weight)}", "vertex": g.vertex(s).key, "cycle": len(traversal.detect_cycle(g)),
             "random": g.random_vertex(1).key is not None and g.random_edge(1).key is not None, "copy": g.clone().size()}
    return answer(spark, frames, facts)


_BASKET = "i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), x AS (SELECT min(o) AS o FROM i), y AS (SELECT min(s) AS s FROM i JOIN x USING (o))"


@query(rows(_BASKET, names="SELECT 'baskets,other'", counts="SELECT count(DISTINCT s) || ',' || count(DISTINCT o) FROM i", grown="SELECT (count(DISTINCT s) + 1) || ',' || (count(DISTINCT o) + 1) FROM i", less_vertex="SELECT DISTINCT o FROM i WHERE o NOT IN (SELECT o FROM i JOIN y USING (s))", less_key="SELECT count(DISTINCT o) - 1 FROM i",
    less_members="SELECT count(DISTINCT o) - (SELECT count(DISTINCT o) FROM i JOIN y USING (s)) FROM i", emptied="SELECT 0", vertex="SELECT s FROM y", edge="SELECT string_agg(s, ',' ORDER BY s) FROM i JOIN x USING (o)", labelled="SELECT o || '|3|q|b' FROM x", labelled_vertex="SELECT s || '|v|2|m|-' FROM y",
    near_key="SELECT DISTINCT a.o FROM i a JOIN i b USING (s), x WHERE b.o = x.o AND a.o <> x.o", near="SELECT DISTINCT o FROM i JOIN y USING (s)", incident="SELECT DISTINCT o FROM i JOIN y USING (s)", neighbours="SELECT DISTINCT a.s FROM i a JOIN i b USING (o), y WHERE b.s = y.s AND a.s <> y.s", random="SELECT true", copy="SELECT count(DISTINCT o) FROM i"))
def hyper_calls(spark, sf):
    g = P.baskets(spark, sf)
    g = g.__class__(materialise(g.vertices, "held"), materialise(g.edges, "held"), g.name)
    o = g.edges.agg(F.min("key")).first()[0]
    members = g.edge(o).members
    s = min(members)
    h = g.set_edge_weight(o, 3).set_edge_value_by_key(o, "p").set_edge_label_by_key(o, "a", "z").set_edge_label_by_key(o, "n", "1").delete_edge_label_by_key(o, "n")
    exact = g.edges_with(members, True).count()
    if exact == 1:  # by members only where no other order has the same
        h = h.set_edge_value(members, "q", True).set_edge_label(members, "a", "b", True).set_edge_label_by_key(o, "n", "1").delete_edge_label(members, "n", True)
    else:
        h = h.set_edge_value_by_key(o, "q").set_edge_label_by_key(o, "a", "b")
    h = h.set_vertex_value(s, "v").set_vertex_weight(s, 2).set_vertex_label(s, "k", "m").set_vertex_label(s, "n", "1").delete_vertex_label(s, "n")
    grown = g.add_vertex(-1).add_edge(-1, [-1, s])
    frames = {"less_vertex": g.remove_vertex(s).edges, "near_key": g.neighbour_edges_by_key(o), "near": g.neighbour_edges([s]), "incident": g.incident_edges(s), "neighbours": g.neighbours(s)}
    frames = {n: df.select("key") for n, df in frames.items()}
    frames["labelled"] = h.edges_by_label({"a": "b"}).select("key", F.col("weight").cast("long"), "value", F.col("labels")["a"])
    frames["labelled_vertex"] = h.vertices_by_label({"k": "m"}).select("key", "value", F.col("weight").cast("long"), F.col("labels")["k"], F.col("labels")["n"])
    facts = {"names": f"{g.name},{g.renamed('other').name}", "counts": f"{g.order()},{g.size()}", "grown": f"{grown.order()},{grown.size()}", "less_key": g.remove_edge_by_key(o).size(), "less_members": g.remove_edges([s]).size(), "emptied": g.remove_all_edges().size(), "vertex": g.vertex(s).key, "edge": ",".join(map(str, members)), "random": g.random_vertex(1).key is not None and g.random_edge(1).key is not None, "copy": g.clone().size()}
    return answer(spark, frames, facts)


# -- forests, dynamic trees, disjoint sets -------------------------------------------------------

_WOOD = "RECURSIVE " + HIERARCHY + ", r(key, root) AS (SELECT key, key FROM h WHERE parent IS NULL UNION ALL SELECT h.key, r.root FROM r JOIN h ON h.parent = r.key), x AS (SELECT parent AS t FROM h WHERE key = 'n:0'), n AS (SELECT count(*) AS n FROM region)"


@query(rows(_WOOD, trees="SELECT key || '|' || min(key) OVER (PARTITION BY root) FROM r", tree_vertices="SELECT r.key FROM r, x WHERE root = t", tree_edges="SELECT r.key FROM r, x WHERE root = t AND r.key <> t", counts="SELECT n || ',' || (n = 1) || ',false' FROM n", root="SELECT t FROM x", roots="SELECT t FROM x", connected="SELECT count(*) = 1 FROM r, x WHERE r.key = 'n:0' AND root = t",
    directed="SELECT 'true,true,false'", unrooted="SELECT 0", grown="SELECT (SELECT count(*) FROM h) + 1 || ',' || n FROM n", less_vertex="SELECT n - 1 + 1 + (SELECT count(*) FROM h WHERE parent = 'n:0') FROM n", less_pair="SELECT n + 1 FROM n", less_edge="SELECT n + 1 FROM n", refused="SELECT count(*) > 0 FROM h WHERE key = 'n:0'"))
def forest_calls(spark, sf):
    h = held(P.hierarchy(spark, sf))
    top = h.in_edges("n:0").first().tail
    f = Forest.of(h)
    g = f.set_root(top)
    d = g.set_directed("n:0")
    one = lambda *x: spark.createDataFrame([x], ", ".join(f"c{i} string" for i in range(len(x))))
    grown = g.add_vertices(one("x:1").toDF("key")).add_edges(one("e", top, "x:1").toDF("key", "tail", "head"))
    try:
        g.add_edges(one("e", "n:0", top).toDF("key", "tail", "head"))
        refused = False
    except (errors.CycleError, errors.GraphError):
        refused = True
    frames = {"trees": f.trees(), "tree_vertices": g.tree_vertices("n:0").select("key"), "tree_edges": g.tree_edges("n:0").select("key")}
    facts = {"counts": f"{f.tree_count()},{str(f.is_tree()).lower()},{str(f.is_digraph()).lower()}", "root": g.root("n:0"), "roots": ",".join(g.all_roots()), "connected": g.connected("n:0", top), "directed": f"{d.is_directed('n:0')},{d.is_digraph()},{d.cancel_directed('n:0').is_digraph()}".lower(), "unrooted": len(g.cancel_root(top).all_roots()), "grown": f"{grown.graph.order()},{grown.tree_count()}",
             "less_vertex": g.without_vertices(one("n:0").toDF("key")).tree_count(), "less_pair": g.without_pairs(one(top, "n:0")).tree_count(), "less_edge": g.without_edges(one("n:0").toDF("key")).tree_count(), "refused": refused}
    return answer(spark, frames, facts)


@query(rows(_WOOD + ", y AS (SELECT min(key) AS k FROM h WHERE parent = 'n:0'), o AS (SELECT min(key) AS k FROM h, x WHERE h.parent IS NULL AND h.key <> x.t)", sizes="SELECT (SELECT count(*) FROM h) || ',' || n FROM n", root="SELECT t FROM x", flags="SELECT 'false,true,true,false'", got="SELECT CAST(weight AS BIGINT) FROM h JOIN y ON h.key = y.k", path="SELECT t || '>n:0>' || k FROM x, y",
    total="SELECT CAST(1 + weight AS BIGINT) FROM h JOIN y ON h.key = y.k", connected="SELECT count(*) = 1 FROM x", cut="SELECT n + 1 FROM n", turned="SELECT 'n:0'", between="SELECT k || '>n:0>' || t FROM x, y", linked="SELECT k FROM o", changed="SELECT 'new,7,8'", made="SELECT n + 1 FROM n"))
def dynamic_tree_calls(spark, sf):
    f = ParentForest(materialise(P.hierarchy_parents(spark, sf), "nodes"))
    top = f.get("n:0").parent
    k = f.nodes.filter("parent = 'n:0'").agg(F.min("key")).first()[0]
    other = f.nodes.filter(F.col("parent").isNull() & (F.col("key") != top)).agg(F.min("key")).first()[0]
    way = lambda forest, key: ">".join(r.key for r in forest.path(key).collect())
    moved = f.cut("n:0").link(other, k)
    changed = f.update_value(k, "new").update_weight(k, 7).get(k)
    facts = {"sizes": f"{f.size()},{f.tree_count()}", "root": f.find_root(k), "flags": f"{f.is_root(k)},{f.is_root(top)},{f.access(k)},{f.access('none')}".lower(), "got": int(f.get(k).weight), "path": way(f, k), "total": int(f.path_aggregate(k, 0.0, lambda s, r: s + r.weight)), "connected": f.connected(k, top), "cut": f.cut("n:0").tree_count(), "turned": f.make_root("n:0").find_root(top),
             "between": way(f.split(k, top), top), "linked": moved.find_root(k), "changed": f"{changed.value},{int(changed.weight)},{int(f.add_or_update(k, 'x', 8).get(k).weight)}", "made": f.make_tree("none").tree_count()}
    return answer(spark, {}, facts)


@query(rows("RECURSIVE u AS (SELECT DISTINCT o_custkey AS a, o_custkey % 7 AS b FROM orders), p AS (SELECT a, b FROM u UNION SELECT b, a FROM u), m AS (SELECT max(a) AS m FROM u), k AS (SELECT i AS v FROM m, range(m + 2) q(i)), r(v, c) AS (SELECT v, v FROM k UNION SELECT p.b, c FROM r JOIN p ON p.a = r.v WHERE c < p.b OR c = p.b), s AS (SELECT v, min(c) AS c FROM r GROUP BY v)",
    component_count="SELECT count(DISTINCT c) FROM s", find="SELECT c FROM s, m WHERE v = m", connected="SELECT count(DISTINCT c) = 1 FROM s, m WHERE v IN (m, m % 7)", apart="SELECT count(DISTINCT c) = 1 FROM s, m WHERE v IN (m, m + 1)", size="SELECT count(*) FROM s WHERE c = (SELECT c FROM s, m WHERE v = m)"))
def disjoint_set_calls(spark, sf):
    pairs = materialise(P.read(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("a"), (F.col("o_custkey") % 7).cast("long").alias("b")).distinct(), "pairs")
    m = pairs.agg(F.max("a")).first()[0]
    s = DisjointSets.singletons(spark, m + 2).union(pairs)
    s = DisjointSets(s.elements, s.pairs)
    return answer(spark, {}, {"component_count": s.count(), "find": s.find(m), "connected": s.connected(m, m % 7), "apart": s.connected(m, m + 1), "size": s.size(m)})


# -- ordered maps, arrays, queues ------------------------------------------------------------------

_MAP = "c AS (SELECT c_custkey AS k, c_name AS v FROM customer), d AS (SELECT c_nationkey AS k, c_custkey AS v FROM customer)"


@query(rows(_MAP, length="SELECT count(*) FROM c", search="SELECT v FROM c WHERE k = 5", seek="SELECT min(k) FROM c WHERE k >= 0", past="SELECT NULL", ends="SELECT min(k) || ',' || max(k) FROM c", rank="SELECT count(*) FROM c WHERE k <= 7", nth="SELECT k FROM c ORDER BY k LIMIT 1 OFFSET 2", scan="SELECT k FROM c", top="SELECT max(k) FROM c",
    halves="SELECT count(*) FILTER (k < 50) || ',' || count(*) FILTER (k >= 50) FROM c", merged="SELECT count(*) FROM c", inserted="SELECT count(*) || ',new' FROM c", fresh="SELECT count(*) + 1 FROM c", deleted="SELECT count(*) - 1 FROM c", missing="SELECT count(*) = 0 FROM c WHERE k = -1", cleared="SELECT 0",
    many="SELECT count(*) + 1 FROM d", many_less="SELECT v FROM d WHERE k = (SELECT min(k) FROM d) AND v > (SELECT min(v) FROM d WHERE k = (SELECT min(k) FROM d))", many_none="SELECT count(*) FROM d WHERE k <> (SELECT min(k) FROM d)", many_update="SELECT v FROM (SELECT v FROM d WHERE k = (SELECT min(k) FROM d) ORDER BY v OFFSET 1) UNION ALL SELECT -4"))
def ordered_map_calls(spark, sf):
    c = P.read(spark, sf, "customer")
    m = OrderedMap(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")))
    many = OrderedMap(c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v")), unique=False)
    least = many.first().k
    low, high = m.split(50)
    try:
        m.delete(-1)
        missing = False
    except errors.NotExistsError:
        missing = True
    new = m.insert(5, "new")
    frames = {"scan": m.scan(True).select("k"), "many_less": many.delete(least).entries.filter(F.col("k") == least).select("v"), "many_update": many.update(least, -4).entries.filter(F.col("k") == least).select("v")}
    facts = {"length": len(m), "search": m.search(5), "seek": m.seek(0)[0], "past": m.seek(10**9), "ends": f"{m.first().k},{m.last().k}", "rank": m.rank(7), "nth": m.nth(3).k if m.nth(0) is None else m.nth(2).k, "top": next(m.visit(True)).k, "halves": f"{len(low)},{len(high)}", "merged": len(low.merge(high)), "inserted": f"{len(new)},{new.search(5)}", "fresh": len(m.insert(-1, "x")),
             "deleted": len(m.delete(5)), "missing": missing, "cleared": len(m.cleared()), "many": len(many.insert(least, -9)), "many_none": len(many.delete_all(least))}
    return answer(spark, frames, facts)


@query(rows("a AS (SELECT p_partkey - 1 AS i, p_size::BIGINT AS x FROM part)", differences="SELECT i || '|' || (x - coalesce(lag(x) OVER (ORDER BY i), 0)) FROM a", length="SELECT count(*) FROM a", appended="SELECT count(*) + 1 FROM a", got="SELECT x FROM a WHERE i = 3", none="SELECT NULL", total="SELECT sum(x) FROM a WHERE i BETWEEN 2 AND 40", most="SELECT greatest(max(x), 99) FROM a WHERE i BETWEEN 0 AND 9",
    doubled="SELECT 2 * x FROM a WHERE i = 4", raised="SELECT sum(x + CASE WHEN i BETWEEN 5 AND 9 THEN 10 ELSE 0 END)::BIGINT FROM a"))
def array_calls(spark, sf):
    a = IndexedArray(materialise(P.read(spark, sf, "part").select((F.col("p_partkey") - 1).alias("i"), F.col("p_size").cast("long").alias("x")), "cells"))
    facts = {"length": len(a), "appended": len(a.append(7)), "got": a.get(3), "none": a.get(-9), "total": a.sum(2, 40), "most": a.set(2, 99).query(0, 9, F.max), "doubled": a.update(4, lambda x: x * 2).get(4), "raised": a.add(10, 5, 9).cells.agg(F.sum("x")).first()[0]}
    return answer(spark, {"differences": a.differences()}, facts)


@query(rows("q AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), f AS (SELECT * FROM q ORDER BY p, k LIMIT 3)", length="SELECT count(*) FROM q", popped="SELECT k FROM f", left_over="SELECT count(*) - 3 FROM q", next="SELECT k FROM q ORDER BY p, k LIMIT 1 OFFSET 3", priority="SELECT CAST(p * 100 AS BIGINT) FROM q WHERE k = 1", raised="SELECT max(k) FROM q", pushed="SELECT count(*) + 1 FROM q",
    stack_top="SELECT max(k) FROM q", stack_left="SELECT count(*) - 1 FROM q", stack_holds="SELECT count(*) > 0 FROM q WHERE k = 1", queue_front="SELECT min(k) FROM q", queue_back="SELECT -1", queue_left="SELECT count(*) FROM q", emptied="SELECT '0,true'"))
def queue_calls(spark, sf):
    """Priority queues, stacks and first-in-first-out queues over the orders."""
    o = P.read(spark, sf, "orders")
    q = PriorityTable(o.select(F.col("o_orderkey").alias("key"), F.lit("v").alias("value"), F.col("o_totalprice").alias("priority")))
    top, rest = q.pop(3)
    last = o.agg(F.max("o_orderkey")).first()[0]
    s = SequenceTable.of(o.select(F.col("o_orderkey").alias("item")), "item")
    out, left = s.pop()
    grown = s.push(-1)
    front, queue = grown.take()
    none = s.cleared()
    facts = {"length": len(q), "left_over": len(rest), "next": rest.top().first().key, "priority": round(q.priority(1) * 100), "raised": q.update(last, -1.0).top().first().key, "pushed": len(q.push(spark.createDataFrame([(-1, "v", 0.0)], q.items.schema))), "stack_top": out, "stack_left": len(left), "stack_holds": s.contains(1), "queue_front": front, "queue_back": grown.top(), "queue_left": len(queue), "emptied": f"{len(none)},{none.is_empty()}".lower()}
    return answer(spark, {"popped": top.select("key")}, facts)


# -- boxes and prefixes ------------------------------------------------------------------------------


@query(rows(_BOXES.removeprefix("WITH ") + ", w AS (SELECT id, sqrt(pow(x0 + x1 - 10, 2) + pow(y0 + y1 - 40, 2)) / 2 AS d FROM c)", covered="SELECT id FROM c WHERE 3 <= x0 AND x1 <= 20 AND -5 <= y0 AND y1 <= 60", areas="SELECT round(sum((x1 - x0) * (y1 - y0)))::BIGINT FROM c", same="SELECT id FROM c WHERE id BETWEEN 1 AND 3", length="SELECT count(*) FROM c", inserted="SELECT count(*) + 1 FROM c", deleted="SELECT count(*) - 1 FROM c", scan="SELECT id FROM c",
    nearest="SELECT id FROM w ORDER BY d, id LIMIT 4", within="SELECT id FROM w WHERE d <= 6"))
def box_calls(spark, sf):
    b = BoxTable(materialise(_boxes(spark, sf, "customer", "c", "c_custkey"), "boxes"))
    first = [b.boxes.filter(F.col("id") == i).first() for i in (1, 2, 3)]
    box = lambda r: (r.minx, r.miny, r.maxx, r.maxy)
    own = ("minx", "miny", "maxx", "maxy")
    cols = tuple(F.col(c) for c in own)
    lits = lambda t: tuple(F.lit(float(x)) for x in t)
    same = traversal._union([b.boxes.filter(equals(cols, lits(box(r))) & (F.col("id") == r.id)).select("id") for r in first])
    frames = {"covered": b.boxes.filter(covers(lits((3, -5, 20, 60)), cols)).select("id"), "same": same, "scan": b.scan().select("id"), "nearest": b.nearest((4.5, 19.0, 5.5, 21.0), 4).select("id"), "within": b.within((4.5, 19.0, 5.5, 21.0), 6.0).select("id")}
    facts = {"areas": round(b.boxes.agg(F.sum(area(cols))).first()[0]), "length": len(b), "inserted": len(b.insert(b.boxes.limit(1))), "deleted": len(b.delete(box(first[0])))}
    return answer(spark, frames, facts)


@query(rows("t AS (SELECT p_name AS k, min(p_partkey) AS v FROM part GROUP BY 1), x AS (SELECT min(k) AS k, min(left(k, 4)) AS s FROM t)", length="SELECT count(*) FROM t", found="SELECT v FROM t JOIN x USING (k)", none="SELECT NULL", inserted="SELECT count(*) + 1 FROM t", raised="SELECT v + 7 FROM t JOIN x USING (k)", deleted="SELECT count(*) - 1 FROM t", cut="SELECT count(*) FROM t, x WHERE NOT starts_with(t.k, s)", first="SELECT k FROM x", scan="SELECT k FROM t"))
def prefix_calls(spark, sf):
    t = PrefixMap(materialise(P.read(spark, sf, "part").groupBy(F.col("p_name").alias("k")).agg(F.min("p_partkey").alias("v")), "prefixes"))
    k, s = t.entries.agg(F.min("k"), F.min(F.substring("k", 1, 4))).first()
    facts = {"length": len(t), "found": t.search(k), "none": t.search("~"), "inserted": len(t.insert(spark.createDataFrame([("~", 1)], t.entries.schema))), "raised": t.update(k, lambda v: v + 7).search(k), "deleted": len(t.delete(k)), "cut": len(t.delete_prefix(s)), "first": t.scan().first().k}
    return answer(spark, {"scan": t.scan().select("k")}, facts)


# -- documents, drawings, generators -------------------------------------------------------------------


@query(rows(TRADE, yaml="SELECT key || '|' || tail || '|' || head || '|' || CAST(weight AS BIGINT) FROM e", file="SELECT key FROM e", pair="SELECT key FROM e", lists="SELECT key FROM e", undirected="SELECT count(*) || ',false' FROM e", lines="SELECT (SELECT count(*) FROM e) > 0", empty="SELECT '0,0'"))
def document_calls(spark, sf):
    g = held(P.trade(spark, sf)).with_()
    g = g.with_(edges=g.edges.select("key", "tail", "head", "weight", "value", "labels"))
    folder = f"{scratch_root(spark)}/graphloom/documents"
    documents.write_pair(g, folder + "/pair", "overwrite")
    documents.to_json(g).select("value").coalesce(1).write.mode("overwrite").text(folder + "/json")
    yaml, read = documents.from_document(spark, documents.to_yaml(g)), documents.read_document(spark, folder + "/json", directed=True)
    plain = documents.from_document(spark, documents.to_json(g).first().value, directed=False)
    lists = PropertyGraph.of_lists(spark, [r.key for r in g.vertices.collect()], [(r.tail, r.head, r.weight) for r in g.edges.collect()], True)
    none = PropertyGraph.empty(spark)
    frames = {"yaml": yaml.edges.select("key", "tail", "head", F.col("weight").cast("long")), "file": read.edges.select("key"), "pair": documents.read_pair(spark, folder + "/pair").edges.select("key"), "lists": lists.edges.select((F.col("tail") * 1000 + F.col("head")).alias("key"))}
    return answer(spark, frames, {"undirected": f"{plain.size()},{str(plain.directed).lower()}", "lines": next(iter(documents.rows_of(g))) is not None, "empty": f"{none.order()},{none.size()}"})


@query(rows(TRADE + "," + HIERARCHY, tikz="SELECT tail || ' -- {' || string_agg(head::VARCHAR, ',' ORDER BY head) || '};' FROM e GROUP BY tail", tikz_alone="SELECT n_nationkey || ';' FROM nation WHERE n_nationkey NOT IN (SELECT tail FROM e UNION SELECT head FROM e)", dot_vertices="SELECT '\"' || n_nationkey || '\" [shape=box];' FROM nation", dot_edges="SELECT '\"' || tail || '\" -> \"' || head || '\" [];' FROM e",
    forest="SELECT x.key || CASE WHEN count(y.key) > 0 THEN ' -- {' || string_agg(y.key, ', ' ORDER BY y.key) || '}' ELSE '' END || ';' FROM h x LEFT JOIN h y ON y.parent = x.key WHERE x.parent IS NULL GROUP BY x.key", html_nodes="SELECT n_nationkey FROM nation", html_links="SELECT tail || '>' || head || ' ' || CAST(weight AS BIGINT) FROM e", document="SELECT true"))
def drawings(spark, sf):
    g = held(P.trade(spark, sf))
    lines = [x.strip() for x in drawing.tikz_graph(g.undirected()).split("\n")]
    dots = [x.strip() for x in drawing.dot(g, shape="box").split("\n")]
    h = P.hierarchy(spark, sf)
    low = h.induced(h.vertices.filter("key like 'r:%' or key like 'n:%'").select("key"))
    f = Forest(held(low).undirected(), low.vertices.filter("key like 'r:%'").select("key", F.lit(False).alias("directed")))
    trees = [x for x in drawing.tikz_forest(f).split("\n") if x.startswith("r:")]
    payload = json.loads(re.search(r"const data = (\{.*\}), directed", drawing.html(g, True)).group(1))
    found = {"tikz": [x for x in lines if " -- {" in x], "tikz_alone": [x for x in lines if re.fullmatch(r"\d+;", x)], "dot_vertices": [x for x in dots if "[shape=box]" in x], "dot_edges": [x for x in dots if "->" in x], "forest": trees, "html_nodes": [x["id"] for x in payload["nodes"]], "html_links": [f"{x['source']}>{x['target']} {int(x['weight'])}" for x in payload["links"]]}
    rows_ = [(what, value) for what, values in found.items() for value in values]
    return answer(spark, {}, {"document": drawing.tikz_document("x").endswith("x")}).unionByName(spark.createDataFrame(rows_, "what string, value string"))


_EDGE_SETS = {
    "petersen": "SELECT i, (i + 1) % 5 FROM range(5) r(i) UNION ALL SELECT i, i + 5 FROM range(5) r(i) UNION ALL SELECT 5 + i, 5 + (i + 2) % 5 FROM range(5) r(i)",
    "heawood": "SELECT i, (i + 1) % 14 FROM range(14) r(i) UNION ALL SELECT i, (i + 5) % 14 FROM range(0, 14, 2) r(i)",
    "K6": "SELECT a.i, b.i FROM range(6) a(i), range(6) b(i) WHERE a.i < b.i",
    "K3,4": "SELECT a.i, b.i FROM range(3) a(i), range(3, 7) b(i)",
    "K2,2,3": "SELECT a.i, b.i FROM range(7) a(i), range(7) b(i) WHERE a.i < b.i AND least(a.i // 2, 2) <> least(b.i // 2, 2)",
    "Q4": "SELECT a.i, b.i FROM range(16) a(i), range(16) b(i) WHERE a.i < b.i AND bit_count(xor(a.i, b.i)) = 1",
    "C9": "SELECT i, (i + 1) % 9 FROM range(9) r(i)",
    "W6": "SELECT i, (i + 1) % 5 FROM range(5) r(i) UNION ALL SELECT i, 5 FROM range(5) r(i)",
    "queen3": "SELECT a.i, b.i FROM range(9) a(i), range(9) b(i) WHERE a.i < b.i AND (a.i // 3 = b.i // 3 OR a.i % 3 = b.i % 3 OR abs(a.i // 3 - b.i // 3) = abs(a.i % 3 - b.i % 3))",
    "tree": "SELECT (i - 1) // 3, i FROM range(1, 13) r(i)",
    "full tree": "SELECT (i - 1) // 2, i FROM range(1, 15) r(i)",
    "hadamard": "SELECT 4 * a.i + s.i, 4 * b.i + 2 + CASE WHEN a.i = 1 AND b.i = 1 THEN 1 - s.i ELSE s.i END FROM range(2) a(i), range(2) b(i), range(2) s(i)",
    "tournament": "SELECT a.i, b.i FROM range(8) a(i), range(8) b(i) WHERE a.i < b.i",
    "sparse": "SELECT 0, 0 WHERE false",
    "dense": "SELECT a.i, b.i FROM range(9) a(i), range(9) b(i) WHERE a.i < b.i",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, least(a, b)::BIGINT AS a, greatest(a, b)::BIGINT AS b FROM ({s}) t(a, b)" for n, s in _EDGE_SETS.items()))
def generated_edges(spark, sf):
    """The edge sets of the generators; of random graphs those that chance cannot change."""
    gs = {
        "petersen": generators.petersen(spark), "heawood": generators.heawood(spark), "K6": generators.complete_graph(spark, 6), "K3,4": generators.complete_bipartite(spark, 3, 4), "K2,2,3": generators.complete_kpartite(spark, [2, 2, 3]), "Q4": generators.hypercube(spark, 4), "C9": generators.cycle(spark, 9),
        "W6": generators.wheel(spark, 6), "queen3": generators.queen(spark, 3, 3), "tree": generators.complete_tree(spark, 3, 13).graph, "full tree": generators.full_tree(spark, 2, 4).graph, "hadamard": generators.hadamard(spark, [[1, 1], [1, -1]]), "tournament": generators.random_tournament(spark, 8),
        "sparse": generators.random_graph(spark, 9, 0.0), "dense": generators.random_graph(spark, 9, 1.0),
    }
    return traversal._union([g.edges.select(F.lit(n).alias("name"), F.least("tail", "head").alias("a"), F.greatest("tail", "head").alias("b")) for n, g in gs.items()])


# -- jobs, workflows, growing graphs -----------------------------------------------------------------


@query(rows("n AS (SELECT count(*) AS n FROM region)", done="SELECT 'success,' || (n + 1) || ',' || (SELECT count(*) FROM nation) FROM n", statuses="SELECT 'success' FROM n, range(n + 1)", waiting="SELECT 'waiting,waiting'", ring="SELECT 'true'", less="SELECT n FROM n", retried="SELECT 'success,2'", late="SELECT 'failed'", paused="SELECT 'paused,success'", stopped="SELECT 'stopped'", alone="SELECT count(*) FROM nation", of_graph="SELECT n FROM n", of_file="SELECT n FROM n", forgiven="SELECT 'success'"))
def job_calls(spark, sf):
    """A job for each region counts its nations; the last sums the counts up."""
    nation = P.read(spark, sf, "nation")
    regions = [r[0] for r in P.read(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    got: dict = {}
    g = JobGraph("regions", spark)
    g.set_max_concurrency(2)
    for r in regions:
        g.add_job(r, lambda r=r: got.__setitem__(r, nation.filter(F.col("n_regionkey") == r).count()))
    g.add_job("sum", lambda: got.__setitem__("sum", sum(got[r] for r in regions)))
    for r in regions:
        g.add_dependency(r, "sum")
    g.start()
    g.wait(120)
    facts = {"done": f"{g.status.value},{len(g.all_jobs())},{got['sum']}"}
    table = g.table().select("status")
    table = spark.createDataFrame(table.collect(), table.schema)
    g.reset()
    facts["waiting"] = f"{g.status.value},{g.job('sum').state.value}"
    g.add_dependency("sum", regions[0])
    facts["ring"] = bool(g.detect_cycle())
    g.remove_dependency("sum", regions[0])
    g.remove_job("sum")
    facts["less"] = len(g.all_jobs())
    g.run_job(regions[0])
    facts["alone"] = got["sum"]
    tries: list = []

    def second():
        tries.append(1)
        if len(tries) < 2:
            raise ValueError("not yet")

    h = JobGraph("retry", spark)
    h.add_job("a", second, retries=1)
    h.start()
    h.wait(60)
    facts["retried"] = f"{h.status.value},{len(tries)}"
    late = JobGraph("late", spark)
    late.add_job("a", lambda: __import__("time").sleep(3), timeout=0.1)
    late.start()
    try:
        late.wait(30)
    except TimeoutError:
        pass
    facts["late"] = late.status.value
    p = JobGraph("pause", spark)
    p.add_job("a", lambda: None)
    p.pause()
    was = p.status
    p.start()
    p.wait(30)
    facts["paused"] = f"{was.value},{p.status.value}"
    s = JobGraph("stop", spark)
    s.add_job("a", lambda: __import__("time").sleep(1))
    s.start()
    s.stop()
    facts["stopped"] = s.status.value
    e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(regions, regions[1:]))], "key long, tail long, head long")
    dag = PropertyGraph.of(spark.createDataFrame([(r,) for r in regions], "key long"), e, True, "chain")
    facts["of_graph"] = len(JobGraph.from_graph(dag).all_jobs())
    folder = f"{scratch_root(spark)}/graphloom/chain"
    documents.to_json(dag).select("value").coalesce(1).write.mode("overwrite").text(folder)
    facts["of_file"] = len(JobGraph.from_file(spark, folder).all_jobs())
    x = JobGraph("forgive", spark)
    x.add_job("a", lambda: spark.range(3 * 10**10).selectExpr("sum(sqrt(id))").collect())
    x.start()
    __import__("time").sleep(1.5)
    x.stop_job("a", as_success=True)
    x.wait(60)
    facts["forgiven"] = x.status.value if x.status is not State.SUCCESS else "success"
    return answer(spark, {"statuses": table}, facts)


@query(rows("o AS (SELECT count(*) AS o FROM orders), l AS (SELECT count(*) AS l FROM lineitem)", name="SELECT 'ratio'", status="SELECT 'success'", result="SELECT l - 2 * o FROM o, l", jobs="SELECT 3", outputs="SELECT l - 2 * o FROM o, l", due="SELECT '2024-01-01 06:00:00,2024-01-02 06:00:00'", stopped="SELECT 'stopped'"))
def workflow_calls(spark, sf):
    """Lines less twice the orders, by three tasks; a fourth is added and removed again."""
    wf = Workflow("ratio", "0 6 * * *", spark)
    wf.add_task(Task("lines", lambda i: {"n": P.read(spark, sf, i["table"]).count()}), Task("orders", lambda i: {"n": i["times"] * P.read(spark, sf, "orders").count()}), Task("less", lambda i: {"d": i["a"] - i["b"]}), Task("gone", lambda i: {}))
    wf.set_input("lines", Parameter("table", "lineitem"))
    wf.set_inputs({"orders": [Parameter("times", 2)], "less": [Parameter("a", ref="lines.output.n"), Parameter("b", ref="ratio.orders.output.n")]})
    wf.set_output("less", Parameter("d"))
    wf.set_outputs({"lines": [Parameter("n")]})
    for first, then in (("lines", "less"), ("orders", "less"), ("less", "gone")):
        wf.add_dependency(first, then)
    wf.remove_dependency("less", "gone")
    wf.remove_task("gone")
    wf.start()
    wf.wait(120)
    from datetime import datetime

    due = wf.due(datetime(2023, 12, 31, 12), 2)
    idle = Workflow("idle", spark=spark)
    idle.add_task(Task("a", lambda i: __import__("time").sleep(1)))
    idle.start()
    idle.stop()
    return answer(spark, {}, {"name": wf.name, "status": wf.status.value, "result": wf.output("less")["d"], "jobs": wf.info().count(), "outputs": wf.tasks["less"].outputs["d"], "due": ",".join(map(str, due)), "stopped": idle.status.value})


@query(rows(HIERARCHY, bridges="SELECT key FROM h WHERE parent IS NOT NULL", bridge_count="SELECT count(*) FROM h WHERE parent IS NOT NULL", one="SELECT true", components="SELECT count(*) + 1 FROM region", size="SELECT count(*) FROM h WHERE parent IS NOT NULL"))
def online_calls(spark, sf):
    """The hierarchy's edges in two batches, the second of them twice; all are bridges."""
    h = held(P.hierarchy(spark, sf))
    online = OnlineConnectivity(spark, key="string")
    parts = [h.edges.filter(F.crc32(F.col("key").cast("binary")) % 2 == i) for i in (0, 1)]
    for part in (*parts, parts[1]):
        online.apply(part)
    online.add_vertex("alone")
    return answer(spark, {"bridges": online.bridges().select("key")}, {"bridge_count": online.bridge_count(), "one": online.is_bridge("n:0"), "components": online.component_count(), "size": online.graph().size()})
