"""All registered queries of the graph engine and their SQL oracles. Every query covers its whole
tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import colouring, flow, matching, paths, spanning, traversal
from ..operators.forest import DisjointSets, ParentForest, lowest_common_ancestors
from ..operators.ordered import IndexedArray, OrderedMap, PriorityTable
from ..operators.spatial import BoxTable, PrefixMap
from ..scratch import materialise
from ..sources import documents, drawing, generators
from ..streaming.connectivity import OnlineConnectivity
from . import projections as P
from .jobs import JobGraph
from .workflow import Parameter, Task, Workflow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.strip()
        return f

    return register


TRADE = """
sold AS (SELECT s_nationkey::BIGINT AS tail, c_nationkey::BIGINT AS head, l_quantity, l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)) AS money
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
e AS (SELECT tail * 1000 + head AS key, tail, head, sum(l_quantity) AS weight, sum(money)::DOUBLE AS revenue FROM sold GROUP BY tail, head)"""
TRANSITIONS = """
e AS (SELECT tail || '>' || head AS key, tail, head, count(*)::DOUBLE AS weight FROM
  (SELECT event_type AS tail, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS head FROM events) WHERE head IS NOT NULL GROUP BY tail, head)"""
SEQUENCE = """
e AS (SELECT event_id AS key, user_id AS tail, head FROM (SELECT event_id, user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS head FROM events) WHERE head IS NOT NULL),
v AS (SELECT tail AS key FROM e UNION SELECT head FROM e)"""
SUPPLY = """
e AS (SELECT l_suppkey * 10 + 1 AS tail, l_partkey * 10 AS head, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)"""
HIERARCHY = """
h AS (SELECT 'r:' || r_regionkey AS key, NULL AS parent, 0.0::DOUBLE AS weight FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 1.0 FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, round(c_acctbal * 100) FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, round(s_acctbal * 100) FROM supplier)"""


def squared(base: str, times: int) -> str:
    """Min-plus squaring as a chain of CTEs d0, d1, ..."""
    out = [f"d0 AS ({base})"]
    for i in range(times):
        out.append(f"d{i + 1} AS (SELECT a.s, b.t, min(a.w + b.w) AS w FROM d{i} a JOIN d{i} b ON a.t = b.s GROUP BY a.s, b.t)")
    return ", ".join(out)


# -- degrees, properties, matrices ---------------------------------------------------------


@query(f"WITH {TRADE} SELECT key, tail, head, weight, revenue FROM e")
def trade_digraph(spark, sf):
    return P.trade(spark, sf).edges.select("key", "tail", "head", "weight", "revenue")


@query(f"""WITH {TRADE} SELECT n_nationkey::BIGINT AS key, (SELECT count(*) FROM e WHERE tail = n_nationkey) + (SELECT count(*) FROM e WHERE head = n_nationkey) AS degree,
  (SELECT count(*) FROM e WHERE head = n_nationkey) AS in_degree, (SELECT count(*) FROM e WHERE tail = n_nationkey) AS out_degree FROM nation""")
def degrees(spark, sf):
    g = P.trade(spark, sf)
    return g.degrees().join(g.in_degrees(), "key").join(g.out_degrees(), "key")


@query(f"""WITH {SUPPLY}, d AS (SELECT k, count(*) AS n FROM (SELECT tail AS k FROM e UNION ALL SELECT head FROM e) GROUP BY k)
SELECT (SELECT count(*) FROM d) AS "order", (SELECT count(*) FROM e) AS size, (SELECT min(n) FROM d) AS min_degree, (SELECT max(n) FROM d) AS max_degree,
  2.0::DOUBLE * (SELECT count(*) FROM e) / (SELECT count(*) FROM d) AS average_degree, 1 AS multiplicity, true AS simple,
  (SELECT min(n) = max(n) FROM d) AS regular, false AS loop, false AS negative_weight, false AS complete, false AS orientation""")
def graph_profile(spark, sf):
    return P.supply(spark, sf).profile()


@query(f"""WITH {HIERARCHY} SELECT 'source' AS kind, key FROM h WHERE parent IS NULL
UNION ALL SELECT 'sink', key FROM h WHERE key NOT IN (SELECT parent FROM h WHERE parent IS NOT NULL)""")
def sources_and_sinks(spark, sf):
    g = P.hierarchy(spark, sf)
    return g.sources().select(F.lit("source").alias("kind"), "key").unionByName(g.sinks().select(F.lit("sink").alias("kind"), "key"))


@query(f"WITH {TRADE} SELECT tail AS i, head AS j, 1 AS x FROM e")
def adjacency_matrix(spark, sf):
    return P.trade(spark, sf).adjacency_matrix()


@query(f"WITH {TRADE} SELECT tail AS i, head AS j, weight AS x FROM e WHERE tail <> head UNION ALL SELECT n_nationkey, n_nationkey, 0.0 FROM nation")
def weight_matrix(spark, sf):
    return P.trade(spark, sf).weight_matrix()


@query(f"""WITH {TRADE} SELECT a.n_nationkey::BIGINT AS i, string_agg(CASE WHEN e.key IS NULL THEN '0' ELSE '1' END, '' ORDER BY b.n_nationkey) AS line
FROM nation a CROSS JOIN nation b LEFT JOIN e ON e.tail = a.n_nationkey AND e.head = b.n_nationkey GROUP BY 1""")
def dense_matrix(spark, sf):
    g = P.trade(spark, sf)
    return g.dense(g.adjacency_matrix(), 0).select("i", F.array_join(F.transform("row", lambda x: x.cast("string")), "").alias("line"))


# -- neighbourhoods ------------------------------------------------------------------------


@query(f"WITH {SEQUENCE} SELECT tail AS v, head AS neighbour FROM e UNION SELECT head, tail FROM e")
def neighbours(spark, sf):
    return P.sequence(spark, sf).adjacency()


@query(f"""WITH {TRANSITIONS}, p AS (SELECT key, tail AS v FROM e UNION SELECT key, head FROM e)
SELECT DISTINCT a.key, b.key AS other FROM p a JOIN p b USING (v) WHERE a.key <> b.key""")
def edge_neighbours(spark, sf):
    return P.transitions(spark, sf).edge_adjacency()


@query(f"""WITH {TRADE}, x AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0), y AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1)
SELECT 'out' AS cut, key FROM e WHERE tail IN (FROM x) AND head NOT IN (FROM x)
UNION ALL SELECT 'in', key FROM e WHERE head IN (FROM x) AND tail NOT IN (FROM x)
UNION ALL SELECT 'coboundary', key FROM e WHERE (tail IN (FROM x)) <> (head IN (FROM x))
UNION ALL SELECT 'from_to', key FROM e WHERE tail IN (FROM x) AND head IN (FROM y)
UNION ALL SELECT 'across', key FROM e WHERE (tail IN (FROM x) AND head IN (FROM y)) OR (tail IN (FROM y) AND head IN (FROM x))""")
def cuts(spark, sf):
    g = P.trade(spark, sf)
    x, y = (g.vertices.filter(F.col("labels")["region"] == r).select("key") for r in ("0", "1"))
    named = {"out": g.arc_cut(x), "in": g.arc_cut(x, incoming=True), "coboundary": g.coboundary(x), "from_to": g.arcs_from_to(x, y), "across": g.edges_across(x, y)}
    return traversal._union([e.select(F.lit(name).alias("cut"), "key") for name, e in named.items()])


# -- edits -----------------------------------------------------------------------------------


@query("""SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey = 3 THEN 'new' ELSE n_name END AS value, CASE WHEN n_nationkey = 4 THEN 2.5::DOUBLE ELSE 0.0 END AS weight,
  CASE WHEN n_nationkey = 5 THEN NULL ELSE n_regionkey::VARCHAR END AS region, CASE WHEN n_nationkey = 6 THEN 'x' END AS mark FROM nation WHERE n_nationkey <> 7
UNION ALL SELECT 100, 'extra', 1.0, NULL, NULL""")
def vertex_edits(spark, sf):
    g = P.trade(spark, sf).set_vertex_value(3, "new").set_vertex_weight(4, 2.5).delete_vertex_label(5, "region").set_vertex_label(6, "mark", "x").remove_vertex(7).add_vertex(100, "extra", 1.0)
    return g.vertices.select("key", "value", "weight", F.col("labels")["region"].alias("region"), F.col("labels")["mark"].alias("mark"))


@query(f"""WITH {TRADE} SELECT key, head AS tail, tail AS head, CASE WHEN key = 1 THEN -1.0 ELSE weight END AS weight, CASE WHEN tail = 2 AND head = 3 THEN 'm' END AS mark
FROM e WHERE tail <> 7 AND head <> 7 AND NOT ((tail = 4 AND head = 5) OR (tail = 5 AND head = 4)) AND key <> 8009""")
def edge_edits(spark, sf):
    g = P.trade(spark, sf)
    g = g.with_(edges=g.edges.select("key", "tail", "head", "weight", "value", "labels")).remove_vertex(7).remove_edges(4, 5)
    g = g.with_(edges=g.edges.filter("key <> 8009"))
    g = g._edge_update(F.col("key") == 1, "weight", F.lit(-1.0)).set_edge_label(2, 3, "mark", "m") if not g.edges_between(2, 3).isEmpty() else g._edge_update(F.col("key") == 1, "weight", F.lit(-1.0))
    return g.reversed().edges.select("key", "tail", "head", "weight", F.col("labels")["mark"].alias("mark"))


@query("""SELECT c_custkey AS key, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'""")
def label_filter(spark, sf):
    from ..graph import vertex_frame
    from ..operators.lookup import has_labels

    v = vertex_frame(P.read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.create_map(F.lit("segment"), "c_mktsegment").alias("labels")))
    return v.filter(has_labels({"segment": "BUILDING"})).select("key", F.col("labels")["segment"].alias("segment"))


# -- algebra ---------------------------------------------------------------------------------

_HALVES = f"""WITH {TRADE}, a AS (SELECT * FROM e WHERE tail < 15 AND head < 15), b AS (SELECT * FROM e WHERE tail >= 10 AND head >= 10)"""


def _halves(spark, sf):
    g = P.trade(spark, sf)
    keys = lambda c: g.vertices.filter(c).select("key")
    return g.induced(keys("key < 15")), g.induced(keys("key >= 10"))


@query(_HALVES + """ SELECT 'union' AS op, key FROM (SELECT key FROM a UNION SELECT key FROM b)
UNION ALL SELECT 'intersection', key FROM (SELECT key FROM a INTERSECT SELECT key FROM b)
UNION ALL SELECT 'difference', key FROM a WHERE tail < 10 AND head < 10
UNION ALL SELECT 'sum', key FROM ((SELECT key FROM a UNION SELECT key FROM b) EXCEPT (SELECT key FROM a INTERSECT SELECT key FROM b))""")
def set_operations(spark, sf):
    a, b = _halves(spark, sf)
    named = {"union": a.union(b), "intersection": a.intersection(b), "difference": a.difference(b), "sum": a.edge_sum(b)}
    return traversal._union([g.edges.select(F.lit(name).alias("op"), "key") for name, g in named.items()])


@query(f"""WITH {TRANSITIONS} SELECT a.key || ':' || b.key || ':' || a.head AS key, a.key AS tail, b.key AS head FROM e a JOIN e b ON a.head = b.tail""")
def line_digraph(spark, sf):
    return P.transitions(spark, sf).line_graph().edges.select("key", "tail", "head")


@query("""WITH c AS (SELECT i AS t, (i + 1) % 4 AS h FROM range(4) r(i)), k AS (SELECT a.i AS t, b.i AS h FROM range(3) a(i), range(3) b(i) WHERE a.i < b.i)
SELECT '(' || k.t || ',' || v.i || ')' AS tail, '(' || k.h || ',' || v.i || ')' AS head FROM k, range(4) v(i)
UNION ALL SELECT '(' || v.i || ',' || c.t || ')', '(' || v.i || ',' || c.h || ')' FROM c, range(3) v(i)""")
def cartesian_product(spark, sf):
    return generators.complete_graph(spark, 3).product(generators.cycle(spark, 4)).edges.select("tail", "head")


@query(f"""WITH {TRADE}, m AS (SELECT key, CASE WHEN tail IN (1, 2) THEN 99 ELSE tail END AS tail, CASE WHEN head IN (1, 2) THEN 99 ELSE head END AS head FROM e WHERE NOT (tail IN (1, 2) AND head IN (1, 2)))
SELECT key, tail, head FROM m""")
def contraction(spark, sf):
    return P.trade(spark, sf).contract(1, 2, 99).edges.select("key", "tail", "head")


@query(f"""WITH {TRADE} SELECT key::VARCHAR AS key, tail, head FROM e WHERE tail <> 3 AND head <> 3
UNION ALL SELECT key || ':' || x, CASE WHEN tail = 3 THEN x ELSE tail END, CASE WHEN head = 3 THEN x ELSE head END FROM e, (VALUES (100), (101)) t(x) WHERE tail = 3 OR head = 3
UNION ALL SELECT 'new', 100, 101""")
def vertex_split(spark, sf):
    return P.trade(spark, sf).split(3, "new", 100, 101).edges.select("key", "tail", "head")


@query(f"WITH {TRADE} SELECT key, tail, head FROM e WHERE tail % 2 = 0 AND head % 2 = 0")
def induced_subgraph(spark, sf):
    g = P.trade(spark, sf)
    return g.induced(g.vertices.filter("key % 2 = 0").select("key")).edges.select("key", "tail", "head")


# -- traversal -------------------------------------------------------------------------------


@query("""WITH RECURSIVE b AS (SELECT v, (7 * v + 1) % 2000 AS w FROM range(2000) r(v)), p AS (SELECT v, w FROM b UNION SELECT w, v FROM b),
reach(v, c) AS (SELECT v, v FROM range(2000) r(v) UNION SELECT p.w, c FROM reach JOIN p ON p.v = reach.v WHERE c <= p.w)
SELECT v AS key, min(c) AS comp FROM reach GROUP BY v""")
def components_modular(spark, sf):
    return traversal.components(P.modular(spark))


@query(f"""WITH RECURSIVE {SEQUENCE}, a AS (SELECT DISTINCT tail, head FROM e), s AS (SELECT min(key) AS k FROM v),
r(key, depth) AS (SELECT k, 0 FROM s UNION SELECT a.head, r.depth + 1 FROM r JOIN a ON a.tail = r.key WHERE r.depth < 20)
SELECT key, min(depth) AS depth FROM r GROUP BY key""")
def breadth_first(spark, sf):
    g = P.sequence(spark, sf)
    start = g.vertices.agg(F.min("key")).first()[0]
    return traversal.breadth_first(g, start)


@query(f"WITH {HIERARCHY} SELECT key, CASE WHEN key LIKE 'r:%' THEN 0 WHEN key LIKE 'n:%' THEN 1 ELSE 2 END AS layer FROM h")
def topological_layers(spark, sf):
    return traversal.topological_layers(P.hierarchy(spark, sf))


@query(f"""WITH RECURSIVE {SEQUENCE}, a AS (SELECT DISTINCT tail, head FROM e),
r(s, t) AS (SELECT key, key FROM v UNION SELECT r.s, a.head FROM r JOIN a ON a.tail = r.t)
SELECT x.s AS key, min(x.t) AS comp FROM r x JOIN r y ON x.s = y.t AND x.t = y.s GROUP BY x.s""")
def strong_components(spark, sf):
    return traversal.strong_components(P.sequence(spark, sf))


@query("""SELECT * FROM (VALUES ('cycle6', true), ('cycle7', false), ('hypercube3', true), ('petersen', false), ('supply', true)) t(name, bipartite)""")
def bipartite_test(spark, sf):
    named = {"cycle6": generators.cycle(spark, 6), "cycle7": generators.cycle(spark, 7), "hypercube3": generators.hypercube(spark, 3), "petersen": generators.petersen(spark), "supply": P.supply(spark, sf)}
    return spark.createDataFrame([(n, traversal.is_bipartite(g)) for n, g in named.items()], "name string, bipartite boolean")


@query(f"WITH {HIERARCHY} SELECT 'bridge' AS kind, key FROM h WHERE parent IS NOT NULL UNION ALL SELECT 'cut', parent FROM h WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > 1 OR parent LIKE 'n:%'")
def bridges_and_cut_vertices(spark, sf):
    g = P.hierarchy(spark, sf).undirected()
    return traversal.bridges(g).select(F.lit("bridge").alias("kind"), "key").unionByName(traversal.cut_vertices(g).select(F.lit("cut").alias("kind"), "key"))


@query(f"""WITH {TRANSITIONS}, a AS (SELECT * FROM e WHERE tail <> head)
SELECT 1 AS length, (SELECT count(*) FROM e WHERE tail = head) AS cycles
UNION ALL SELECT 2, (SELECT count(*) FROM a x JOIN a y ON x.head = y.tail AND y.head = x.tail WHERE x.tail < x.head)
UNION ALL SELECT 3, (SELECT count(*) FROM a x JOIN a y ON x.head = y.tail JOIN a z ON y.head = z.tail AND z.head = x.tail WHERE x.tail < y.tail AND x.tail < z.tail AND y.tail <> z.tail)
UNION ALL SELECT 4, (SELECT count(*) FROM a x JOIN a y ON x.head = y.tail JOIN a z ON y.head = z.tail JOIN a u ON z.head = u.tail AND u.head = x.tail
  WHERE x.tail < least(y.tail, z.tail, u.tail) AND y.tail <> z.tail AND y.tail <> u.tail AND z.tail <> u.tail)""")
def cycle_counts(spark, sf):
    g = P.transitions(spark, sf)
    return spark.createDataFrame([(n, traversal.count_cycles(g, n)) for n in (1, 2, 3, 4)], "length int, cycles long")




# -- paths, trees, flow ------------------------------------------------------------------------

_ARCS = "SELECT tail AS s, head AS t, min(weight) AS w FROM e WHERE tail <> head GROUP BY ALL UNION ALL SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation"


@query(f"WITH {TRADE}, {squared(_ARCS, 5)} SELECT s AS source, t AS target, w AS weight FROM d5 WHERE s = 0")
def shortest_paths(spark, sf):
    return paths.shortest_paths(P.trade(spark, sf), 0).select(F.col("source").cast("long").alias("source"), "target", "weight")


@query(f"WITH {TRADE}, {squared(_ARCS, 5)} SELECT s AS source, t AS target, w AS weight FROM d5")
def all_shortest_paths(spark, sf):
    return paths.all_shortest_paths(P.trade(spark, sf)).select("source", "target", "weight")


def _bottleneck(times: int) -> str:
    """Smallest greatest edge (as weight, key) on a path, by squaring."""
    out = ["u AS (SELECT tail AS s, head AS t, min((weight, key)) AS m FROM (SELECT tail, head, weight, key FROM e UNION ALL SELECT head, tail, weight, key FROM e) WHERE tail <> head GROUP BY ALL)", "d0 AS (FROM u)"]
    for i in range(times):
        out.append(f"d{i + 1} AS (SELECT s, t, min(m) AS m FROM (FROM d{i} UNION ALL SELECT a.s, b.t, greatest(a.m, b.m) FROM d{i} a JOIN d{i} b ON a.t = b.s) GROUP BY s, t)")
    return ", ".join(out)


@query(f"WITH {TRADE}, {_bottleneck(5)} SELECT e.key, e.weight FROM e JOIN d5 ON d5.s = e.tail AND d5.t = e.head WHERE e.tail <> e.head AND d5.m = (e.weight, e.key)")
def spanning_forest(spark, sf):
    return spanning.spanning_forest(P.trade(spark, sf).undirected()).select("key", "weight")


@query(f"""WITH {TRANSITIONS}, n AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM (SELECT tail AS key FROM e UNION SELECT head FROM e)),
c AS (SELECT m FROM range(1 << (SELECT max(n) FROM n)::INT) r(m) WHERE m & 1 = 1 AND m & (1 << ((SELECT max(n) FROM n) - 1)::INT) = 0)
SELECT min(v) AS value FROM (SELECT m, coalesce(sum(CASE WHEN (m >> a.i::INT) & 1 = 1 AND (m >> b.i::INT) & 1 = 0 THEN weight END), 0) AS v FROM c, e JOIN n a ON a.key = e.tail JOIN n b ON b.key = e.head GROUP BY m)""")
def max_flow(spark, sf):
    g = P.transitions(spark, sf)
    low, high = g.vertices.agg(F.min("key"), F.max("key")).first()
    return spark.createDataFrame([(flow.max_flow(g, low, high),)], "value double")


@query("SELECT * FROM (VALUES ('edges', 3), ('vertices', 3), ('cycle', 2)) t(kind, paths)")
def disjoint_paths(spark, sf):
    g = generators.petersen(spark)
    rows = [("edges", flow.edge_disjoint_paths(g, 0, 7)), ("vertices", flow.vertex_disjoint_paths(g, 0, 7)), ("cycle", flow.edge_disjoint_paths(generators.cycle(spark, 9), 0, 4))]
    return spark.createDataFrame(rows, "kind string, paths int")


# -- matching, colouring, planarity --------------------------------------------------------------


@query(f"WITH {SUPPLY} SELECT count(DISTINCT tail) AS matched, count(DISTINCT tail) AS cover, 0 AS violations FROM e")
def bipartite_matching(spark, sf):
    g = P.supply(spark, sf)
    g = g.with_(edges=materialise(g.edges, "supply"))
    m, c = (materialise(df, "matching") for df in matching.matching_and_cover(g))
    bare = g.edges.join(c.toDF("tail"), "tail", "left_anti").join(c.toDF("head"), "head", "left_anti").count()
    twice = m.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count().filter("count > 1").count()
    return spark.createDataFrame([(m.count(), c.count(), bare + twice)], "matched long, cover long, violations long")


@query("SELECT * FROM (VALUES ('petersen', 5), ('cycle7', 3), ('K6', 3)) t(name, edges)")
def general_matching(spark, sf):
    named = {"petersen": generators.petersen(spark), "cycle7": generators.cycle(spark, 7), "K6": generators.complete_graph(spark, 6)}
    return spark.createDataFrame([(n, matching.general_matching(g).count()) for n, g in named.items()], "name string, edges int")


@query("""WITH m AS (SELECT n_regionkey AS a, o_orderpriority[1]::INT AS b, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT min(v.w + x.w + y.w + z.w + u.w)::DOUBLE AS least, max(v.w + x.w + y.w + z.w + u.w)::DOUBLE AS greatest FROM m v, m x, m y, m z, m u
WHERE v.a = 0 AND x.a = 1 AND y.a = 2 AND z.a = 3 AND u.a = 4 AND v.b NOT IN (x.b, y.b, z.b, u.b) AND x.b NOT IN (y.b, z.b, u.b) AND y.b NOT IN (z.b, u.b) AND z.b <> u.b""")
def weighted_matching(spark, sf):
    """Regions (0 to 4) with order priorities (11 to 15), weighed by the orders that a region's customers placed at a priority."""
    from ..operators.bipartite import Bipartite

    placed = P.read(spark, sf, "orders").select("o_custkey", (F.substring("o_orderpriority", 1, 1).cast("long") + 10).alias("head"))
    placed = placed.join(P.read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    placed = placed.join(P.read(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("tail")), F.col("c_nationkey") == F.col("n_nationkey"))
    e = placed.groupBy("tail", "head").agg(F.count("*").cast("double").alias("weight")).withColumn("key", F.col("tail") * 100 + F.col("head"))
    e = materialise(e, "edges")
    v = e.select(F.explode(F.array("tail", "head")).alias("key")).distinct().withColumn("part_a", F.col("key") < 5)
    g = Bipartite.of(materialise(v, "parts"), e)
    total = lambda m: matching.weighted_matching(g, m).agg(F.sum("weight")).first()[0]
    return spark.createDataFrame([(total(False), total(True))], "least double, greatest double")


@query("SELECT count(*) AS vertices, 0::BIGINT AS violations FROM nation")
def greedy_colouring(spark, sf):
    g = P.trade(spark, sf).undirected()
    c = colouring.greedy_vertex_colouring(g)
    bad = g.edges.filter("tail <> head").join(c.toDF("tail", "a"), "tail").join(c.toDF("head", "b"), "head").filter("a = b").count()
    return spark.createDataFrame([(c.count(), bad)], "vertices long, violations long")


@query("SELECT * FROM (VALUES ('petersen', 3, 10), ('petersen edges', 4, 15), ('cycle7', 3, 7)) t(name, colours, coloured)")
def exact_colouring(spark, sf):
    rows = [("petersen", 3, colouring.vertex_colouring(generators.petersen(spark), 3).count()), ("petersen edges", 4, colouring.edge_colouring(generators.petersen(spark), 4).count()), ("cycle7", 3, colouring.vertex_colouring(generators.cycle(spark, 7), 3).count())]
    return spark.createDataFrame(rows, "name string, colours int, coloured int")


@query("SELECT 0::BIGINT AS inside, 0::BIGINT AS outside")
def maximal_independent_set(spark, sf):
    """Edges inside the set, and vertices that could still enter."""
    g = P.sequence(spark, sf).undirected()
    s = colouring.maximal_independent_set(g)
    e = g.edges.filter("tail <> head")
    inside = e.join(s.toDF("tail"), "tail", "left_semi").join(s.toDF("head"), "head", "left_semi").count()
    touched = g.both_ways().filter("src <> dst").join(s.toDF("src"), "src", "left_semi").select(F.col("dst").alias("key"))
    outside = g.vertices.join(s, "key", "left_anti").join(touched, "key", "left_anti").count()
    return spark.createDataFrame([(inside, outside)], "inside long, outside long")


@query("SELECT * FROM (VALUES ('petersen', false), ('K4', true), ('K5', false), ('K2,3', true), ('K3,3', false), ('Q3', true), ('Q4', false)) t(name, planar)")
def planarity(spark, sf):
    named = {"petersen": generators.petersen(spark), "K4": generators.complete_graph(spark, 4), "K5": generators.complete_graph(spark, 5), "K2,3": generators.complete_bipartite(spark, 2, 3), "K3,3": generators.complete_bipartite(spark, 3, 3), "Q3": generators.hypercube(spark, 3), "Q4": generators.hypercube(spark, 4)}
    return spark.createDataFrame([(n, colouring.is_planar(g)) for n, g in named.items()], "name string, planar boolean")



# -- hypergraphs, forests ------------------------------------------------------------------------


@query("SELECT l_suppkey AS key, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY 1")
def hyper_degrees(spark, sf):
    return P.baskets(spark, sf).degrees()


@query("SELECT l_orderkey AS key FROM lineitem GROUP BY 1 HAVING bool_or(l_suppkey = 1) AND bool_or(l_suppkey = 2)")
def hyper_superset(spark, sf):
    return P.baskets(spark, sf).edges_with([1, 2]).select("key")


@query("WITH i AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT DISTINCT a.l_suppkey AS v, b.l_suppkey AS neighbour FROM i a JOIN i b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey")
def hyper_neighbours(spark, sf):
    return P.baskets(spark, sf).adjacency()


@query(f"""WITH {HIERARCHY}, p AS (SELECT 'c:' || c_custkey AS a, 's:' || ((c_custkey % (SELECT count(*) FROM supplier)) + 1) AS b FROM customer)
SELECT p.a, p.b, CASE WHEN x.parent = y.parent THEN x.parent WHEN nx.parent = ny.parent THEN nx.parent END AS ancestor
FROM p JOIN h x ON x.key = p.a LEFT JOIN h y ON y.key = p.b LEFT JOIN h nx ON nx.key = x.parent LEFT JOIN h ny ON ny.key = y.parent""")
def lowest_ancestors(spark, sf):
    n = P.read(spark, sf, "supplier").count()
    pairs = P.read(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("s:"), (F.col("c_custkey") % n + 1).cast("string")).alias("b"))
    return lowest_common_ancestors(P.hierarchy_parents(spark, sf).select("key", "parent"), pairs)


@query(f"WITH {HIERARCHY} SELECT h.key, h.weight + coalesce(p.weight, 0) + coalesce(q.weight, 0) AS total FROM h LEFT JOIN h p ON p.key = h.parent LEFT JOIN h q ON q.key = p.parent")
def path_sums(spark, sf):
    return ParentForest(P.hierarchy_parents(spark, sf)).path_sums()


@query(f"WITH {HIERARCHY} SELECT h.key, coalesce(q.key, p.key, h.key) AS root FROM h LEFT JOIN h p ON p.key = h.parent LEFT JOIN h q ON q.key = p.parent")
def tree_roots(spark, sf):
    return ParentForest(P.hierarchy_parents(spark, sf)).roots()


@query("""WITH RECURSIVE u AS (SELECT o_custkey AS a, o_custkey % 97 AS b FROM orders), p AS (SELECT a, b FROM u UNION SELECT b, a FROM u),
k AS (SELECT c_custkey AS v FROM customer UNION SELECT a FROM u UNION SELECT b FROM u), r(v, c) AS (SELECT v, v FROM k UNION SELECT p.b, c FROM r JOIN p ON p.a = r.v WHERE c < p.b OR c = p.b)
SELECT v AS key, min(c) AS comp FROM r GROUP BY v""")
def disjoint_sets(spark, sf):
    pairs = P.read(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") % 97).alias("b")).distinct()
    keys = P.read(spark, sf, "customer").select(F.col("c_custkey").alias("key")).union(pairs.select("a")).union(pairs.select("b")).distinct()
    return DisjointSets(keys, pairs).sets()


# -- ordered, arrays, spatial, prefix -----------------------------------------------------------


@query("SELECT c_custkey AS k, rank, next, prev FROM (SELECT c_custkey, row_number() OVER w AS rank, lead(c_custkey) OVER w AS next, lag(c_custkey) OVER w AS prev FROM customer WINDOW w AS (ORDER BY c_custkey))")
def ordered_cursor(spark, sf):
    return OrderedMap(P.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))).cursor().select("k", "rank", "next", "prev")


@query("SELECT s.x AS probe, min(c.x) AS k, coalesce(min(c.x) = s.x, false) AS exact FROM (SELECT DISTINCT s_acctbal AS x FROM supplier) s LEFT JOIN (SELECT DISTINCT c_acctbal AS x FROM customer) c ON c.x >= s.x GROUP BY s.x")
def ceiling_lookup(spark, sf):
    m = OrderedMap.build(P.read(spark, sf, "customer").select(F.col("c_acctbal").alias("k"), F.col("c_custkey").alias("v")), seq="v")
    return m.seek_all(P.read(spark, sf, "supplier").select(F.col("s_acctbal").alias("probe")).distinct()).select("probe", "k", "exact")


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000")
def ordered_range(spark, sf):
    return OrderedMap(P.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))).range(1000, 2000)


@query("""WITH a AS (SELECT p_partkey AS i, p_size::BIGINT AS x FROM part), c AS (SELECT l_partkey AS low, l_partkey + l_quantity::BIGINT AS high, l_linenumber::BIGINT AS amount FROM lineitem),
d AS (SELECT i, sum(d) AS d FROM (SELECT low AS i, amount AS d FROM c UNION ALL SELECT high + 1, -amount FROM c) GROUP BY i)
SELECT i, x + t AS x FROM (SELECT i, x, sum(coalesce(d, 0)) OVER (ORDER BY i) AS t FROM (SELECT coalesce(a.i, d.i) AS i, a.x, d.d FROM a FULL JOIN d USING (i))) WHERE x IS NOT NULL""")
def range_updates(spark, sf):
    a = IndexedArray(P.read(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("long").alias("x")))
    changes = P.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("low"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("high"), F.col("l_linenumber").cast("long").alias("amount"))
    return a.add_ranges(changes).cells


@query("""SELECT s_suppkey AS q, sum(p_size)::BIGINT AS total, min(p_size)::BIGINT AS least, max(p_size)::BIGINT AS most FROM supplier JOIN part ON p_partkey BETWEEN s_suppkey AND s_suppkey * 3 + 10 GROUP BY 1""")
def segment_queries(spark, sf):
    a = IndexedArray(P.read(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("long").alias("x")))
    return a.query_all(P.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("q"), F.col("s_suppkey").alias("low"), (F.col("s_suppkey") * 3 + 10).alias("high")), block=64)


@query("SELECT o_orderkey AS key, o_totalprice AS priority FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def priority_top(spark, sf):
    return PriorityTable(P.read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.lit(1).alias("value"), F.col("o_totalprice").alias("priority"))).top(25).select("key", "priority")


_BOXES = """WITH c AS (SELECT c_custkey AS id, c_nationkey AS x0, c_acctbal / 100 AS y0, c_nationkey + 1 AS x1, c_acctbal / 100 + 2 AS y1 FROM customer),
p AS (SELECT s_suppkey AS id, s_nationkey AS x0, s_acctbal / 100 AS y0, s_nationkey + 1 AS x1, s_acctbal / 100 + 2 AS y1 FROM supplier)"""


def _boxes(spark, sf, table, p, key):
    t = P.read(spark, sf, table)
    x, y = F.col(f"{p}_nationkey").cast("double"), F.col(f"{p}_acctbal") / 100
    return t.select(F.col(key).alias("id"), x.alias("minx"), y.alias("miny"), (x + 1).alias("maxx"), (y + 2).alias("maxy"))


@query(_BOXES + " SELECT c.id, p.id AS other FROM c JOIN p ON c.x0 <= p.x1 AND p.x0 <= c.x1 AND c.y0 <= p.y1 AND p.y0 <= c.y1")
def box_join(spark, sf):
    return BoxTable(_boxes(spark, sf, "customer", "c", "c_custkey")).overlaps(_boxes(spark, sf, "supplier", "s", "s_suppkey"), 4.0)


@query(_BOXES + " SELECT id FROM c WHERE x0 <= 8 AND 5 <= x1 AND y0 <= 40 AND 10 <= y1")
def box_window(spark, sf):
    return BoxTable(_boxes(spark, sf, "customer", "c", "c_custkey")).search((5, 10, 8, 40)).select("id")


@query(_BOXES + """, d AS (SELECT p.id AS probe, c.id, sqrt(pow(c.x0 + c.x1 - p.x0 - p.x1, 2) + pow(c.y0 + c.y1 - p.y0 - p.y1, 2)) / 2 AS distance FROM c, p WHERE p.id % 50 = 0)
SELECT probe, id, round(distance, 6) AS distance, place FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, id) AS place FROM d) WHERE place <= 5""")
def nearest_boxes(spark, sf):
    probes = _boxes(spark, sf, "supplier", "s", "s_suppkey").filter("id % 50 = 0").withColumnRenamed("id", "probe")
    return BoxTable(_boxes(spark, sf, "customer", "c", "c_custkey")).nearest_each(probes, 5).withColumn("distance", F.round("distance", 6))


@query("SELECT p_name AS k, min(p_partkey) AS v FROM part WHERE starts_with(p_name, (SELECT min(left(p_name, 3)) FROM part)) GROUP BY 1")
def prefix_search(spark, sf):
    part = P.read(spark, sf, "part")
    start = part.agg(F.min(F.substring("p_name", 1, 3))).first()[0]
    return PrefixMap(part.groupBy(F.col("p_name").alias("k")).agg(F.min("p_partkey").alias("v"))).prefix(start)


# -- sources, text, jobs, streams ------------------------------------------------------------------


@query(f"WITH {TRADE} SELECT (SELECT count(*) FROM nation) AS vertices, count(*) AS edges, sum(weight) AS weight FROM e")
def json_round_trip(spark, sf):
    g = P.trade(spark, sf)
    back = documents.from_document(spark, documents.to_json(g).first().value)
    return back.edges.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")).withColumn("vertices", F.lit(back.order()).cast("long"))


@query(f"WITH {TRADE} SELECT tail, tail || ' -> {{' || string_agg(head::VARCHAR, ',' ORDER BY head) || '}};' AS line FROM e GROUP BY tail")
def tikz_lines(spark, sf):
    return drawing.edge_lines(P.trade(spark, sf), "->")


@query("SELECT n_name AS key, 'success' AS status FROM nation UNION ALL SELECT 'all', 'success' FROM region WHERE r_regionkey = 0")
def job_table(spark, sf):
    """A job for each nation, in chains of their regions that end in one job."""
    jobs = JobGraph("nations", spark)
    nations = P.read(spark, sf, "nation").select("n_regionkey", "n_name").orderBy("n_regionkey", "n_name").collect()
    for r in nations:
        jobs.add_job(r.n_name, lambda r=r: len(r.n_name))
    jobs.add_job("all", lambda: P.read(spark, sf, "nation").count())
    for r, after in zip(nations, [*nations[1:], None]):
        jobs.add_dependency(r.n_name, after.n_name if after and after.n_regionkey == r.n_regionkey else "all")
    jobs.start()
    jobs.wait(120)
    return jobs.table().select("key", "status")


@query("SELECT (SELECT count(*) FROM customer) * 3 - (SELECT count(*) FROM supplier) AS result")
def workflow_result(spark, sf):
    """Three times the customers less the suppliers, by four tasks."""
    wf = Workflow("counts", spark=spark)
    count = lambda i: {"n": P.read(spark, sf, i["table"]).count()}
    wf.add_task(Task("buyers", count), Task("sellers", count), Task("triple", lambda i: {"n": 3 * i["n"]}), Task("less", lambda i: {"n": i["a"] - i["b"]}))
    wf.set_inputs({"buyers": [Parameter("table", "customer")], "sellers": [Parameter("table", "supplier")], "triple": [Parameter("n", ref="buyers.output.n")], "less": [Parameter("a", ref="triple.output.n"), Parameter("b", ref="counts.sellers.output.n")]})
    for first, then in (("buyers", "triple"), ("triple", "less"), ("sellers", "less")):
        wf.add_dependency(first, then)
    wf.start()
    wf.wait(60)
    return spark.createDataFrame([(wf.output("less")["n"],)], "result int")


@query(f"""WITH RECURSIVE {SEQUENCE}, p AS (SELECT tail AS a, head AS b FROM e UNION SELECT head, tail FROM e),
r(v, c) AS (SELECT key, key FROM v UNION SELECT p.b, c FROM r JOIN p ON p.a = r.v WHERE c < p.b OR c = p.b)
SELECT v AS key, min(c) AS comp FROM r GROUP BY v""")
def online_components(spark, sf):
    """The event sequence's edges, in three batches by event."""
    g = P.sequence(spark, sf)
    online = OnlineConnectivity(spark, with_bridges=False)
    for i in range(3):
        online.apply(g.edges.filter(F.pmod("key", F.lit(3)) == i))
    return online.components()


from . import inventory  # noqa: E402, F401  (registers further queries)
