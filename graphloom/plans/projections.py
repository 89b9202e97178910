"""Graphs over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..graph import PropertyGraph
from ..operators.bipartite import Bipartite
from ..operators.hyper import HyperGraph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nation -> nation: supplier's to customer's nation, weight = quantity sold; exact revenue as a column."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    sold = line.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sold = sold.join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    money = F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    e = sold.groupBy(F.col("s_nationkey").cast("long").alias("tail"), F.col("c_nationkey").cast("long").alias("head")).agg(F.sum("l_quantity").alias("weight"), F.sum(money).cast("double").alias("revenue"))
    v = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("labels"))
    return PropertyGraph.of(v, e.withColumn("key", F.col("tail") * 1000 + F.col("head")), True, "trade", validate=False)


def supply(spark: SparkSession, sf_dir: str) -> Bipartite:
    """Supplier - part, weight = quantity; suppliers are part A, keyed s * 10 + 1, parts p * 10."""
    tail, head = (F.col("l_suppkey") * 10 + 1).alias("tail"), (F.col("l_partkey") * 10).alias("head")
    line = read(spark, sf_dir, "lineitem")
    e = line.groupBy(tail, head).agg(F.sum("l_quantity").alias("weight"))
    v = line.select(tail.alias("key")).distinct().union(line.select(head.alias("key")).distinct()).withColumn("part_a", F.col("key") % 10 == 1)
    return Bipartite.of(v, e, False, "supply", validate=False)


def sequence(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """User -> user of the next event; parallel edges stay, keyed by event. The order is global, so
    the successor comes from ranks over range partitions."""
    from ..functions.ranking import with_rank

    ranked = with_rank(read(spark, sf_dir, "events").select("ts", "event_id", "user_id"), "ts", "event_id")
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.col("user_id").alias("head"))
    e = ranked.join(after, "rank").select(F.col("event_id").alias("key"), F.col("user_id").alias("tail"), "head")
    return PropertyGraph.from_edges(e, True, "sequence")


def transitions(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Event type -> next type of the same user, weight = how often."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = read(spark, sf_dir, "events").select(F.col("event_type").alias("tail"), F.lead("event_type").over(w).alias("head")).filter("head is not null")
    e = pairs.groupBy("tail", "head").agg(F.count("*").cast("double").alias("weight"))
    return PropertyGraph.from_edges(e.withColumn("key", F.concat_ws(">", "tail", "head")), True, "transitions")


def baskets(spark: SparkSession, sf_dir: str) -> HyperGraph:
    """Orders as hyperedges over suppliers."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return HyperGraph.from_incidence(rows, "l_orderkey", "l_suppkey", "baskets")


def modular(spark: SparkSession, n: int = 2000) -> PropertyGraph:
    """v - 7v + 1 mod n."""
    e = spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("tail"), ((F.col("id") * 7 + 1) % n).alias("head"))
    return PropertyGraph.of(spark.range(n).toDF("key"), e, False, "modular", validate=False)


def hierarchy(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Region -> nation -> customer and supplier, with prefixed keys; weight = acctbal in cents."""
    nation, customer, supplier = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    cents = lambda c: F.round(F.col(c) * 100).cast("double")
    rows = read(spark, sf_dir, "region").select(key("r:", "r_regionkey").alias("key"), none.alias("parent"), F.lit(0.0).alias("weight"))
    rows = rows.unionByName(nation.select(key("n:", "n_nationkey").alias("key"), key("r:", "n_regionkey").alias("parent"), F.lit(1.0).alias("weight")))
    rows = rows.unionByName(customer.select(key("c:", "c_custkey").alias("key"), key("n:", "c_nationkey").alias("parent"), cents("c_acctbal").alias("weight")))
    rows = rows.unionByName(supplier.select(key("s:", "s_suppkey").alias("key"), key("n:", "s_nationkey").alias("parent"), cents("s_acctbal").alias("weight")))
    e = rows.filter("parent is not null").select("key", F.col("parent").alias("tail"), F.col("key").alias("head"))
    return PropertyGraph.of(rows.select("key", "weight"), e, True, "hierarchy", validate=False)


def hierarchy_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, parent, value, weight)`` of the hierarchy."""
    g = hierarchy(spark, sf_dir)
    up = g.edges.select(F.col("head").alias("key"), F.col("tail").alias("parent"))
    return g.vertices.select("key", "value", "weight").join(up, "key", "left").select("key", "parent", "value", "weight")
