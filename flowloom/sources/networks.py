"""Networks derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, build_graph, materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation -> customer nation; capacity is the quantity traded.

    Each row meets its supplier's nation and each order its customer's before
    the two are joined, so lineitem is dealt out by one key alone.
    """
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(supp, "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(cust, "o_custkey")
    flows = line.join(orders, "l_orderkey").withColumnRenamed("l_quantity", "q")
    pairs = flows.groupBy("src", "dst").agg(F.sum("q").alias("capacity"))
    return pairs.select(
        "src", "dst", "capacity", (1 + (F.col("src") * 7 + F.col("dst") * 11) % 13).cast("long").alias("cost"), (F.col("src") * 1000 + F.col("dst")).cast("long").alias("ext_edge_id")
    )


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    return build_graph(trade_edges(spark, sf_dir), 25)


SUPPLIER_AT, BRAND_AT = 100, 50


def two_hop_edges(spark: SparkSession, sf_dir: str, tiers: int = 1) -> DataFrame:
    """nation -> supplier -> brand, parallel edges for each return flag.

    Nation nodes are 0..24, brand nodes BRAND_AT + rank, supplier nodes
    SUPPLIER_AT + key.  With more tiers a supplier's first hop costs
    1 + s_suppkey mod tiers.
    """
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.lit(True).alias("known"))
    flag = F.ascii("l_returnflag")
    brand = (F.regexp_extract("p_brand", "[0-9]+$", 0).cast("int") % 50) + BRAND_AT
    mid = (F.col("l_suppkey") + SUPPLIER_AT).cast("int")
    # one scan gives both hops: the first is a rollup of the second
    sold = materialise(line.join(part, "l_partkey", "left").groupBy("l_suppkey", brand.alias("dst"), "l_returnflag", "known").agg(F.sum("l_quantity").alias("q")))
    out = sold.where("known").groupBy(mid.alias("src"), "dst", flag.alias("flag")).agg(F.sum("q").alias("capacity")).withColumn("cost", F.lit(1).cast("long"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    into = (
        sold.groupBy("l_suppkey", "l_returnflag").agg(F.sum("q").alias("q"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("s_nationkey").cast("int").alias("src"), mid.alias("dst"), flag.alias("flag"), (F.floor(F.col("q") / 20) + 1).cast("double").alias("capacity"), (1 + F.col("s_suppkey") % tiers).cast("long").alias("cost"))
    )
    both = into.unionByName(out)
    return both.select("src", "dst", "capacity", "cost", (F.col("src").cast("long") * 100_000_000_000 + F.col("dst").cast("long") * 1000 + F.col("flag")).alias("ext_edge_id"))


def two_hop(spark: SparkSession, sf_dir: str, tiers: int = 1) -> Graph:
    edges = two_hop_edges(spark, sf_dir, tiers)
    top = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] or 0
    return build_graph(edges, int(top) + SUPPLIER_AT + 1)


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between consecutive event types of a user; capacity counts them."""
    from pyspark.sql import Window as W

    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return ev.withColumn("next_type", nxt).where("next_type IS NOT NULL").groupBy("event_type", "next_type").agg(F.count("*").alias("transitions"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query rows (query_id, src, dst): every nation to every brand."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("src"))
    brands = table(spark, sf_dir, "part").select(((F.regexp_extract("p_brand", "[0-9]+$", 0).cast("int") % 50) + BRAND_AT).alias("dst")).distinct()
    keyed = nations.withColumn("dst", F.explode(F.array([F.lit(i) for i in range(BRAND_AT, BRAND_AT + 50)])))
    return keyed.join(brands, "dst", "left_semi").select((F.col("src") * 100 + F.col("dst")).cast("long").alias("query_id"), "src", "dst")
