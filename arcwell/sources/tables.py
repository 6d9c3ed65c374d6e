"""The property graph and logs over the provided parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwell.plans.query import Edges, Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def commerce(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, orders, parts, suppliers, nations and regions with their edges."""
    t = {n: read(spark, sf_dir, n) for n in ("customer", "orders", "part", "supplier", "nation", "region", "lineitem")}
    c = F.col
    nodes = {
        "Customer": t["customer"].select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_acctbal").alias("balance"), c("c_mktsegment").alias("segment")),
        "Order": t["orders"].select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"), c("o_totalprice").alias("total"), c("o_orderdate").alias("placed_at"), c("o_orderpriority").alias("priority")),
        "Part": t["part"].select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_brand").alias("brand"), c("p_type").alias("type"), c("p_size").alias("size"), c("p_retailprice").alias("price")),
        "Supplier": t["supplier"].select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("balance")),
        "Nation": t["nation"].select(c("n_nationkey").cast("long").alias("id"), c("n_name").alias("name")),
        "Region": t["region"].select(c("r_regionkey").cast("long").alias("id"), c("r_name").alias("name")),
    }
    edges = {
        "Placed": Edges(t["orders"].select(c("o_orderkey").alias("id"), c("o_custkey").alias("from_id"), c("o_orderkey").alias("to_id"), c("o_totalprice").alias("total"), c("o_orderpriority").alias("priority")), "Customer", "Order"),
        # (l_orderkey, l_linenumber) repeats, so these edges have no key of their own.
        "Contains": Edges(t["lineitem"].select(c("l_linenumber").cast("long").alias("id"), c("l_orderkey").alias("from_id"), c("l_partkey").alias("to_id"), c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"), c("l_suppkey").alias("supplier"), c("l_returnflag").alias("flag")), "Order", "Part"),
        "CustomerIn": Edges(t["customer"].select(c("c_custkey").alias("id"), c("c_custkey").alias("from_id"), c("c_nationkey").cast("long").alias("to_id")), "Customer", "Nation"),
        "SupplierIn": Edges(t["supplier"].select(c("s_suppkey").alias("id"), c("s_suppkey").alias("from_id"), c("s_nationkey").cast("long").alias("to_id")), "Supplier", "Nation"),
        "InRegion": Edges(t["nation"].select(c("n_nationkey").cast("long").alias("id"), c("n_nationkey").cast("long").alias("from_id"), c("n_regionkey").cast("long").alias("to_id")), "Nation", "Region"),
    }
    trade_rows = trade(spark, sf_dir)
    edges["Trades"] = Edges(trade_rows, "Nation", "Nation")
    return Graph(nodes, edges)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nations: from each customer nation to every nation that supplies it.

    (id, from_id, to_id, revenue, cost); revenue in whole cents; cost falls with revenue.
    Of as many rows as there are pairs of nations, whatever the tables hold.
    """
    l, o, c, s = (read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    # Sum by order and supplier first: the large table meets the small ones aggregated.
    sums = l.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    rows = sums.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.filter("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("from_id"), F.col("s_nationkey").cast("long").alias("to_id")).agg(F.sum("cents").alias("revenue"))
    rank = F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("revenue"), "to_id"))
    top = F.max("revenue").over(Window.partitionBy("from_id"))
    pairs = pairs.withColumn("rank", rank).withColumn("top", top)
    return pairs.select((F.col("from_id") * 1000 + F.col("to_id")).alias("id"), "from_id", "to_id", "revenue", (F.col("rank") * 100 + F.floor(F.col("top") * 10 / F.col("revenue"))).cast("long").alias("cost"))


TRADE_SQL = """
trade_sums AS (
  SELECT c_nationkey::BIGINT AS from_id, s_nationkey::BIGINT AS to_id, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
), trade_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY revenue DESC, to_id) AS rank, max(revenue) OVER (PARTITION BY from_id) AS top FROM trade_sums
), trade AS (
  SELECT from_id * 1000 + to_id AS id, from_id, to_id, revenue, CAST(rank * 100 + floor(top * 10.0 / revenue) AS BIGINT) AS cost FROM trade_ranked
)"""


def supplied_by(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (from_id, to_id, weight) from parts (negative ids, as both count from 0) to suppliers."""
    edges = read(spark, sf_dir, "lineitem").groupBy((-F.col("l_partkey") - 1).alias("from_id"), F.col("l_suppkey").alias("to_id")).agg(F.count(F.lit(1)).alias("weight"))
    nodes = read(spark, sf_dir, "part").select((-F.col("p_partkey") - 1).alias("id")).union(read(spark, sf_dir, "supplier").select("s_suppkey"))
    return nodes, edges


SUPPLIED_SQL = """
e AS (SELECT -l_partkey - 1 AS from_id, l_suppkey AS to_id, count(*) AS weight FROM lineitem GROUP BY 1, 2),
n AS (SELECT -p_partkey - 1 AS id FROM part UNION ALL SELECT s_suppkey FROM supplier)"""


def located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (from_id, to_id): customers (4 n), suppliers (4 n + 1) in nations (4 n + 2), these in regions (4 n + 3)."""
    c, s, n = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    ends = [(c, "c_custkey", 0, "c_nationkey", 2), (s, "s_suppkey", 1, "s_nationkey", 2), (n, "n_nationkey", 2, "n_regionkey", 3)]
    edges = [t.select((F.col(a).cast("long") * 4 + x).alias("from_id"), (F.col(b).cast("long") * 4 + y).alias("to_id")) for t, a, x, b, y in ends]
    edges = edges[0].union(edges[1]).union(edges[2])
    return edges.select(F.col("from_id").alias("id")).union(read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long") * 4 + 3)), edges


LOCATED_SQL = """
located AS (
  SELECT c_custkey::BIGINT * 4 AS from_id, c_nationkey::BIGINT * 4 + 2 AS to_id FROM customer
  UNION ALL SELECT s_suppkey::BIGINT * 4 + 1, s_nationkey::BIGINT * 4 + 2 FROM supplier
  UNION ALL SELECT n_nationkey::BIGINT * 4 + 2, n_regionkey::BIGINT * 4 + 3 FROM nation)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as history envelopes of users; valid until the user's next event.

    signup creates (1), view and click update (2), error deletes (3), purchase connects (4).
    """
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 4).otherwise(2)
    until = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.lit("User").alias("entity_type"), F.col("user_id").alias("entity_id"), kind.alias("operation_kind"), F.col("ts").alias("captured_at"), F.col("ts").alias("valid_from"), until.alias("valid_to"),
        F.lit(False).alias("is_edge"), F.lit(None).cast("long").alias("from_id"), F.lit(None).cast("long").alias("to_id"), "event_id", "event_type", "value",
    )


HISTORY_SQL = """
h AS (
  SELECT 'User' AS entity_type, user_id AS entity_id,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 2 END AS operation_kind,
         ts AS captured_at, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, event_id, event_type, value
  FROM events
)"""
