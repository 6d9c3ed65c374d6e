"""All registered queries over the property graph, with their SQL.

Doubles are rounded to six places on both sides: sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.functions import predicates as P
from arcwell.operators import centrality, communities, deltas, documents, flow, history, planning, pregel, routes, structure, twin
from arcwell.plans.include import Include, load, load_relationships, related_rows
from arcwell.plans.model import EdgeType, GraphModel, NodeType, Relationship
from arcwell.plans.query import NO_IMMEDIATE_CYCLE, NO_REVISIT, Path
from arcwell.sources.tables import HISTORY_SQL, LOCATED_SQL, SUPPLIED_SQL, TRADE_SQL, commerce, located, read, supplied_by, trade
from arcwell.sources.tables import history as history_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# Scans, filters, predicates


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def node_scan(spark, d):
    return commerce(spark, d).set("Customer").to_df()


@query("SELECT o_orderkey AS id, o_custkey AS from_id, o_orderkey AS to_id, o_totalprice AS total, o_orderpriority AS priority FROM orders")
def edge_scan(spark, d):
    return commerce(spark, d).edge_set("Placed").to_df()


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F' OR o_totalprice < 1500")
def where_comparison(spark, d):
    return commerce(spark, d).set("Order").where(lambda o: (o.total >= 200000) & (o.status != "F") | (o.total < 1500)).select(id="id", total="total").to_df()


@query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN value > 50 THEN value END AS v, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END AS b FROM events) WHERE (v IS NULL OR v > 90) AND NOT coalesce(b, true)")
def where_null_logic(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("v"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0).alias("b"))
    return e.filter((P.equals(F.col("v"), None) | (F.col("v") > 90)) & P.is_false(F.col("b"))).select("event_id", "v")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def where_in_list(spark, d):
    return commerce(spark, d).set("Customer").where(lambda c: P.one_of(c.segment, ["BUILDING", "MACHINERY", "BUILDING"])).select(id="id").to_df()


@query("SELECT c_custkey AS id FROM customer WHERE false")
def where_in_empty(spark, d):
    return commerce(spark, d).set("Customer").where(lambda c: P.one_of(c.segment, [])).select(id="id").to_df()


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS t FROM events) WHERE t IN ('click') OR t IS NULL")
def where_in_null(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("t"))
    return e.filter(P.one_of(F.col("t"), ["click", None])).select("event_id")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE starts_with(p_brand, 'Brand#1') AND (p_type LIKE '%E%' OR p_name LIKE '%1')")
def string_starts_ends_contains(spark, d):
    return commerce(spark, d).set("Part").where(lambda p: P.starts_with(p.brand, "Brand#1") & (P.contains(p.type, "E") | P.ends_with(p.name, "1"))).select(id="id", name="name").to_df()


@query("SELECT event_id, coalesce(t, '') || '/' || event_id::VARCHAR AS tag FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '' ELSE event_type END AS t FROM events) WHERE t IS NULL OR trim(t, ' ') = ''")
def string_null_or_blank(spark, d):
    n = F.col("event_id") % 4
    e = read(spark, d, "events").select("event_id", F.when(n == 0, F.lit(None)).when(n == 1, "  ").when(n == 2, "").otherwise(F.col("event_type")).alias("t"))
    return e.filter(P.is_null_or_blank(F.col("t"))).select("event_id", P.text_concat(F.col("t"), F.lit("/"), F.col("event_id")).alias("tag"))


@query("SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 7")
def where_key(spark, d):
    return commerce(spark, d).set("Customer").where_key("id", "7").select(id="id").to_df()


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def where_ids_semi_join(spark, d):
    wanted = read(spark, d, "lineitem").filter("l_quantity >= 49").select("l_partkey")
    return commerce(spark, d).set("Part").where_ids(wanted).select(id="id", name="name").to_df()


# Projection, traversal, paths


@query("SELECT o_orderkey AS id, o_totalprice AS total, o_orderpriority AS priority FROM orders WHERE o_totalprice > 150000")
def select_object(spark, d):
    q = commerce(spark, d).set("Order").select(id="id", total="total", priority=lambda o: o.priority)
    return q.where(lambda r: r.total > 150000).to_df()


@query("SELECT c_custkey AS customer, o_orderkey AS order_id, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def select_with_edge(spark, d):
    q = commerce(spark, d).set("Customer").where(lambda c: c.segment == "BUILDING").outgoing("Placed")
    return q.select_with_edge(customer=lambda n, e: e.from_id, order_id=lambda n, e: n.id, total=lambda n, e: e.total).to_df()


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0")
def outgoing_1hop(spark, d):
    return commerce(spark, d).set("Customer").where(lambda c: c.balance < 0).outgoing("Placed").select(id="id", status="status").to_df()


@query("SELECT c_custkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def incoming_1hop(spark, d):
    return commerce(spark, d).set("Order").where(lambda o: o.priority == "1-URGENT").incoming("Placed").select(id="id", name="name").to_df()


@query("SELECT o_orderkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' AND o_totalprice > 250000")
def outgoing_edge_predicate(spark, d):
    return commerce(spark, d).set("Customer").where(lambda c: c.segment == "AUTOMOBILE").outgoing("Placed", lambda e: e.total > 250000).select(id="id").to_df()


@query("SELECT l_orderkey AS order_id, p_partkey AS part, p_name AS name, l_quantity AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000 AND l_quantity > 40")
def two_hop_path(spark, d):
    q = commerce(spark, d).set("Customer").where(lambda c: c.segment == "BUILDING").outgoing("Placed", lambda e: e.total > 200000).then_outgoing("Contains", lambda e: e.quantity > 40)
    return q.select_with_edge(order_id=lambda n, e: e.from_id, part=lambda n, e: n.id, name=lambda n, e: n.name, quantity=lambda n, e: e.quantity).to_df()


@query(f"WITH {TRADE_SQL} SELECT n.n_nationkey::BIGINT AS id, n.n_name AS name FROM trade a JOIN trade b ON a.to_id = b.from_id JOIN trade c ON b.to_id = c.from_id JOIN nation n ON n.n_nationkey = c.to_id")
def repeat_outgoing_k(spark, d):
    return commerce(spark, d).set("Nation").path(Path("Nation").repeat_outgoing("Trades", 3)).select(id="id", name="name").to_df()


@query(f"WITH {TRADE_SQL} SELECT DISTINCT c_custkey AS id FROM trade JOIN customer ON c_nationkey = from_id WHERE to_id < 5")
def path_distinct(spark, d):
    path = Path("Nation").incoming("Trades").incoming("CustomerIn").distinct_results()
    return commerce(spark, d).set("Nation").where(lambda n: n.id < 5).path(path).select(id="id").to_df()


@query(f"WITH {TRADE_SQL} SELECT a.from_id AS start, c.to_id AS id FROM trade a JOIN trade b ON a.to_id = b.from_id JOIN trade c ON b.to_id = c.from_id WHERE c.to_id NOT IN (a.from_id, a.to_id, b.to_id)")
def path_no_revisit(spark, d):
    q = commerce(spark, d).set("Nation").path(Path("Nation").repeat_outgoing("Trades", 3).guarded(NO_REVISIT))
    return q.df.select(F.split(F.element_at("__passed", 1), ":")[1].cast("long").alias("start"), F.col("node.id").alias("id"))


@query(f"WITH {TRADE_SQL} SELECT b.to_id AS id FROM trade a JOIN trade b ON a.to_id = b.from_id WHERE b.to_id <> a.from_id")
def path_no_immediate_cycle(spark, d):
    return commerce(spark, d).set("Nation").path(Path("Nation").repeat_outgoing("Trades", 2).guarded(NO_IMMEDIATE_CYCLE)).select(id="id").to_df()


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def from_node(spark, d):
    return commerce(spark, d).edge_set("Placed").where(lambda e: e.total > 300000).from_node().select(id="id", segment="segment").to_df()


@query("SELECT p_partkey AS id, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50 AND l_returnflag = 'R'")
def to_node(spark, d):
    return commerce(spark, d).edge_set("Contains").where(lambda e: (e.quantity == 50) & (e.flag == "R")).to_node().select(id="id", brand="brand").to_df()


# Order, paging, distinct, terminals


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def order_skip_take(spark, d):
    return commerce(spark, d).set("Customer").order_by("balance", True).then_by("id").skip(10).take(20).select(id="id", balance="balance").to_df()


@query("SELECT c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 100")
def skip_by_key(spark, d):
    return commerce(spark, d).set("Customer").select(id="id").skip(100).take(5).to_df()


@query("SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
def distinct_projection(spark, d):
    return commerce(spark, d).set("Part").select(brand="brand", size="size").distinct().to_df()


@query("SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS n, EXISTS(SELECT 1 FROM customer WHERE c_acctbal > 9999999) AS some, NOT EXISTS(SELECT 1 FROM customer WHERE NOT c_custkey > 0) AS every, EXISTS(SELECT 1 FROM customer WHERE c_custkey = 3) AS has")
def count_any_all(spark, d):
    q = commerce(spark, d).set("Customer")
    row = (q.count(lambda c: c.balance > 9000), q.any(lambda c: c.balance > 9999999), q.all(lambda c: c.id > 0), q.contains_id(3))
    return spark.createDataFrame([row], "n long, some boolean, every boolean, has boolean")


@query("SELECT round(coalesce(sum(o_totalprice), 0), 2) AS sum, round(avg(o_totalprice), 6) AS average, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders WHERE o_orderstatus = 'O'")
def sum_avg_min_max(spark, d):
    a = commerce(spark, d).set("Order").where(lambda o: o.status == "O").aggregate("total")
    return a.select(F.round("sum", 2).alias("sum"), r6("average").alias("average"), "min", "max")


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def last_by_key(spark, d):
    return commerce(spark, d).set("Order").select(id="id", total="total").last_df()


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1 OFFSET 41")
def element_at(spark, d):
    return commerce(spark, d).set("Order").order_by("total", True).then_by("id").skip(41).take(1).select(id="id").to_df()


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def first_single(spark, d):
    q = commerce(spark, d).set("Order")
    first = q.order_by("total").then_by("id").select(id="id").first()
    same = q.where_id(first["id"]).select(id="id").single()
    return spark.createDataFrame([(same["id"],)], "id long")


# Includes


@query("SELECT c_custkey AS id, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def include_collection(spark, d):
    g = commerce(spark, d)
    out = load(g, g.nodes["Customer"], "Customer", (Include("orders", "Placed"),))
    return out.select("id", F.array_join(F.transform("orders", lambda o: o["id"].cast("string")), ",").alias("orders"))


@query("WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW') SELECT c_custkey AS id, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY r), '') AS orders FROM customer LEFT JOIN x ON o_custkey = c_custkey AND r BETWEEN 2 AND 4 GROUP BY 1")
def include_filtered_top_n(spark, d):
    g = commerce(spark, d)
    inc = Include("orders", "Placed", where=lambda o: o.status == "O", where_edge=lambda e: e.priority != "5-LOW", order=(("total", True),), skip=1, take=3)
    return load(g, g.nodes["Customer"], "Customer", (inc,)).select("id", F.array_join(F.transform("orders", lambda o: o["id"].cast("string")), ",").alias("orders"))


@query("SELECT n_nationkey::BIGINT AS id, r_name AS region, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers, (SELECT count(*) FROM customer c JOIN orders o ON o_custkey = c_custkey WHERE c.c_nationkey = n.n_nationkey AND o_totalprice > 250000) AS orders FROM nation n JOIN region ON r_regionkey = n_regionkey")
def then_include(spark, d):
    g = commerce(spark, d)
    orders = Include("orders", "Placed", where=lambda o: o.total > 250000)
    out = load(g, g.nodes["Nation"], "Nation", (Include("customers", "CustomerIn", outgoing=False, then=(orders,)), Include("region", "InRegion", reference=True)))
    n = F.aggregate("customers", F.lit(0).cast("long"), lambda a, c: a + F.size(c["orders"]))
    return out.select("id", F.col("region.name").alias("region"), F.size("customers").cast("long").alias("customers"), n.alias("orders"))


@query("WITH x AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS r FROM lineitem) SELECT o_orderkey AS id, round(coalesce(sum(l_quantity), 0), 2) AS quantity, count(l_partkey) AS parts FROM orders LEFT JOIN x ON l_orderkey = o_orderkey AND r <= 2 WHERE o_totalprice > 200000 GROUP BY 1")
def include_with_edges(spark, d):
    g = commerce(spark, d)
    roots = g.nodes["Order"].filter("total > 200000")
    out = load(g, roots, "Order", (Include("lines", "Contains", edge_order=(("quantity", True),), take=2, with_edges=True),))
    return out.select("id", F.round(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["edge"]["quantity"]), 2).alias("quantity"), F.size("lines").cast("long").alias("parts"))


@query("SELECT n_nationkey::BIGINT AS id, r_name AS region, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers FROM nation n JOIN region ON r_regionkey = n_regionkey")
def include_relationship(spark, d):
    g = commerce(spark, d)
    types = {n: NodeType(n, ()) for n in ("Nation", "Region", "Supplier")}
    edges = {n: EdgeType(n, g.edges[n].source, g.edges[n].target) for n in ("InRegion", "SupplierIn")}
    ways = (Relationship("region", "Nation", "InRegion", "Region", many=False), Relationship("suppliers", "Nation", "SupplierIn", "Supplier", outgoing=False))
    model = GraphModel(types, edges, {(w.owner, w.name): w for w in ways})
    out = load_relationships(g, model, g.nodes["Nation"], "Nation", "region", "suppliers")
    return out.select("id", F.col("region.name").alias("region"), F.size("suppliers").cast("long").alias("suppliers"))


@query("SELECT o_custkey AS owner, r AS rank, o_orderkey AS order_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F') WHERE r <= 3")
def load_related_rows(spark, d):
    g = commerce(spark, d)
    rows = related_rows(g, g.nodes["Customer"], "Customer", Include("orders", "Placed", where=lambda o: o.status != "F", order=(("total", True),), take=3))
    return rows.select("owner", F.col("rank").cast("long").alias("rank"), F.col("node.id").alias("order_id"))


# Mutations and deltas


def _mutations(spark, d):
    e = read(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "attach").when(F.col("event_type") == "view", "update").otherwise("upsert")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") * 2).alias("id"), (F.col("event_id") % 3).cast("string").alias("payload"))


@query("""
WITH m AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'attach' WHEN 'view' THEN 'update' ELSE 'upsert' END AS op,
  CASE WHEN event_id % 7 <> 0 THEN event_id * 2 END AS id, (event_id % 3)::VARCHAR AS payload FROM events),
k AS (SELECT o_orderkey AS id, (o_orderkey % 2)::VARCHAR AS payload FROM orders),
x AS (SELECT m.*, k.id AS k_id, k.payload AS k_payload, m.id IS NOT NULL AND row_number() OVER (PARTITION BY m.id ORDER BY seq) > 1 AS again FROM m LEFT JOIN k ON m.id = k.id)
SELECT seq, op, id,
  CASE WHEN op = 'add' THEN 'Insert' WHEN op = 'attach' THEN 'Attach' WHEN op = 'remove' THEN 'Delete' WHEN op = 'upsert' AND id IS NULL THEN 'Insert'
       WHEN k_id IS NOT NULL AND payload IS NOT DISTINCT FROM k_payload THEN 'NoOp' ELSE 'Update' END AS action,
  CASE WHEN op IN ('attach', 'update', 'remove') AND id IS NULL THEN 'missing id' WHEN again THEN 'duplicate id' WHEN op = 'add' AND k_id IS NOT NULL THEN 'duplicate key' END AS problem
FROM x""")
def mutation_plan(spark, d):
    known = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).cast("string").alias("payload"))
    return deltas.plan_mutations(_mutations(spark, d), known)


def _customer_mutations(spark, d):
    c = read(spark, d, "customer")
    n = F.col("c_custkey") % 5
    op = F.when(n == 0, "remove").when(n == 1, "update").when(n == 2, "upsert")
    m = c.select(F.col("c_custkey").alias("seq"), op.alias("op"), F.when(n != 2, F.col("c_custkey")).alias("id"), (F.col("c_acctbal") * 2).alias("balance")).filter("op is not null")
    return m, c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN c_acctbal * 2 ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_custkey), c_acctbal * 2, NULL FROM customer WHERE c_custkey % 5 = 2""")
def mutation_apply(spark, d):
    m, rows = _customer_mutations(spark, d)
    plan = deltas.plan_mutations(m.withColumn("payload", F.col("balance").cast("string")), rows.select("id", F.col("balance").cast("string").alias("payload")))
    return deltas.apply_mutations(rows, plan, m)


@query("""WITH m AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'disconnect' ELSE 'reconnect' END AS op,
  CASE WHEN event_id % 3 <> 0 THEN event_id * 5 END AS id, event_id % 2000 AS from_id, event_id * 7 AS to_id FROM events),
f AS (SELECT o_custkey AS a, o_orderkey AS b, count(*) AS fits FROM orders GROUP BY 1, 2),
x AS (SELECT m.*, k.o_orderkey IS NOT NULL AS known, f.fits, c.c_custkey IS NULL OR e.o_orderkey IS NULL AS loose, m.id IS NOT NULL AND row_number() OVER (PARTITION BY m.id ORDER BY seq) > 1 AS again
  FROM m LEFT JOIN orders k ON k.o_orderkey = m.id LEFT JOIN f ON f.a = m.from_id AND f.b = m.to_id LEFT JOIN customer c ON c.c_custkey = m.from_id LEFT JOIN orders e ON e.o_orderkey = m.to_id)
SELECT seq, op, id, CASE WHEN op = 'connect' THEN 'Insert' WHEN op = 'reconnect' THEN 'Update' WHEN id IS NULL AND fits IS NULL THEN 'NoOp' ELSE 'Delete' END AS action,
  CASE WHEN op <> 'disconnect' AND loose THEN 'end missing' WHEN op = 'reconnect' AND id IS NULL THEN 'missing id' WHEN again THEN 'duplicate id' WHEN op = 'connect' AND known THEN 'duplicate key'
       WHEN id IS NOT NULL AND op <> 'connect' AND NOT known THEN 'unknown edge' WHEN op = 'disconnect' AND id IS NULL AND fits > 1 THEN 'ambiguous ends' END AS problem FROM x""")
def mutation_plan_edges(spark, d):
    op = F.when(F.col("event_type") == "signup", "connect").when(F.col("event_type") == "error", "disconnect").otherwise("reconnect")
    e = F.col("event_id")
    m = read(spark, d, "events").select(e.alias("seq"), op.alias("op"), F.when(e % 3 != 0, e * 5).alias("id"), (e % 2000).alias("from_id"), (e * 7).alias("to_id"))
    orders, customers = read(spark, d, "orders"), read(spark, d, "customer")
    edges = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("from_id"), F.col("o_orderkey").alias("to_id"))
    # Customers and orders both count from 0, so each end is looked up among its own.
    return deltas.plan_edge_mutations(m, customers.select(F.col("c_custkey").alias("id")), edges, orders.select(F.col("o_orderkey").alias("id")))


def _accounts(spark, d):
    """Customers (even ids) and orders (odd ids) with an amount, linked by what was placed."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    nodes = c.select((F.col("c_custkey") * 2).alias("id"), F.col("c_acctbal").alias("amount")).union(o.select(F.col("o_orderkey") * 2 + 1, "o_totalprice"))
    return nodes, o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 2).alias("from_id"), (F.col("o_orderkey") * 2 + 1).alias("to_id"), F.col("o_totalprice").alias("total"))


def _account_delta(spark, d):
    """A seventh of the customers goes, a fifth of the orders gets more, an eleventh of the edges starts at customer 1."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    none = F.lit(None).cast("long")
    gone = c.filter("c_custkey % 7 = 0").select(F.lit("remove").alias("op"), F.lit("node").alias("kind"), (F.col("c_custkey") * 2).alias("id"), none.alias("from_id"), none.alias("to_id"), F.lit(None).cast("double").alias("amount"))
    more = o.filter("o_orderkey % 5 = 0").select(F.lit("update"), F.lit("node"), F.col("o_orderkey") * 2 + 1, none, none, F.col("o_totalprice") + 1)
    moved = o.filter("o_orderkey % 11 = 0").select(F.lit("update"), F.lit("edge"), F.col("o_orderkey"), F.lit(2).cast("long"), none, F.lit(None).cast("double"))
    return gone.union(more).union(moved)


@query("SELECT c_custkey * 2 AS id, c_acctbal AS amount FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT o_orderkey * 2 + 1, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END FROM orders")
def delta_update_properties(spark, d):
    return deltas.apply_delta(*_accounts(spark, d), _account_delta(spark, d))[0]


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE o_custkey * 2 END AS from_id, o_orderkey * 2 + 1 AS to_id, o_totalprice AS total FROM orders WHERE o_orderkey % 11 = 0 OR o_custkey % 7 <> 0")
def delta_update_edges(spark, d):
    return deltas.Projection("accounts", 1, *_accounts(spark, d)).apply(_account_delta(spark, d), "accounts", 1)[0].edges


def _trade_delta(spark, d):
    rows = [("remove", "node", 3, None, None), ("add", "node", 100, None, None), ("add", "edge", 900100, 4, 100), ("add", "edge", 900101, 100, 7)]
    return spark.createDataFrame(rows, "op string, kind string, id long, from_id long, to_id long")


@query(f"WITH {TRADE_SQL} SELECT id, from_id, to_id FROM trade WHERE from_id <> 3 AND to_id <> 3 UNION ALL SELECT 900100, 4, 100 UNION ALL SELECT 900101, 100, 7")
def delta_apply(spark, d):
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return deltas.apply_delta(nodes, trade(spark, d), _trade_delta(spark, d))[1].select("id", "from_id", "to_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS version FROM customer")
def save_versioned(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("version"))
    return deltas.save_versioned(rows, rows.filter("id % 10 = 0").withColumn("balance", F.col("balance") + 1))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'balance,segment' WHEN c_custkey % 2 = 0 THEN 'balance' ELSE 'segment' END AS changed FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def change_tracking(spark, d):
    before = commerce(spark, d).nodes["Customer"].select("id", "balance", "segment")
    after = before.select("id", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("balance")).alias("balance"), F.when(F.col("id") % 3 == 0, "NONE").otherwise(F.col("segment")).alias("segment"))
    return deltas.changed_properties(before, after).select("id", F.array_join("changed", ",").alias("changed"))


# History and time

_T1, _T2 = datetime(2024, 1, 10), datetime(2024, 1, 20)


@query(f"WITH {HISTORY_SQL} SELECT event_id, entity_id FROM h WHERE captured_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def history_between(spark, d):
    return history.between(history_log(spark, d), _T1, _T2).select("event_id", "entity_id")


_LATEST = "SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY captured_at DESC, valid_to IS NOT NULL, valid_from DESC) AS r FROM h"


@query(f"WITH {HISTORY_SQL} SELECT event_id, entity_id, operation_kind FROM ({_LATEST} WHERE captured_at <= TIMESTAMP '2024-01-20') WHERE r = 1 AND operation_kind NOT IN (3, 5)")
def history_as_of(spark, d):
    return history.as_of(history_log(spark, d), _T2).select("event_id", "entity_id", "operation_kind")


@query(f"WITH {HISTORY_SQL} SELECT event_id, entity_id, operation_kind FROM ({_LATEST}) WHERE r = 1 AND operation_kind NOT IN (3, 5)")
def history_current(spark, d):
    return history.current(history_log(spark, d)).select("event_id", "entity_id", "operation_kind")


@query(f"WITH {HISTORY_SQL} SELECT event_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY captured_at DESC, valid_from DESC, valid_to IS NULL) AS r FROM h WHERE captured_at <= TIMESTAMP '2024-01-20' AND valid_from <= TIMESTAMP '2024-01-10' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10')) WHERE r = 1 AND operation_kind NOT IN (3, 5)")
def bitemporal_project(spark, d):
    return history.project(history_log(spark, d), _T2, _T1).select("event_id", "entity_id")


@query("SELECT 'User' AS entity_type, user_id AS entity_id, ts AS captured_at, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def history_snapshot_json(spark, d):
    h = history_log(spark, d).join(read(spark, d, "events").select("event_id", F.col("props").alias("snapshot_json")), "event_id")
    return history.typed_snapshots(h, "k bigint")


def _edge_history(spark, d):
    """Which user followed which: each event links its user to the one 7 ids on, and errors undo it."""
    h = history_log(spark, d)
    return h.withColumns({"from_id": F.col("entity_id"), "to_id": (F.col("entity_id") + 7) % 150, "entity_type": F.lit("Follows"), "is_edge": F.lit(True)})


_HOP = f"""
WITH {HISTORY_SQL}, a AS (SELECT * FROM ({_LATEST} WHERE captured_at <= TIMESTAMP '2024-01-20') WHERE r = 1 AND operation_kind NOT IN (3, 5))
SELECT s.entity_id AS source_id, n.entity_id AS node_id, n.event_id AS event_id FROM a s JOIN a e ON %s JOIN a n ON %s"""


@query(_HOP % ("e.entity_id = s.entity_id", "n.entity_id = (e.entity_id + 7) % 150"))
def temporal_outgoing(spark, d):
    h = history_log(spark, d)
    out = history.temporal_hop(history.as_of(h, _T2), _edge_history(spark, d), h, _T2)
    return out.select("source_id", F.col("node.entity_id").alias("node_id"), F.col("node.event_id").alias("event_id"))


@query(_HOP % ("(e.entity_id + 7) % 150 = s.entity_id", "n.entity_id = e.entity_id"))
def temporal_incoming(spark, d):
    h = history_log(spark, d)
    out = history.temporal_hop(history.as_of(h, _T2), _edge_history(spark, d), h, _T2, outgoing=False)
    return out.select("source_id", F.col("node.entity_id").alias("node_id"), F.col("node.event_id").alias("event_id"))


@query(f"""
WITH {HISTORY_SQL}, t(instant) AS (VALUES (TIMESTAMP '2024-01-10'), (TIMESTAMP '2024-01-20')),
a AS (SELECT * FROM (SELECT h.*, t.instant, row_number() OVER (PARTITION BY entity_type, entity_id, instant ORDER BY captured_at DESC, valid_to IS NOT NULL, valid_from DESC) AS r FROM h JOIN t ON captured_at <= instant) WHERE r = 1 AND operation_kind NOT IN (3, 5))
SELECT s.instant AS instant, s.entity_id AS source_id, n.entity_id AS node_id, n.event_id AS event_id FROM a s JOIN a e ON e.instant = s.instant AND e.entity_id = s.entity_id JOIN a n ON n.instant = s.instant AND n.entity_id = (e.entity_id + 7) % 150""")
def temporal_outgoing_own_instants(spark, d):
    h = history_log(spark, d)
    out = history.temporal_hop(history.as_of(h, _T1).union(history.as_of(h, _T2)), _edge_history(spark, d), h)
    return out.select(F.col("query_as_of").cast("timestamp_ntz").alias("instant"), "source_id", F.col("node.entity_id").alias("node_id"), F.col("node.event_id").alias("event_id"))


def _snap(spark, d, at):
    rows = history.as_of(history_log(spark, d), at).select(F.col("entity_id").alias("id"), "event_type", "value")
    return history.snapshot(rows, "id", ["event_type", "value"])


@query(f"""WITH {HISTORY_SQL}, x AS (SELECT entity_id, event_type, value FROM ({_LATEST} WHERE captured_at <= TIMESTAMP '2024-01-10') WHERE r = 1 AND operation_kind NOT IN (3, 5)),
y AS (SELECT entity_id, event_type, value FROM ({_LATEST} WHERE captured_at <= TIMESTAMP '2024-01-20') WHERE r = 1 AND operation_kind NOT IN (3, 5))
SELECT coalesce(x.entity_id, y.entity_id) AS id, CASE WHEN x.entity_id IS NULL THEN 'Added' WHEN y.entity_id IS NULL THEN 'Removed' ELSE 'Modified' END AS change
FROM x FULL JOIN y ON x.entity_id = y.entity_id WHERE x.event_type IS DISTINCT FROM y.event_type OR x.value IS DISTINCT FROM y.value""")
def snapshot_diff(spark, d):
    return history.diff(_snap(spark, d, _T1), _snap(spark, d, _T2))


@query("""WITH s AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS version, user_id AS id, max(event_type) AS f FROM events WHERE event_type IN ('signup', 'view') AND value > 40 GROUP BY 1, 2),
v AS (SELECT DISTINCT version FROM s), p AS (SELECT version, lag(version) OVER (ORDER BY version) AS previous FROM v),
c AS (SELECT p.version, CASE WHEN b.id IS NULL THEN 'a' WHEN b.f <> s.f THEN 'm' END AS k FROM p JOIN s ON s.version = p.version LEFT JOIN s b ON b.version = p.previous AND b.id = s.id WHERE p.previous IS NOT NULL
  UNION ALL SELECT p.version, 'r' FROM p JOIN s b ON b.version = p.previous LEFT JOIN s ON s.version = p.version AND s.id = b.id WHERE s.id IS NULL)
SELECT p.version::BIGINT AS version, count(*) FILTER (WHERE k = 'a') AS added, count(*) FILTER (WHERE k = 'r') AS removed, count(*) FILTER (WHERE k = 'm') AS modified FROM p LEFT JOIN c USING (version) GROUP BY 1""")
def timeline_counts(spark, d):
    e = read(spark, d, "events").filter("event_type in ('signup', 'view') and value > 40")
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    return history.timeline(e.groupBy(week.alias("version"), F.col("user_id").alias("id")).agg(F.max("event_type").alias("fingerprint")))


# Graph algorithms


def _nations(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


@query(f"WITH {SUPPLIED_SQL} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1.0)), 6) AS density, (SELECT count(*) FROM n WHERE id NOT IN (SELECT from_id FROM e) AND id NOT IN (SELECT to_id FROM e)) AS isolated, 0::BIGINT AS orphans")
def projection_statistics(spark, d):
    s = structure.statistics(*supplied_by(spark, d))
    return s.withColumn("density", r6("density"))


_DEGREE = """, x AS (SELECT id, (SELECT count(*) FROM {e} e WHERE e.to_id = n.id) AS i, (SELECT count(*) FROM {e} e WHERE e.from_id = n.id) AS o, (SELECT count(*) FROM n) - 1.0 AS top FROM n)
SELECT id, i AS in_degree, o AS out_degree, round(i / top, 6) AS in_score, round(o / top, 6) AS out_score, round((i + o) / (2 * top), 6) AS score FROM x"""


def _scores(df):
    return df.select("id", "in_degree", "out_degree", r6("in_score").alias("in_score"), r6("out_score").alias("out_score"), r6("score").alias("score"))


@query(f"WITH {SUPPLIED_SQL}" + _DEGREE.format(e="e"))
def degree_centrality(spark, d):
    return _scores(centrality.degree(*supplied_by(spark, d)))


@query(f"WITH {TRADE_SQL}, n AS (SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 100), e2 AS (SELECT from_id, to_id FROM trade WHERE from_id <> 3 AND to_id <> 3 UNION ALL SELECT 4, 100 UNION ALL SELECT 100, 7)" + _DEGREE.format(e="e2"))
def degree_incremental(spark, d):
    nodes, edges = _nations(spark, d), trade(spark, d)
    before = centrality.degree(nodes, edges)
    new_nodes, new_edges, affected = deltas.apply_delta(nodes, edges, _trade_delta(spark, d))
    return _scores(centrality.incremental_degree(before, new_nodes, new_edges, affected))


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS s FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS (SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(s), 0) FROM r{i - 1} WHERE id NOT IN (SELECT from_id FROM o)) / (SELECT count(*) FROM n)) AS s "
            f"FROM n LEFT JOIN (SELECT e.to_id, sum(r.s / o.k) AS got FROM e JOIN r{i - 1} r ON r.id = e.from_id JOIN o ON o.from_id = e.from_id GROUP BY 1) g ON g.to_id = n.id)"
        )
    return f"WITH {SUPPLIED_SQL}, o AS (SELECT from_id, count(*) AS k FROM e GROUP BY 1), {', '.join(steps)} SELECT id, round(s, 6) AS score FROM r{rounds}"


@query(_pagerank_sql(6))
def pagerank_fixed(spark, d):
    nodes, edges = supplied_by(spark, d)
    return centrality.pagerank(nodes, edges, iterations=6, fixed=True).select("id", r6("score").alias("score"))


def _labels_sql(rounds: int) -> str:
    """Each round every node takes the least label around it; the last rounds change nothing."""
    steps = ["r0 AS MATERIALIZED (SELECT id, id AS c FROM n)"]
    steps += [f"r{i} AS MATERIALIZED (SELECT id, min(c) AS c FROM (SELECT * FROM r{i - 1} UNION ALL SELECT u.b, r.c FROM u JOIN r{i - 1} r ON r.id = u.a) GROUP BY id)" for i in range(1, rounds + 1)]
    return f"WITH {SUPPLIED_SQL}, u AS MATERIALIZED (SELECT from_id AS a, to_id AS b FROM e UNION ALL SELECT to_id, from_id FROM e), {', '.join(steps)} SELECT id, c AS component FROM r{rounds}"


@query(_labels_sql(16))
def weak_components(spark, d):
    return structure.weak_components(*supplied_by(spark, d))


@query(f"WITH RECURSIVE {TRADE_SQL}" + """, n AS (SELECT n_nationkey::BIGINT AS id FROM nation), r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, t.to_id FROM r JOIN trade t ON t.from_id = r.b)
SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def strong_components(spark, d):
    return structure.strong_components(_nations(spark, d), trade(spark, d))


def _costs_sql(name: str, start: str, a: str, b: str, rounds: int = 24) -> str:
    """Least costs from ``start`` after as many rounds as a path between 25 nations can have edges."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT {start} AS id, 0::DOUBLE AS cost)"]
    for i in range(1, rounds + 1):
        steps.append(f"{name}{i} AS MATERIALIZED (SELECT id, min(cost) AS cost FROM (SELECT * FROM {name}{i - 1} UNION ALL SELECT t.{b}, x.cost + t.cost FROM {name}{i - 1} x JOIN trade t ON t.{a} = x.id) GROUP BY id)")
    return ", ".join(steps)


@query(f"WITH {TRADE_SQL}, {_costs_sql('s', '0::BIGINT', 'from_id', 'to_id')} SELECT id, cost FROM s24")
def shortest_path_costs(spark, d):
    return routes.shortest_costs(trade(spark, d), spark.createDataFrame([(0,)], "id long"), "cost").select("id", "cost")


#: The goal of routes from nation 0, and what every nation's way to it costs at least.
_GOAL_SQL = f"{TRADE_SQL}, goal AS (SELECT max(to_id) AS goal FROM trade), {_costs_sql('g', '(SELECT goal FROM goal)', 'to_id', 'from_id')}"


def _goal(spark, d) -> int:
    return trade(spark, d).agg(F.max("to_id")).first()[0]


def _routes_sql(name: str, k: int, keep: str = "true") -> str:
    """All loopless routes to the goal that cost no more than the k-th of those of three edges at most."""
    grow = f"SELECT p.path || ',' || t.to_id, list_append(p.nodes, t.to_id), t.to_id, p.cost + t.cost FROM %s p JOIN trade t ON t.from_id = p.last JOIN g24 ON g24.id = t.to_id, goal WHERE p.last <> goal AND NOT list_contains(p.nodes, t.to_id) AND ({keep})"
    return f"""{name}_short(path, nodes, last, cost) AS (SELECT '0', [0::BIGINT], 0::BIGINT, 0::DOUBLE UNION ALL {grow % f"{name}_short"} AND len(p.nodes) <= 3),
{name}_bound AS (SELECT max(cost) AS bound FROM (SELECT cost FROM {name}_short, goal WHERE last = goal ORDER BY cost LIMIT {k})),
{name}_all(path, nodes, last, cost) AS (SELECT '0', [0::BIGINT], 0::BIGINT, 0::DOUBLE UNION ALL {grow % f"{name}_all"} AND p.cost + t.cost + g24.cost <= (SELECT bound FROM {name}_bound)),
{name} AS (SELECT path, nodes, cost, len(nodes) AS size, row_number() OVER (ORDER BY cost, len(nodes), path) AS rank FROM {name}_all, goal WHERE last = goal)"""


@query(f"WITH RECURSIVE {_GOAL_SQL}, {_routes_sql('q', 5)} SELECT rank, path, cost, false AS exhausted FROM q WHERE rank <= 5")
def k_shortest(spark, d):
    k = routes.k_shortest(trade(spark, d), 0, _goal(spark, d), 5, "cost")
    return k.select(F.col("rank").cast("long").alias("rank"), F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"), "cost", "exhausted")


def _pareto_sql(rounds: int = 24) -> str:
    steps = ["v0 AS MATERIALIZED (SELECT 0::BIGINT AS id, 0::DOUBLE AS cost, 0::DOUBLE AS bulk, '0' AS path)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"v{i} AS MATERIALIZED (SELECT id, cost, bulk, path FROM (SELECT *, min(bulk) OVER (PARTITION BY id ORDER BY cost, bulk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM ("
            f"SELECT id, cost, bulk, min(path) AS path FROM (SELECT * FROM v{i - 1} UNION ALL SELECT t.to_id, v.cost + t.cost, v.bulk + t.revenue % 97, v.path || ',' || t.to_id FROM v{i - 1} v JOIN trade t ON t.from_id = v.id) GROUP BY 1, 2, 3)) WHERE had IS NULL OR bulk < had)"
        )
    return ", ".join(steps)


@query(f"WITH {TRADE_SQL}, goal AS (SELECT max(to_id) AS goal FROM trade), {_pareto_sql()} SELECT path, cost, bulk, false AS truncated FROM v24, goal WHERE id = goal")
def pareto_routes(spark, d):
    edges = trade(spark, d).withColumn("bulk", F.col("revenue") % 97)
    return routes.pareto_routes(edges, 0, _goal(spark, d), ("cost", "bulk"), limit=None).select("path", "cost", "bulk", "truncated")


@query(f"""WITH RECURSIVE {_GOAL_SQL}, {_routes_sql('q', 1)}, failed AS (SELECT nodes[2] AS f FROM q, goal WHERE rank = 1 AND nodes[2] <> goal),
{_routes_sql('w', 3, "t.to_id NOT IN (SELECT f FROM failed)")}
SELECT w.rank, w.path, w.cost, w.cost - q.cost AS cost_delta, w.size - q.size AS hop_delta FROM w, q WHERE w.rank <= 3 AND q.rank = 1""")
def impact_reroute(spark, d):
    edges, goal = trade(spark, d), _goal(spark, d)
    best = routes.shortest_path(edges, 0, goal, "cost")[0]
    out = routes.impact_reroute(edges, 0, goal, [best[1]] if best[1] != goal else [], [], 3, "cost")
    return out.select(F.col("rank").cast("long").alias("rank"), F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"), "cost", "cost_delta", F.col("hop_delta").cast("long").alias("hop_delta"))


@query(f"""WITH RECURSIVE {TRADE_SQL}, p(start, last, path) AS (SELECT from_id, to_id, [from_id] FROM trade WHERE to_id >= from_id
UNION ALL SELECT p.start, t.to_id, list_append(p.path, p.last) FROM p JOIN trade t ON t.from_id = p.last WHERE p.last <> p.start AND t.to_id >= p.start AND NOT list_contains(p.path, p.last) AND len(p.path) < 4 AND (t.to_id = p.start OR NOT list_contains(list_append(p.path, p.last), t.to_id)))
SELECT start, array_to_string(path, ',') AS path FROM p WHERE last = start""")
def cycles_bounded(spark, d):
    found, _ = structure.cycles(_nations(spark, d), trade(spark, d), max_length=4, max_cycles=1_000_000)
    return found.select("start", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


def _betweenness_sql(rounds: int = 24) -> str:
    steps = ["b0 AS MATERIALIZED (SELECT id AS s, id, 0::DOUBLE AS cost FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(f"b{i} AS MATERIALIZED (SELECT s, id, min(cost) AS cost FROM (SELECT * FROM b{i - 1} UNION ALL SELECT x.s, t.to_id, x.cost + t.cost FROM b{i - 1} x JOIN trade t ON t.from_id = x.id) GROUP BY 1, 2)")
    return f"""WITH RECURSIVE {TRADE_SQL}, n AS (SELECT n_nationkey::BIGINT AS id FROM nation), {', '.join(steps)},
p(s, last, nodes) AS (SELECT id, id, [id] FROM n UNION ALL SELECT p.s, t.to_id, list_append(p.nodes, t.to_id) FROM p JOIN trade t ON t.from_id = p.last JOIN b{rounds} x ON x.s = p.s AND x.id = p.last JOIN b{rounds} y ON y.s = p.s AND y.id = t.to_id WHERE x.cost + t.cost = y.cost),
c AS (SELECT s, last, count(*) AS k FROM p GROUP BY 1, 2), i AS (SELECT s, last, unnest(nodes[2:-2]) AS v FROM p WHERE len(nodes) > 2), v AS (SELECT v, sum(1.0 / k) AS score FROM i JOIN c USING (s, last) GROUP BY 1)
SELECT n.id, round(coalesce(score, 0), 6) AS score, round(coalesce(score, 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 6) AS normalised FROM n LEFT JOIN v ON v.v = n.id"""


@query(_betweenness_sql())
def betweenness(spark, d):
    return centrality.betweenness(_nations(spark, d), trade(spark, d), "cost").select("id", r6("score").alias("score"), r6("normalised").alias("normalised"))


_ACTIVITIES = """a AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey % 5 + 1)::DOUBLE AS d FROM nation), l AS (SELECT from_id AS a, to_id AS b, (cost % 3)::DOUBLE AS lag FROM trade JOIN nation x ON x.n_nationkey = from_id JOIN nation y ON y.n_nationkey = to_id WHERE x.n_regionkey < y.n_regionkey)"""


@query(f"""WITH RECURSIVE {TRADE_SQL}, {_ACTIVITIES}, f(id, t) AS (SELECT id, 0::DOUBLE FROM a UNION SELECT l.b, f.t + x.d + l.lag FROM f JOIN l ON l.a = f.id JOIN a x ON x.id = f.id),
es AS (SELECT id, max(t) AS t FROM f GROUP BY id), e AS (SELECT max(t + d) AS e FROM es JOIN a USING (id)),
g(id, t) AS (SELECT id, d FROM a UNION SELECT l.a, g.t + x.d + l.lag FROM g JOIN l ON l.b = g.id JOIN a x ON x.id = l.a), tail AS (SELECT id, max(t) AS t FROM g GROUP BY id)
SELECT a.id, a.d AS duration, es.t AS earliest_start, es.t + a.d AS earliest_finish, e - tail.t AS latest_start, e - tail.t + a.d AS latest_finish, e - tail.t - es.t AS slack, abs(e - tail.t - es.t) <= 1e-9 AS critical FROM a JOIN es USING (id) JOIN tail USING (id), e""")
def critical_path(spark, d):
    nodes = _nations(spark, d).withColumn("d", (F.col("id") % 5 + 1).cast("double"))
    # What goes from a region to a later one.
    region = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    ends = [region.select(F.col("n_nationkey").cast("long").alias(f"{e}_id"), F.col("n_regionkey").alias(e)) for e in ("from", "to")]
    edges = trade(spark, d).join(ends[0], "from_id").join(ends[1], "to_id").filter("from < to").withColumn("lag", F.col("cost") % 3)
    return planning.critical_path(nodes, edges, "d", "lag")


@query()
def max_flow(spark, d):
    f = flow.maximum_flow(trade(spark, d), 0, _goal(spark, d), "cost")
    return f.edges.agg(F.lit(f.value).alias("value"), F.sum(F.when(F.col("in_cut"), F.col("capacity")).otherwise(0.0)).alias("cut_capacity"), F.sum(F.col("saturated").cast("long")).alias("bottlenecks"))


@query()
def leiden_communities(spark, d):
    return communities.communities(*supplied_by(spark, d), "weight")


_PARITY = "m AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS community FROM nation)"


@query(f"""WITH {TRADE_SQL}, {_PARITY}, e AS (SELECT t.*, a.community AS ca, b.community AS cb FROM trade t JOIN m a ON a.id = from_id JOIN m b ON b.id = to_id), t AS (SELECT sum(cost)::DOUBLE AS total FROM e),
s AS (SELECT community, count(*) AS size FROM m GROUP BY 1),
x AS (SELECT s.community, s.size, coalesce((SELECT sum(cost) FROM e WHERE ca = s.community AND cb = s.community), 0)::DOUBLE AS internal, coalesce((SELECT count(*) FROM e WHERE ca = s.community AND cb = s.community), 0) AS k,
 coalesce((SELECT sum(cost) FROM e WHERE (ca = s.community) <> (cb = s.community)), 0)::DOUBLE AS boundary,
 (SELECT count(DISTINCT v) FROM (SELECT from_id AS v FROM e WHERE ca = s.community AND cb <> s.community UNION SELECT to_id FROM e WHERE cb = s.community AND ca <> s.community)) AS bridge_nodes FROM s)
SELECT community, size, internal, boundary, round(CASE WHEN size > 1 THEN k / (size * (size - 1.0)) ELSE 0 END, 6) AS density, round(boundary / least(2 * internal + boundary, 2 * total - 2 * internal - boundary), 6) AS conductance, bridge_nodes FROM x, t""")
def community_metrics(spark, d):
    members = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("community"))
    m = communities.community_metrics(members, trade(spark, d), "cost")
    return m.withColumns({"density": r6("density"), "conductance": r6("conductance")})


@query(f"""WITH {TRADE_SQL}, {_PARITY}, e AS (SELECT t.cost::DOUBLE AS w, a.community AS ca, b.community AS cb FROM trade t JOIN m a ON a.id = from_id JOIN m b ON b.id = to_id), t AS (SELECT sum(w) AS t FROM e),
o AS (SELECT ca AS c, sum(w) AS o, sum(CASE WHEN ca = cb THEN w ELSE 0 END) AS i FROM e GROUP BY 1), n AS (SELECT cb AS c, sum(w) AS n FROM e GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / t - coalesce(o, 0) * coalesce(n, 0) / (t * t)), 6) AS modularity FROM (SELECT coalesce(o.c, n.c) AS c, i, o, n FROM o FULL JOIN n ON o.c = n.c), t""")
def modularity(spark, d):
    members = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("community"))
    return communities.modularity(members, trade(spark, d), "cost").select(r6("modularity").alias("modularity"))


@query(f"""WITH {LOCATED_SQL}, l AS (SELECT from_id AS v, to_id AS u FROM located UNION SELECT to_id, from_id FROM located), g AS (SELECT v, count(*) AS d FROM l GROUP BY 1),
p AS (SELECT x.v AS a, y.v AS b, count(*) AS common, sum(CASE WHEN g.d > 1 THEN 1 / ln(g.d) ELSE 0 END) AS aa FROM l x JOIN l y ON x.u = y.u AND x.v < y.v JOIN g ON g.v = x.u GROUP BY 1, 2),
q AS (SELECT p.*, common / (ga.d + gb.d - common)::DOUBLE AS jac, (ga.d * gb.d)::DOUBLE AS att FROM p JOIN g ga ON ga.v = a JOIN g gb ON gb.v = b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.v = p.a AND l.u = p.b)),
t AS (SELECT max(common) AS tc, max(jac) AS tj, max(aa) AS ta, max(att) AS tt FROM q),
s AS (SELECT a, b, common, jac, aa, att, round((common / tc::DOUBLE * 1.0 + jac / tj * 1.5 + aa / ta * 1.5 + att / tt * 0.25) / 5.25, 12) AS c FROM q, t ORDER BY c DESC, a, b LIMIT 20)
SELECT a, b, common, round(jac, 6) AS jaccard, round(aa, 6) AS adamic_adar, att AS attachment, round(c, 6) AS confidence FROM s""")
def link_prediction(spark, d):
    p = communities.predict_links(*located(spark, d), limit=20)
    return p.select("a", "b", "common", r6("jaccard").alias("jaccard"), r6("adamic_adar").alias("adamic_adar"), "attachment", r6("confidence").alias("confidence"))


@query(f"""WITH {LOCATED_SQL}, o AS (SELECT from_id AS v, count(*) AS d FROM located GROUP BY 1), i AS (SELECT to_id AS v, count(*) AS d FROM located GROUP BY 1),
p AS (SELECT x.from_id AS a, y.to_id AS b, count(*) AS common, sum(1 / ln(o.d + i.d)) AS aa FROM located x JOIN located y ON y.from_id = x.to_id JOIN o ON o.v = x.to_id JOIN i ON i.v = x.to_id GROUP BY 1, 2),
q AS (SELECT p.*, common / (o.d + i.d - common)::DOUBLE AS jac, (o.d * i.d)::DOUBLE AS att FROM p JOIN o ON o.v = a JOIN i ON i.v = b),
t AS (SELECT max(common) AS tc, max(jac) AS tj, max(aa) AS ta, max(att) AS tt FROM q),
s AS (SELECT a, b, common, jac, aa, att, round((common / tc::DOUBLE * 1.0 + jac / tj * 1.5 + aa / ta * 1.5 + att / tt * 0.25) / 5.25, 12) AS c FROM q, t ORDER BY c DESC, a, b LIMIT 50)
SELECT a, b, common, round(jac, 6) AS jaccard, round(aa, 6) AS adamic_adar, att AS attachment, round(c, 6) AS confidence FROM s""")
def link_prediction_directed(spark, d):
    p = communities.predict_links(*located(spark, d), limit=50, directed=True)
    return p.select("a", "b", "common", r6("jaccard").alias("jaccard"), r6("adamic_adar").alias("adamic_adar"), "attachment", r6("confidence").alias("confidence"))


@query(f"WITH RECURSIVE {TRADE_SQL}, r(id, s) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT * 7 % 25 FROM nation UNION SELECT t.to_id, r.s FROM r JOIN trade t ON t.from_id = r.id) SELECT id, max(s) AS state FROM r GROUP BY id")
def pregel_max(spark, d):
    nodes = _nations(spark, d)
    return pregel.run(nodes, trade(spark, d), F.col("id") * 7 % 25, lambda s, w: s, F.max, lambda s, m: F.greatest(s, m))[0]


# Live changes


@query(f"WITH {TRADE_SQL} SELECT from_id, to_id FROM trade WHERE from_id <> 3 AND to_id <> 3 AND id <> (SELECT min(id) FROM trade WHERE from_id <> 3 AND to_id <> 3) UNION ALL SELECT 4, 100")
def live_feed_apply(spark, d):
    from arcwell.scratch import shared_dir
    from arcwell.streaming.feed import LiveGraph, follow

    edges = trade(spark, d)
    first = edges.filter("from_id <> 3 and to_id <> 3").agg(F.min("id")).first()[0]
    rows = [(1, "remove", "node", 3, None, None), (2, "add", "node", 100, None, None), (3, "add", "edge", 900100, 4, 100), (4, "remove", "edge", first, None, None)]
    from uuid import uuid4

    path = f"{shared_dir(spark)}/arcwell/feed-{uuid4().hex}"
    spark.createDataFrame(rows, "sequence long, op string, kind string, id long, from_id long, to_id long").coalesce(1).write.json(f"{path}/changes")
    live = follow(spark, f"{path}/changes", LiveGraph(_nations(spark, d), edges.select("id", "from_id", "to_id")), f"{path}/state")
    return live.edges.select("from_id", "to_id")


@query(f"WITH {TRADE_SQL} SELECT from_id, to_id, CASE WHEN id = (SELECT min(id) FROM trade WHERE from_id <> 3 AND to_id <> 3) THEN 1 ELSE cost END AS cost FROM trade WHERE from_id <> 3 AND to_id <> 3 UNION ALL SELECT 4, 100, 7 UNION ALL SELECT 5, 3, 2")
def live_feed_properties(spark, d):
    from uuid import uuid4

    from arcwell.scratch import shared_dir
    from arcwell.streaming.feed import CHANGE, LiveGraph, follow

    edges = trade(spark, d)
    first = edges.filter("from_id <> 3 and to_id <> 3").agg(F.min("id")).first()[0]
    rows = [(1, "remove", "node", 3, None, None, None), (2, "add", "node", 100, None, None, None), (2, "add", "edge", 900100, 4, 100, 5), (3, "update", "edge", 900100, None, None, 7), (4, "add", "node", 3, None, None, None), (5, "add", "edge", 900101, 5, 3, 2), (6, "update", "edge", first, None, None, 1)]
    path, schema = f"{shared_dir(spark)}/arcwell/feed-{uuid4().hex}", f"{CHANGE}, cost long"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{path}/changes")
    live = follow(spark, f"{path}/changes", LiveGraph(_nations(spark, d), edges.select("id", "from_id", "to_id", "cost")), f"{path}/state", schema)
    return live.edges.select("from_id", "to_id", "cost")


# What-if


@query(f"""WITH {TRADE_SQL}, n AS (SELECT count(*) AS n FROM nation), e AS (SELECT count(*) AS e FROM trade), e2 AS (SELECT count(*) + 2 AS e FROM trade WHERE from_id <> 3 AND to_id <> 3)
SELECT 'density' AS metric, round(e.e / (n * (n - 1.0)), 6) AS before, round(e2.e / (n * (n - 1.0)), 6) AS after FROM n, e, e2
UNION ALL SELECT 'edges', e.e, e2.e FROM e, e2 UNION ALL SELECT 'nodes', n, n FROM n""")
def scenario_apply(spark, d):
    base = (_nations(spark, d), trade(spark, d))
    c = twin.compare_scenarios(base, twin.scenario(*base, _trade_delta(spark, d)))
    return c.filter("metric <> 'weak_components'").select("metric", r6("before").alias("before"), r6("after").alias("after"))


@query("SELECT event_id, CASE WHEN value <= 60 THEN row_number() OVER (PARTITION BY value <= 60 ORDER BY value, event_type, event_id) END AS turn FROM events")
def discrete_event(spark, d):
    events = read(spark, d, "events").select("event_id", F.col("value").alias("offset"), F.col("event_type").alias("priority"))
    return twin.order_events(events, 60.0).select("event_id", F.col("turn").cast("long").alias("turn"))


def _cascade_sql(rounds: int) -> str:
    steps = ["d0 AS MATERIALIZED (SELECT n_nationkey::BIGINT AS id, 0 AS round FROM nation WHERE n_nationkey < 8)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT f.id, {i} FROM fed f WHERE f.id NOT IN (SELECT id FROM d{i - 1}) AND coalesce((SELECT sum(cost) FROM trade t WHERE t.to_id = f.id AND t.from_id NOT IN (SELECT id FROM d{i - 1})), 0) + 1e-9 < f.demand)"
        )
    return f"WITH {TRADE_SQL}, fed AS (SELECT to_id AS id, sum(cost) * 0.7 AS demand FROM trade GROUP BY 1), {', '.join(steps)} SELECT id, round FROM d{rounds}"


@query(_cascade_sql(25))
def cascade_failure(spark, d):
    """What the failure of nations 0 to 7 brings down."""
    edges = trade(spark, d).select("from_id", "to_id", F.col("cost").cast("double").alias("capacity"))
    nodes = edges.groupBy(F.col("to_id").alias("id")).agg((F.sum("capacity") * 0.7).alias("demand"))
    return twin.cascade(nodes, edges, _nations(spark, d).filter("id < 8"))


def _draws_sql() -> str:
    """SplitMix64's numbers (fixed values) for 20,000 runs of 12 draws, in whole numbers of 128 bits."""
    golden, first, second, size = ("11400714819323198485", "13787848793156543929", "10723151780598845931", "18446744073709551616::UHUGEINT")
    times = lambda x, c: f"(({x})::UHUGEINT * {c}::UHUGEINT % {size})::UBIGINT"
    return f"""x0 AS (SELECT run, ((xor({times('run', golden)}, 42::UBIGINT)::UHUGEINT + {times('k', golden)}::UHUGEINT) % {size})::UBIGINT AS x FROM range(20000) r(run), range(1, 13) d(k)),
x1 AS (SELECT run, {times('xor(x, x >> 30)', first)} AS x FROM x0), x2 AS (SELECT run, {times('xor(x, x >> 27)', second)} AS x FROM x1),
u AS (SELECT run, (xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992 AS u FROM x2)"""


@query(f"""WITH p AS (SELECT avg(p_retailprice) AS a, stddev_samp(p_retailprice) AS s FROM part), {_draws_sql()}, o AS (SELECT run, a + s * (sum(u) - 6) AS v FROM u, p GROUP BY run, a, s),
t AS (SELECT avg(v) AS mean, stddev_samp(v) AS deviation, stddev_samp(v) / sqrt(count(*)) AS error, min(v) AS least, max(v) AS most, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM o)
SELECT round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(error, 6) AS error, round(mean - 1.959963984540054 * error, 6) AS low, round(mean + 1.959963984540054 * error, 6) AS high,
round(least, 6) AS least, round(most, 6) AS most, round(q[1], 6) AS p25, round(q[2], 6) AS p50, round(q[3], 6) AS p75 FROM t""")
def monte_carlo(spark, d):
    prices = read(spark, d, "part").agg(F.avg("p_retailprice"), F.stddev_samp("p_retailprice")).first()
    runs = twin.monte_carlo(spark, 20000, lambda u: prices[0] + prices[1] * (u.sum(axis=1) - 6.0), 12)
    return twin.outcome_statistics(runs).select(*[r6(c).alias(c) for c in ("mean", "deviation", "error", "low", "high", "least", "most", "p25", "p50", "p75")])


@query("SELECT count(value) AS runs, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75 FROM events")
def monte_carlo_stats(spark, d):
    s = twin.outcome_statistics(read(spark, d, "events"), "value")
    return s.select("runs", r6("mean").alias("mean"), r6("deviation").alias("deviation"), "least", "most", r6("p25").alias("p25"), r6("p75").alias("p75"))


@query("""WITH s AS (SELECT p_brand AS policy, 'price' AS criterion, avg(p_retailprice) AS value, 2.0 AS w, false AS up FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'parts', count(*), 1.0, true FROM part GROUP BY 1),
u AS (SELECT *, min(value) OVER (PARTITION BY criterion) AS lo, max(value) OVER (PARTITION BY criterion) AS hi FROM s),
p AS (SELECT policy, sum(w * CASE WHEN hi = lo THEN 1 WHEN up THEN (value - lo) / (hi - lo) ELSE 1 - (value - lo) / (hi - lo) END) / sum(w) AS utility FROM u GROUP BY 1)
SELECT policy, round(utility, 6) AS utility, row_number() OVER (ORDER BY round(utility, 12) DESC, policy) AS rank FROM p""")
def policy_ranking(spark, d):
    by = read(spark, d, "part").groupBy(F.col("p_brand").alias("policy"))
    scores = by.agg(F.avg("p_retailprice").alias("value")).withColumn("criterion", F.lit("price")).unionByName(by.agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("criterion", F.lit("parts")))
    criteria = spark.createDataFrame([("price", 2.0, False), ("parts", 1.0, True)], "criterion string, weight double, maximise boolean")
    return twin.rank_policies(scores, criteria).select("policy", r6("utility").alias("utility"), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT p_brand AS parameter, p_size AS value, avg(p_retailprice) AS outcome FROM part GROUP BY 1, 2),
l AS (SELECT *, lag(value) OVER (PARTITION BY parameter ORDER BY value) AS v0, lag(outcome) OVER (PARTITION BY parameter ORDER BY value) AS o0 FROM s),
a AS (SELECT parameter, max(outcome) - min(outcome) AS rng, avg(CASE WHEN v0 <> 0 AND o0 <> 0 THEN ((outcome - o0) / abs(o0)) / ((value - v0) / abs(v0)::DOUBLE) END) AS el, min(outcome - o0) AS lo, max(outcome - o0) AS hi FROM l GROUP BY 1)
SELECT parameter, round(rng, 6) AS range, round(el, 6) AS elasticity, CASE WHEN lo IS NULL OR lo = 0 AND hi = 0 THEN 'Flat' WHEN lo >= 0 THEN 'Increasing' WHEN hi <= 0 THEN 'Decreasing' ELSE 'Mixed' END AS direction FROM a""")
def sensitivity(spark, d):
    s = read(spark, d, "part").groupBy(F.col("p_brand").alias("parameter"), F.col("p_size").alias("value")).agg(F.avg("p_retailprice").alias("outcome"))
    return twin.sensitivity(s).select("parameter", r6("range").alias("range"), r6("elasticity").alias("elasticity"), "direction")


@query(f"""WITH {TRADE_SQL} SELECT 1::BIGINT + 2 AS added, (SELECT 1 + count(*) FROM trade WHERE from_id = 3 OR to_id = 3) AS removed, 0::BIGINT AS modified, true AS topology_changed,
CASE WHEN (SELECT 4 + count(*) FROM trade WHERE from_id = 3 OR to_id = 3) / greatest((SELECT count(*) FROM trade) + 25, (SELECT count(*) FROM trade WHERE from_id <> 3 AND to_id <> 3) + 27)::DOUBLE >= 0.3 THEN 'Critical' ELSE 'High' END AS level""")
def drift_report(spark, d):
    def world(n, e):
        nodes = n.select(F.lit("node").alias("kind"), "id", F.lit("-").alias("fingerprint"), F.lit("-").alias("ends"))
        return nodes.union(e.select(F.lit("edge"), "id", F.lit("-"), F.concat_ws(">", F.col("from_id").cast("string"), F.col("to_id").cast("string"))))

    base = (_nations(spark, d), trade(spark, d))
    return twin.drift(world(*base), world(*twin.scenario(*base, _trade_delta(spark, d))))


@query("""WITH m AS (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1), r(rule, metric, comparison, threshold, severity) AS (VALUES ('a', 'error', '>', 10.0, 3), ('b', 'click', '<', 1.0, 2), ('c', 'view', '>=', 5.0, 1), ('d', 'purchase', '<=', 1000.0, 3))
SELECT rule, metric, round(value, 6) AS value, severity FROM m JOIN r USING (metric) WHERE CASE comparison WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '<' THEN value < threshold ELSE value <= threshold END""")
def warning_rules(spark, d):
    metrics = read(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    rules = spark.createDataFrame([("a", "error", ">", 10.0, 3), ("b", "click", "<", 1.0, 2), ("c", "view", ">=", 5.0, 1), ("d", "purchase", "<=", 1000.0, 3)], "rule string, metric string, comparison string, threshold double, severity int")
    return twin.warnings(metrics, rules).select("rule", "metric", r6("value").alias("value"), "severity")


@query("""WITH s AS (SELECT event_type AS metric, date_trunc('day', ts) AS day, avg(value) AS value FROM events GROUP BY 1, 2), x AS (SELECT *, epoch(day) - min(epoch(day)) OVER (PARTITION BY metric) AS x FROM s),
f AS (SELECT metric, regr_slope(value, x) AS a, regr_intercept(value, x) AS b, regr_r2(value, x) AS r2, max(x) AS last FROM x GROUP BY 1)
SELECT metric, round(a * 86400, 6) AS per_day, round(b, 6) AS intercept, round(r2, 6) AS r2, round(CASE WHEN a <> 0 AND (60 - b) / a > last THEN (60 - b) / a / 86400 END, 4) AS breach_day, coalesce(CASE WHEN a <> 0 AND (60 - b) / a > last THEN (60 - b) / a - last <= 8640000 END, false) AS within_horizon FROM f""")
def threshold_prediction(spark, d):
    s = read(spark, d, "events").groupBy(F.col("event_type").alias("metric"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at")).agg(F.avg("value").alias("value"))
    p = twin.predict_breach(s, 60.0, 8_640_000.0)
    return p.select("metric", r6(F.col("slope") * 86400).alias("per_day"), r6("intercept").alias("intercept"), r6("r2").alias("r2"), F.round(F.col("breach_after") / 86400, 4).alias("breach_day"), "within_horizon")


# Documents


@query(f"WITH RECURSIVE {TRADE_SQL}, r(id, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT t.to_id, r.depth + 1 FROM r JOIN trade t ON t.from_id = r.id WHERE r.depth < 2) SELECT 'N' || id AS id, min(depth) AS depth FROM r GROUP BY 1")
def document_focus(spark, d):
    nodes = _nations(spark, d).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("id"))
    links = trade(spark, d).select(F.concat(F.lit("N"), F.col("from_id").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("to_id").cast("string")).alias("target"))
    return documents.focus(nodes, links, "n0", 2)


@query("SELECT CASE WHEN n_nationkey < 10 THEN 'n' ELSE 'N' END || n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN 'second' ELSE 'first' END AS kind, n_name AS label FROM nation")
def document_merge(spark, d):
    n = read(spark, d, "nation")
    build = lambda prefix, rows, kind: documents.build(rows.withColumn("key", F.concat(F.lit(prefix), F.col("n_nationkey").cast("string"))), kind, "key", "n_name")
    return documents.merge([build("N", n, "first"), build("n", n.filter("n_nationkey < 10"), "second")]).select("id", "kind", "label")
