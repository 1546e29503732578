"""Graphs derived from the test tables, and the same graphs as SQL.

Each graph is built once per session and folder and written; queries on it read the written tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import with_previous
from ..graph import Graph
from .data_queries import read
from .iterate import cut

SUPPLIERS, NATIONS, REGIONS = 1_000_000, 1_000_000, 2_000_000

_BUILT: dict[tuple[str, str, str], Graph] = {}


def co_purchase(spark: SparkSession, d: str) -> Graph:
    """Parts that share an order, in both directions."""
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"))
    pairs = lines.join(lines.withColumnRenamed("src", "dst"), "l_orderkey").where("src <> dst").select("src", "dst").distinct()
    return Graph.of_edges(pairs, directed=False)


def customer_supplier(spark: SparkSession, d: str) -> Graph:
    """Customers and suppliers of their orders, weighted by the number of lines, in both directions."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.lit(SUPPLIERS) + F.col("l_suppkey")).alias("dst"))
    weighted = lines.join(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src")), "o_orderkey").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    weighted = cut(weighted)
    return Graph.of_edges(weighted.union(weighted.select("dst", "src", "weight")), directed=False, weighted=True)


def transitions(spark: SparkSession, d: str) -> Graph:
    """From the user of an event to the user of the next one."""
    events = read(spark, d, "events").select("ts", "event_id", "user_id")
    following = with_previous(events, ["-ts", "-event_id"], {"dst": "user_id"}).where("dst is not null")
    return Graph.of_edges(following.where("user_id <> dst").select(F.col("user_id").alias("src"), "dst").distinct())


def forest(spark: SparkSession, d: str) -> Graph:
    """From customers to nations to regions."""
    up = read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("src"), (F.lit(NATIONS) + F.col("c_nationkey")).cast("long").alias("dst"))
    top = read(spark, d, "nation").select((F.lit(NATIONS) + F.col("n_nationkey")).cast("long").alias("src"), (F.lit(REGIONS) + F.col("n_regionkey")).cast("long").alias("dst"))
    return Graph.of_edges(up.union(top))


def order_chain(spark: SparkSession, d: str) -> Graph:
    """From each order to the customer's next one, weighted by days between; an order may have no other."""
    from pyspark.sql import Window

    orders = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("src"), "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "src")
    following = orders.select("src", F.lead("src").over(w).alias("dst"), F.date_diff(F.lead("o_orderdate").over(w), F.col("o_orderdate")).cast("long").alias("weight"))
    edges = cut(following.where("dst is not null"))
    return Graph(cut(orders.select(F.col("src").alias("id"))), edges, directed=True, weighted=True)


def stored(spark: SparkSession, d: str) -> Graph:
    """The delivered edges: each position once, without null ends and ends that are no vertex; a missing weight is 1."""
    vertices = cut(read(spark, d, "vertices").select("id", "value").union(read(spark, d, "core_vertices").select("id", "value")))
    rows = read(spark, d, "edges").where("src is not null and dst is not null").select("pos", "src", "dst", "weight").distinct()
    edges = rows.join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.coalesce("weight", F.lit(1)).alias("weight"))
    return Graph(vertices, cut(edges), directed=True, weighted=True, valued=True)


def delivered(spark: SparkSession, d: str) -> Graph:
    """stored() before the check of ends: with the edges that have an end that is no vertex."""
    vertices = cut(read(spark, d, "vertices").select("id", "value").union(read(spark, d, "core_vertices").select("id", "value")))
    rows = read(spark, d, "edges").where("src is not null and dst is not null").select("pos", "src", "dst", "weight").distinct()
    return Graph(vertices, cut(rows.select("src", "dst", F.coalesce("weight", F.lit(1)).alias("weight"))), directed=True, weighted=True, valued=True)


BUILDERS: dict[str, Callable[[SparkSession, str], Graph]] = {f.__name__: f for f in (co_purchase, customer_supplier, transitions, forest, order_chain, stored, delivered)}


def graph(spark: SparkSession, d: str, name: str) -> Graph:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        _BUILT[key] = BUILDERS[name](spark, d)
    return _BUILT[key]


def ends_of_edges(edges: str = "e") -> str:
    return f"SELECT src AS id FROM {edges} UNION SELECT dst FROM {edges}"


_SUPPLY = f"""SELECT o_custkey AS src, {SUPPLIERS} + l_suppkey AS dst, count(*) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""

#: (edges, vertices) of each graph; edges are named e where vertices refer to them.
SQL = {
    "co_purchase": ("""SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a
        JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey""", ends_of_edges()),
    "customer_supplier": (f"WITH s AS ({_SUPPLY}) SELECT * FROM s UNION ALL SELECT dst, src, weight FROM s", ends_of_edges()),
    "transitions": ("""SELECT DISTINCT src, dst FROM (
        SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE src <> dst""", ends_of_edges()),
    "forest": (f"""SELECT CAST(c_custkey AS BIGINT) AS src, CAST({NATIONS} + c_nationkey AS BIGINT) AS dst FROM customer
        UNION ALL SELECT CAST({NATIONS} + n_nationkey AS BIGINT), CAST({REGIONS} + n_regionkey AS BIGINT) FROM nation""", ends_of_edges()),
    "order_chain": ("""SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER w AS dst,
        date_diff('day', o_orderdate, lead(o_orderdate) OVER w) AS weight
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE dst IS NOT NULL""",
        "SELECT o_orderkey AS id FROM orders"),
    "stored": ("""SELECT src, dst, coalesce(weight, 1) AS weight FROM (SELECT DISTINCT pos, src, dst, weight FROM edges)
        WHERE src IS NOT NULL AND dst IN (SELECT id FROM vertices UNION ALL SELECT id FROM core_vertices)""",
        "SELECT id FROM vertices UNION ALL SELECT id FROM core_vertices"),
    "delivered": ("""SELECT src, dst, coalesce(weight, 1) AS weight FROM (SELECT DISTINCT pos, src, dst, weight FROM edges)
        WHERE src IS NOT NULL AND dst IS NOT NULL""",
        "SELECT id FROM vertices UNION ALL SELECT id FROM core_vertices"),
}


def with_graph(name: str, more: str = "") -> str:
    """WITH RECURSIVE e, v and further expressions."""
    edges, vertices = SQL[name]
    return f"WITH RECURSIVE e AS MATERIALIZED ({edges}), v AS MATERIALIZED ({vertices})" + (f", {more}" if more else "")
