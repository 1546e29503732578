"""One query for each operator on graphs, and its SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import places
from ..functions.spread import spread_sql
from ..graph import UNREACHED, UNREACHED_HOPS, Graph
from ..operators import analyze, centrality, components, flow, generate, partition, ranking, sets, structure, transform, traversal
from ..sources import binary, store, text
from ..streaming import degrees as stream
from . import vertex_program
from .data_queries import read
from .graphs import graph, with_graph
from .iterate import cut, remove, shared_folder

SOURCE, HUB = 0, 17
DIGITS = 10
HALVES = (0.5, 0.5)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, of: str, sql: str | None = None):
    """Register a query on a named graph; its SQL follows WITH and has e and v."""

    def register(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, d: f(graph(spark, d, of))
        if sql is not None:
            more, _, body = sql.rpartition("\n---\n")
            ORACLE_SQL[name] = with_graph(of, more.strip()) + "\n" + body.strip()
        return f

    return register


def _joined(lists: DataFrame, *columns: str) -> DataFrame:
    """Lists as text, so that results compare by value."""
    return lists.select("id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in columns))


# Scans, degrees and analysis

_query("scan_edges", "stored", "SELECT src, dst, weight FROM e")(lambda g: g.edges)
_query("scan_vertices", "stored", "SELECT id, value FROM vertices UNION ALL SELECT id, value FROM core_vertices")(lambda g: g.vertices)

_DEGREES = "{n} AS (SELECT v.id, count(e.{by}) AS degree FROM v LEFT JOIN e ON e.{by} = v.id GROUP BY v.id)"
_OUT, _IN = _DEGREES.format(n="o", by="src"), _DEGREES.format(n="i", by="dst")

_query("out_degree", "stored", f"{_OUT}\n---\nSELECT * FROM o")(lambda g: structure.degree(g, "src"))
_query("in_degree", "stored", f"{_IN}\n---\nSELECT * FROM i")(lambda g: structure.degree(g, "dst"))
_query("degree_distribution", "stored", f"{_OUT}\n---\nSELECT degree, count(*) AS vertex_count FROM o GROUP BY degree")(analyze.degree_distribution)
_query("repeated_edges", "stored", """
    c AS (SELECT count(*) AS n FROM e GROUP BY src, dst)
---
    SELECT CAST(sum(n - 1) AS BIGINT) AS repeated, round(100 * sum(n - 1) / sum(n), 10) AS percent FROM c""")(
    lambda g: analyze.repeated_edges(g).withColumn("percent", F.round("percent", 10)))
_query("singletons_and_leaves", "stored", f"""
    {_OUT}, {_IN}
---
    SELECT count(*) FILTER (o.degree = 0 AND i.degree = 0) AS singletons, count(*) FILTER (o.degree = 0 AND i.degree > 0) AS leaves
    FROM o JOIN i USING (id)""")(analyze.singletons_and_leaves)
_SUMMARY = f"""
    {_OUT}
---
    SELECT (SELECT count(*) FROM v) AS vertex_count, (SELECT count(*) FROM e) AS edge_count,
           (SELECT count(*) FROM e WHERE src = dst) AS self_loops,
           (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM v) OR dst NOT IN (SELECT id FROM v)) AS dangling_edges,
           (SELECT max(degree) FROM o) AS max_degree,
           NOT EXISTS (SELECT src, dst FROM e EXCEPT SELECT dst, src FROM e) AS is_symmetric"""
_query("graph_summary", "stored", _SUMMARY)(analyze.summary)
_query("graph_summary_delivered", "delivered", _SUMMARY)(analyze.summary)
_query("degree_order", "forest", f"""
    {_OUT}, s AS (SELECT degree - lag(degree) OVER (ORDER BY id) AS step FROM o)
---
    SELECT CASE WHEN count(*) FILTER (step < 0) = 0 THEN 'ascending' WHEN count(*) FILTER (step > 0) = 0 THEN 'descending' ELSE 'none' END AS degree_order FROM s""")(analyze.degree_order)
_query("power_law", "stored", f"""
    {_OUT}, h AS (SELECT ln(degree) AS x, ln(count(*)) AS y FROM o WHERE degree > 0 GROUP BY degree)
---
    SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept, round(corr(x, y), 9) AS correlation FROM h""")(
    lambda g: analyze.power_law(analyze.degree_distribution(g)).select(*(F.round(c, 9).alias(c) for c in ("slope", "intercept", "correlation"))))

QUERIES["neighbour_order"] = lambda spark, d: analyze.neighbour_order(read(spark, d, "edges").select("src", "dst", "pos").where("src is not null and dst is not null").distinct())
ORACLE_SQL["neighbour_order"] = """
    WITH p AS (SELECT DISTINCT src, dst, pos FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
         s AS (SELECT dst - lag(dst) OVER (PARTITION BY src ORDER BY pos) AS step FROM p)
    SELECT CASE WHEN count(*) FILTER (step < 0) = 0 THEN 'ascending' WHEN count(*) FILTER (step > 0) = 0 THEN 'descending' ELSE 'none' END AS neighbour_order FROM s"""


def _significant(column: str) -> tuple[Column, Column]:
    """Nine significant digits."""
    x = F.col(column)
    scale = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.when(x > 0, F.round(x / scale, 8)).alias(column), F.when(x > 0, F.floor(F.log10(x)).cast("int")).alias(f"{column}_exponent")


def _summary_columns(spark: SparkSession, d: str) -> DataFrame:
    found = analyze.run_summary(read(spark, d, "bench_runs"), ["config_id"], ["total", "exec"])
    return found.select("config_id", "measure", "n", *_significant("mean"), *_significant("ci95"))


QUERIES["run_summary"] = _summary_columns
_DIGITS_SQL = "CASE WHEN {x} > 0 THEN round({x} / pow(10.0, floor(log10({x}))), 8) END AS {x}, CASE WHEN {x} > 0 THEN CAST(floor(log10({x})) AS INTEGER) END AS {x}_exponent"
ORACLE_SQL["run_summary"] = f"""
    WITH m AS (SELECT config_id, unnest([{{'measure': 'total', 'x': total}}, {{'measure': 'exec', 'x': exec}}], recursive := true) FROM bench_runs),
         s AS (SELECT config_id, measure, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM m WHERE x IS NOT NULL AND isfinite(x) GROUP BY 1, 2),
         c AS (SELECT *, CASE WHEN n > {len(analyze.T_95) + 1} THEN {analyze.Z_95} WHEN n > 1 THEN {list(analyze.T_95)}[n - 1] END * sd / sqrt(n) AS ci95 FROM s)
    SELECT config_id, measure, n, {_DIGITS_SQL.format(x="mean")}, {_DIGITS_SQL.format(x="ci95")} FROM c"""



def _rates(spark: SparkSession, d: str) -> DataFrame:
    found = analyze.rate_statistics(read(spark, d, "bench_runs"), "exec", "trv_edges")
    return found.select("n", *(F.round(c, 4).alias(c) for c in found.columns if c != "n"))


QUERIES["rate_statistics"] = _rates
ORACLE_SQL["rate_statistics"] = """
    WITH r AS (SELECT exec AS t, trv_edges AS e FROM bench_runs WHERE exec > 0 AND isfinite(exec))
    SELECT count(*) AS n, round(min(t), 4) AS time_min, round(quantile_cont(t, 0.25), 4) AS time_p25, round(quantile_cont(t, 0.5), 4) AS time_p50,
           round(quantile_cont(t, 0.75), 4) AS time_p75, round(max(t), 4) AS time_max, round(avg(t), 4) AS time_mean, round(stddev_samp(t), 4) AS time_sd,
           round(count(*) FILTER (e > 0) / sum(t / e) FILTER (e > 0), 4) AS rate_harmonic_mean FROM r"""

# Transforms

_query("reverse_graph", "order_chain", "SELECT dst AS src, src AS dst, weight FROM e")(lambda g: transform.reverse(g).edges)
_query("undirected_graph", "stored", "SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e")(lambda g: transform.undirected(g).edges)
_BOTH = "SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst"
_query("symmetrize", "stored", _BOTH)(lambda g: transform.symmetrized(g).edges)
_query("simplify_graph", "stored", f"s AS ({_BOTH})\n---\nSELECT src AS id, count(*) AS neighbours FROM s GROUP BY src")(
    lambda g: structure.degree(transform.simplified(g)).withColumnRenamed("degree", "neighbours"))
_query("induced_subgraph", "stored", """
    k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM (SELECT id, value FROM vertices UNION ALL SELECT id, value FROM core_vertices) WHERE value > 10)
---
    SELECT a.new AS src, b.new AS dst, e.weight FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst""")(
    lambda g: transform.induced_subgraph(g, g.vertices.where("value > 10")).edges)
_query("remove_singletons", "stored", """
    k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM v WHERE id IN (SELECT src FROM e) OR id IN (SELECT dst FROM e))
---
    SELECT a.new AS src, b.new AS dst, e.weight FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst""")(lambda g: transform.remove_singletons(g).edges)
_query("residual_graph", "order_chain", "SELECT src, dst, weight, true AS forward FROM e UNION ALL SELECT dst, src, 0, false FROM e")(transform.residual)
_RANKED = f"{_OUT}, r AS (SELECT id, row_number() OVER (ORDER BY degree, id) - 1 AS new FROM o)"
_query("sort_vertices_by_degree", "stored", f"{_RANKED}\n---\nSELECT a.new AS src, b.new AS dst, e.weight FROM e JOIN r a ON a.id = e.src JOIN r b ON b.id = e.dst")(lambda g: transform.sorted_by_degree(g).edges)
_query("adjacency_list", "order_chain", """
    SELECT v.id, coalesce(array_to_string(list(e.dst ORDER BY e.dst, e.weight) FILTER (e.dst IS NOT NULL), ','), '') AS neighbours,
           coalesce(array_to_string(list(e.weight ORDER BY e.dst, e.weight) FILTER (e.dst IS NOT NULL), ','), '') AS weights
    FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id""")(lambda g: _joined(transform.adjacency(g), "neighbours", "weights"))
_query("sorted_adjacency", "transitions", """
    SELECT v.id, coalesce(array_to_string(list(e.dst ORDER BY e.dst DESC) FILTER (e.dst IS NOT NULL), ','), '') AS neighbours
    FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id""")(lambda g: _joined(transform.adjacency(g, descending=True), "neighbours"))
_query("explode_adjacency", "stored", "SELECT src, dst, weight FROM e")(lambda g: transform.explode_adjacency(transform.adjacency(g)))
_query("degree_sorted_adjacency", "transitions", f"""
    {_OUT}
---
    SELECT v.id, coalesce(array_to_string(list(e.dst ORDER BY o.degree, e.dst) FILTER (e.dst IS NOT NULL), ','), '') AS neighbours
    FROM v LEFT JOIN (e JOIN o ON o.id = e.dst) ON e.src = v.id GROUP BY v.id""")(lambda g: _joined(transform.degree_sorted_adjacency(g), "neighbours"))
# The place of each row in the result as it is returned, and the leading bits there.
_query("radix_sort", "stored", f"{_OUT}\n---\nSELECT row_number() OVER (ORDER BY degree >> 2) - 1 AS place, CAST(degree >> 2 AS BIGINT) AS leading FROM o")(
    lambda g: places(transform.radix_order(structure.degree(g), "degree", 30), "place").select("place", F.shiftright(F.col("degree").cast("long"), 2).alias("leading")))
_query("permute_vertices", "stored", f"""
    r AS (SELECT id, row_number() OVER (ORDER BY {spread_sql(transform.SEED, "id")}, id) - 1 AS new FROM v)
---
    SELECT a.new AS src, b.new AS dst, e.weight FROM e JOIN r a ON a.id = e.src JOIN r b ON b.id = e.dst""")(lambda g: transform.permuted(g).edges)
_query("random_weights", "transitions", f"SELECT src, dst, {spread_sql(transform.SEED, 'src', 'dst')} % (SELECT count(*) FROM v) AS weight FROM e")(lambda g: transform.random_weights(g).edges)
_query("adjacency_chunks", "stored", """
    n AS (SELECT src AS id, dst, weight, (row_number() OVER (PARTITION BY src ORDER BY dst, weight) - 1) // 1000 AS chunk FROM e)
---
    SELECT v.id, CAST(coalesce(n.chunk, 0) AS INTEGER) AS chunk, coalesce(array_to_string(list(n.dst ORDER BY n.dst, n.weight) FILTER (n.dst IS NOT NULL), ','), '') AS neighbours
    FROM v LEFT JOIN n USING (id) GROUP BY v.id, n.chunk""")(
    lambda g: transform.adjacency(g, most=1000).select("id", "chunk", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours")))
_query("direction_check", "co_purchase", """
    SELECT false AS labelled_directed, NOT EXISTS (SELECT src, dst FROM e EXCEPT SELECT dst, src FROM e) AS is_symmetric, 'undirected' AS direction""")(analyze.direction)
_query("direction_check_stored", "stored", """
    SELECT true AS labelled_directed, NOT EXISTS (SELECT src, dst FROM e EXCEPT SELECT dst, src FROM e) AS is_symmetric, 'directed' AS direction""")(analyze.direction)

# Partitions

_HALF = """h AS (SELECT id, degree, CASE WHEN coalesce(sum(degree) OVER (ORDER BY degree {d}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    < 0.5 * (SELECT count(*) FROM e) THEN 0 ELSE 1 END AS pid FROM o)"""
_ASC, _DESC = f"{_OUT}, {_HALF.format(d='')}", f"{_OUT}, {_HALF.format(d='DESC')}"
_query("partition_by_degree_asc", "stored", f"{_ASC}\n---\nSELECT id, pid FROM h")(lambda g: partition.by_degree(g, HALVES))
_query("partition_by_degree_desc", "stored", f"{_DESC}\n---\nSELECT id, pid FROM h")(lambda g: partition.by_degree(g, HALVES, descending=True))
_query("partition_local_ids", "stored", f"{_ASC}\n---\nSELECT id, pid, row_number() OVER (PARTITION BY pid ORDER BY degree, id) - 1 AS local_id FROM h")(
    lambda g: partition.local_ids(g, partition.by_degree(g, HALVES)))
_ENDS = "x AS (SELECT e.*, a.pid AS src_pid, b.pid AS dst_pid FROM e JOIN h a ON a.id = e.src JOIN h b ON b.id = e.dst)"
_query("partition_edges", "stored", f"{_ASC}, {_ENDS}\n---\nSELECT * FROM x")(lambda g: partition.partitioned_edges(g, partition.by_degree(g, HALVES)))
_query("partition_stats", "stored", f"""
    {_DESC}, {_ENDS}, s AS (SELECT pid, count(*) AS vertices FROM h GROUP BY pid),
    y AS (SELECT src_pid AS pid, count(*) AS edges, count(*) FILTER (src_pid <> dst_pid) AS remote_edges, count(DISTINCT dst) FILTER (src_pid <> dst_pid) AS remote_vertices FROM x GROUP BY 1)
---
    SELECT pid, vertices, coalesce(edges, 0) AS edges, coalesce(remote_edges, 0) AS remote_edges, coalesce(remote_vertices, 0) AS remote_vertices,
           coalesce(round(100.0 * remote_vertices / edges, 9), 0) AS beta FROM s LEFT JOIN y USING (pid)""")(
    lambda g: partition.partition_stats(g, partition.by_degree(g, HALVES, descending=True)).withColumn("beta", F.round("beta", 9)))
_query("partition_modularity", "stored", f"""
    {_DESC}, {_ENDS}, y AS (SELECT count(*) FILTER (src_pid = dst_pid) / CAST((SELECT count(*) FROM e) AS DOUBLE) AS l,
                                    count(*) FILTER (src_pid <> dst_pid) / CAST((SELECT count(*) FROM e) AS DOUBLE) AS r FROM x GROUP BY src_pid)
---
    SELECT round(sum(l - r * r), 9) AS modularity FROM y""")(
    lambda g: partition.modularity(g, partition.by_degree(g, HALVES, descending=True)).select(F.round("modularity", 9).alias("modularity")))
_BY_SPREAD = f"p AS (SELECT id, {spread_sql(partition.SEED, 'id')} AS x FROM v)"
_query("partition_random_fraction", "stored", f"""
    {_BY_SPREAD}, r AS (SELECT id, row_number() OVER (ORDER BY x, id) - 1 AS k, count(*) OVER () AS n FROM p)
---
    SELECT id, CASE WHEN k < floor(n * 0.2::DOUBLE) THEN 0 WHEN k < floor(n * 0.2::DOUBLE) + floor(n * 0.3::DOUBLE) THEN 1 ELSE 2 END AS pid FROM r""")(
    lambda g: partition.by_fractions(g, (0.2, 0.3, 0.5)))
_query("partition_random", "stored", f"{_BY_SPREAD}\n---\nSELECT id, CAST(x % 4 AS INTEGER) AS pid FROM p")(lambda g: partition.by_hash(g, 4))
# Three partitions: where each ends depends on where the one before crossed its share.
_FILLED = """{out}, m AS (SELECT count(*) AS m FROM e),
    x AS (SELECT id, degree, row_number() OVER w - 1 AS i, coalesce(sum(degree) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WINDOW w AS (ORDER BY degree {d}, id)),
    c1 AS (SELECT max(before + degree) AS c FROM x, m WHERE before < {f}::DOUBLE * m), c2 AS (SELECT max(before + degree) AS c FROM x, m, c1 WHERE before >= c AND before < c + {f}::DOUBLE * m),
    h AS (SELECT x.*, CASE WHEN before < c1.c THEN 0 WHEN before < c2.c THEN 1 ELSE 2 END AS pid FROM x, c1, c2)"""
_THREE = _FILLED.format(out=_OUT, d="", f=0.3)
_query("partition_three", "stored", f"{_THREE}\n---\nSELECT id, pid FROM h")(lambda g: partition.by_degree(g, (0.3, 0.3, 0.4)))
_query("partition_even", "stored", f"{_FILLED.format(out=_OUT, d='DESC', f=repr(1 / 3))}\n---\nSELECT id, pid FROM h")(lambda g: partition.by_degree(g, 3, descending=True))
_query("partition_lambda", "stored", f"""
    {_THREE}, y AS (SELECT h.*, m - before - degree AS after FROM h, m),
    l1 AS (SELECT max(after + degree) AS l FROM y, m WHERE after < 0.1::DOUBLE * m), l2 AS (SELECT max(after + degree) AS l FROM y, m, l1 WHERE after >= l AND after < l + 0.1::DOUBLE * m)
---
    SELECT id, CASE WHEN i > 0 AND after < l1.l THEN 0 WHEN i > 0 AND after < l2.l THEN 1 ELSE pid END AS pid FROM y, l1, l2""")(
    lambda g: partition.by_degree(g, (0.3, 0.3, 0.4), from_end=0.2))
_query("partition_singletons", "stored", f"""
    {_DESC}
---
    SELECT id, CASE WHEN degree = 0 THEN 1 WHEN pid = 0 THEN 0 ELSE 2 END AS pid FROM h""")(
    lambda g: partition.by_degree(g, (0.5, 0.2, 0.3), descending=True, singletons=True))
_query("partition_randomized", "stored", f"""
    {_THREE}
---
    SELECT id, CAST(CASE WHEN pid < 2 THEN {spread_sql(partition.SEED, 'id')} % 2 ELSE pid END AS INTEGER) AS pid FROM h""")(
    lambda g: partition.shuffled_among(partition.by_degree(g, (0.3, 0.3, 0.4)), 0, 2))

# Sets and look-ups

_query("vertex_set_difference", "stored", "SELECT DISTINCT src AS id FROM e WHERE src NOT IN (SELECT dst FROM e)")(
    lambda g: sets.difference(g.edges.select(F.col("src").alias("id")), g.edges.select(F.col("dst").alias("id"))))
_query("vertex_set_symmetric_difference", "stored", """
    a AS (SELECT DISTINCT src AS id FROM e), b AS (SELECT DISTINCT dst AS id FROM e)
---
    SELECT id FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id FROM b WHERE id NOT IN (SELECT id FROM a)""")(
    lambda g: sets.symmetric_difference(g.edges.select(F.col("src").alias("id")), g.edges.select(F.col("dst").alias("id"))))
_query("vertex_set_size", "stored", "SELECT count(DISTINCT src) AS size FROM e")(lambda g: sets.size(g.edges.select(F.col("src").alias("id"))))
_query("value_lookup", "stored", """
    t AS (SELECT id, value FROM vertices UNION ALL SELECT id, value FROM core_vertices)
---
    SELECT e.dst AS id, coalesce(t.value, -1) AS value FROM e LEFT JOIN t ON t.id = e.dst""")(
    lambda g: sets.get(g.edges.select(F.col("dst").alias("id")), g.vertices))

# Ranks

_PUSH = """
    n AS (SELECT count(*) AS n FROM v), {out}, r0 AS (SELECT id, degree, 1.0::DOUBLE / n AS rank, 1.0::DOUBLE / n AS sent FROM o, n), {rounds}
---
    SELECT id, round(rank, {digits}) AS rank FROM r{last}"""


def _rounds(count: int, join: str, group: str, keep: bool = False, when_none: str = "NULL") -> str:
    rank = "0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(s.got, 0)"
    if keep:
        rank = f"CASE WHEN r.degree = 0 THEN 1.0::DOUBLE / n ELSE {rank} END"
    one = """s{k} AS (SELECT {group} AS id, sum(sent) AS got FROM e JOIN r{p} ON r{p}.id = e.{join} GROUP BY 1),
        r{k} AS (SELECT id, degree, rank, CASE WHEN degree > 0 THEN rank / degree ELSE {none} END AS sent
                 FROM (SELECT r.id, r.degree, {rank} AS rank FROM r{p} r CROSS JOIN n LEFT JOIN s{k} s ON s.id = r.id))"""
    return ", ".join(one.format(k=k, p=k - 1, join=join, group=group, rank=rank, none=when_none) for k in range(1, count + 1))


def _ranked(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", F.round("rank", DIGITS).alias("rank"))


_query("pagerank", "co_purchase", _PUSH.format(out=_OUT, rounds=_rounds(5, "src", "dst"), digits=DIGITS, last=5))(lambda g: _ranked(ranking.pagerank(g)))
_query("pagerank_stored", "stored", _PUSH.format(out=_OUT, rounds=_rounds(5, "src", "dst"), digits=DIGITS, last=5))(lambda g: _ranked(ranking.pagerank(g)))
_query("pagerank_hybrid4", "stored", _PUSH.format(out=_OUT, rounds=_rounds(4, "src", "dst", keep=True), digits=DIGITS, last=4))(lambda g: _ranked(ranking.pagerank_hybrid(g)))
_query("pagerank_incoming", "co_purchase", _PUSH.format(out=_OUT, rounds=_rounds(5, "dst", "src", when_none="0"), digits=DIGITS, last=5))(lambda g: _ranked(ranking.pagerank_incoming(g)))

# Traversals

_HOPS = """h(id, d) USING KEY (id) AS (SELECT {source}::BIGINT, 0 UNION
    SELECT e.dst, min(h.d + 1) FROM h JOIN e ON h.id = e.src LEFT JOIN recurring.h p ON p.id = e.dst WHERE p.id IS NULL GROUP BY e.dst)"""
_LEVELS, _FROM_HUB = _HOPS.format(source=SOURCE), _HOPS.format(source=HUB)
_COST = f"SELECT v.id, coalesce(h.d, {UNREACHED_HOPS})::INTEGER AS cost FROM v LEFT JOIN h USING (id)"
_query("bfs_levels", "co_purchase", f"{_LEVELS}\n---\n{_COST}")(lambda g: traversal.bfs(g, SOURCE))
_query("bfs_levels_stored", "stored", f"{_FROM_HUB}\n---\n{_COST}")(lambda g: traversal.bfs(g, HUB))
_query("bfs_push", "order_chain", f"{_LEVELS}\n---\n{_COST}")(lambda g: traversal.bfs(g, SOURCE, direction="push"))
_query("bfs_pull", "co_purchase", f"{_LEVELS}\n---\n{_COST}")(lambda g: traversal.bfs(g, SOURCE, direction="pull"))
_TREE = f"""t AS (SELECT b.id, min(a.id) AS parent FROM h a JOIN e ON e.src = a.id JOIN h b ON b.id = e.dst AND b.d = a.d + 1 GROUP BY b.id
        UNION ALL SELECT id, id FROM h WHERE d = 0)
---
    SELECT v.id, coalesce(t.parent, {UNREACHED}) AS parent FROM v LEFT JOIN t USING (id)"""
_query("bfs_tree", "co_purchase", f"{_LEVELS}, {_TREE}")(lambda g: traversal.bfs_tree(g, SOURCE))
_query("bfs_tree_stored", "stored", f"{_FROM_HUB}, {_TREE}")(lambda g: traversal.bfs_tree(g, HUB))


def _broken_tree(g: Graph) -> DataFrame:
    """The tree with wrong parents: vertices of large values are their own, and those without a value have the root."""
    tree = traversal.bfs_tree(g, HUB).join(g.vertices, "id")
    reached = (F.col("parent") != UNREACHED) & (F.col("id") != HUB)
    return tree.select("id", F.when(reached & (F.col("value") > 10), F.col("id")).when(reached & F.col("value").isNull(), F.lit(HUB)).otherwise(F.col("parent")).alias("parent"))


_query("bfs_tree_validate", "stored", f"""
    {_FROM_HUB}, {_TREE.partition("---")[0]}, w AS (SELECT id, value FROM vertices UNION ALL SELECT id, value FROM core_vertices),
    x AS (SELECT id, CASE WHEN id = {HUB} THEN parent WHEN value > 10 THEN id WHEN value IS NULL THEN {HUB} ELSE parent END AS parent FROM t JOIN w USING (id)),
    l(id, d) USING KEY (id) AS (SELECT id, 0 FROM x WHERE id = {HUB} UNION SELECT x.id, l.d + 1 FROM l JOIN x ON x.parent = l.id AND x.id <> x.parent),
    q AS (SELECT a.d AS la, b.d AS lb FROM e LEFT JOIN l a ON a.id = e.src LEFT JOIN l b ON b.id = e.dst)
---
    SELECT CAST(NOT EXISTS (SELECT 1 FROM x WHERE id = {HUB} AND parent = {HUB}) AS BIGINT) AS bad_root,
           (SELECT count(*) FROM x WHERE id <> parent AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = x.parent AND e.dst = x.id)) AS not_in_graph,
           (SELECT count(*) FROM x WHERE id NOT IN (SELECT id FROM l)) AS no_path,
           (SELECT count(*) FROM q WHERE la IS NOT NULL AND lb IS NULL) AS one_end, (SELECT count(*) FROM q WHERE lb - la > 1) AS level_gap""")(
    lambda g: traversal.validate_tree(g, _broken_tree(g), HUB))
_query("st_connectivity", "forest", f"""
    {_LEVELS}
---
    SELECT 0::BIGINT AS source, 2000001::BIGINT AS target, count(*) > 0 AS reachable, min(d)::INTEGER AS hops FROM h WHERE id = 2000001""")(
    lambda g: traversal.st_connectivity(g, SOURCE, 2_000_001))
_query("traversed_edges", "stored", f"{_FROM_HUB}\n---\nSELECT count(*) AS traversed_edges FROM e WHERE src IN (SELECT id FROM h)")(
    lambda g: traversal.traversed_edges(g, traversal.bfs(g, HUB)))
_SHORTEST = """h(id, d) USING KEY (id) AS (SELECT {source}::BIGINT, 0::BIGINT UNION
    SELECT e.dst, min(h.d + e.weight) FROM h JOIN e ON h.id = e.src LEFT JOIN recurring.h p ON p.id = e.dst GROUP BY e.dst
    HAVING min(h.d + e.weight) < coalesce(min(p.d), 9000000000000000000))"""
_query("sssp", "stored", f"{_SHORTEST.format(source=HUB)}\n---\nSELECT v.id, coalesce(h.d, {UNREACHED}) AS distance FROM v LEFT JOIN h USING (id)")(lambda g: traversal.sssp(g, HUB))
_query("sssp_chain", "order_chain", f"{_SHORTEST.format(source=SOURCE)}\n---\nSELECT v.id, coalesce(h.d, {UNREACHED}) AS distance FROM v LEFT JOIN h USING (id)")(lambda g: traversal.sssp(g, SOURCE))
_PAIRS = """h(s, id, d) USING KEY (s, id) AS (SELECT id, id, 0::BIGINT FROM v UNION
    SELECT h.s, e.dst, min(h.d + {w}) FROM h JOIN e ON h.id = e.src LEFT JOIN recurring.h p ON p.s = h.s AND p.id = e.dst GROUP BY h.s, e.dst
    HAVING min(h.d + {w}) < coalesce(min(p.d), 9000000000000000000))"""
_query("apsp", "order_chain", f"{_PAIRS.format(w='e.weight')}\n---\nSELECT s AS src, id AS dst, d AS distance FROM h")(traversal.apsp)

# Components

_WEAK = "w AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_LABELS = """h(id, l) USING KEY (id) AS (SELECT id, id FROM v UNION
    SELECT t.dst, min(h.l) FROM h JOIN {edges} t ON h.id = t.src JOIN recurring.h p ON p.id = t.dst GROUP BY t.dst HAVING min(h.l) < min(p.l))"""
_query("connected_components", "order_chain", f"{_WEAK}, {_LABELS.format(edges='w')}\n---\nSELECT id, l AS label FROM h")(components.connected_components)
_query("connected_components_stored", "stored", f"{_WEAK}, {_LABELS.format(edges='w')}\n---\nSELECT id, l AS label FROM h")(components.connected_components)
_query("cc_out", "order_chain", f"{_LABELS.format(edges='e')}\n---\nSELECT id, l AS label FROM h")(lambda g: components.connected_components(g, "out"))
_query("component_stats", "forest", f"""
    {_WEAK}, {_LABELS.format(edges="w")}, m AS (SELECT id, dense_rank() OVER (ORDER BY l) - 1 AS component FROM h),
    s AS (SELECT component, count(DISTINCT id) AS vertex_count, count(e.src) AS edge_count FROM m LEFT JOIN e ON e.src = m.id GROUP BY component)
---
    SELECT *, component = (SELECT component FROM s ORDER BY vertex_count DESC, component LIMIT 1) AS is_biggest FROM s""")(components.component_stats)
_LP_TURNS = 3
_query("label_propagation", "transitions", f"""
    {_OUT}, p0 AS (SELECT id, id AS label, 1.0::DOUBLE AS p FROM o WHERE degree > 0 UNION ALL SELECT e.src, e.dst, 1.0::DOUBLE / degree FROM e JOIN o ON o.id = e.src),
    {", ".join(f"p{k} AS (SELECT e.src AS id, q.label, sum(q.p) / any_value(o.degree) AS p FROM e JOIN p{k - 1} q ON q.id = e.dst JOIN o ON o.id = e.src GROUP BY 1, 2)" for k in range(1, _LP_TURNS + 1))},
    b AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY round(p, 7) DESC, label) AS k FROM p{_LP_TURNS})
---
    SELECT v.id, coalesce(b.label, v.id) AS label FROM v LEFT JOIN b ON b.id = v.id AND b.k = 1""")(
    lambda g: components.label_propagation(g, turns=_LP_TURNS))
# All turns up to the limit, the labels after each, and the turn after which labels were stable for long enough.
_query("label_propagation_stable", "transitions", f"""
    {_OUT}, p(turn, id, label, p) AS (SELECT 0, id, id, 1.0::DOUBLE FROM o WHERE degree > 0 UNION ALL SELECT 0, e.src, e.dst, 1.0::DOUBLE / degree FROM e JOIN o ON o.id = e.src UNION ALL
        SELECT q.turn + 1, e.src, q.label, sum(q.p) / any_value(o.degree) FROM e JOIN p q ON q.id = e.dst JOIN o ON o.id = e.src WHERE q.turn < {components.LP_TURNS} GROUP BY 1, 2, 3),
    b AS MATERIALIZED (SELECT turn, id, label FROM p WHERE turn > 0 QUALIFY row_number() OVER (PARTITION BY turn, id ORDER BY round(p, 7) DESC, label) = 1),
    c AS (SELECT y.turn, count(*) FILTER (x.label <> y.label) AS changed FROM b y JOIN b x ON x.id = y.id AND x.turn = y.turn - 1 GROUP BY y.turn),
    q AS (SELECT turn, sum(changed) OVER w AS changed, count(*) OVER w AS n FROM c WINDOW w AS (ORDER BY turn ROWS BETWEEN {components.LP_STABLE - 1} PRECEDING AND CURRENT ROW)),
    z AS (SELECT coalesce(min(turn), {components.LP_TURNS}) AS turn FROM q WHERE changed = 0 AND n = {components.LP_STABLE})
---
    SELECT v.id, coalesce(b.label, v.id) AS label FROM v LEFT JOIN b ON b.id = v.id AND b.turn = (SELECT turn FROM z)""")(
    components.label_propagation)

# Structure

_SIMPLE = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst)"
_TRIANGLES = f"""{_SIMPLE}, t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b),
    c AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id)"""
_query("triangle_count", "co_purchase", f"{_TRIANGLES}\n---\nSELECT v.id, coalesce(n, 0) AS triangles FROM v LEFT JOIN c USING (id)")(structure.triangle_count)
_query("clustering_coefficient", "transitions", f"""
    {_TRIANGLES}, g AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id)
---
    SELECT v.id, round(CASE WHEN d >= 2 THEN 2.0 * coalesce(n, 0) / (d * (d - 1)) ELSE 0 END, {DIGITS}) AS coefficient FROM v LEFT JOIN g USING (id) LEFT JOIN c USING (id)""")(
    lambda g: structure.clustering_coefficient(g).select("id", F.round("coefficient", DIGITS).alias("coefficient")))
# Peeled wave by wave: the round is the largest so far, or that of the least sum left, and who supports no more goes.
_query("pcore", "customer_supplier", """
    h(id, r) USING KEY (id) AS (SELECT id, -1::BIGINT FROM v UNION
        SELECT id, r FROM (
            SELECT s.id, s.need, greatest((SELECT max(r) FROM recurring.h), min(s.need) OVER ()) AS r FROM (
                SELECT p.id, CAST(ceil(coalesce(sum(e.weight) FILTER (q.r = -1), 0) / 5.0) AS BIGINT) AS need
                FROM recurring.h p LEFT JOIN e ON e.src = p.id LEFT JOIN recurring.h q ON q.id = e.dst
                WHERE p.r = -1 AND EXISTS (SELECT 1 FROM h) GROUP BY p.id) s)
        WHERE need <= r)
---
    SELECT id, r AS round FROM h""")(lambda g: structure.pcore(g, start=0, step=5))

# Centralities

_HOPS_FROM = """h(s, id, d) USING KEY (s, id) AS (SELECT id, id, 0 FROM {start} UNION
    SELECT h.s, e.dst, min(h.d + 1) FROM h JOIN e ON h.id = e.src LEFT JOIN recurring.h p ON p.s = h.s AND p.id = e.dst WHERE p.id IS NULL GROUP BY h.s, e.dst)"""
_ALL_HOPS = _HOPS_FROM.format(start="v")
_query("closeness", "transitions", f"""
    {_ALL_HOPS}, c AS (SELECT s AS id, count(*) AS c, sum(d) AS t FROM h GROUP BY s)
---
    SELECT id, round(CASE WHEN t > 0 THEN (c - 1) * (c - 1) / (((SELECT count(*) FROM v) - 1) * CAST(t AS DOUBLE)) ELSE 0 END, {DIGITS}) AS score FROM c""")(
    lambda g: centrality.closeness(g).select("id", F.round("score", DIGITS).alias("score")))
_DEPTH = 6


def _paths(depth: int, gain: str, start: str = "v") -> str:
    """Numbers of paths by level, and what comes back, down from the deepest level; levels beyond the graph's are empty."""
    out = [f"f0 AS (SELECT id AS s, id, 1.0::DOUBLE AS p FROM {start})"]
    for k in range(1, depth + 1):
        out.append(f"f{k} AS MATERIALIZED (SELECT h.s, h.id, sum(f.p) AS p FROM f{k - 1} f JOIN e ON e.src = f.id JOIN h ON h.s = f.s AND h.id = e.dst AND h.d = {k} GROUP BY 1, 2)")
    out.append(f"b{depth} AS (SELECT s, id, p, 0.0::DOUBLE AS g FROM f{depth})")
    for k in range(depth - 1, 0, -1):
        out.append(f"b{k} AS MATERIALIZED (SELECT f.s, f.id, any_value(f.p) AS p, coalesce(sum({gain}), 0) AS g FROM f{k} f LEFT JOIN (e JOIN b{k + 1} b ON b.id = e.dst) ON e.src = f.id AND b.s = f.s GROUP BY 1, 2)")
    return ", ".join(out)


_BACK = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(1, _DEPTH))
_query("betweenness_exact", "transitions", f"""
    {_ALL_HOPS}, {_paths(_DEPTH, "f.p / b.p * (1 + b.g)")}, z AS (SELECT id, sum(g) AS g FROM ({_BACK}) GROUP BY id)
---
    SELECT v.id, round(coalesce(g, 0), 6) AS score FROM v LEFT JOIN z USING (id)""")(
    lambda g: centrality.betweenness(g).select("id", F.round("score", 6).alias("score")))
_query("stress", "transitions", f"""
    {_ALL_HOPS}, {_paths(_DEPTH, "1 + b.g")}, z AS (SELECT id, sum(g * p) AS g FROM ({_BACK}) GROUP BY id)
---
    SELECT v.id, CAST(round(coalesce(g, 0)) AS BIGINT) AS score FROM v LEFT JOIN z USING (id)""")(centrality.stress)
_query("betweenness", "transitions", f"""
    k AS MATERIALIZED (SELECT id FROM v WHERE id IN (SELECT src FROM e) ORDER BY {spread_sql(centrality.SEED, "id")}, id
        LIMIT (SELECT CAST(floor(log2(count(*))) / (0.5::DOUBLE * 0.5::DOUBLE) AS BIGINT) FROM v)),
    {_HOPS_FROM.format(start="k")}, {_paths(_DEPTH, "f.p / b.p * (1 + b.g)", "k")}, z AS (SELECT id, sum(g) AS g FROM ({_BACK}) GROUP BY id)
---
    SELECT v.id, round(coalesce(g, 0) * ((SELECT count(*) FROM v) / (SELECT count(*) FROM k)::DOUBLE), 6) AS score FROM v LEFT JOIN z USING (id)""")(
    lambda g: centrality.betweenness(g, epsilon=0.5, batch=16).select("id", F.round("score", 6).alias("score")))
_query("centrality_samples", "stored", "SELECT least(CAST(floor(floor(log2(count(*))) / (0.2::DOUBLE * 0.2::DOUBLE)) AS BIGINT), count(*)) AS samples FROM v")(
    lambda g: centrality.samples(g, 0.2).agg(F.count(F.lit(1)).alias("samples")))

# Vertex programs and flow

_query("pregel_in_degree", "stored", f"{_IN}\n---\nSELECT id, degree AS state FROM i")(
    lambda g: vertex_program.run(g, F.lit(0).cast("long"), F.lit(1).cast("long"), "sum", F.coalesce("message", F.lit(0)), active=F.lit(False), max_steps=1))
_query("pregel_components", "order_chain", f"{_WEAK}, {_LABELS.format(edges='w')}\n---\nSELECT id, l AS state FROM h")(
    lambda g: vertex_program.run(g, F.col("id"), F.col("state"), "min", F.least("state", "message"), against=F.col("state")))

_query("pregel_largest", "order_chain", f"{_WEAK}, {_LABELS.format(edges='w').replace('min(', 'max(').replace('max(h.l) < max(p.l)', 'max(h.l) > max(p.l)')}\n---\nSELECT id, l AS state FROM h")(
    lambda g: vertex_program.run(g, F.col("id"), F.col("state"), "max", F.greatest("state", "message"), against=F.col("state")))
_query("pregel_gathered_levels", "stored", f"{_FROM_HUB}\n---\nSELECT v.id, h.d::BIGINT AS state FROM v LEFT JOIN h USING (id)")(
    lambda g: vertex_program.run(g, F.when(F.col("id") == HUB, 0).cast("long"), F.col("state") + 1, "min", F.col("message"), gather=F.col("state").isNull()))
_query("pregel_rank", "stored", f"""
    {_OUT}, n AS (SELECT count(*) AS n FROM v), a AS (SELECT id, degree, 1.0::DOUBLE / n AS x FROM o, n),
    b AS (SELECT e.dst AS id, sum(x / degree) AS got FROM e JOIN a ON a.id = e.src GROUP BY 1)
---
    SELECT v.id, round(0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0), {DIGITS}) AS state FROM v CROSS JOIN n LEFT JOIN b USING (id)""")(
    lambda g: _one_rank(g))


def _one_rank(g: Graph) -> DataFrame:
    """A program in which vertices without messages change, too: a round of rank over edges with their share as weight."""
    n = g.vertex_count()
    shares = g.edges.select("src", "dst").join(structure.degree(g).withColumnRenamed("id", "src"), "src").select("src", "dst", F.col("degree").alias("weight"))
    shared = Graph(g.vertices, shares, directed=True, weighted=True)
    rank = vertex_program.run(shared, F.lit(1.0 / n), F.col("state") / F.col("weight"), "sum", F.lit(0.15 / n) + 0.85 * F.coalesce("message", F.lit(0.0)), idle=True, max_steps=1)
    return rank.select("id", F.round("state", DIGITS).alias("state"))


def _supply_network(spark: SparkSession, d: str) -> Graph:
    """From -1 to all customers, to suppliers, to -2; suppliers pass on at most 100 lines."""
    lines = graph(spark, d, "customer_supplier").edges.where("src < dst")
    customers, suppliers = lines.groupBy("src").agg(F.sum("weight").alias("w")), lines.select("dst").distinct()
    start = customers.select(F.lit(-1).cast("long"), "src", "w")
    end = suppliers.select("dst", F.lit(-2).cast("long"), F.lit(100).cast("long"))
    return Graph.of_edges(lines.union(start).union(end), directed=True, weighted=True)


QUERIES["maxflow"] = lambda spark, d: flow.maxflow(_supply_network(spark, d), -1, -2)
ORACLE_SQL["maxflow"] = with_graph("customer_supplier") + """
    SELECT -1::BIGINT AS source, -2::BIGINT AS sink, CAST(sum(least(w, 100)) AS BIGINT) AS flow
    FROM (SELECT dst, sum(weight) AS w FROM e WHERE src < dst GROUP BY dst)"""

# Generators

QUERIES["rmat"] = lambda spark, d: analyze.degree_distribution(generate.rmat(spark, generate.SCALE))
_COUNTS = ("vertex_count", "edge_count", "self_loops", "dangling_edges")


def _uniform_sql(scale: int) -> str:
    n = (1 << scale) - 2
    return f"""WITH e AS (SELECT {spread_sql(generate.SEED, "range")} % {n} AS src, {spread_sql(generate.SEED + 1, "range")} % {n - 1} + 1 AS shift FROM range({16 * n}))
        SELECT src, (src + shift) % {n} AS dst FROM e"""


QUERIES["uniform_graph"] = lambda spark, d: generate.uniform(spark, 12).edges
ORACLE_SQL["uniform_graph"] = _uniform_sql(12)
QUERIES["uniform_degrees_20"] = lambda spark, d: analyze.degree_distribution(generate.uniform(spark, generate.SCALE))
ORACLE_SQL["uniform_degrees_20"] = f"""
    SELECT degree, count(*) AS vertex_count FROM (SELECT v.range AS id, count(src) AS degree FROM range({(1 << generate.SCALE) - 2}) v LEFT JOIN ({_uniform_sql(generate.SCALE)}) ON src = v.range GROUP BY 1) GROUP BY 1"""
QUERIES["rmat_summary_20"] = lambda spark, d: analyze.summary(generate.rmat(spark, generate.SCALE).written()).select(*_COUNTS)
ORACLE_SQL["rmat_summary_20"] = f"SELECT {(1 << generate.SCALE) - 2}::BIGINT AS vertex_count, {16 * ((1 << generate.SCALE) - 2)}::BIGINT AS edge_count, 0::BIGINT AS self_loops, 0::BIGINT AS dangling_edges"
QUERIES["kronecker"] = lambda spark, d: analyze.degree_distribution(generate.kronecker(spark, generate.SCALE))
QUERIES["bter"] = lambda spark, d: analyze.degree_distribution(generate.bter(spark, [(1, 200_000), (2, 435_500), (5, 317_750), (20, 95_324)]))

# Streams


def _stream_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Each batch appends the counts that it changed; a count only grows, so the largest is the newest."""
    folder = f"{shared_folder(spark)}/arcweave-stream-{uuid.uuid4().hex}"
    counts = stream.running_degrees(stream.edge_stream(spark, f"{d}/edges.parquet*"))
    writer = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/degrees/batch={n}")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/degrees").groupBy("id").agg(F.max("degree").alias("degree"))


QUERIES["stream_degrees"] = _stream_degrees
ORACLE_SQL["stream_degrees"] = "SELECT src AS id, count(*) AS degree FROM edges WHERE src IS NOT NULL GROUP BY src"

# Files: each graph is written, read again and kept as a table; the files go.

_KEPT_SQL = "k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM v WHERE id IN (SELECT src FROM e) OR id IN (SELECT dst FROM e))"
_DENSE_SQL = f"{_KEPT_SQL}\n---\nSELECT a.new AS src, b.new AS dst, e.weight FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst"


def _through(form: Callable[[Graph, str], Graph]) -> Callable[[Graph], DataFrame]:
    def run(g: Graph) -> DataFrame:
        path = f"{shared_folder(g.spark)}/arcweave-files-{uuid.uuid4().hex}"
        rows = cut(form(transform.remove_singletons(g).written(), path).edges)
        remove(g.spark, path)
        return rows

    return run


def _as_text(g: Graph, path: str) -> Graph:
    text.write_text(g, f"{path}/g")
    return text.read_text(g.spark, text.concatenated(g.spark, f"{path}/g"), weighted=True)


def _as_binary(g: Graph, path: str) -> Graph:
    g.spark.range(1).write.parquet(path)  # makes the folder
    binary.write_binary(g, f"{path}/g.bin")
    return binary.read_binary(g.spark, f"{path}/g.bin", weighted=True)


def _as_store(g: Graph, path: str) -> Graph:
    store.write_graph(g, path)
    return store.load(g.spark, path)


def _as_edge_list(g: Graph, path: str) -> Graph:
    """Ids that are not dense, in lines of their own kind of separator."""
    g.edges.select(F.format_string("%d\t: %d", F.col("src") * 3 + 5, F.col("dst") * 3 + 5).alias("line")).write.text(path)
    return text.read_edge_list(g.spark, path)


def _as_matrix(g: Graph, path: str) -> Graph:
    g.edges.select(F.format_string("%d %d 1.5", F.col("src") + 1, F.col("dst") + 1).alias("line")).write.text(path)
    return text.read_sparse_matrix(g.spark, path)


_query("text_round_trip", "stored", _DENSE_SQL)(_through(_as_text))
_query("binary_round_trip", "stored", _DENSE_SQL)(_through(_as_binary))
_query("store_round_trip", "stored", _DENSE_SQL)(_through(_as_store))
_query("edge_list", "stored", _DENSE_SQL.replace(", e.weight", ""))(_through(_as_edge_list))
_query("sparse_matrix", "stored", _DENSE_SQL.replace(", e.weight", "").replace("a.new AS", "a.new + 1 AS").replace("b.new AS", "b.new + 1 AS"))(_through(_as_matrix))
