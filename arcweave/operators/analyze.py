"""What a graph is like: counts, checks and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import with_previous, with_running
from ..graph import Graph
from ..plans.iterate import scoped
from .structure import degree

ORDERS = ("ascending", "descending", "none")


def _order(rises: str, falls: str):
    """Of two flags whether there is any rise and any fall."""
    return F.when(~F.coalesce(F.col(falls), F.lit(False)), ORDERS[0]).when(~F.coalesce(F.col(rises), F.lit(False)), ORDERS[1]).otherwise(ORDERS[2])


def is_symmetric(graph: Graph) -> bool:
    """Whether every edge has its reverse."""
    pairs = graph.edges.select("src", "dst").distinct()
    return pairs.join(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").isEmpty()


DIRECTIONS = {
    (True, False): "directed", (True, True): "labelled directed, with every edge in both directions",
    (False, True): "undirected", (False, False): "invalid: labelled undirected, without the reverse of every edge",
}


def direction(graph: Graph) -> DataFrame:
    """One row (labelled_directed, is_symmetric, direction): what the label says, what the edges say, and one of the four
    outcomes of comparing them."""
    symmetric = is_symmetric(graph)
    return graph.spark.range(1).select(F.lit(graph.directed).alias("labelled_directed"), F.lit(symmetric).alias("is_symmetric"), F.lit(DIRECTIONS[graph.directed, symmetric]).alias("direction"))


@scoped
def summary(graph: Graph) -> DataFrame:
    """One row (vertex_count, edge_count, self_loops, dangling_edges, max_degree, is_symmetric); dangling edges have an
    end that is no vertex."""
    ids = graph.vertices.select("id")
    vertices = graph.vertices.agg(F.count(F.lit(1)).alias("vertex_count"))
    edges = graph.edges.agg(F.count(F.lit(1)).alias("edge_count"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"))
    whole = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").agg(F.count(F.lit(1)).alias("whole"))
    most = degree(graph).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))
    row = vertices.first().asDict() | edges.first().asDict() | most.first().asDict()
    row["dangling_edges"] = row["edge_count"] - whole.first()[0]
    numbers = [F.lit(row[k]).cast("long").alias(k) for k in ("vertex_count", "edge_count", "self_loops", "dangling_edges", "max_degree")]
    return graph.spark.range(1).select(*numbers, F.lit(is_symmetric(graph)).alias("is_symmetric"))


@scoped
def neighbour_order(positioned: DataFrame) -> DataFrame:
    """One row (neighbour_order) of edges(src, dst, pos): whether each vertex's neighbours ascend or descend along pos."""
    rows = with_previous(positioned.select("src", "dst", "pos"), ["src", "pos", "dst"], {"_src": "src", "_dst": "dst"}).where("src = _src")
    steps = rows.agg(F.max(F.col("dst") > F.col("_dst")).alias("rises"), F.max(F.col("dst") < F.col("_dst")).alias("falls"))
    return steps.select(_order("rises", "falls").alias("neighbour_order"))


@scoped
def degree_order(graph: Graph) -> DataFrame:
    """One row (degree_order): whether out-degrees ascend or descend with the ids."""
    rows = with_previous(degree(graph), ["id"], {"_before": "degree"})
    steps = rows.agg(F.max(F.col("degree") > F.col("_before")).alias("rises"), F.max(F.col("degree") < F.col("_before")).alias("falls"))
    return steps.select(_order("rises", "falls").alias("degree_order"))


def repeated_edges(graph: Graph) -> DataFrame:
    """One row (repeated, percent): edges beyond the first of each (src, dst)."""
    pairs = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    sums = pairs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    return sums.select("repeated", F.when(F.col("all") > 0, 100 * F.col("repeated") / F.col("all")).otherwise(0.0).alias("percent"))


def singletons_and_leaves(graph: Graph) -> DataFrame:
    """One row (singletons, leaves): vertices without edges; vertices that edges only enter."""
    both = degree(graph, "src").withColumnRenamed("degree", "o").join(degree(graph, "dst").withColumnRenamed("degree", "i"), "id")
    alone, leaf = (F.col("o") == 0) & (F.col("i") == 0), (F.col("o") == 0) & (F.col("i") > 0)
    return both.agg(F.count(F.when(alone, 1)).alias("singletons"), F.count(F.when(leaf, 1)).alias("leaves"))


def degree_distribution(graph: Graph) -> DataFrame:
    """(degree, vertex_count) of out-degrees, 0 included."""
    return degree(graph).groupBy("degree").agg(F.count(F.lit(1)).alias("vertex_count"))


def power_law(distribution: DataFrame) -> DataFrame:
    """One row (slope, intercept, correlation) of log vertex_count against log degree, for degrees above 0."""
    logs = distribution.where("degree > 0 and vertex_count > 0").select(F.ln("degree").alias("x"), F.ln("vertex_count").alias("y"))
    return logs.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("correlation"))


# Two-sided 95 % quantiles of Student's distribution for 1 to 30 degrees of freedom; above, the normal one.
T_95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
Z_95 = 1.96


def run_summary(runs: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys..., measure, n, mean, ci95) of timed runs: mean and half the width of its 95 % confidence interval, which is
    null for a single run. Null, NaN and infinite values don't count."""
    long = runs.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures))).alias("_m")).select(*keys, "_m.*")
    long = long.where(~F.isnan("x") & (F.abs("x") < float("inf")))
    stats = long.groupBy(*keys, "measure").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("_s"))
    table = F.array(*(F.lit(t) for t in T_95))
    t = F.when(F.col("n") - 1 > len(T_95), Z_95).when(F.col("n") > 1, F.try_element_at(table, (F.col("n") - 1).cast("int")))
    return stats.select(*keys, "measure", "n", "mean", (t * F.col("_s") / F.sqrt("n")).alias("ci95"))


@scoped
def rate_statistics(runs: DataFrame, time: str, edges: str) -> DataFrame:
    """One row of a traversal benchmark: minimum, quartiles, maximum, mean and deviation of time, and the harmonic mean
    of the rates. Rows without a positive finite time don't count. Quartiles are exact, by the times' places in order."""
    good = runs.where(F.col(time) > 0).where(F.col(time) < float("inf")).select(F.col(time).cast("double").alias("t"), F.col(edges).cast("double").alias("e"))
    placed = with_running(good, ["t", "e"], index="i")
    n = placed.count()
    columns = []
    for quarter in (1, 2, 3):
        at = quarter * (n - 1)  # in quarters of a row
        a, b = (F.max(F.when(F.col("i") == i, F.col("t"))) for i in (at // 4, -(-at // 4)))
        columns.append((a + (b - a) * F.lit(at % 4 / 4)).alias(f"time_p{25 * quarter}"))
    return placed.agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("time_min"), *columns, F.max("t").alias("time_max"),
        F.avg("t").alias("time_mean"), F.stddev_samp("t").alias("time_sd"),
        (F.count(F.when(F.col("e") > 0, 1)) / F.sum(F.when(F.col("e") > 0, F.col("t") / F.col("e")))).alias("rate_harmonic_mean"))
