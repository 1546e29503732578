"""Assigning vertices to partitions, and how good an assignment is.

Defined results: partitions are numbered from 0; every vertex has one; of equal degrees the smaller id comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import lookup_join
from ..functions.ordering import with_running
from ..functions.spread import spread
from ..graph import Graph
from ..plans.iterate import cut, scoped
from .structure import degree

SEED = 1985


def check_fractions(fractions: Sequence[float]) -> None:
    if not fractions or any(f < 0 for f in fractions) or not 99 <= int(sum(fractions) * 100 + 1e-9) <= 101:
        raise ValueError("fractions are not negative and add up to 1")


def by_hash(graph: Graph, k: int, seed: int = SEED) -> DataFrame:
    """(id, pid): k partitions of about equal size. No shuffle."""
    if k <= 0:
        raise ValueError("at least one partition")
    graph.require()
    return graph.vertices.select("id", F.pmod(spread(seed, "id"), F.lit(k)).cast("int").alias("pid"))


def _bucket(position: Column, bounds: Sequence[int]) -> Column:
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(position < bounds[i], i).otherwise(out)
    return out.cast("int")


@scoped
def by_fractions(graph: Graph, fractions: Sequence[float], seed: int = SEED) -> DataFrame:
    """(id, pid): pseudo-random partitions of exactly floor(V * fraction) vertices; the last takes the rest."""
    check_fractions(fractions)
    graph.require()
    n = graph.vertex_count()
    bounds, upto = [], 0
    for f in fractions[:-1]:
        upto += int(n * f)
        bounds.append(upto)
    ranked = with_running(graph.vertices.select("id", spread(seed, "id").alias("_h")), ["_h", "id"], index="_n")
    return ranked.select("id", _bucket(F.col("_n"), bounds).alias("pid"))


def even(k: int) -> tuple[float, ...]:
    """The fractions of k partitions of equal share."""
    if k <= 0:
        raise ValueError("at least one partition")
    return (1 / k,) * k


@scoped
def by_degree(graph: Graph, fractions: Sequence[float] | int, descending: bool = False, singletons: bool = False, from_end: float = 0.0) -> DataFrame:
    """(id, pid): in order of degree and, of equal ones, of id, a partition is filled until its share of the edges reaches
    its fraction; the vertex that crosses it still belongs to it. The last partition takes the rest.

    fractions: one per partition, or a number of partitions of equal share. singletons: vertices without out-edges have
    a partition of their own, the last but one, which is not filled otherwise. from_end: a share of the edges that, split
    evenly over the partitions that are filled, these take from the other end of the order, from whichever partition has
    it; the first vertex of the order stays.
    """
    fractions = even(fractions) if isinstance(fractions, int) else tuple(fractions)
    check_fractions(fractions)
    if singletons and len(fractions) < 2:
        raise ValueError("singletons need a partition besides the last")
    graph.require()
    last, filled = len(fractions) - 1, len(fractions) - (2 if singletons else 1)
    total = graph.edge_count()
    degrees = degree(graph)
    apart = degrees.where("degree = 0").select("id", F.lit(last - 1).alias("pid")) if singletons else None
    if singletons:
        degrees = degrees.where("degree > 0")
    placed = cut(with_running(degrees, ["-degree", "id"] if descending else ["degree", "id"], index="_i", sums={"_before": "degree"}))

    def filling(before: Column, shares: Sequence[float]) -> list[int]:
        """Where the edges of each partition end, along an order with so many edges before each vertex. A share that is not
        reached takes all vertices to the end."""
        bounds, start = [], 0
        for share in shares:
            goal = start + share * total
            if goal > total:
                start = total + 1
            elif share > 0:
                crossed = placed.where((before >= start) & (before < goal)).agg(F.max(before + F.col("degree"))).first()[0]
                start = start if crossed is None else max(start, crossed)
            bounds.append(start)
        return bounds

    # Where a partition begins depends on how far the one before overshot, so the bounds are found one by one.
    pid = F.lit(last)
    starts = [0, *filling(F.col("_before"), fractions[:filled])]
    for i in range(filled - 1, -1, -1):
        pid = F.when((F.col("_before") >= starts[i]) & (F.col("_before") < starts[i + 1]), i).otherwise(pid)
    if from_end > 0 and filled:
        after = F.lit(total) - F.col("_before") - F.col("degree")
        starts = [0, *filling(after, [from_end / filled] * filled)]
        for i in range(filled - 1, -1, -1):
            pid = F.when((F.col("_i") > 0) & (after >= starts[i]) & (after < starts[i + 1]), i).otherwise(pid)
    result = placed.select("id", pid.cast("int").alias("pid"))
    return result.unionByName(apart.select("id", F.col("pid").cast("int"))) if apart is not None else result


def shuffled_among(labels: DataFrame, first: int, count: int, seed: int = SEED) -> DataFrame:
    """(id, pid): the vertices of partitions first .. first + count - 1 spread over these at random."""
    inside = F.col("pid").between(first, first + count - 1)
    other = F.lit(first) + F.pmod(spread(seed, "id"), F.lit(count))
    return labels.select("id", F.when(inside, other).otherwise(F.col("pid")).cast("int").alias("pid"))


@scoped
def local_ids(graph: Graph, labels: DataFrame, descending: bool = False) -> DataFrame:
    """(id, pid, local_id): numbers from 0 within a partition, in order of degree and id.

    Ranks are taken over the whole order, sorted by partition first, so that a partition may be of any size.
    """
    rows = degree(graph).join(labels, "id")
    ranked = cut(with_running(rows, ["pid", "-degree", "id"] if descending else ["pid", "degree", "id"], index="_n"))
    firsts = ranked.groupBy("pid").agg(F.min("_n").alias("_first"))
    return ranked.join(firsts, "pid").select("id", "pid", (F.col("_n") - F.col("_first")).alias("local_id"))


@scoped
def partitioned_edges(graph: Graph, labels: DataFrame) -> DataFrame:
    """Edges with src_pid and dst_pid."""
    a, b = labels.select(F.col("id").alias("src"), F.col("pid").alias("src_pid")), labels.select(F.col("id").alias("dst"), F.col("pid").alias("dst_pid"))
    return lookup_join(lookup_join(graph.edges, "src", a), "dst", b).select(*graph.edges.columns, "src_pid", "dst_pid")


@scoped
def partition_stats(graph: Graph, labels: DataFrame) -> DataFrame:
    """(pid, vertices, edges, remote_edges, remote_vertices, beta): edges start in the partition; remote ones end in
    another; remote vertices are their distinct ends; beta is the share of remote vertices in remote edges, in percent of edges."""
    labels = cut(labels)
    ends = partitioned_edges(graph, labels)
    remote = F.col("src_pid") != F.col("dst_pid")
    # Distinct ends are found by an aggregation of their own, so no set of ends is held per partition.
    far = ends.where(remote).select("src_pid", "dst").distinct().groupBy(F.col("src_pid").alias("pid")).agg(F.count(F.lit(1)).alias("remote_vertices"))
    own = ends.groupBy(F.col("src_pid").alias("pid")).agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(remote, 1)).alias("remote_edges"))
    sizes = labels.groupBy("pid").agg(F.count(F.lit(1)).alias("vertices"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = sizes.join(own, "pid", "left").join(far, "pid", "left").select("pid", "vertices", zero("edges"), zero("remote_edges"), zero("remote_vertices"))
    return joined.withColumn("beta", F.when(F.col("edges") > 0, 100.0 * F.col("remote_vertices") / F.col("edges")).otherwise(0.0))


@scoped
def modularity(graph: Graph, labels: DataFrame) -> DataFrame:
    """One row (modularity): over the partitions, local / E - (remote / E) ** 2 added up; 0 without edges or partitions to compare."""
    ends = partitioned_edges(graph, labels)
    per = ends.groupBy("src_pid").agg(F.count(F.when(F.col("src_pid") == F.col("dst_pid"), 1)).alias("local"), F.count(F.when(F.col("src_pid") != F.col("dst_pid"), 1)).alias("remote"))
    e = graph.edge_count()
    k = labels.select("pid").distinct().count()
    if not e or k <= 1:
        return graph.spark.range(1).select(F.lit(0.0).alias("modularity"))
    share = F.col("local") / F.lit(float(e)) - (F.col("remote") / F.lit(float(e))) * (F.col("remote") / F.lit(float(e)))
    return per.agg(F.sum(share).alias("modularity"))
