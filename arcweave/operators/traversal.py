"""Traversals: hop distances, parent trees, weighted distances, reachability.

Each turn joins the newest level with the edges laid out by Adjacency. What it reaches is looked up in a Ledger of what is
known, and only what is new, or nearer, is written and sends in the next turn. When the level is small its table is
broadcast, when it is large it is shuffled: the planner sees the size of the written table and decides.

Defined results: unreached vertices have the sentinel, or null with unreachable=None; an edge to an id that is no vertex
leads nowhere; repeated edges and self loops change nothing; a missing source raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import lookup_join
from ..graph import UNREACHED, UNREACHED_HOPS, Graph
from ..plans.adjacency import Adjacency
from ..plans.iterate import Table, cut, scoped
from ..plans.ledger import Ledger

PULL_SHARE = 0.05


def _finish(graph: Graph, reached: DataFrame, name: str, unreachable: int | None, kind: str) -> DataFrame:
    column: Column = F.col(name)
    if unreachable is not None:
        column = F.coalesce(column, F.lit(unreachable))
    return graph.vertices.select("id").join(reached, "id", "left").select("id", column.cast(kind).alias(name))


def _vertices_only(graph: Graph) -> DataFrame:
    """Edges whose ends are vertices: a traversal must not pass through an id that is none."""
    ids = graph.vertices.select(F.col("id").alias("dst"))
    return graph.edges.join(ids, "dst", "left_semi")


def levels(graph: Graph, sources: DataFrame, depth: int | None = None, stop_at: int | None = None, direction: str = "auto") -> DataFrame:
    """(id, cost, parent) of a breadth-first traversal from sources(id); parent is the least one.

    direction: 'push' sends from the newest level; 'pull' lets vertices that are not reached yet look for a neighbour in
    it, over reversed edges; 'auto' pulls when the newest level holds more than PULL_SHARE of all vertices.
    """
    total = graph.vertex_count()
    edges, count = _vertices_only(graph), graph.edge_count()
    by_dst: Adjacency | None = None
    start = sources.select("id", F.lit(0).alias("cost"), F.col("id").alias("parent"))
    with Adjacency(edges, "src", count) as by_src, Ledger(start, ["id"], ["cost", "parent"], "once") as known:
        newest = known.base
        reached, cost = newest.rows, 0
        while newest.rows and (depth is None or cost < depth) and reached < total:
            frontier = newest.df.select(F.col("id").alias("parent"))
            if stop_at is not None and not frontier.where(F.col("parent") == stop_at).isEmpty():
                break
            if direction == "pull" or (direction == "auto" and newest.rows > PULL_SHARE * total):
                by_dst = by_dst or Adjacency(edges, "dst", count)
                open_ = known.beside(graph.vertices.select("id")).where("known is null").select("id")
                candidates = by_dst.join(open_).withColumnRenamed("src", "parent").join(frontier, "parent", "left_semi")
                found = candidates.groupBy("id").agg(F.min("parent").alias("parent"))
            else:
                sent = by_src.join(frontier, "parent").withColumnRenamed("dst", "id")
                found = known.beside(sent.groupBy("id").agg(F.min("parent").alias("parent"))).where("known is null")
            cost += 1
            newest = known.add(found.select("id", F.lit(cost).alias("cost"), "parent"))
            reached += newest.rows
        if by_dst is not None:
            by_dst.edges.unpersist()
        return known.all()


def _source(graph: Graph, source: int) -> DataFrame:
    graph.require(source)
    return graph.spark.range(source, source + 1).select("id")


@scoped
def bfs(graph: Graph, source: int, unreachable: int | None = UNREACHED_HOPS, direction: str = "auto") -> DataFrame:
    """(id, cost): hops from the source along edges."""
    reached = levels(graph, _source(graph, source), direction=direction)
    return _finish(graph, reached.select("id", "cost"), "cost", unreachable, "int")


@scoped
def bfs_tree(graph: Graph, source: int, unreachable: int | None = UNREACHED) -> DataFrame:
    """(id, parent): of the neighbours one hop nearer to the source, the least id; the source is its own parent."""
    reached = levels(graph, _source(graph, source))
    return _finish(graph, reached.select("id", "parent"), "parent", unreachable, "long")


@scoped
def validate_tree(graph: Graph, tree: DataFrame, source: int, unreachable: int = UNREACHED) -> DataFrame:
    """One row of counts of what is wrong with a parent tree; all 0 for a valid one.

    bad_root: the source is not its own parent. not_in_graph: a tree edge that is no edge. no_path: following parents
    doesn't lead to the source (a cycle). one_end: an edge with one end in the tree (for directed graphs, only the
    start). level_gap: edges whose ends' levels differ by more than 1 (for directed graphs, that lead more than one
    level down).
    """
    tree = cut(tree.where(F.col("parent") != unreachable).select("id", "parent"))
    level = Table(tree.where(F.col("id") == source).select("id", F.lit(0).alias("level")))
    trail = [level]
    while trail[-1].rows:
        below = tree.where(F.col("id") != F.col("parent")).join(trail[-1].df.select(F.col("id").alias("parent"), "level"), "parent").select("id", (F.col("level") + 1).alias("level"))
        trail.append(Table(below))
    depth = graph.spark.read.schema(level.df.schema).parquet(*(t.path for t in trail))
    bad_root = tree.where((F.col("id") == source) & (F.col("parent") == source)).agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("bad_root"))
    links = graph.edges.select("src", "dst").distinct()
    not_in = tree.where(F.col("id") != F.col("parent")).join(links.select(F.col("src").alias("parent"), F.col("dst").alias("id")), ["parent", "id"], "left_anti").agg(F.count("*").alias("not_in_graph"))
    no_path = tree.join(depth, "id", "left_anti").agg(F.count("*").alias("no_path"))
    a, b = depth.select(F.col("id").alias("src"), F.col("level").alias("la")), depth.select(F.col("id").alias("dst"), F.col("level").alias("lb"))
    ends = graph.edges.select("src", "dst").join(graph.vertices.select(F.col("id").alias("dst")), "dst", "left_semi")
    ends = lookup_join(lookup_join(cut(ends), "src", a, "left"), "dst", b, "left")
    half = F.col("la").isNotNull() & F.col("lb").isNull()
    gap = F.col("lb") - F.col("la") > 1
    if not graph.directed:
        half, gap = F.col("la").isNull() != F.col("lb").isNull(), F.abs(F.col("lb") - F.col("la")) > 1
    edge_counts = ends.agg(F.count(F.when(half, 1)).alias("one_end"), F.count(F.when(gap, 1)).alias("level_gap"))
    row = {k: v for df in (bad_root, not_in, no_path, edge_counts) for k, v in df.first().asDict().items()}
    return graph.spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in row.items()))


@scoped
def st_connectivity(graph: Graph, source: int, target: int) -> DataFrame:
    """One row (source, target, reachable, hops); hops is null if the target is not reached. Stops at its level."""
    graph.require(source, target)
    hit = levels(graph, _source(graph, source), stop_at=target).where(F.col("id") == target).select(F.col("cost").alias("hops"))
    one = graph.spark.range(1).select(F.lit(source).cast("long").alias("source"), F.lit(target).cast("long").alias("target"))
    joined = one.join(hit, how="left")
    return joined.select("source", "target", F.col("hops").isNotNull().alias("reachable"), F.col("hops").cast("int").alias("hops"))


def relax(graph: Graph, start: DataFrame, keys: list[str]) -> DataFrame:
    """Least distances (keys..., id, distance) from start(keys..., id, distance), by label correction.

    Only rows that improved in the last turn send, and only rows that improve are written. The distances are exact for
    weights that are not negative.
    """
    on = [*keys, "id"]
    edges = graph.with_weights().join(graph.vertices.select(F.col("id").alias("dst")), "dst", "left_semi")
    table = Table(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")).where("weight is not null"))
    if not table.df.where("weight < 0").isEmpty():
        raise ValueError("a weight is negative")
    with Adjacency(table.df, "src", table.rows) as out, Ledger(start, on, ["distance"], "least") as known:
        improved = known.base
        while improved.rows:
            sent = out.join(improved.df.select(*on, "distance"))
            sent = sent.groupBy(*keys, F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
            improved = known.add(known.beside(sent).where("known is null or distance < known").select(*on, "distance"))
        return known.all()


@scoped
def sssp(graph: Graph, source: int, unreachable: int | None = UNREACHED) -> DataFrame:
    """(id, distance): least sum of weights from the source. The graph must be weighted."""
    if not graph.weighted:
        raise ValueError("shortest paths need a weighted graph")
    start = _source(graph, source).select("id", F.lit(0).cast("long").alias("distance"))
    return _finish(graph, relax(graph, start, []), "distance", unreachable, "long")


@scoped
def apsp(graph: Graph) -> DataFrame:
    """(src, dst, distance) of all pairs with a path, each vertex with itself included; a pair without a row has none.

    Every vertex is a source of the same relaxation, keyed by source and vertex.
    """
    start = graph.vertices.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("distance"))
    return relax(graph, start, ["source"]).select(F.col("source").alias("src"), F.col("id").alias("dst"), "distance")


def traversed_edges(graph: Graph, costs: DataFrame, unreachable: int = UNREACHED_HOPS) -> DataFrame:
    """One row (traversed_edges): out-degrees of the reached vertices, added up."""
    reached = costs.where(F.col("cost") != unreachable).select(F.col("id").alias("src"))
    return graph.edges.join(reached, "src", "left_semi").agg(F.count(F.lit(1)).alias("traversed_edges"))
