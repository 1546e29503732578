"""Graphs from graphs, and adjacency lists.

Defined results: ids need not be dense before; where an operator renumbers, new ids run from 0. Repeated edges and self
loops are kept unless said otherwise. Vertices without edges are kept unless said otherwise.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import lookup_join
from ..functions.ordering import with_running
from ..functions.spread import spread
from ..graph import Graph
from ..plans.iterate import Table, cut, scoped

SEED = 1985
#: Edges in one list.
LIST_ROWS = 1_000_000


def renumbered(graph: Graph, numbers: DataFrame) -> Graph:
    """numbers: (id, new), new ids of all vertices that stay. Edges with an end that has none are left out."""
    a, b = numbers.select(F.col("id").alias("src"), F.col("new").alias("_a")), numbers.select(F.col("id").alias("dst"), F.col("new").alias("_b"))
    rest = [c for c in graph.edges.columns if c not in ("src", "dst")]
    edges = lookup_join(lookup_join(graph.edges, "src", a), "dst", b).select(F.col("_a").alias("src"), F.col("_b").alias("dst"), *rest)
    values = ["value"] * graph.valued
    vertices = graph.vertices.join(numbers, "id").select(F.col("new").alias("id"), *values)
    return replace(graph, vertices=vertices, edges=edges)


@scoped
def induced_subgraph(graph: Graph, keep: DataFrame, renumber: bool = True) -> Graph:
    """The vertices in keep(id) and the edges between them, renumbered in order of id."""
    kept = graph.vertices.join(keep.select("id").distinct(), "id", "left_semi").select("id")
    if renumber:
        return renumbered(graph, with_running(kept, ["id"], index="new"))
    return renumbered(graph, kept.select("id", F.col("id").alias("new")))


@scoped
def remove_singletons(graph: Graph, renumber: bool = True) -> Graph:
    """Without the vertices that no edge leaves or enters; a self loop is an edge."""
    touched = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return induced_subgraph(graph, touched, renumber)


def reverse(graph: Graph) -> Graph:
    if not graph.directed:
        raise ValueError("an undirected graph has no reverse")
    return replace(graph, edges=graph.reversed_edges())


def undirected(graph: Graph) -> Graph:
    """With the reverse of every edge, repeated or not."""
    if not graph.directed:
        raise ValueError("the graph is undirected already")
    return replace(graph, edges=graph.edges.unionByName(graph.reversed_edges()), directed=False)


def symmetrized(graph: Graph) -> Graph:
    """Undirected, without self loops and repeated edges, and without weights."""
    edges = graph.edges.where("src <> dst")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    return replace(graph, edges=both, directed=False, weighted=False)


def simplified(graph: Graph) -> Graph:
    """symmetrized(), and without the vertices that have no edge then."""
    return remove_singletons(symmetrized(graph), renumber=False)


def residual(graph: Graph) -> DataFrame:
    """(src, dst, weight, forward): the edges, and the reverse of each with weight 0. An edge and its reverse differ in
    forward and swap src and dst."""
    edges = graph.with_weights().select("src", "dst", "weight", F.lit(True).alias("forward"))
    return edges.union(edges.select("dst", "src", F.lit(0).cast("long"), F.lit(False)))


@scoped
def permuted(graph: Graph, seed: int = SEED) -> Graph:
    """Renumbered in pseudo-random order."""
    numbers = with_running(graph.vertices.select("id", spread(seed, "id").alias("_h")), ["_h", "id"], index="new")
    return renumbered(graph, numbers.select("id", "new"))


@scoped
def degree_order(graph: Graph) -> DataFrame:
    """(id, new): numbers from 0 in order of out-degree and, of equal ones, of id."""
    from .structure import degree

    return with_running(degree(graph), ["degree", "id"], index="new").select("id", "new")


@scoped
def sorted_by_degree(graph: Graph) -> Graph:
    return renumbered(graph, cut(degree_order(graph)))


def random_weights(graph: Graph, seed: int = SEED) -> Graph:
    """With weights from 0 to V - 1 that follow from the ends and the seed."""
    if graph.weighted:
        raise ValueError("the graph has weights")
    n = graph.vertex_count()
    return replace(graph, edges=graph.edges.withColumn("weight", F.pmod(spread(seed, "src", "dst"), F.lit(max(n, 1)))), weighted=True)


def _lists(rows: DataFrame, order: list[str], descending: bool, most: int) -> DataFrame:
    """(id, chunk, _l) of rows(src, ...): for each src, lists of at most `most` structs of the order's columns, in that order.

    Vertices with more rows than that are found by a count; of these alone, the places along the order are taken over
    ranges of all rows, so that no task gets all edges of one.
    """
    item = F.struct(*order)
    short = lambda df: df.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(item), not descending).alias("_l")).select("id", F.lit(0).alias("chunk"), "_l")
    hubs = Table(rows.groupBy("src").count().where(F.col("count") > most).select("src"))
    if not hubs.rows:
        return short(rows)
    many = with_running(rows.join(F.broadcast(hubs.df), "src", "left_semi"), ["src", *(f"-{c}" if descending else c for c in order)], index="_i")  # fewer hubs than rows / most
    many = cut(many)
    first = many.groupBy("src").agg(F.min("_i").alias("_first"))
    chunk = F.floor((F.col("_i") - F.col("_first")) / most).cast("int").alias("chunk")
    long = many.join(F.broadcast(first), "src").groupBy(F.col("src").alias("id"), chunk).agg(F.sort_array(F.collect_list(item), not descending).alias("_l"))
    return short(rows.join(F.broadcast(hubs.df), "src", "left_anti")).unionByName(long)


def _with_empty(graph: Graph, lists: DataFrame) -> DataFrame:
    joined = graph.vertices.select("id").join(lists, "id", "left")
    empty = [F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in lists.columns[2:]]
    return joined.select("id", F.coalesce("chunk", F.lit(0)).alias("chunk"), *empty)


@scoped
def adjacency(graph: Graph, descending: bool = False, most: int = LIST_ROWS) -> DataFrame:
    """(id, chunk, neighbours[, weights]) in order of neighbour; weights stay with their neighbours. A vertex has one row,
    chunk 0, or, with more than `most` edges, several, numbered along the order."""
    if graph.weighted:
        lists = _lists(graph.edges, ["dst", "weight"], descending, most).select("id", "chunk", F.col("_l.dst").alias("neighbours"), F.col("_l.weight").alias("weights"))
    else:
        lists = _lists(graph.edges, ["dst"], descending, most).select("id", "chunk", F.col("_l.dst").alias("neighbours"))
    return _with_empty(graph, lists)


def explode_adjacency(lists: DataFrame) -> DataFrame:
    """(src, dst[, weight]) from adjacency()."""
    if "weights" in lists.columns:
        pair = F.explode(F.arrays_zip("neighbours", "weights")).alias("_p")
        return lists.select("id", pair).select(F.col("id").alias("src"), F.col("_p.neighbours").alias("dst"), F.col("_p.weights").alias("weight"))
    return lists.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst"))


@scoped
def degree_sorted_adjacency(graph: Graph, descending: bool = False, most: int = LIST_ROWS) -> DataFrame:
    """(id, chunk, neighbours) in order of the neighbours' out-degree and, of equal ones, of id; chunks as in adjacency()."""
    from .structure import degree

    edges = lookup_join(graph.edges.select("src", "dst"), "dst", degree(graph).select(F.col("id").alias("dst"), "degree"))
    return _with_empty(graph, _lists(edges, ["degree", "dst"], descending, most).select("id", "chunk", F.col("_l.dst").alias("neighbours")))


def radix_order(df: DataFrame, column: str, bits: int = 32, ascending: bool = True) -> DataFrame:
    """Sorted by the leading `bits` of a 32-bit column: an approximate order for less than 32, an exact one for 32."""
    if not 1 <= bits <= 32:
        raise ValueError("bits from 1 to 32")
    key = F.shiftright(F.col(column).cast("long"), 32 - bits)
    return df.orderBy(key if ascending else key.desc())
