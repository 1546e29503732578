"""PageRank.

The formula differs from the textbook's: the first push is not divided by the out-degree, five rounds are made, and the
rank of vertices without out-edges is not redistributed.  Every round is a join of ranks with the laid-out edges and an
aggregation, both keyed by vertex; ranks are written between rounds.

Defined results: an edge to an id that is no vertex takes its share nowhere; a vertex without edges has the constant
term; repeated edges count each; an empty graph raises ValueError; a graph of one vertex has rank 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.adjacency import Adjacency
from ..plans.iterate import Table, scoped

ROUNDS = 5
DAMPING = 0.85


def _ranks(graph: Graph, by: str, rounds: int, damping: float, first_normalized: bool, start: DataFrame | None, keep_without_edges: bool) -> DataFrame:
    """by: the end of an edge that sends its rank to the other. Ranks are divided by out-degrees in either case.

    A round is one aggregation: the vertices, with nothing, are added to what is sent, so that every vertex has a row and
    no join follows.
    """
    graph.require()
    n = graph.vertex_count()
    if n == 1:
        return graph.vertices.select("id", F.lit(1.0).alias("rank"))
    degrees = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    vertices = graph.vertices.select("id").join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if start is not None:
        vertices = vertices.join(start.select("id", F.col("rank").cast("double").alias("rank")), "id", "left")
    else:
        vertices = vertices.withColumn("rank", F.lit(1.0 / n))
    divided = F.when(F.col("degree") > 0, F.col("rank") / F.col("degree"))
    ids = vertices.withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    table = Table(ids.select("id", "degree", "rank", F.col("rank").alias("first"), (divided if first_normalized else F.col("rank")).alias("sent")))
    with Adjacency(graph.edges.select("src", "dst"), by, graph.edge_count()) as out:
        to = "dst" if by == "src" else "src"
        for _ in range(rounds):
            sent = out.join(table.df.where("sent is not null").select(F.col("id").alias("_from"), "sent"), "_from")
            sent = sent.select(F.col(to).alias("id"), F.lit(None).cast("long").alias("degree"), F.lit(None).cast("double").alias("first"), "sent")
            all_ = table.df.select("id", "degree", "first", F.lit(0.0).alias("sent")).union(sent)
            sums = all_.groupBy("id").agg(F.max("degree").alias("degree"), F.max("first").alias("first"), F.sum("sent").alias("got")).where("degree is not null")
            rank = F.lit((1 - damping) / n) + F.lit(damping) * F.col("got")
            if keep_without_edges:
                rank = F.when(F.col("degree") == 0, F.col("first")).otherwise(rank)
            following = Table(sums.withColumn("rank", rank).select("id", "degree", "rank", "first", divided.alias("sent")))
            table.drop()
            table = following
    return table.df.select("id", "rank")


@scoped
def pagerank(graph: Graph, rounds: int = ROUNDS, damping: float = DAMPING, first_normalized: bool = False, start: DataFrame | None = None) -> DataFrame:
    """(id, rank), pushing along edges. start: (id, rank) to begin with, 0 for ids it lacks; by default 1/V each."""
    return _ranks(graph, "src", rounds, damping, first_normalized, start, False)


@scoped
def pagerank_hybrid(graph: Graph, damping: float = DAMPING) -> DataFrame:
    """The variant with one round less, in which vertices without out-edges keep their first rank."""
    return _ranks(graph, "src", ROUNDS - 1, damping, False, None, True)


@scoped
def pagerank_incoming(graph: Graph, rounds: int = ROUNDS, damping: float = DAMPING, start: DataFrame | None = None) -> DataFrame:
    """Pulling: a vertex adds up the ranks of the ends of its own edges, as if these were stored reversed. The degree is
    that of the vertex that is pulled from; one without edges of its own brings nothing after the first round."""
    return _ranks(graph, "dst", rounds, damping, False, start, False)
