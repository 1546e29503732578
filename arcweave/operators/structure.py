"""Degrees, triangles, clustering coefficients and weighted cores.

Defined results: every vertex has a row; rows of edges whose source is no vertex count for no vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookup
from ..functions.lookup import lookup_join
from ..graph import Graph
from ..plans.adjacency import Adjacency
from ..plans.iterate import Table, cut, scoped
from ..plans.ledger import Ledger


def degree(graph: Graph, by: str = "src") -> DataFrame:
    """(id, degree): edges that leave ('src') or enter ('dst') each vertex; repeated edges count each."""
    counts = graph.edges.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return graph.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def _closed(graph: Graph, least_rows: int | None = None) -> DataFrame:
    """(id, triangles) of vertices with any, edges taken both ways and without repeats and loops.

    Each edge points from the end with fewer neighbours to the other, so no vertex points to more than about the square
    root of twice the edges, however large its degree. A vertex u sends to each v that it points to those of its list
    behind v, which is each pair of neighbours once; what v points to, too, closes triangles, and each is found once. A v
    that very many u point to meets them in several tasks, among which the u are spread and to which v's list is copied.
    """
    pairs = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    table = Table(pairs)
    pairs, total = table.df, table.rows
    degrees = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    both = lookup_join(pairs, "a", degrees.select(F.col("id").alias("a"), F.col("d").alias("da")), total=total)
    both = lookup_join(both, "b", degrees.select(F.col("id").alias("b"), F.col("d").alias("db")), total=total)
    a, b = F.struct(F.col("da").alias("d"), F.col("a").alias("id")), F.struct(F.col("db").alias("d"), F.col("b").alias("id"))
    pointed = cut(both.select(F.least(a, b)["id"].alias("u"), F.greatest(a, b).alias("v")))
    lists = cut(pointed.groupBy("u").agg(F.transform(F.sort_array(F.collect_list("v")), lambda x: x["id"]).alias("to")))
    sent = lists.where(F.size("to") > 1).select("u", F.posexplode("to").alias("i", "v"), "to").select("u", "v", F.slice("to", F.col("i") + 2, F.size("to")).alias("rest")).where(F.size("rest") > 0)
    found = lists.select(F.col("u").alias("v"), F.col("to").alias("_to"))
    most = max(1, total // (4 * int(graph.spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = Table(pointed.groupBy(F.col("v.id").alias("v")).count().where(F.col("count") > most).select("v", F.ceil(F.col("count") / most).cast("int").alias("_n"))) if total > (lookup.LEAST_ROWS if least_rows is None else least_rows) else None
    on = ["v"]
    if hot is not None and hot.rows:  # at most four per partition
        salts = F.coalesce("_n", F.lit(1))
        sent = sent.join(F.broadcast(hot.df), "v", "left").withColumn("_salt", F.pmod(F.xxhash64("u"), salts).cast("int")).drop("_n")
        found = found.join(F.broadcast(hot.df), "v", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_n")
        on = ["v", "_salt"]
    met = sent.join(found.hint("shuffle_merge"), on).select("u", "v", F.array_intersect("rest", "_to").alias("w")).where(F.size("w") > 0)
    ends = F.array(F.struct(F.col("u").alias("id"), F.size("w").alias("n")), F.struct(F.col("v").alias("id"), F.size("w").alias("n")))
    all_ = F.concat(ends, F.transform("w", lambda x: F.struct(x.alias("id"), F.lit(1).alias("n"))))
    return met.select(F.explode(all_).alias("t")).groupBy("t.id").agg(F.sum("t.n").alias("triangles"))


@scoped
def triangle_count(graph: Graph) -> DataFrame:
    """(id, triangles)."""
    return graph.vertices.select("id").join(_closed(graph), "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


@scoped
def clustering_coefficient(graph: Graph) -> DataFrame:
    """(id, coefficient): of the pairs of neighbours, the share that are neighbours themselves; 0 below two neighbours.

    Edges are taken both ways, without repeats and loops.
    """
    pairs = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    joined = graph.vertices.select("id").join(degrees, "id", "left").join(_closed(graph), "id", "left")
    value = F.when(F.col("d") >= 2, 2 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return joined.select("id", value.cast("double").alias("coefficient"))


@scoped
def pcore(graph: Graph, start: int = 0, step: int = 1) -> DataFrame:
    """(id, round): the round in which the vertex is peeled off. In round r, vertices with a sum of weights, to vertices
    still there, of at most start + r * step are peeled until there are none; then the next round begins.

    Instead of peeling wave by wave, every vertex holds an upper bound of its round, at first from its whole sum, and
    lowers it to the largest round that its neighbours' bounds support. In a turn only vertices with a neighbour whose
    bound fell look at their neighbours, and only what falls is written. The graph must be weighted and undirected; a graph of one
    vertex gives its number of edges.
    """
    if not graph.weighted or graph.directed:
        raise ValueError("cores need a weighted, undirected graph")
    if step <= 0:
        raise ValueError("step must be positive")
    graph.require()
    if graph.vertex_count() == 1:
        return graph.vertices.select("id", F.lit(graph.edge_count()).cast("long").alias("round"))
    edges = graph.edges.join(graph.vertices.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    table = Table(edges.where("weight > 0"))
    supports = lambda s: F.greatest(F.lit(0), F.ceil((s - start) / F.lit(step))).cast("long")
    sums = table.df.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("s"))
    bounds = graph.vertices.select("id").join(sums, "id", "left").select("id", supports(F.coalesce("s", F.lit(0))).alias("round"))
    with Adjacency(table.df, "src", table.rows) as out, Ledger(bounds, ["id"], ["round"], "least") as known:
        fallen = known.base
        while fallen.rows:
            near = out.join(fallen.df.select("id")).select(F.col("dst").alias("id")).distinct()
            near = cut(known.beside(near).where("known > 0").select("id", F.col("known").alias("own")))
            ends = out.join(near).select(F.col("id").alias("_of"), "own", F.col("dst").alias("id"), "weight")
            # A neighbour's bound above the vertex's own counts as if equal, which keeps the groups small.
            by_bound = known.beside(ends).groupBy("_of", "own", F.least("own", "known").alias("r")).agg(F.sum("weight").alias("w"))
            above = Window.partitionBy("_of").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            best = by_bound.withColumn("s", F.sum("w").over(above)).groupBy("_of", "own").agg(F.max(F.least("r", supports(F.col("s")))).alias("best"))
            fallen = known.add(best.where("best < own").select(F.col("_of").alias("id"), F.col("best").alias("round")))
        return known.all()
