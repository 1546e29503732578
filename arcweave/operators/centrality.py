"""Centralities from traversals of many sources at once.

Where a task's memory holds the edges, each task takes blocks of sources through all levels (plans.blocks).  Otherwise the
state is a table keyed by (source, id): one loop over levels serves all sources, so its number of jobs is that of the
deepest traversal and not that of the sources.  `batch` limits how many sources are in work at a time, in a task or in the
table; results of the batches are added up.

Defined results: scores are not scaled; on undirected graphs every pair counts in both directions; repeated edges
multiply the number of paths; edges to ids that are no vertices lead nowhere; a source's own score gains nothing from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spread import spread
from ..graph import Graph
from ..plans import blocks
from ..plans.adjacency import Adjacency, Trail
from ..plans.iterate import Table, cut, scoped

EXACT, SINGLE = 0.0, -1.0
SEED = 1985


def sample_count(vertices: int, epsilon: float) -> int:
    """How many sources: all for 0, one for -1, else floor(log2 V) / epsilon ** 2."""
    if epsilon == EXACT:
        return vertices
    if epsilon == SINGLE:
        return 1
    return int(max(0, vertices.bit_length() - 1) / (epsilon * epsilon))


@scoped
def samples(graph: Graph, epsilon: float, seed: int = SEED) -> DataFrame:
    """(id): sources for an approximation, the first in pseudo-random order of those with out-edges; all vertices for epsilon 0."""
    if epsilon == EXACT:
        return graph.vertices.select("id")
    sources = graph.vertices.select("id").join(graph.edges.select(F.col("src").alias("id")), "id", "left_semi")
    return sources.orderBy(spread(seed, "id"), "id").limit(sample_count(graph.vertex_count(), epsilon))


def _edges(graph: Graph) -> Table:
    """(src, dst, times) between vertices, without loops, which are on no shortest path."""
    ids = graph.vertices.select(F.col("id").alias("dst"))
    edges = graph.edges.where("src <> dst").join(ids, "dst", "left_semi")
    return Table(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")))


def _forward(out: Adjacency, sources: DataFrame) -> Trail:
    """Levels (source, id, cost, paths): the number of shortest paths from the source."""
    trail = Trail(sources.sparkSession)
    new = trail.append(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("cost"), F.lit(1).cast("double").alias("paths")))
    while new:
        sent = out.join(trail.last().select("source", "id", "paths")).select("source", F.col("dst").alias("id"), (F.col("paths") * F.col("times")).alias("paths"))
        found = sent.groupBy("source", "id").agg(F.sum("paths").alias("paths"))
        found = found.join(trail.all().select("source", "id"), ["source", "id"], "left_anti")
        new = trail.append(found.select("source", "id", F.lit(len(trail)).alias("cost"), "paths"))
    return trail


def _dependencies(graph: Graph, edges: DataFrame, sources: DataFrame, stress: bool) -> DataFrame:
    """(id, score) over the sources: forward, then back level by level."""
    scores = Trail(graph.spark)
    with Adjacency(edges, "src") as out:
        trail = _forward(out, sources)
    levels = [t.df for t in trail.tables]
    with Adjacency(edges, "dst") as back:
        share = (1 + F.col("later")) * F.col("times") if stress else (1 + F.col("later")) * F.col("times") / F.col("paths")
        below = levels[-1].select("source", "id", "paths", F.lit(0.0).alias("later"))
        for level in reversed(levels[1:-1]):
            sent = back.join(below).select("source", F.col("src").alias("id"), share.alias("share")).groupBy("source", "id").agg(F.sum("share").alias("share"))
            own = level.join(sent, ["source", "id"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
            later = F.col("share") if stress else F.col("share") * F.col("paths")
            scores.append(own.select("source", "id", "paths", later.alias("later")))
            below = scores.last()
    if not len(scores):
        return graph.vertices.select("id", F.lit(0.0).alias("score"))
    score = F.col("later") * F.col("paths") if stress else F.col("later")
    return scores.all().groupBy("id").agg(F.sum(score).alias("score"))


def _batched(graph: Graph, sources: DataFrame, batch: int | None, stress: bool) -> DataFrame:
    chosen, edges = Table(sources), _edges(graph)
    sources, n = chosen.df, chosen.rows
    if edges.rows <= blocks.MOST_EDGES:
        found = blocks.dependencies(edges.df, sources, n, stress, min(batch or blocks.WIDEST, blocks.WIDEST))
        return cut(found.groupBy("id").agg(F.sum("score").alias("score")))
    if not batch or n <= batch:
        return _dependencies(graph, edges.df, sources, stress)
    parts = -(-n // batch)
    results = [cut(_dependencies(graph, edges.df, sources.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i), stress)) for i in range(parts)]
    whole = results[0]
    for r in results[1:]:
        whole = whole.unionByName(r)
    return whole.groupBy("id").agg(F.sum("score").alias("score"))


@scoped
def betweenness(graph: Graph, epsilon: float = EXACT, sources: DataFrame | None = None, batch: int | None = None) -> DataFrame:
    """(id, score): over the sources, the shares of shortest paths that pass through the vertex. With epsilon other than
    0, scores are scaled up from the sampled sources, except for a single one. sources(id) overrides the sample."""
    graph.require()
    chosen = cut(samples(graph, epsilon) if sources is None else sources)
    found = _batched(graph, chosen, batch, False)
    scale = 1.0
    if sources is None and epsilon not in (EXACT, SINGLE):
        scale = graph.vertex_count() / max(1, chosen.count())
    return graph.vertices.select("id").join(found, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * scale).alias("score"))


@scoped
def stress(graph: Graph, sources: DataFrame | None = None, batch: int | None = None) -> DataFrame:
    """(id, score): the number of shortest paths, from all sources, that pass through the vertex."""
    graph.require()
    found = _batched(graph, graph.vertices.select("id") if sources is None else sources, batch, True)
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.round(F.coalesce("score", F.lit(0.0))).cast("long").alias("score"))


@scoped
def closeness(graph: Graph, batch: int | None = None) -> DataFrame:
    """(id, score): with c vertices reached, itself included, and their distances' sum S, (c - 1) ** 2 / ((V - 1) * S); 0 if S is 0."""
    graph.require()
    sources, edges = Table(graph.vertices.select("id")), _edges(graph)
    n, parts = sources.rows, -(-sources.rows // batch) if batch else 1
    whole: DataFrame | None = None
    if edges.rows <= blocks.MOST_EDGES:
        whole, parts = cut(blocks.reached(edges.df, sources.df, n, min(batch or n, 8 * blocks.WIDEST))), 0
    with Adjacency(edges.df, "src") as out:
        for i in range(parts):
            trail = _forward(out, sources.df.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i))
            own = cut(trail.all().groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("c"), F.sum("cost").alias("s")))
            for table in trail.tables:
                table.drop()
            whole = own if whole is None else whole.unionByName(own)
    score = F.when(F.col("s") > 0, (F.col("c") - 1) * (F.col("c") - 1) / (F.lit(float(n - 1)) * F.col("s"))).otherwise(0.0)
    return graph.vertices.select("id").join(whole, "id").select("id", score.alias("score"))
