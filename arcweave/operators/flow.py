"""Maximum flow.

What leaves the source is sent towards the sink in phases.  A phase finds the exact distance of every vertex to the sink
over arcs that have room, by a traversal backwards, and then lets a wave run down these distances: from the furthest
level to the nearest, every vertex passes on what has come to it, along its arcs to the next level, until these are full.
What a vertex cannot pass on stays for the next phase, in which the vertex is further from the sink.  A vertex that has
lost every way to the sink never gets one back, so what it holds is given up; when nothing else is left, what has come to
the sink is the maximum flow.

A wave uses an arc once, so the arcs are rewritten once a phase, and a level moves only what is on it.  An arc's share of
a vertex's excess follows from the running sum of room in front of it, which is taken over ranges of all arcs; so neither
a level nor a vertex with very many arcs is gathered in one task.

Defined results: repeated edges add up; self loops and edges with an end that is no vertex carry nothing; edges in both
directions are allowed; null or negative capacities count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import lookup_join
from ..functions.ordering import with_running
from ..graph import Graph
from ..plans.adjacency import Adjacency
from ..plans.iterate import Table, cut, scoped
from ..plans.ledger import Ledger


def _arcs(graph: Graph) -> DataFrame:
    """(src, dst, room) of arcs with room."""
    ids = graph.vertices.select("id")
    edges = graph.edges.where("src <> dst and weight > 0")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("room"))


def _distances(arcs: Table, sink: int) -> DataFrame:
    """(id, level): arcs with room to the sink, for the vertices that have a way there."""
    spark = arcs.df.sparkSession
    with Adjacency(arcs.df.select("src", "dst"), "dst", arcs.rows) as back, Ledger(spark.range(sink, sink + 1).select("id", F.lit(0).alias("level")), ["id"], ["level"], "once") as known:
        newest, level = known.base, 0
        while newest.rows:
            level += 1
            found = back.join(newest.df.select("id")).select(F.col("src").alias("id")).distinct()
            newest = known.add(known.beside(found).where("known is null").select("id", F.lit(level).alias("level")))
        return known.all()


def _downhill(arcs: Table, level: DataFrame, highest: int) -> DataFrame:
    """(src, dst, room, before) of arcs to the next level, from levels up to the highest; before: the room of the arcs of
    the same vertex that come first."""
    a, b = level.select(F.col("id").alias("src"), F.col("level").alias("_a")), level.select(F.col("id").alias("dst"), F.col("level").alias("_b"))
    down = lookup_join(lookup_join(arcs.df, "src", a, total=arcs.rows), "dst", b, total=arcs.rows).where(f"_a = _b + 1 and _a <= {highest}")
    summed = cut(with_running(down.select("src", "dst", "room"), ["src", "dst"], sums={"upto": "room"}))
    first = summed.groupBy("src").agg(F.min("upto").alias("_first"))
    return lookup_join(summed, "src", first, total=arcs.rows).select("src", "dst", "room", (F.col("upto") - F.col("_first")).alias("before"))


@scoped
def maxflow(graph: Graph, source: int, sink: int) -> DataFrame:
    """One row (source, sink, flow). The graph must be weighted and directed."""
    if not graph.weighted or not graph.directed:
        raise ValueError("flow needs a weighted, directed graph")
    if source == sink:
        raise ValueError("source and sink are the same")
    graph.require(source, sink)
    given = cut(_arcs(graph))
    # The source's arcs are filled at once. What comes back to the source, or leaves the sink, does not matter.
    inner = lambda df: df.where((F.col("src") != source) & (F.col("dst") != source) & (F.col("src") != sink))
    excess = Table(given.where(F.col("src") == source).select(F.col("dst").alias("id"), F.col("room").alias("excess")))
    arcs = Table(inner(given))
    while True:
        level = cut(_distances(arcs, sink))
        active = Table(excess.df.where(F.col("id") != sink).join(level, "id"))
        if not active.rows:
            break
        highest = active.df.agg(F.max("level")).first()[0]
        pushes: list[DataFrame] = []
        with Adjacency(cut(_downhill(arcs, level, highest)), "src", arcs.rows) as down:
            arrived: DataFrame | None = None
            for at in range(highest, 0, -1):
                here = active.df.where(F.col("level") == at).select("id", "excess")
                if arrived is not None:
                    here = here.unionByName(arrived).groupBy("id").agg(F.sum("excess").alias("excess"))
                push = F.least(F.col("room"), F.col("excess") - F.col("before"))
                pushed = cut(down.join(here).select(F.col("id").alias("src"), "dst", push.alias("push")).where("push > 0"))
                pushes.append(pushed)
                arrived = pushed.groupBy(F.col("dst").alias("id")).agg(F.sum("push").alias("excess"))
        moved = pushes[0]
        for pushed in pushes[1:]:
            moved = moved.unionByName(pushed)
        held = active.df.select("id", "excess").unionByName(excess.df.where(F.col("id") == sink))
        change = moved.select(F.col("src").alias("id"), (-F.col("push")).alias("excess")).unionByName(moved.select(F.col("dst").alias("id"), F.col("push").alias("excess")))
        excess = Table(held.unionByName(change).groupBy("id").agg(F.sum("excess").alias("excess")).where("excess > 0"))
        change = moved.select("src", "dst", (-F.col("push")).alias("room")).unionByName(inner(moved.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("push").alias("room"))))
        following = Table(arcs.df.unionByName(change).groupBy("src", "dst").agg(F.sum("room").alias("room")).where("room > 0"))
        arcs.drop()
        arcs = following
    flow = excess.df.where(F.col("id") == sink).agg(F.coalesce(F.sum("excess"), F.lit(0)).alias("flow"))
    return flow.select(F.lit(source).cast("long").alias("source"), F.lit(sink).cast("long").alias("sink"), "flow")
