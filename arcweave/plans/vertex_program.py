"""Vertex programs: what users write instead of kernels and callbacks.

A program is made of column expressions only. In each superstep the active vertices send messages along (and against)
their edges, messages to one vertex are reduced on the sender's side first, and vertices that get one update their
state.  With `gather`, it is the vertices that want something that fetch it: only their edges are looked at.  The program
ends when no vertex is active, or after max_steps.  A superstep writes the vertices that it updates, see plans.ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .adjacency import Adjacency
from .iterate import scoped
from .ledger import Ledger

REDUCERS: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


@scoped
def run(
    graph: Graph,
    initial: Column,
    send: Column,
    reduce: str,
    update: Column,
    against: Column | None = None,
    active: Column | None = None,
    gather: Column | None = None,
    idle: bool = False,
    max_steps: int | None = None,
    before_step: Callable[[int], None] | None = None,
) -> DataFrame:
    """(id, state) after the last superstep.

    initial: from id (and value, if the graph has values).  send and against: from id, state, dst and weight (weight is
    1 where the graph has none), evaluated at the sender; null sends nothing.  For `against`, dst is the edge's source.
    reduce: sum, min or max.  update: from id, state and message.  active: from old and state; by default a vertex is
    active when its state changed.  Every vertex is active at first.

    gather: from id and state; the vertices for which it is true look along their incoming edges for active senders, and
    no others get messages.  idle: vertices without a message update, too, with message null.  A program in which none
    of them would change is the same without, and cheaper.
    """
    combine = REDUCERS[reduce]
    active = (~F.col("old").eqNullSafe(F.col("state"))) if active is None else active
    edges = graph.with_weights()
    start = graph.vertices.select("id", initial.alias("state"))
    if gather is not None and against is not None:
        raise ValueError("gather looks along incoming edges only")
    with ExitStack() as stack:
        known = stack.enter_context(Ledger(start, ["id"], ["state"], "newest"))
        out = stack.enter_context(Adjacency(edges, "src" if gather is None else "dst"))
        back = stack.enter_context(Adjacency(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), "src")) if against is not None else None
        newest, senders, turn = known.base, known.base.df.select("id", "state"), 0
        while newest.rows and (max_steps is None or turn < max_steps):
            turn += 1
            if senders.isEmpty():
                break
            if before_step:
                before_step(turn)
            if gather is None:
                sent = out.join(senders).select(F.col("dst").alias("id"), send.alias("message"))
            else:
                wanting = known.all().where(gather).select(F.col("id").alias("_to"))
                found = out.join(wanting, "_to").withColumnRenamed("src", "id").join(senders, "id").withColumn("dst", F.col("_to"))
                sent = found.select("_to", send.alias("message")).withColumnRenamed("_to", "id")
            if back is not None:
                sent = sent.union(back.join(senders).select("dst", against.alias("message")))
            inbox = sent.where("message is not null").groupBy("id").agg(combine("message").alias("message"))
            if idle:
                told = known.all().withColumnRenamed("state", "known").join(inbox, "id", "left")
            else:  # messages to ids that are no vertices go nowhere
                told = known.beside(inbox).join(graph.vertices.select("id"), "id", "left_semi")
            told = told.select("id", F.col("known").alias("old"), F.col("known").alias("state"), "message")
            new = told.select("id", "old", update.alias("state"))
            newest = known.add(new.select("id", "state", active.alias("active")))
            senders = newest.df.where("active").select("id", "state")
        return known.all()
