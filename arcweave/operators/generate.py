"""Synthetic graphs, generated by range and hash; only renumbering joins edges with new ids.

Every edge follows from its number, or that of its block, and the seed, so a lost task makes the same edges again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import spread
from ..graph import Graph
from ..plans.shipping import ship

SEED = 1985
# The initiator of R-MAT graphs, and the noise that each level adds to it.
RMAT = (0.57, 0.19, 0.19, 0.05)
NOISE = 0.05
SCALE = 20
BITS = 53
BLOCK = 1 << 17
# How dense the blocks of the smallest degree are and how this falls, the share of vertices of degree one that
# are linked by hand, what is added to the others' degree, and the links drawn in excess.
RHO, RHO_DECAY, BY_HAND, TWEAK, EXTRA = 0.9, 0.5, 0.75, 0.1, 0.1
#: What a vertex lacks is counted in so many parts of a link.
PARTS = 1000


def _uniform(seed: int, *of: Column | str) -> Column:
    """A number in [0, 1) that follows from the columns and the seed."""
    return F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << BITS)) / F.lit(float(1 << BITS))


def _vertices(spark: SparkSession, n: int):
    return spark.range(n).select("id")


def _checked(scale: int, edge_factor: int) -> tuple[int, int]:
    if not 2 <= scale <= 32 or edge_factor < 1:
        raise ValueError("a scale from 2 to 32 and an edge factor from 1 on")
    n = (1 << scale) - 2
    return n, edge_factor * n


def _rmat_block(block: int, count: int, scale: int, vertices: int, seed: int, initiator: Sequence[float], noise: float) -> tuple[np.ndarray, np.ndarray]:
    """The ends of a block's edges. Edges that are self loops or end beyond the last vertex are drawn again."""
    draw = np.random.Generator(np.random.Philox(key=[seed, block]))
    src, dst = np.empty(count, np.int64), np.empty(count, np.int64)
    open_ = np.arange(count)
    while len(open_):
        a, b = np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
        for _ in range(scale):
            # Each quadrant's probability is stretched or shrunk by up to the noise.
            p = np.array(initiator)[:, None] * (1 - noise + 2 * noise * draw.random((4, len(open_))))
            upto = np.cumsum(p, axis=0)
            quadrant = (draw.random(len(open_)) * upto[3] >= upto[:3]).sum(axis=0)
            a, b = 2 * a + (quadrant >> 1), 2 * b + (quadrant & 1)
        src[open_], dst[open_] = a, b
        open_ = open_[(a == b) | (a >= vertices) | (b >= vertices)]
    return src, dst


def _drawn(spark: SparkSession, scale: int, edge_factor: int, seed: int, initiator: Sequence[float], noise: float, block_edges: int) -> Graph:
    """The graph with ids as drawn, by which low ids have the most edges."""
    n, m = _checked(scale, edge_factor)
    blocks = -(-m // block_edges)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                ends = _rmat_block(block, min(block_edges, m - block * block_edges), scale, n, seed, initiator, noise)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["src", "dst"])

    edges = spark.range(0, blocks, 1, min(blocks, 10_000)).mapInArrow(run, "src long, dst long")
    return Graph(_vertices(spark, n), edges)


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = SEED, initiator: Sequence[float] = RMAT, noise: float = NOISE, block_edges: int = BLOCK) -> Graph:
    """2 ** scale - 2 vertices, edge_factor edges for each, no self loops, renumbered at random. Blocks of edges have
    random streams of their own."""
    from .transform import permuted

    return permuted(_drawn(spark, scale, edge_factor, seed, initiator, noise, block_edges).written(), seed)


def uniform(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = SEED) -> Graph:
    """Ends drawn evenly, no self loops."""
    n, m = _checked(scale, edge_factor)
    src, shift = F.pmod(spread(seed, "id"), F.lit(n)), F.pmod(spread(seed + 1, "id"), F.lit(n - 1)) + 1
    edges = spark.range(m).select(src.alias("src"), shift.alias("shift")).select("src", F.pmod(F.col("src") + F.col("shift"), F.lit(n)).alias("dst"))
    return Graph(_vertices(spark, n), edges)


def kronecker(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = SEED) -> Graph:
    """rmat() without noise."""
    return rmat(spark, scale, edge_factor, seed, noise=0.0)


def falling(degree: int, largest: int, first: float = RHO, decay: float = RHO_DECAY) -> float:
    """How densely a block whose vertices have this degree is linked: less the larger the degree."""
    if degree < 2 or largest <= 2:
        return first
    return max(0.0, first * (1 - decay * (math.log(degree - 1) / math.log(largest - 1)) ** 2))


def bter(spark: SparkSession, degrees: Sequence[tuple[int, int]], clustering: Callable[[int, int], float] = falling, by_hand: float = BY_HAND, seed: int = SEED) -> Graph:
    """Blocks of vertices of about equal degree, densely linked within, with the rest of each degree spread over all.

    degrees: (degree, number of vertices), as a distribution. A block of degree d has d + 1 vertices, each pair linked
    with probability clustering(d, largest degree). What vertices still lack is linked, EXTRA more of it as repeated links
    vanish, between vertices drawn in proportion to what they lack. Vertices of degree one are in no block; of these, the
    share `by_hand` gets its one link for certain: p of them, with M edges in all, get p ** 2 / (2 M) links among
    themselves, and the others one to a vertex that is drawn as above; the rest is drawn as if of degree 1 + TWEAK.
    Undirected, simple.
    """
    runs, n = [], 0
    for d, count in sorted(degrees):
        if d > 0 and count > 0:
            runs.append((d, n, count))
            n += count
    isolated = sum(count for d, count in degrees if d == 0)
    vertices = spark.range(n + isolated).select("id")
    if not runs:
        return Graph(vertices, spark.range(0).select("id", F.col("id").alias("dst")).withColumnRenamed("id", "src"), directed=False)
    largest, ones = runs[-1][0], sum(c for d, _, c in runs if d == 1)
    manual = int(by_hand * ones)
    # One piece of the table for each degree, and one more for the vertices of degree one that are linked by hand.
    pieces, upto = [], 0
    for d, a, c in runs:
        for first, count, rho, lack in [(a, manual, 0.0, 0.0), (a + manual, c - manual, 0.0, 1.0 + TWEAK)] if d == 1 else [(a, c, clustering(d, largest), d * (1 - clustering(d, largest)))]:
            if count:
                pieces.append((d, first, count, rho, lack, upto))
                upto += round(count * lack * PARTS)
    names = (("d", "int"), ("a", "long"), ("c", "long"), ("rho", "double"), ("lack", "double"), ("u", "long"))
    spec = F.array(*(F.struct(*(F.lit(v).cast(t).alias(k) for v, (k, t) in zip(x, names))) for x in pieces))
    owned = spark.range(n).select("id", F.element_at(F.filter(spec, lambda r: r["a"] <= F.col("id")), -1).alias("r"))
    block = F.floor((F.col("id") - F.col("r.a")) / (F.col("r.d") + 1))
    first = F.col("r.a") + block * (F.col("r.d") + 1)
    last = F.least(first + F.col("r.d"), F.col("r.a") + F.col("r.c") - 1)
    # A vertex links to the later ones of its block: at most d of them.
    later = F.explode(F.when((F.col("id") < last) & (F.col("r.rho") > 0), F.sequence(F.col("id") + 1, last)).otherwise(F.array().cast("array<bigint>")))
    within = owned.withColumn("dst", later).where(_uniform(seed, "id", "dst") < F.col("r.rho")).select(F.col("id").alias("src"), "dst")

    def drawn(rows: DataFrame, seed: int) -> DataFrame:
        """rows(src, k) with a vertex drawn in proportion to what it lacks."""
        x = rows.withColumn("x", F.pmod(F.xxhash64("src", "k", F.lit(seed)), F.lit(max(upto, 1))))
        x = x.withColumn("t", F.element_at(F.filter(spec, lambda r: (r["u"] <= F.col("x")) & (r["lack"] > 0)), -1))
        return x.select("src", (F.col("t.a") + F.floor((F.col("x") - F.col("t.u")) / (F.col("t.lack") * PARTS))).alias("dst"))

    # Half of what all lack, as each link serves two.
    share = F.col("r.lack") / 2 * (1 + EXTRA)
    times = (F.floor(share) + F.when(_uniform(seed + 1, "id") < share - F.floor(share), 1).otherwise(0)).cast("int")
    stubs = owned.select(F.col("id").alias("src"), F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias("k"))
    links = within.union(drawn(stubs, seed + 2) if upto else stubs.select("src", F.col("src").alias("dst")))
    if manual:
        start = next(a for d, a, _ in runs if d == 1)
        edges = sum(d * c for d, _, c in runs) / 2
        among = min(manual // 2, round(manual * manual / (2 * edges))) if upto else manual // 2
        hand = spark.range(manual)
        pairs = hand.where(F.col("id") < among).select((F.col("id") * 2 + start).alias("src"), (F.col("id") * 2 + 1 + start).alias("dst"))
        singles = hand.where(F.col("id") >= 2 * among).select((F.col("id") + start).alias("src"), F.lit(0).alias("k"))
        links = links.union(pairs).union(drawn(singles, seed + 3)) if upto else links.union(pairs)
    links = links.where("src <> dst")
    return Graph(vertices, links.union(links.select("dst", "src")).distinct(), directed=False)
