"""Mixing sources to target weights.

The mix is as large as all documents.  Over its course t, from 0 to 1, a source has a weight: its target share times a
schedule, given as weights at even steps of t and linear between them, scaled so that the mean is 1.  The integral of
the weight, times the size of the mix, is the demand for the source's tokens up to t.  The documents of a source lie
behind each other in pseudo-random order on an axis of tokens, and behind the last one the source begins again, at most
max_repeats times in all; what lies before the whole demand is taken, and its position in the mix is the inverse of the
demand at its middle.  The mix is range-sorted by position, and numbered by the tokens that lie before.

The schedules of several sources are relative, each to its own source: at t, the sources share what is placed there as
their target shares times their weights do, so a source whose weight is high while others' are low has more than its
share for a while, and the mix passes through t faster where the sum of these products is above 1.  As each schedule has
mean 1, every source has its target share of the whole.

Running sums of tokens are taken at two levels: a source is cut into buckets of about bucket_rows documents by the hash
that also orders it, so a newspaper with a third of all documents is many small windows, and one window over the
buckets' sums.

Defined results: documents of null or unlisted sources count for the size of the mix and are not in it; documents
without tokens (null and empty texts among them) are not in it; equal ids are documents of their own; a null or negative
share or max_repeats counts as 0; targets with a null source are ignored, and of repeated sources the largest share
counts; without documents all shares reached are 0; a source that cannot reach its demand is used up, evenly over t.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import with_running
from ..plans.iterate import cut, scoped
from .bpe import TOKENIZER_DIR, VOCABULARY
from .tokens import count_tokens

BUCKET_ROWS = 20_000
SEED = 1985


def _segments(weights: Sequence[float]) -> list[tuple[float, float, float, float]]:
    """(t where it begins, weight there, slope, integral before) of each piece; the integral over all is 1."""
    if len(weights) < 2 or min(weights) < 0 or not any(weights):
        raise ValueError("a schedule is two or more weights, none negative and not all 0")
    step = 1 / (len(weights) - 1)
    whole = sum((a + b) / 2 * step for a, b in zip(weights, weights[1:]))
    out, before = [], 0.0
    for i, (a, b) in enumerate(zip(weights, weights[1:])):
        out.append((i * step, a / whole, (b - a) / whole / step, before))
        before += (a + b) / 2 * step / whole
    return out


def _literal(segments: list[tuple[float, float, float, float]]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(x, ("t", "w", "slope", "before")))) for x in segments))


def _integral(t: Column) -> Column:
    """The integral, from 0 to t, of the schedule in `pieces`."""
    piece = F.element_at(F.filter("pieces", lambda x: x["t"] <= t), -1)
    y = t - piece["t"]
    return piece["before"] + piece["w"] * y + piece["slope"] * y * y / 2


class Mix:
    """documents: (doc_id, source, n_tokens, repeat, position, first_token), first_token being the number of tokens of the
    mix that lie before; report: one row per listed source, added up from the documents as they are placed."""

    def __init__(self, documents: DataFrame, report: DataFrame, plan: DataFrame) -> None:
        self.documents, self.report, self._plan = documents, report, plan

    def ordered(self) -> DataFrame:
        return self.documents.orderBy("first_token")

    def course(self, parts: int = 10) -> DataFrame:
        """(source, part, tokens, expected): the tokens of each source in each of so many even parts of the course, and
        what its integrated weight asks for."""
        each = self._plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        upto = _integral((F.col("part") + 1) / parts) - _integral(F.col("part") / parts)
        each = each.select("source", "part", (F.when(F.col("max_repeats") > 0, F.col("taken")).otherwise(0.0) * upto).alias("expected"))
        part = F.least(F.lit(parts - 1), F.floor(F.col("position") * parts)).cast("int").alias("part")
        found = self.documents.groupBy("source", part).agg(F.sum("n_tokens").alias("tokens"))
        return each.join(found, ["source", "part"], "left").select("source", "part", F.coalesce("tokens", F.lit(0)).alias("tokens"), "expected")

    def checked(self, parts: int = 10) -> DataFrame:
        """One row of counts of what is wrong with the mix; all 0 for a right one.

        unordered: neighbours by first_token whose positions fall. gaps: neighbours where first_token does not go on by the
        tokens between. over_repeats: documents placed more often than their source allows, equal ids apart. off_course:
        sources and parts whose tokens differ from the integrated weight by more than two of the source's largest documents.
        """
        numbered = cut(with_running(self.documents, ["first_token"], index="i"))
        after = numbered.select((F.col("i") - 1).alias("i"), F.col("position").alias("_position"), F.col("first_token").alias("_first"))
        steps = numbered.join(after, "i").agg(F.count(F.when(F.col("_position") < F.col("position"), 1)).alias("unordered"), F.count(F.when(F.col("_first") != F.col("first_token") + F.col("n_tokens"), 1)).alias("gaps"))
        over = self.documents.groupBy("source").agg((F.max("repeat") + 1).alias("most")).join(self._plan, "source").agg(F.count(F.when(F.col("most") > F.col("max_repeats"), 1)).alias("over_repeats"))
        largest = self.documents.groupBy("source").agg(F.max("n_tokens").alias("largest"))
        off = self.course(parts).join(largest, "source", "left").agg(F.count(F.when(F.abs(F.col("tokens") - F.col("expected")) > 2 * F.coalesce("largest", F.lit(0)), 1)).alias("off_course"))
        return steps.join(over).join(off)  # one row each


@scoped
def mix(documents: DataFrame, targets: DataFrame, schedules: Mapping[str, Sequence[float]] | None = None, bucket_rows: int = BUCKET_ROWS, seed: int = SEED, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Mix:
    """documents(doc_id, source, text), targets(source, target_share, max_repeats)."""
    spark = documents.sparkSession
    sizes = cut(count_tokens(documents, ["doc_id", "source"], "text", directory, vocabulary))
    of_source = cut(sizes.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count(F.when(F.col("n_tokens") > 0, 1)).alias("n_docs")))
    total = of_source.agg(F.sum("supply")).first()[0] or 0
    pieces = _literal(_segments([1.0, 1.0]))
    for source, weights in (schedules or {}).items():
        pieces = F.when(F.col("source") == source, _literal(_segments(weights))).otherwise(pieces)
    targets = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = targets.join(of_source, "source", "left").select(
        "source",
        F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
        F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0))).cast("long").alias("max_repeats"),
        F.coalesce("supply", F.lit(0)).alias("supply"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        pieces.alias("pieces"))
    plan = plan.withColumn("demand", F.col("target_share") * F.lit(float(total))).withColumn("taken", F.least(F.col("demand"), (F.col("max_repeats") * F.col("supply")).cast("double")))
    plan = cut(plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_rows)).cast("long")))

    rows = sizes.where("n_tokens > 0").join(plan.where("demand > 0 and max_repeats > 0"), "source").withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.withColumn("_b", F.pmod(F.shiftright("_h", 20), F.col("buckets")))
    in_bucket = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_upto", F.sum("n_tokens").over(in_bucket))
    of_bucket = sizes.where("n_tokens > 0").join(plan.select("source", "buckets"), "source").groupBy("source", F.pmod(F.shiftright(F.xxhash64("doc_id", F.lit(seed)), 20), F.col("buckets")).alias("_b")).agg(F.sum("n_tokens").alias("_n"))
    before = of_bucket.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("source", "_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    rows = rows.join(before, ["source", "_b"]).withColumn("_start", F.col("_before") + F.col("_upto") - F.col("n_tokens"))
    copies = F.least(F.col("max_repeats"), F.ceil((F.col("demand") - F.col("_start")) / F.col("supply")).cast("long"))
    rows = rows.where(F.col("_start") < F.col("demand")).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    share = F.least(F.lit(1.0), (F.col("_start") + F.col("repeat") * F.col("supply") + F.col("n_tokens") / 2) / F.col("taken"))
    piece = F.element_at(F.filter("pieces", lambda x: x["before"] <= F.col("_share")), -1)
    rows = rows.withColumn("_share", share).withColumn("_p", piece).withColumn("_y", F.col("_share") - F.col("_p.before"))
    # w x + slope x^2 / 2 = y, solved without a difference of nearly equal numbers
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("_p.w") * F.col("_p.w") + 2 * F.col("_p.slope") * F.col("_y")))
    below = F.col("_p.w") + root
    position = F.col("_p.t") + F.when(below > 0, 2 * F.col("_y") / below).otherwise(0.0)
    placed = rows.select("doc_id", "source", "n_tokens", "repeat", position.alias("position"))
    placed = cut(with_running(placed, ["position", "source", "doc_id", "repeat", "n_tokens"], sums={"first_token": "n_tokens"}))

    reached = placed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), (F.max("repeat") + 1).alias("most_repeats"))
    report = plan.select("source", "target_share", "max_repeats", "supply", "demand").join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", "supply", "demand",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "copies", "most_repeats")))
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per listed source
    report = report.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)).withColumn("short", F.col("tokens") < F.col("demand"))
    return Mix(placed, report, plan)
