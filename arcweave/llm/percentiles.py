"""Percentiles of groups from mergeable sketches with a stated error.

The sketch is a hierarchy of randomised compactors (KLL): a full level is sorted, every other value is kept and moves up
a level at twice the weight; two sketches are merged level by level.  Spark builds it on the map side, so that a group
that holds a third of all rows leaves each task as one sketch of at most about 3 k values.  A sketch of k values answers
a percentile with a rank error of at most rank_error(k), with 99 % probability; groups of up to k values are exact.

Results by day or file are tables of sketches (column `sketch` per field); merge() combines them.

Defined results: null, NaN and infinite values count for no field; a group without finite values has n = 0 and null
percentiles; a null group key is a group of its own; an empty table has no groups; columns that are not asked for are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut, scoped

K = 800
GRID = 512
BOUND = 1_000_000
#: A table of brackets of up to so many rows, of about 60 bytes each, is broadcast.
BROADCAST_ROWS = 50_000


def rank_error(k: int) -> float:
    """The error of a single rank, as a share of the values, that is exceeded with a probability of 1 %."""
    return 2.296 / k**0.9723  # fixed values: fitted by the authors of the sketch's public implementation


def finite(value: Column) -> Column:
    """The value as double; null unless it is finite."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def sketches(df: DataFrame, keys: Sequence[Column], fields: Sequence[str], k: int = K) -> DataFrame:
    """One row per group of the keys and field: (keys..., field, sketch, n). This form can be stored and merged.

    keys: columns with aliases other than field, sketch and n. All fields are sketched in one pass and one shuffle.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    given = [df.select(c).columns[0] for c in keys]
    rows = df.select(*(c.alias(n) for c, n in zip(keys, names)), *(finite(F.col(f"`{f}`")).alias(f"_f{i}") for i, f in enumerate(fields)))
    wide = rows.groupBy(*names).agg(*(F.kll_sketch_agg_double(f"_f{i}", F.lit(k)).alias(f"_f{i}") for i in range(len(fields))))
    long = wide.select(*names, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").alias("sketch")) for i, f in enumerate(fields)))).alias("_s"))
    return long.select(*(F.col(n).alias(g) for n, g in zip(names, given)), "_s.field", "_s.sketch", F.coalesce(F.kll_sketch_get_n_double("_s.sketch"), F.lit(0)).alias("n"))


def merge(parts: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Combine sketches of days, files or partitions: (keys..., field, sketch, n)."""
    merged = parts.groupBy(*keys, "field").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged.withColumn("n", F.coalesce(F.kll_sketch_get_n_double("sketch"), F.lit(0)))


def quantile(rank: float) -> Column:
    """The value of `sketch` at a rank from 0 to 1; null for an empty sketch."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, rank)))))


def grid() -> Column:
    """The values of `sketch` at GRID + 1 evenly spaced ranks. Spark takes constant ranks only; see low() and high()."""
    ranks = F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", ranks))


def low(values: str, rank: Column) -> Column:
    """Of a grid, the value at the next rank that is no larger."""
    return F.element_at(values, (F.greatest(F.lit(0), F.least(F.lit(GRID), F.floor(rank * GRID))) + 1).cast("int"))


def high(values: str, rank: Column) -> Column:
    """Of a grid, the value at the next rank that is no smaller."""
    return F.element_at(values, (F.greatest(F.lit(0), F.least(F.lit(GRID), F.ceil(rank * GRID))) + 1).cast("int"))


def _name(p: float) -> str:
    return f"p{100 * p:g}".replace(".", "_")


def percentiles(table: DataFrame, wanted: Sequence[float], k: int = K) -> DataFrame:
    """Add, for each wanted percentile p, p<100p> and its bounds p<100p>_low and p<100p>_high, and the rank error."""
    exact, e = F.col("n") <= k, rank_error(k)
    out = []
    for p in wanted:
        name, value = _name(p), quantile(p)
        out += [value.alias(name), F.when(exact, value).otherwise(quantile(p - e)).alias(f"{name}_low"), F.when(exact, value).otherwise(quantile(p + e)).alias(f"{name}_high")]
    return table.select(*(c for c in table.columns if c != "sketch"), *out, F.when(exact, 0.0).otherwise(e).alias("rank_error"))


def _beside(rows: DataFrame, table: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows(_key, _field, v) joined with a written table of some rows per group (_k, _f, n, ...), n being the group's size.

    A table of at most most_rows rows is broadcast. Of a longer one, only the groups with more values than a quarter of
    an average partition are, of which there are at most four per partition; the others are joined by shuffle.
    """
    on = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_field") == F.col("_f"))
    if table.count() <= most_rows:
        return rows.join(F.broadcast(table), on)
    groups = table.select("_k", "_f", "n").distinct()
    most = groups.agg(F.sum("n")).first()[0] / (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = rows.join(F.broadcast(table.where(F.col("n") > most)), on)
    light = rows.join(F.broadcast(groups.where(F.col("n") > most)), on, "left_anti").join(table.where(F.col("n") <= most), on)
    return heavy.unionByName(light)


def _values(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(_key, _field, v): a row for each finite value."""
    stacked = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), finite(F.col(f"`{f}`")).alias("v")) for f in fields)))
    return df.select(F.col(f"`{key}`").alias("_key"), stacked.alias("_s")).select("_key", F.col("_s.field").alias("_field"), F.col("_s.v").alias("v")).where("v is not null")


_RANKS = {"a": F.floor, "b": F.ceil}


def _counted(rows: DataFrame, brackets: DataFrame, k: int) -> DataFrame:
    """Add to each bracket what a pass over its group tells: how many values lie below, at its ends and between, the
    first and last of those between and a sketch of them, the group's least and largest, and `a` and `b`, the values at
    the ranks next to p, as far as they are known now."""
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    between = F.when((v > low) & (v < high), v)
    found = _beside(rows, brackets).groupBy("_k", "_f", "p", "n", "low", "high").agg(
        F.count(F.when(v < low, 1)).alias("below"), F.count(F.when(v == low, 1)).alias("at_low"), F.count(F.when((v == high) & (high > low), 1)).alias("at_high"),
        F.count(between).alias("strict"), F.min(between).alias("first"), F.max(between).alias("last"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.kll_sketch_agg_double(between, F.lit(k)).alias("sketch"))
    start, end = F.col("below") + F.col("at_low"), F.col("below") + F.col("at_low") + F.col("strict")
    found = found.withColumn("start", start).withColumn("upto", end + F.col("at_high"))
    for name, step in _RANKS.items():
        r = step(F.col("p") * (F.col("n") - 1))
        found = found.withColumn(name, F.when((r >= F.col("below")) & (r < start), low).when((r >= end) & (r < F.col("upto")), high)
            .when((r == start) & (r < end), F.col("first")).when((r == end - 1) & (r >= start), F.col("last")))
    return cut(found)


@scoped
def exact_percentiles(df: DataFrame, key: str, brackets: DataFrame, k: int = K, bound: int = BOUND) -> DataFrame:
    """Exact, interpolated percentiles of the groups in brackets(key, field, p, n, low, high), where n is the number of
    finite values and low and high are values that should enclose the percentile.

    A pass over the groups counts what lies below, at and between the ends. A bracket that does not enclose its ranks is
    widened. A rank that falls on an end, or next to one, is answered at once, so equal values, however many, are never
    gathered. What is left lies between the ends: at most `bound` values are ranked one by one, more of them are narrowed
    by their sketch, whose values become the new ends. Every turn leaves fewer values between, so there is no limit of turns.
    """
    fields = [r[0] for r in brackets.select("field").distinct().collect()]  # at most the fields asked for
    if not fields:
        return brackets.select(key, "field", "p", F.lit(None).cast("double").alias("value"))
    rows = _values(df, key, fields)
    names = ["_k", "_f", "p", "n", "low", "high"]
    now = cut(brackets.select(F.col(key).alias("_k"), F.col("field").alias("_f"), "p", "n", "low", "high"))
    known, few = [], []
    first, following = (step(F.col("p") * (F.col("n") - 1)) for step in _RANKS.values())
    while not now.isEmpty():
        counted = _counted(rows, now, k)
        solved = F.col("a").isNotNull() & F.col("b").isNotNull()
        missed = (first < F.col("below")) | (following >= F.col("upto"))
        known.append(counted.where(solved).select("_k", "_f", "p", "n", "a", "b"))
        rest = counted.where(~solved)
        few.append(rest.where(~missed & (F.col("strict") <= bound)).select(*names, "start"))
        wide = rest.where(missed).select("_k", "_f", "p", "n", F.when(first < F.col("below"), F.col("least")).otherwise(F.col("low")).alias("low"), F.when(following >= F.col("upto"), F.col("most")).otherwise(F.col("high")).alias("high"))
        room = F.lit(3 * rank_error(k))
        many = rest.where(~missed & (F.col("strict") > bound)).withColumn("grid", F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))))
        many = many.withColumn("from", (first - F.col("start")) / F.col("strict") - room).withColumn("to", (following + 1 - F.col("start")) / F.col("strict") + room)
        narrow = many.select("_k", "_f", "p", "n", F.when(F.col("from") > 0, low("grid", F.col("from"))).otherwise(F.col("first")).alias("low"), F.when(F.col("to") < 1, high("grid", F.col("to"))).otherwise(F.col("last")).alias("high"))
        now = cut(wide.unionByName(narrow))
    listed = cut(_united(few))
    if not listed.isEmpty():
        values = _beside(rows, listed).where("v > low and v < high").groupBy("_k", "_f", "p", "n", "start", "v").count()
        upto = F.col("start") + F.sum("count").over(Window.partitionBy("_k", "_f", "p").orderBy("v"))
        ranked = values.withColumn("upto", upto).withColumn("since", F.col("upto") - F.col("count"))
        pick = lambda r: F.max(F.when((F.col("since") <= r) & (r < F.col("upto")), F.col("v")))
        known.append(ranked.groupBy("_k", "_f", "p", "n").agg(pick(first).alias("a"), pick(following).alias("b")))
    at = F.col("p") * (F.col("n") - 1)
    value = F.col("a") + (at - first) * (F.col("b") - F.col("a"))
    return _united(known).select(F.col("_k").alias(key), F.col("_f").alias("field"), "p", value.alias("value"))


def _united(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@scoped
def misplaced(df: DataFrame, key: str, table: DataFrame, wanted: Sequence[float], k: int = K) -> DataFrame:
    """(key, field, n, outside) of each group of a table of percentiles(): how many of the wanted ones are values whose
    true rank is further from the wanted one than three times the stated error (for groups that are exact, at all)."""
    fields = [r[0] for r in table.select("field").distinct().collect()]
    asked = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(_name(p)).alias("x")) for p in wanted))).alias("_a")
    asked = cut(table.where("n > 0").select(F.col(key).alias("_k"), F.col("field").alias("_f"), "n", asked).select("_k", "_f", "n", "_a.p", "_a.x"))
    if not fields or asked.isEmpty():
        return table.select(key, "field", "n", F.lit(0).cast("long").alias("outside"))
    counts = _beside(_values(df, key, fields), asked).groupBy("_k", "_f", "n", "p").agg(F.count(F.when(F.col("v") < F.col("x"), 1)).alias("less"), F.count(F.when(F.col("v") <= F.col("x"), 1)).alias("upto"))
    rank = F.col("p") * F.col("n")
    away = F.greatest(F.col("less") - rank, rank - F.col("upto"), F.lit(0.0)) > F.when(F.col("n") <= k, 0.0).otherwise(3 * rank_error(k) * F.col("n")) + 1
    bad = counts.groupBy("_k", "_f").agg(F.count(F.when(away, 1)).alias("outside"))
    return table.select(key, "field", "n").join(bad, F.col(key).eqNullSafe(F.col("_k")) & (F.col("field") == F.col("_f")), "left").select(key, "field", "n", F.coalesce("outside", F.lit(0)).alias("outside"))


@scoped
def heavy_tails(df: DataFrame, key: str, fields: Sequence[str], least: int = 40, high_at: float = 0.9, times: float = 4.0, k: int = K) -> DataFrame:
    """Groups and fields with at least `least` finite values whose high percentile is more than `times` the median: (key, field).

    Sketches decide all groups whose bounds, taken at three times the stated error, leave no doubt; the percentiles of
    the others are made exact.
    """
    e = F.when(F.col("n") <= k, 0.0).otherwise(3 * rank_error(k)) + 1.5 / F.col("n")
    groups = sketches(df, [F.col(f"`{key}`").alias(key)], fields, k).where(F.col("n") >= least).select(key, "field", "n", grid().alias("grid"), e.alias("e"))
    groups = cut(groups.select(
        key, "field", "n",
        low("grid", F.lit(0.5) - F.col("e")).alias("mid_low"), high("grid", F.lit(0.5) + F.col("e")).alias("mid_high"),
        low("grid", F.lit(high_at) - F.col("e")).alias("high_low"), high("grid", F.lit(high_at) + F.col("e")).alias("high_high")))
    # The multiple of a negative median is smaller than the median; the bounds hold with any sign.
    sure = F.col("high_low") > times * F.col("mid_high")
    open_ = ~sure & (F.col("high_high") > times * F.col("mid_low"))
    doubtful = groups.where(open_)
    brackets = doubtful.select(key, "field", "n", F.explode(F.array(
        F.struct(F.lit(0.5).alias("p"), F.col("mid_low").alias("low"), F.col("mid_high").alias("high")),
        F.struct(F.lit(high_at).alias("p"), F.col("high_low").alias("low"), F.col("high_high").alias("high")))).alias("b")).select(key, "field", "n", "b.*")
    exact = exact_percentiles(df, key, brackets, k)
    checked = exact.groupBy(key, "field").agg(F.max(F.when(F.col("p") == high_at, F.col("value"))).alias("h"), F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("m")).where(F.col("h") > times * F.col("m"))
    return groups.where(sure).select(key, "field").unionByName(checked.select(key, "field"))
