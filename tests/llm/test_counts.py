"""Percentiles, frequent values and term counts against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcweave.llm import frequent, percentiles, terms


def runs(spark, rows):
    return spark.createDataFrame(rows, "config_id long, exec double, alpha int, day int, n string, sketch string")


def test_sketch_is_within_its_bound_and_merges(spark):
    draw = np.random.default_rng(4)
    values = draw.lognormal(0, 3, 60_000)
    rows = [(1, float(v), None, i % 7, "x", "y") for i, v in enumerate(values)]
    k = 200
    days = percentiles.sketches(runs(spark, rows), [F.col("config_id"), F.col("day")], ["exec", "alpha"], k)
    assert days.count() == 14
    merged = percentiles.merge(days, ["config_id"], k)
    got = {r.field: r for r in percentiles.percentiles(merged, (0.5, 0.9), k).collect()}
    assert got["exec"].n == 60_000 and got["alpha"].n == 0 and got["alpha"].p50 is None
    ordered = np.sort(values)
    for p, name in ((0.5, "p50"), (0.9, "p90")):
        rank = np.searchsorted(ordered, got["exec"][name]) / len(ordered)
        assert abs(rank - p) <= 2 * percentiles.rank_error(k)
        assert got["exec"][f"{name}_low"] <= got["exec"][name] <= got["exec"][f"{name}_high"]
    assert got["exec"].rank_error == percentiles.rank_error(k)


def test_small_groups_are_exact_and_odd_values_do_not_count(spark):
    rows = [(1, float(v), 5, 0, "x", "y") for v in range(1, 12)] + [(1, x, None, 0, "x", "y") for x in (None, math.nan, math.inf, -math.inf)] + [(None, 2.0, 1, 0, "x", "y"), (2, math.nan, None, 0, "x", "y")]
    got = {(r.config_id, r.field): r for r in percentiles.percentiles(percentiles.sketches(runs(spark, rows), [F.col("config_id")], ["exec", "alpha"]), (0.5,)).collect()}
    assert got[(1, "exec")].n == 11 and got[(1, "exec")].p50 == 6.0 and got[(1, "exec")].rank_error == 0
    assert got[(1, "alpha")].p50 == 5.0 and got[(None, "exec")].n == 1 and got[(2, "exec")].n == 0
    nothing = percentiles.sketches(runs(spark, rows).limit(0), [F.col("config_id")], ["exec"])
    assert nothing.count() == 0


@pytest.mark.parametrize("k", [8, 50, 800])
def test_heavy_tails(spark, k):
    """Many groups near the threshold; a small sketch leaves most of them in doubt."""
    draw = np.random.default_rng(9)
    rows, expected = [], set()
    for config in range(40):
        n = int(draw.integers(35, 400))
        values = np.round(draw.lognormal(0, 0.6 + 0.05 * config, n), 2)
        alpha = draw.integers(0, 5, n)
        rows += [(config, float(v), int(a), 0, "x", "y") for v, a in zip(values, alpha)] + [(config, math.nan, None, 0, "x", "y")]
        for field, x in (("exec", values), ("alpha", alpha)):
            if n >= 40 and np.percentile(x, 90) > 4 * np.percentile(x, 50):
                expected.add((config, field))
    rows += [(99, -1.0 - i % 5, 0, 0, "x", "y") for i in range(60)]
    if np.percentile([-1.0 - i % 5 for i in range(60)], 90) > 4 * np.percentile([-1.0 - i % 5 for i in range(60)], 50):
        expected.add((99, "exec"))
    got = {tuple(r) for r in percentiles.heavy_tails(runs(spark, rows), "config_id", ["exec", "alpha"], k=k).collect()}
    assert got == expected
    assert percentiles.heavy_tails(runs(spark, rows).limit(0), "config_id", ["exec"], k=k).count() == 0


def test_exact_percentiles_narrow_a_wide_bracket(spark):
    draw = np.random.default_rng(2)
    values = np.round(draw.normal(0, 1, 5000), 3)
    df = runs(spark, [(None, float(v), 1, 0, "x", "y") for v in values])
    brackets = spark.createDataFrame([(None, "exec", 5000, p, -9.0, 9.0) for p in (0.0, 0.37, 0.5, 1.0)], "config_id long, field string, n long, p double, low double, high double")
    got = {r.p: r.value for r in percentiles.exact_percentiles(df, "config_id", brackets, k=100, bound=900).collect()}
    assert got == pytest.approx({p: np.percentile(values, 100 * p) for p in (0.0, 0.37, 0.5, 1.0)})


def _brackets(spark, rows):
    return spark.createDataFrame(rows, "config_id long, field string, n long, p double, low double, high double")


def test_brackets_that_miss_are_widened(spark):
    df = runs(spark, [(1, float(v), 1, 0, "x", "y") for v in range(1000)])
    rows = [(1, "exec", 1000, p, a, b) for p, a, b in ((0.5, 600.0, 700.0), (0.25, 2000.0, 3000.0), (0.75, -9.0, -3.0), (0.3, 100.0, 200.0), (0.6, 599.4, 599.4))]
    for bound in (1_000_000, 50):
        got = {r.p: r.value for r in percentiles.exact_percentiles(df, "config_id", _brackets(spark, rows), k=100, bound=bound).collect()}
        assert got == pytest.approx({p: np.percentile(np.arange(1000), 100 * p) for p in (0.5, 0.25, 0.75, 0.3, 0.6)})


def test_equal_values_are_never_gathered(spark, monkeypatch):
    """A million equal values are answered by one pass, and a few more by two, whatever the bound."""
    passes = []
    plain = percentiles._counted
    monkeypatch.setattr(percentiles, "_counted", lambda *x: passes.append(1) or plain(*x))
    equal = spark.range(1_000_000).selectExpr("1 AS config_id", "7.0D AS exec")
    got = percentiles.exact_percentiles(equal, "config_id", _brackets(spark, [(1, "exec", 1_000_000, 0.5, 7.0, 7.0), (1, "exec", 1_000_000, 0.9, 7.0, 7.0)]), bound=10).collect()
    assert [r.value for r in got] == [7.0, 7.0] and len(passes) == 1
    mostly = equal.union(spark.range(1000).selectExpr("1", "CAST(id AS DOUBLE) / 100"))
    got = percentiles.exact_percentiles(mostly, "config_id", _brackets(spark, [(1, "exec", 1_001_000, 0.5, 1.0, 9.0)]), bound=10).collect()
    assert [r.value for r in got] == [7.0] and len(passes) <= 4


def test_groups_beyond_a_broadcast_are_split(spark):
    rows = [(0, float(i % 50), 1, 0, "x", "y") for i in range(4000)] + [(c, float(i), 1, 0, "x", "y") for c in range(1, 30) for i in range(20)]
    table = spark.createDataFrame([(0, "exec", 4000, 1.0)] + [(c, "exec", 20, 2.0) for c in range(1, 30)], "_k long, _f string, n long, x double")
    values = percentiles._values(runs(spark, rows), "config_id", ["exec"])
    whole, split = percentiles._beside(values, table), percentiles._beside(values, table, most_rows=5)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect())) and split.count() == len(rows)


def test_misplaced_values_are_found(spark):
    rows = [(1, float(v), None, 0, "x", "y") for v in range(5000)] + [(2, 3.0, None, 0, "x", "y")]
    df = runs(spark, rows)
    table = percentiles.percentiles(percentiles.sketches(df, [F.col("config_id")], ["exec", "alpha"], 100), (0.5, 0.9), 100)
    assert {(r.config_id, r.field): (r.n, r.outside) for r in percentiles.misplaced(df, "config_id", table, (0.5, 0.9), 100).collect()} == {(1, "exec"): (5000, 0), (2, "exec"): (1, 0), (1, "alpha"): (0, 0), (2, "alpha"): (0, 0)}
    wrong = table.withColumn("p90", F.col("p50"))
    assert {r.config_id: r.outside for r in percentiles.misplaced(df, "config_id", wrong, (0.5, 0.9), 100).where("field = 'exec'").collect()} == {1: 1, 2: 0}


def test_top_values(spark):
    df = spark.createDataFrame([(5, 1)] * 100 + [(7, 1)] * 3 + [(6, 1)] * 3 + [(1, 1)] + [(None, 1)] * 500, "value long, n int")
    assert [tuple(r) for r in frequent.top_values(df, "value", 3).collect()] == [(5, 100), (6, 3), (7, 3)]
    assert frequent.top_values(df, "value", 50).count() == 4
    assert frequent.top_values(df.limit(0), "value", 3).count() == 0
    text = spark.createDataFrame([("x" * 100_000,), ("",), ("",), (None,)], "n string")
    assert [(len(r.value), r.n) for r in frequent.top_values(text, "n", 2).collect()] == [(0, 2), (100_000, 1)]


def test_value_counts(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, 1, 2, 3, 1000 + i]), draw.choice([None, 1, 2, 2000 + i // 2]), 9) for i in range(3000)]
    occurrences, records = Counter(), Counter()
    for a, b, _ in rows:
        occurrences.update(x for x in (a, b) if x is not None)
        records.update({a, b} - {None})
    df = spark.createDataFrame(rows, "src long, dst long, n int")
    counts = terms.value_counts(df, ["src", "dst"])
    assert {r.value: (r.occurrences, r.records) for r in counts.collect()} == {x: (occurrences[x], records[x]) for x in occurrences}
    marks = {r.value: r.mark for r in terms.marked(counts, len(rows)).collect()}
    assert marks == {x: "rare" if n <= 2 else "common" if n * 100 >= 2 * len(rows) else None for x, n in records.items()}
    assert terms.value_counts(df.limit(0), ["src", "dst"]).count() == 0


def test_suffixes_are_sorted_for_the_stack(spark, monkeypatch):
    """A row is a record of two terms; its suffixes, those of a hot first term spread by salts, come to the stack sorted."""
    df = spark.createDataFrame([(i % 3, 100 + i // 3) for i in range(300)] + [(7, 7), (None, 7), (8, None)], "src long, dst long")
    counts = terms.row_counts(df, ["src", "dst"])
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("Aggregate") < plan.index("MapInArrow") < plan.index("Sort [t1") < plan.rindex("MapInArrow")
    expected = {(i, None): (100, 100) for i in range(3)} | {(100 + i, None): (3, 3) for i in range(100)} | {(i % 3, 100 + i // 3): (1, 1) for i in range(300)}
    expected |= {(7, None): (3, 2), (8, None): (1, 1), (7, 7): (1, 1)}
    assert {(r.t1, r.t2): (r.occurrences, r.records) for r in counts.collect()} == expected
    batch = pa.RecordBatch.from_pydict({"t1": [1] * 40 + list(range(50, 90)), "t2": [*range(80)], **{c: [1] * 80 for c in ("n", "d1", "d2")}})
    monkeypatch.setattr(terms, "HOT_SHARE", 0.1)
    (got,) = terms.combine(iter([batch]), 2, rows=80, salts=4)
    salts = Counter(r["salt"] for r in got.to_pylist() if r["t1"] == 1)
    assert salts == {0: 10, 1: 10, 2: 10, 3: 10} and {r["salt"] for r in got.to_pylist() if r["t1"] != 1} == {0}
    with pytest.raises(ValueError):
        terms.row_counts(df, ["src", "dst"], [3])


def test_long_records_are_parts_of_their_own():
    column = pa.array([[1, 2], None, list(range(30)), [], [5, 5, 5], [None, 6]], pa.list_(pa.int64()))
    whole = pa.Table.from_batches(terms.record_suffixes(iter([pa.RecordBatch.from_arrays([column], ["terms"])]), 2)).to_pylist()
    parts = list(terms.record_suffixes(iter([pa.RecordBatch.from_arrays([column], ["terms"])]), 2, most=10))
    assert len(parts) == 2 and pa.Table.from_batches(parts).to_pylist() == whole
    fives = [r for r in whole if r["t1"] == 5 and r["t2"] in (5, None)]
    assert [(r["t2"], r["d1"], r["d2"]) for r in fives if r["t2"] == 5] == [(5, 1, 1), (5, 0, 0)] and (None, 0, 0) in [(r["t2"], r["d1"], r["d2"]) for r in fives]


def test_combine_keeps_sums():
    batch = pa.RecordBatch.from_pydict({"t1": ["a", "a", None, "b"], "t2": [None, None, "x", "c"], "n": [1, 2, 3, 4], "d1": [1, 0, 1, 1], "d2": [0, 0, 1, 1]})
    for rows in (1, 100):
        got = pa.Table.from_batches(terms.combine(iter([batch, batch]), 2, rows)).to_pylist()
        assert len(got) == (6 if rows == 1 else 3)
        assert sum(r["n"] for r in got if r["t1"] == "a") == 6 and sum(r["d1"] for r in got if r["t1"] == "a") == 2
        assert sum(r["d2"] for r in got) == 4


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_sequence_counts(spark, batch, kind):
    """Sequences of up to three terms; a third of all terms is one; stacks are carried across batches."""
    draw = random.Random(6)
    words = [0, 0, 0, 1, 2, 3, None] if kind == "bigint" else ["the", "the", "the", "a", "bb", "", None]
    records = [[draw.choice(words) for _ in range(draw.randint(0, 12))] for _ in range(120)] + [None, [None]]
    occurrences, sets = Counter(), Counter()
    for record in records:
        own = [w for w in record or [] if w is not None]
        grams = [tuple(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)]
        occurrences.update(grams)
        sets.update(set(grams))
    df = spark.createDataFrame([(r, 1) for r in records], f"terms array<{kind}>, n int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(x for x in (r.t1, r.t2, r.t3)[: r.length]): (r.occurrences, r.records) for r in terms.sequence_counts(df, "terms", 3, salts=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {g: (occurrences[g], sets[g]) for g in occurrences}
    assert terms.sequence_counts(df.limit(0), "terms", 3).count() == 0
