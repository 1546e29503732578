"""Results per key, with a key that holds most rows."""

from decimal import Decimal

from arcweave.operators import keyed


def test_per_key(spark):
    rows = [(1, 5, "a")] * 300 + [(2, None, "b"), (2, 7, "b"), (None, 1, "c"), (3, 9223372036854775807, "d"), (3, 9223372036854775807, "d"), (4, None, None)]
    df = spark.createDataFrame(rows, "src long, weight long, key string")
    got = {r.key: tuple(r)[1:] for r in keyed.per_key(df, "src", "weight").collect()}
    assert got == {
        1: (300, 300, Decimal(1500), 5, 5),
        2: (2, 1, Decimal(7), 7, 7),
        3: (2, 2, Decimal(2 * 9223372036854775807), 9223372036854775807, 9223372036854775807),
        4: (1, 0, None, None, None),
    }
    assert keyed.per_key(df.limit(0), "src", "weight").count() == 0


def test_heavy_keys(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 2 + [(3,)] * 1 + [(None,)] * 147, "key long")
    assert {r.key for r in keyed.heavy_keys(df, "key").collect()} == {1, 2}
    assert keyed.heavy_keys(df.limit(0), "key").count() == 0
    assert keyed.heavy_keys(df.where("key is null"), "key").count() == 0


def test_states_are_combined_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2)], "src long, weight long")
    plan = keyed.per_key(df, "src", "weight")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1 and "partial_sum" in plan
