"""Results per key where a few keys hold most rows.

Count, sum, least and largest are algebraic: each task combines its rows in a hash table that holds one state per key
and spills, and only these states are shuffled.  A key in a third of all rows arrives as one state per task, so its
final task has no more to do than any other.  Nothing is salted, as nothing is left to spread.

Defined results: rows with a null key belong to no key; null values count as rows but for no other result; a sum is a
decimal of 38 digits, so that it does not overflow; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_rows, n_values, value_sum, value_min, value_max) of every key."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value")).where("key is not null")
    return rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("value").alias("n_values"),
        F.sum(F.col("value").cast("decimal(19,0)")).cast("decimal(38,0)").alias("value_sum"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
    )


def heavy_keys(df: DataFrame, key: str, percent: int = 1) -> DataFrame:
    """(key, n_rows) of the keys that hold at least this percentage of all rows, those with a null key included."""
    counts = df.select(F.col(f"`{key}`").alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where(F.col("n_rows") * 100 >= F.lit(percent) * total)
