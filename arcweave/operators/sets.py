"""Sets of vertices, and look-ups by key: what bitmaps, frontiers and hash tables are for elsewhere.

A set is a DataFrame with a column id. Null is no member; repeated ids count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import lookup_join
from ..plans.iterate import scoped


def members(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """In left and not in right; the frontier is what is reached now and was not before."""
    return members(left).join(members(right), "id", "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """In one of both."""
    both = members(left).select("id", F.lit(1).alias("_n")).union(members(right).select("id", F.lit(1)))
    return both.groupBy("id").agg(F.sum("_n").alias("_n")).where("_n = 1").select("id")


def size(df: DataFrame) -> DataFrame:
    """One row (size)."""
    return members(df).agg(F.count(F.lit(1)).alias("size"))


@scoped
def get(keys: DataFrame, table: DataFrame, missing: int = -1) -> DataFrame:
    """(id, value) for every row of keys(id) from table(id, value) with unique ids; `missing` where there is none."""
    found = lookup_join(keys.select("id"), "id", table.select("id", "value"), "left")
    return found.select("id", F.coalesce("value", F.lit(missing)).alias("value"))
