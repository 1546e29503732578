"""The most frequent values of a column, by exact aggregation that spills.

Each task counts its rows in a hash table of bounded memory, which spills to disk; only (value, count) pairs are
shuffled, by value.  Every partition keeps its own top k, and the last step orders k rows of each.  The counts are exact,
so the error of the approximate counts that were asked for is nought.  No task holds a count for every value.

Defined results: null is no value; of values with equal counts the smaller comes first; an empty column has no rows;
columns that are not asked for are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n): the k most frequent values of the column and how often they occur, most frequent first."""
    values = df.select(F.col(f"`{column}`").alias("value")).where("value is not null")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
