"""Joining many rows with a table of one row per key, where a few keys hold most rows.

A plain join sends all rows of a key to one task.  Here the keys with more rows than a quarter of an average partition
are found first, by a count that is combined on the map side.  There are at most four of them per partition, so their
rows of the table can be broadcast whatever the size of the data; only the others are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut

LEAST_ROWS = 2_000_000


def lookup_join(rows: DataFrame, key: str, table: DataFrame, how: str = "inner", total: int | None = None, least_rows: int | None = None) -> DataFrame:
    """rows joined with table on a column that both have; how is inner or left. Null keys match nothing.

    rows should be cheap to read again (a written table, say); they are counted unless total is given. Up to least_rows
    the join is plain.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    total = rows.count() if total is None else total
    if total <= (LEAST_ROWS if least_rows is None else least_rows):
        return rows.join(table, key, how)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, total // (4 * partitions))
    hot = cut(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > most).select(key))
    if hot.isEmpty():
        return rows.join(table, key, how)
    of_hot = cut(table.join(F.broadcast(hot), key, "left_semi"))
    heavy = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(of_hot), key, how)
    light = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how)
    return heavy.unionByName(light)
