"""Positions in a global order, and running sums along it, without a window over all rows.

The rows are range-partitioned and sorted once, each partition is numbered as it is written, and the partitions' sums,
one row per partition, are added up in front.  As range partitioning splits no run of equal keys, pass enough columns to
make the order total where a third of all rows could be equal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.iterate import cut
from ..plans.shipping import ship

#: monotonically_increasing_id() has the number of the partition above, and that of the row in it below, this bit.
_ROW_BITS = 33


def _running(batches: Iterator[pa.RecordBatch], at: list[int]) -> Iterator[pa.RecordBatch]:
    """Replace the whole numbers in the columns `at` by their sums over the rows before in the partition."""
    before = [0] * len(at)
    for batch in batches:
        columns = list(batch.columns)
        for k, i in enumerate(at):
            values = columns[i].fill_null(0).to_numpy()
            upto = before[k] + np.cumsum(values, dtype=np.int64)
            columns[i] = pa.array(upto - values)
            before[k] = int(upto[-1]) if len(upto) else before[k]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def with_running(df: DataFrame, order: Sequence[str], index: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Add the 0-based index in the order, and for each (name, column) the sum of a column of whole numbers over the
    rows before; null counts as 0.

    order: names of columns, with a '-' in front for descending. The order must be total for a defined result, and names
    of added columns must not occur in df. Rows leave in order within, but not across, partitions.
    """
    sums = sums or {}
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    given = [F.col(f"`{c}`").cast("long").alias(f"_s{i}") for i, c in enumerate(sums.values())]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", *given, F.monotonically_increasing_id().alias("_at"))
    width = len(df.columns)
    if sums:
        ship(df.sparkSession)
        # The value stays, and beside it goes its running sum.
        placed = placed.select(*df.columns, *(f"_s{i}" for i in range(len(sums))), *(F.col(f"_s{i}").alias(f"_r{i}") for i in range(len(sums))), "_at")
        at = list(range(width + len(sums), width + 2 * len(sums)))
        placed = placed.mapInArrow(lambda it: _running(it, at), T.StructType([T.StructField(f.name, f.dataType) for f in placed.schema]))
    placed = cut(placed)
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    own = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.sum(f"_s{i}"), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = own.select("_part", *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_b{n}") for n in ["_n", *(f"_s{i}" for i in range(len(sums)))]))
    joined = placed.join(F.broadcast(before), part == F.col("_part"))
    added = [(F.col("_b_n") + row).alias(index)] if index else []
    added += [(F.col(f"_b_s{i}") + F.col(f"_r{i}")).alias(name) for i, name in enumerate(sums)]
    return joined.select(*df.columns, *added)


def places(df: DataFrame, name: str) -> DataFrame:
    """Add the 0-based place of each row in the result, for a DataFrame that orderBy() has sorted."""
    placed = cut(df.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_b"))
    return placed.join(F.broadcast(before), part == F.col("_part")).select(*df.columns, (F.col("_b") + row).alias(name))


def _shifted(batches: Iterator[pa.RecordBatch], at: list[int]) -> Iterator[pa.RecordBatch]:
    """Replace the columns `at` by their values one row before in the partition; null in its first row."""
    last: list = [None] * len(at)
    for batch in batches:
        columns = list(batch.columns)
        for k, i in enumerate(at):
            if batch.num_rows:
                columns[i] = pa.concat_arrays([pa.array([last[k]], batch.column(i).type), batch.column(i).slice(0, batch.num_rows - 1)])
                last[k] = batch.column(i)[batch.num_rows - 1].as_py()
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def with_previous(df: DataFrame, order: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Add, for each (name, column), the column's value in the row before in the whole order; null in the first row.

    order: as in with_running(). Rows are compared within sorted partitions as these are written; only the last row of
    each partition, one per partition, is carried over to the next.
    """
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    given = [F.col(f"`{c}`") for c in names.values()]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", *(c.alias(f"_v{i}") for i, c in enumerate(given)), *(c.alias(f"_w{i}") for i, c in enumerate(given)), F.monotonically_increasing_id().alias("_at"))
    ship(df.sparkSession)
    at = list(range(len(df.columns) + len(given), len(df.columns) + 2 * len(given)))
    placed = cut(placed.mapInArrow(lambda it: _shifted(it, at), T.StructType([T.StructField(f.name, f.dataType) for f in placed.schema])))
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    lasts = placed.groupBy(part.alias("_part")).agg(F.max_by(F.struct(*(f"_v{i}" for i in range(len(given)))), "_at").alias("_last"))
    before = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))  # one row per partition
    joined = placed.join(F.broadcast(before), part == F.col("_part"))
    return joined.select(*df.columns, *(F.when(row == 0, F.col(f"_before._v{i}")).otherwise(F.col(f"_w{i}")).alias(name) for i, name in enumerate(names)))
