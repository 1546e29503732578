"""Degrees of a graph that arrives as a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Edges from Parquet files as they appear under the path."""
    reader = spark.readStream.schema("src long, dst long, weight long, pos long, loaded_at timestamp")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def running_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) so far, for output mode update or complete. State: one count per source."""
    return edges.where("src is not null").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def windowed_degrees(edges: DataFrame, window: str = "1 day", late: str = "3 days") -> DataFrame:
    """(start, id, degree) per window of loaded_at, without rows delivered again.

    Rows later than `late` behind the newest are dropped, which lets state end; a row is told from one delivered again by
    its pos, within that time. Rows without a time belong to no window.
    """
    once = edges.where("src is not null and loaded_at is not null").withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["pos"])
    counted = once.groupBy(F.window("loaded_at", window), F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return counted.select(F.col("window.start").alias("start"), "id", "degree")
