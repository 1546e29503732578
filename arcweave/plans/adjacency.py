"""Edges laid out once for a loop that joins them, turn after turn, with a state per vertex.

The layout is hash-partitioned and sorted by the vertex that sends, and cached, so that a turn moves and sorts the state
and not the edges.
A vertex with very many edges would make one partition large: such hubs, those with more edges than a quarter of an
average partition, are salted, which spreads their edges over several partitions, and their state is repeated once per
salt.  There can be at most four hubs per partition, so the table of hubs is small whatever the graph, and is broadcast.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .iterate import Table

LEAST_HUB = 100_000


class Adjacency:
    """Edges by `by` ('src' to send along edges, 'dst' against them). Use as a context manager: the cache ends with it."""

    def __init__(self, edges: DataFrame, by: str = "src", total: int | None = None, least_hub: int | None = None) -> None:
        """total: the number of edges, or a little more, if it is known."""
        self.by, spark = by, edges.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        total = edges.count() if total is None else total
        most = max(LEAST_HUB if least_hub is None else least_hub, total // (4 * n))
        self.hubs: DataFrame | None = None
        if total > most:
            hubs = Table(edges.groupBy(by).count().where(F.col("count") > most).select(F.col(by).alias("_hub"), F.ceil(F.col("count") / most).cast("int").alias("_salts")))
            if hubs.rows:
                self.hubs = hubs.df
        if self.hubs is None:
            placed = edges.repartition(n, by).sortWithinPartitions(by)
        else:
            other = "dst" if by == "src" else "src"
            placed = edges.join(F.broadcast(self.hubs), F.col(by) == F.col("_hub"), "left")
            placed = placed.withColumn("_salt", F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(other), F.col("_salts"))).otherwise(F.lit(0)).cast("int"))
            placed = placed.drop("_hub", "_salts").repartition(n, by, "_salt").sortWithinPartitions(by, "_salt")
        self.edges = placed.persist(StorageLevel.MEMORY_AND_DISK)

    def join(self, state: DataFrame, key: str = "id") -> DataFrame:
        """One row per edge whose `by` end has a row in the state; the state's columns and the edge's other columns.

        The state's key keeps its name; its other names must differ from the edges'.
        """
        if self.hubs is None:
            return state.join(self.edges, F.col(key) == F.col(self.by)).drop(self.by)
        state = state.join(F.broadcast(self.hubs), F.col(key) == F.col("_hub"), "left")
        salts = F.when(F.col("_salts") > 1, F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
        state = state.withColumn("_of", F.explode(salts)).drop("_hub", "_salts")
        return state.join(self.edges, (F.col(key) == F.col(self.by)) & (F.col("_of") == F.col("_salt"))).drop(self.by, "_salt", "_of")

    def __enter__(self) -> Adjacency:
        return self

    def __exit__(self, *_) -> None:
        self.edges.unpersist()


class Trail:
    """Tables written one after the other and read together: the levels of a traversal."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark: SparkSession = spark
        self.tables: list[Table] = []

    def append(self, df: DataFrame) -> int:
        """Write the next level; its number of rows."""
        table = Table(df)
        self.tables.append(table)
        return table.rows

    def last(self) -> DataFrame:
        return self.tables[-1].df

    def all(self) -> DataFrame:
        first = self.tables[0].df
        return self.spark.read.schema(first.schema).parquet(*(t.path for t in self.tables))

    def __len__(self) -> int:
        return len(self.tables)
