"""State of a loop in which a turn changes few rows: what changes is written, and nothing else.

A ledger has a base, with a row for each key that it knows, and entries: tables of the rows that turns added.  The base is
laid out by key once, and cached, so that a turn's rows are looked up by moving these alone.  When the entries hold more
rows than the base, both become a new base; before that, short entries are put together, so that there are only about as
many as the logarithm of the rows.  Over a whole loop, a row is thus rewritten a few times, however many turns there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .iterate import Table

#: Entries of up to so many rows in all, and so many entries, are left as they are.
LEAST_ROWS, LEAST_ENTRIES = 200_000, 8
RULES = ("once", "least", "newest")


class Ledger:
    """start(keys..., values...). rule: 'once', every key is added once; 'least' or 'newest', of the rows of a key the one
    with the least value, or the one added last, counts, and there is one value. Use as a context manager: the cache
    ends with it."""

    def __init__(self, start: DataFrame, keys: Sequence[str], values: Sequence[str], rule: str, least_rows: int | None = None) -> None:
        assert rule in RULES and (rule == "once" or len(values) == 1)
        self.keys, self.values, self.rule = list(keys), list(values), rule
        self.least_rows = LEAST_ROWS if least_rows is None else least_rows
        self.spark, self.turn = start.sparkSession, 0
        self.entries: list[Table] = []
        self._later: list[Table] = []
        start = start.select(*self.keys, *self.values)
        self.schema = T.StructType([*start.schema.fields, T.StructField("_turn", T.IntegerType())])
        self._lay(Table(start))

    def _lay(self, base: Table) -> None:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.base = base
        known = base.df.select(*self.keys, F.col(self.values[0]).alias("_base"))
        self.placed = known.repartition(n, *self.keys).sortWithinPartitions(*self.keys).persist(StorageLevel.MEMORY_AND_DISK)

    def _read(self, entries: list[Table]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(t.path for t in entries))

    def _counting(self, rows: DataFrame) -> DataFrame:
        """Of rows(keys..., values..., _turn), those that count: (keys..., values...)."""
        if self.rule == "once":
            return rows.drop("_turn")
        value = self.values[0]
        return rows.groupBy(*self.keys).agg((F.min(value) if self.rule == "least" else F.max_by(value, "_turn")).alias(value))

    def beside(self, rows: DataFrame) -> DataFrame:
        """rows, of any keys, with the first value known so far in a column `known`, null where there is none."""
        found = rows.join(self.placed, self.keys, "left")
        if not self.entries:
            return found.withColumnRenamed("_base", "known")
        entered = self._counting(self._read(self.entries)).select(*self.keys, F.col(self.values[0]).alias("_entry"))
        found = found.join(entered, self.keys, "left")
        known = F.least("_entry", "_base") if self.rule == "least" else F.coalesce("_entry", "_base")
        return found.withColumn("known", known).drop("_entry", "_base")

    def add(self, rows: DataFrame) -> Table:
        """Write rows(keys..., values..., ...), one per key, as the turn's entry; further columns are only in this table.
        Entries before the last one must not be read any more."""
        self.turn += 1
        entry = Table(rows.withColumn("_turn", F.lit(self.turn)))
        for table in self._later:
            table.drop()
        self._later = []
        self.entries.append(entry)
        self._settle()
        return entry

    def _settle(self) -> None:
        last = self.entries[-1]
        if sum(t.rows for t in self.entries) > max(self.least_rows, self.base.rows):
            old, base = [*self.entries, self.base], Table(self.all())
            self.placed.unpersist()
            self.entries = []
            self._lay(base)
        elif len(self.entries) >= LEAST_ENTRIES:
            # From the last one back, as long as the next is no longer than these together.
            first, rows = len(self.entries) - 1, last.rows
            while first and self.entries[first - 1].rows <= max(rows, self.least_rows // LEAST_ENTRIES):
                first -= 1
                rows += self.entries[first].rows
            old = self.entries[first:]
            if len(old) <= LEAST_ENTRIES // 2:
                return
            self.entries[first:] = [Table(self._counting(self._read(old)).withColumn("_turn", F.lit(self.turn)))]
        else:
            return
        for table in old:
            if table is last:  # the next turn reads it
                self._later.append(table)
            else:
                table.drop()

    def all(self) -> DataFrame:
        """(keys..., values...) of every key."""
        if not self.entries:
            return self.base.df
        return self._counting(self.base.df.withColumn("_turn", F.lit(0)).unionByName(self._read(self.entries)))

    def __enter__(self) -> Ledger:
        return self

    def __exit__(self, *_) -> None:
        self.placed.unpersist()
