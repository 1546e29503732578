"""Cutting lineage and driving loops.

A loop's state is written, once per step, as a Parquet table under the folder that spark.checkpoint.dir names, and read
again: the plan of a step stays short, the table's size is known to the planner (so that it broadcasts a small frontier
and shuffles a large one), and losing an executor loses nothing.  Tables of earlier steps are removed as the loop goes
on.  A function under @scoped removes, when it ends, all tables that it made and its result does not read; what a result
reads stays until release(), or the end of the session.
"""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_KEPT: dict[str, SparkSession] = {}
#: The tables made in the innermost scope.
_SCOPE: ContextVar[list[Table] | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables: spark.checkpoint.dir. Only a session in a single process gets one of our own where
    that is unset; on a cluster, where such a folder would be another one on each machine, it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="arcweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever the folder is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _KEPT.pop(path, None)


class Table:
    """A written table: its DataFrame, its number of rows, which is counted as they are written, and how to remove it."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/arcweave-{uuid.uuid4().hex}"
        schema, counted = df.schema, Observation()
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.option("compression", "lz4").parquet(self.path)
        _KEPT[self.path] = self.spark
        if (scope := _SCOPE.get()) is not None:
            scope.append(self)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        self.rows: int = counted.get["rows"]

    def drop(self) -> None:
        remove(self.spark, self.path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a written table: what comes before is computed once."""
    return Table(df).df


def _frames(result) -> list[DataFrame]:
    """The DataFrames in a result: one, several, or attributes of an object."""
    if isinstance(result, DataFrame):
        return [result]
    if isinstance(result, (list, tuple)):
        return [x for r in result for x in _frames(r)]
    return [x for r in getattr(result, "__dict__", {}).values() for x in _frames(r)]


def _tables_of(result) -> set[str]:
    """Names of the written tables that a result reads."""
    return {f.rsplit("/", 2)[-2] for df in _frames(result) for f in df.inputFiles()}


def scoped(function: Callable) -> Callable:
    """Remove the tables made inside, unless the result, a DataFrame or an object with some, reads them. A result must not
    hold cached DataFrames made from such tables."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        own: list[Table] = []
        outer, token = _SCOPE.get(), _SCOPE.set(own)
        read: set[str] = set()
        try:
            result = function(*args, **kwargs)
            read = _tables_of(result) if any(t.path in _KEPT for t in own) else read
            return result
        finally:
            _SCOPE.reset(token)
            for table in own:
                if table.path not in _KEPT:
                    continue
                if table.path.rsplit("/", 1)[-1] not in read:
                    table.drop()
                elif outer is not None:
                    outer.append(table)

    return run


def release(df: DataFrame) -> None:
    """Remove the written tables that a result reads, when it is not needed any more."""
    for path in [p for p in _KEPT if p.rsplit("/", 1)[-1] in _tables_of(df)]:
        remove(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_KEPT.items()):
        try:
            remove(spark, path)
        except Exception:  # the session, or the folder with it, is gone already
            return


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame | None], limit: int | None = None) -> DataFrame:
    """Apply step to the state until it returns None or, after the given number of steps, stop.

    A step gets the state as a written table and its own number, from 1 on. Only the newest two tables are kept.
    """
    tables = [Table(state)]
    turn = 0
    while limit is None or turn < limit:
        turn += 1
        new = step(tables[-1].df, turn)
        if new is None:
            break
        tables.append(Table(new))
        if len(tables) > 2:
            tables.pop(0).drop()
    return tables[-1].df
