"""The engine's own store: Parquet tables of vertices and edges, and a small table of flags."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def write_graph(graph: Graph, path: str, sort: bool = True, descending: bool = False) -> None:
    """sort: cluster edges by source and neighbour within files, which compresses better and lets scans skip; descending:
    neighbours from the largest down."""
    order = [F.asc("src"), F.desc("dst") if descending else F.asc("dst")]
    edges = graph.edges.repartitionByRange(*order).sortWithinPartitions(*order) if sort else graph.edges
    edges.write.parquet(f"{path}/edges")
    graph.vertices.write.parquet(f"{path}/vertices")
    flags = graph.spark.range(1).select(*(F.lit(getattr(graph, f)).alias(f) for f in ("directed", "weighted", "valued")))
    flags.coalesce(1).write.parquet(f"{path}/flags")


def read_graph(spark: SparkSession, path: str) -> Graph:
    flags = spark.read.parquet(f"{path}/flags").first().asDict()
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), **flags)


def is_store(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/flags")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def load(spark: SparkSession, path: str, weighted: bool = False) -> Graph:
    """A graph from a store, a binary file or a text file, whichever is there."""
    from . import binary, text

    if is_store(spark, path):
        return read_graph(spark, path)
    try:
        binary.layout(path)
    except (ValueError, OSError):
        return text.read_text(spark, path, weighted)
    return binary.read_binary(spark, path, weighted)
