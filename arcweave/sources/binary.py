"""Graphs as compressed sparse rows in one binary file, read in slices by many tasks.

Little-endian: magic, sizes of vertex and edge ids (uint32 each), vertex and edge counts (of these sizes), three bytes
(valued, weighted, directed), then V + 1 offsets, V values if valued, E neighbours, E weights if weighted.  A task reads
a range of edges: the first one's source is found by bisection in the file, and no task holds the whole of any array.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import with_running
from ..graph import Graph
from ..plans.iterate import cut, remove, scoped, shared_folder
from ..plans.shipping import ship

# Fixed values of the format.
MAGIC = 0x10102048
_TYPES = {4: "<u4", 8: "<u8"}
WEIGHT = np.dtype("<u4")
SLICE = 1 << 20
COPIED = 1 << 24


@dataclass(frozen=True)
class Layout:
    """Where the arrays of a file lie."""

    vertex_size: int
    edge_size: int
    vertices: int
    edges: int
    valued: bool
    weighted: bool
    directed: bool

    @property
    def offsets_at(self) -> int:
        return 12 + self.vertex_size + self.edge_size + 3

    @property
    def values_at(self) -> int:
        return self.offsets_at + (self.vertices + 1) * self.edge_size

    @property
    def neighbours_at(self) -> int:
        return self.values_at + self.valued * self.vertices * 4

    @property
    def weights_at(self) -> int:
        return self.neighbours_at + self.edges * self.vertex_size


def _open(path: str):
    system, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(name)


def layout(path: str) -> Layout:
    with _open(path) as file:
        magic, v, e = struct.unpack("<3I", file.read_at(12, 0))
        if magic != MAGIC or v not in _TYPES or e not in _TYPES:
            raise ValueError("not a binary graph")
        n = int(np.frombuffer(file.read_at(v, 12), _TYPES[v])[0])
        m = int(np.frombuffer(file.read_at(e, 12 + v), _TYPES[e])[0])
        return Layout(v, e, n, m, *(bool(b) for b in file.read_at(3, 12 + v + e)))


def _array(file, at: int, kind, first: int, count: int) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(file.read_at(count * kind.itemsize, at + first * kind.itemsize), kind).astype(np.int64)


def _owner(file, x: Layout, edge: int) -> int:
    """The last vertex whose edges begin at or before the edge."""
    low, high = 0, x.vertices
    while high - low > 1:
        middle = (low + high) // 2
        if _array(file, x.offsets_at, _TYPES[x.edge_size], middle, 1)[0] <= edge:
            low = middle
        else:
            high = middle
    return low


def _edge_slice(file, x: Layout, a: int, b: int, weighted: bool) -> pa.RecordBatch:
    sources = np.empty(b - a, np.int64)
    vertex, at = _owner(file, x, a), a
    while at < b:
        count = min(1 << 16, x.vertices - vertex)
        ends = _array(file, x.offsets_at, _TYPES[x.edge_size], vertex + 1, count)
        upto = np.clip(ends, at, b)
        lengths = np.diff(upto, prepend=at)
        filled = int(upto[-1]) - at
        sources[at - a : at - a + filled] = np.repeat(np.arange(vertex, vertex + count), lengths)
        at += filled
        vertex += count
    columns = [pa.array(sources), pa.array(_array(file, x.neighbours_at, _TYPES[x.vertex_size], a, b - a))]
    if weighted:
        weights = _array(file, x.weights_at, WEIGHT, a, b - a) if x.weighted else np.ones(b - a, np.int64)
        columns.append(pa.array(weights))
    return pa.RecordBatch.from_arrays(columns, ["src", "dst", "weight"][: len(columns)])


def read_binary(spark: SparkSession, path: str, weighted: bool = False, slice_edges: int = SLICE) -> Graph:
    """The graph of a file that all executors can read. Weights are read if asked for, and are 1 in a file without."""
    x = layout(path)
    ship(spark)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as file:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    yield _edge_slice(file, x, start, min(start + slice_edges, x.edges), weighted)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as file:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    count = min(slice_edges, x.vertices - start)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + count)), pa.array(_array(file, x.values_at, WEIGHT, start, count))], ["id", "value"])

    starts = lambda n: spark.range(0, n, slice_edges, max(1, min(10_000, -(-n // slice_edges))))
    edge_rows = starts(x.edges).mapInArrow(edges, "src long, dst long" + ", weight long" * weighted)
    vertices = starts(x.vertices).mapInArrow(values, "id long, value long") if x.valued else spark.range(x.vertices).select("id")
    return Graph(vertices, edge_rows, x.directed, weighted, x.valued)


def _parts(df: DataFrame, folder: str, name: str, kind: str) -> list[str]:
    """Write the one column of a sorted DataFrame as raw numbers, a part for each partition; the parts in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        path = f"{folder}/{name}-{context.partitionId():06d}-{context.taskAttemptId()}"
        system, file = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        system.create_dir(os.path.dirname(file))
        with system.open_output_stream(file) as out:
            for batch in batches:
                out.write(batch.column(0).fill_null(0).to_numpy().astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([path])], ["part", "path"])

    # One row per partition comes back, with the file of the attempt that counts.
    return [r.path for r in sorted(df.mapInArrow(write, "part int, path string").collect())]


@scoped
def write_binary(graph: Graph, path: str) -> None:
    """One binary file of a graph with dense ids, edges sorted by source and neighbour.

    An export for tools of this format; the engine's own store is Parquet, see store.write_graph(). The arrays are sorted
    and written by all tasks, a part for each partition, in the folder for written tables; the driver only puts the
    parts' bytes behind each other.
    """
    ship(graph.spark)
    n, m = graph.vertex_count(), graph.edge_count()
    wide = m >= 1 << 32
    edge_kind = _TYPES[8 if wide else 4]
    folder = f"{shared_folder(graph.spark)}/arcweave-{uuid.uuid4().hex}"
    degrees = graph.vertices.select("id").join(graph.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    ends = with_running(degrees, ["id"], sums={"start": "d"}).orderBy("id").select((F.col("start") + F.col("d")).alias("end"))
    arrays = [_parts(ends, folder, "offsets", edge_kind)]
    if graph.valued:
        arrays.append(_parts(graph.vertices.orderBy("id").select("value"), folder, "values", WEIGHT.str))
    ordered = cut(graph.edges.orderBy(*graph.edges.columns).withColumn("_at", F.monotonically_increasing_id()))
    for column in ("dst", "weight")[: 1 + graph.weighted]:
        arrays.append(_parts(ordered.orderBy("_at").select(column), folder, column, WEIGHT.str))
    system, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with system.open_output_stream(name) as out:
        out.write(struct.pack("<3I", MAGIC, 4, 8 if wide else 4) + struct.pack("<I", n) + np.array([m], edge_kind).tobytes())
        out.write(bytes([graph.valued, graph.weighted, graph.directed]) + np.array([0], edge_kind).tobytes())
        for part in (p for parts in arrays for p in parts):
            with _open(part) as file:
                while block := file.read(COPIED):
                    out.write(block)
    remove(graph.spark, folder)
