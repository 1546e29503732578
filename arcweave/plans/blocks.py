"""Traversals of many sources, and distributions over many labels, in blocks: each task has all edges and works through
its own blocks in numpy.

Sources, and labels, have nothing to do with each other until results are added up.  A block's state, a row per vertex
and a column per source or label, is therefore kept in the task from the first level to the last, and V * V rows of state
are neither written nor shuffled: only the edges, once per task, and the results are.  A block has at most CELLS cells,
whatever the graph.  That needs the edges in a task's memory; where they are more than MOST_EDGES, callers join tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

MOST_EDGES = 8_000_000
# Read where work() is made, as workers have the module's own values.
CELLS, WIDEST, CHUNK, FEW = 1 << 21, 128, 1 << 16, 4
#: From here on, sums of whole numbers are rounded and a part can't be subtracted.
LARGEST = 2**53
#: Columns that make another task worth its copy of the edges.
LEAST_COLUMNS = 32


class Layout:
    """Edges by the vertex that sends, and in the order of those that receive."""

    def __init__(self, by: np.ndarray, other: np.ndarray, times: np.ndarray, vertices: int) -> None:
        order = np.argsort(by, kind="stable")
        self.by, self.other = by[order], other[order]
        self.times = None if (times == 1).all() else times[order].astype(np.float64)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(by, minlength=vertices))))
        self.across = np.argsort(self.other, kind="stable").astype(np.int32)
        self.vertices = vertices

    def route(self, rows: np.ndarray, keep: np.ndarray | None = None) -> tuple:
        """How values of these vertices reach the ends of their edges, or those that keep (a mask) has."""
        counts = self.starts[rows + 1] - self.starts[rows]
        total = int(counts.sum())
        if 4 * total > len(self.by):
            place = np.full(self.vertices, -1, np.int32)
            place[rows] = np.arange(len(rows))
            edge = self.across
            sender = place[self.by[edge]]
            wanted = sender >= 0 if keep is None else (sender >= 0) & keep[self.other[edge]]
            edge, sender = edge[wanted], sender[wanted]
        else:
            sender = np.repeat(np.arange(len(rows)), counts)
            edge = np.arange(total) + np.repeat(self.starts[rows] - (np.cumsum(counts) - counts), counts)
            if keep is not None:
                wanted = keep[self.other[edge]]
                edge, sender = edge[wanted], sender[wanted]
            ends = self.other[edge]
            if len(ends) and (low := ends.min()) + (1 << 16) > ends.max():  # numpy sorts such numbers in one pass
                ends = (ends - low).astype(np.uint16)
            order = np.argsort(ends, kind="stable")
            edge, sender = edge[order], sender[order]
        ends = self.other[edge]
        first = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1]))) if len(ends) else np.zeros(0, np.int64)
        return ends[first], np.append(first, len(ends)), sender, None if self.times is None else self.times[edge]


def carry(route: tuple, values: np.ndarray, chunk: int, combine: np.ufunc = np.add) -> np.ndarray:
    """A row per end of the route: the combined rows of the values that are sent there; sums count an edge as often as it is.
    chunk: cells in work at a time, which the processor's cache should hold."""
    ends, bounds, sender, times = route
    found = np.empty((len(ends), values.shape[1]), values.dtype)
    step = max(1, chunk // values.shape[1])
    buffer = np.empty((step, values.shape[1]), values.dtype)
    many = np.diff(bounds)
    order = np.argsort(-many, kind="stable")

    def sent(edge: np.ndarray | slice) -> np.ndarray:
        which = sender[edge]
        rows = np.take(values, which, axis=0, out=buffer[: len(which)], mode="clip")
        if times is not None and combine is np.add:
            rows *= times[edge, None]
        return rows

    # The first edges of some ends, then their second ones, ...; what is left of a few ends with many more, end by end.
    for a in range(0, len(order), step):
        own = order[a : a + step]
        first, left = bounds[own], many[own]
        into = sent(first).copy()
        k, live = 1, int(np.searchsorted(-left, -1))
        while live > FEW:
            combine(into[:live], sent(first[:live] + k), out=into[:live])
            k += 1
            live = int(np.searchsorted(-left, -k))
        for i in range(live):
            for j in range(first[i] + k, first[i] + left[i], step):
                combine(into[i], combine.reduce(sent(slice(j, min(j + step, first[i] + left[i]))), axis=0), out=into[i])
        found[own] = into
    return found


def blocks(columns: int, vertices: int, task: int, tasks: int, widest: int, cells: int) -> Iterator[tuple[int, int]]:
    """The task's blocks: columns from and to. Neighbouring columns stay together, tasks take turns."""
    width = max(1, min(widest, cells // max(1, vertices), -(-columns // tasks)))
    for a in range(task * width, columns, tasks * width):
        yield a, min(columns, a + width)


def _narrow(values: np.ndarray) -> bytes:
    """The values' size in bytes, then all first bytes, all second ones, ..., which are the same for many and compress well."""
    least, most = (values.min(), values.max()) if len(values) else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    size = np.dtype(kind).itemsize
    return bytes([size]) + values.astype(kind).view(np.uint8).reshape(-1, size).T.tobytes()


def _widened(packed: pa.Buffer) -> np.ndarray:
    size = packed[0]
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8, offset=1).reshape(size, -1).T).view(f"<i{size}").ravel()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per batch, in order of its first column and then the next: each column's values as bytes."""
    for batch in batches:
        columns = [np.asarray(c, np.int64) for c in batch.columns]
        order = np.lexsort(columns[::-1])
        yield pa.RecordBatch.from_arrays([pa.array([_narrow(c[order])], pa.binary()) for c in columns], names=batch.schema.names)


def _places(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ids in these columns, in order, and for each column where they are there."""
    some = [x for x in columns if len(x)]
    low, high = (int(min(x.min() for x in some)), int(max(x.max() for x in some))) if some else (0, -1)
    if high - low < 8 * sum(map(len, some)):
        there = np.zeros(high - low + 1, bool)
        for x in some:
            there[x.astype(np.int64) - low] = True
        where = np.cumsum(there, dtype=np.int32) - np.int32(1)
        return np.flatnonzero(there) + low, *(where[x.astype(np.int64) - low] for x in columns)
    ids = np.unique(np.concatenate(columns)).astype(np.int64)
    return ids, *(np.searchsorted(ids, x).astype(np.int32) for x in columns)


def in_tasks(edges: DataFrame, sources: DataFrame | None, columns: int, work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows of work(ids, src, dst, times, columns, task, tasks), run in tasks that each have all edges(src, dst, times), with ends
    as places in the sorted ids. columns are the places of the sources(id); without sources, of all ids. Their number, about, decides on that of tasks."""
    spark = edges.sparkSession
    ship(spark)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, columns // LEAST_COLUMNS))
    packed = edges.select("src", "dst", "times").mapInArrow(_packed, "src binary, dst binary, times binary").withColumn("sources", F.lit(None).cast("binary"))
    if sources is not None:
        none = [F.lit(None).cast("binary").alias(c) for c in ("src", "dst", "times")]
        packed = packed.union(sources.select(F.col("id").alias("sources")).mapInArrow(_packed, "sources binary").select(*none, "sources"))
    copies = packed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    of_all = sources is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for task, *row in zip(*(batch.column(c) for c in ("task", "src", "dst", "times", "sources"))):
                into = parts.setdefault(task.as_py(), [[], [], [], []])
                for values, cell in zip(into, row):
                    if cell.is_valid:
                        values.append(_widened(cell.as_buffer()))
        for task in list(parts):
            src, dst, times, chosen = (np.concatenate([np.empty(0, np.int8), *x]) for x in parts.pop(task))
            ids, src, dst, chosen = _places(src, dst, chosen)
            yield from work(ids, src, dst, times, np.arange(len(ids)) if of_all else np.sort(chosen), task, tasks)

    return copies.repartitionById(tasks, "task").mapInArrow(run, schema)


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


class Ways:
    """Vertices with a single edge out lead to the first one, the root, that has others. Whatever starts there goes on as from the root, so
    that a traversal from the root stands for all sources whose way ends there. In a ring, the least vertex is a root."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, times: np.ndarray, vertices: int) -> None:
        self.vertices = vertices
        following = np.arange(vertices)
        single = (np.bincount(src, times, vertices) == 1)[src] if len(src) else np.zeros(0, bool)
        following[src[single]] = dst[single]
        reach, least = following.copy(), np.arange(vertices)
        for _ in range(vertices.bit_length()):
            least = np.minimum(least, least[reach])
            reach = reach[reach]
        # What a long way ends in, a root or a ring; reach is on it.
        ring = np.zeros(vertices, bool)
        ring[reach] = True
        roots = np.flatnonzero(ring & (least == np.arange(vertices)))
        following[roots] = roots
        self.jumps = [following]
        self.depth = (following != np.arange(vertices)).astype(np.int64)
        while (self.jumps[-1] != (further := self.jumps[-1][self.jumps[-1]])).any():
            self.depth += self.depth[self.jumps[-1]]
            self.jumps.append(further)
        self.root = self.jumps[-1]

    def way(self, vertex: int) -> list[int]:
        """The vertex and those on its way, with the root."""
        way = [vertex]
        while self.depth[way[-1]]:
            way.append(self.jumps[0][way[-1]])
        return way

    def below(self, values: np.ndarray) -> np.ndarray:
        """At each vertex, the sum of the values on its way, without the root's."""
        sums = np.where(self.depth > 0, values, 0)
        for jump in self.jumps:
            sums = sums + sums[jump]
        return sums

    def above(self, values: np.ndarray) -> np.ndarray:
        """At each vertex, the sum of the values from which a way leads there, with its own."""
        sums = values
        for k, jump in enumerate(self.jumps):
            far = self.depth >= 1 << k
            sums = sums + np.bincount(jump[far], sums[far], self.vertices)
        return sums


def dependencies(edges: DataFrame, sources: DataFrame, count: int, stress: bool, widest: int) -> DataFrame:
    """(id, score) by task, over its sources: numbers of shortest paths forward, then shares back level by level. Sources on
    a way to a root are computed with it."""

    def work(ids, src, dst, times, columns, task, tasks):
        n = len(ids)
        out, back = Layout(src, dst, times, n), Layout(dst, src, times, n)
        ways, chosen = Ways(src, dst, times, n), np.bincount(columns, minlength=n).astype(np.float64)
        # Sources whose way leads through a vertex, itself included, and those of the whole root.
        through = ways.above(chosen)
        whole = through[ways.root]
        columns = np.flatnonzero((ways.depth == 0) & (whole > 0))
        on_way = np.flatnonzero((ways.depth > 0) & (whole > 0))
        on_way = on_way[np.argsort(ways.root[on_way], kind="stable")]
        of_root = ways.root[on_way]
        score, beyond, missed, done, exact = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool), np.full(n, np.nan)
        for a, b in blocks(len(columns), n, task, tasks, widest, CELLS):
            depth, paths = np.full((n, b - a), -1, np.int32), np.zeros((n, b - a))
            depth[columns[a:b], np.arange(b - a)] = 0
            paths[columns[a:b], np.arange(b - a)] = 1
            levels = [columns[a:b]]
            values = paths[levels[0]]
            while len(levels[-1]):
                route = out.route(levels[-1])
                new = carry(route, values, CHUNK)
                new[depth[route[0]] >= 0] = 0
                some = (new > 0).any(axis=1)
                rows, values = route[0][some], new[some]
                depth[rows] = np.where(values > 0, len(levels), depth[rows])
                paths[rows] += values
                levels.append(rows)
            # An end counts for all sources of the root, but for those on whose way it is.
            weight, later = whole[columns[a:b]], np.zeros((n, b - a))
            own = on_way[np.searchsorted(of_root, columns[a]) : np.searchsorted(of_root, columns[b - 1], "right")]
            at = np.searchsorted(columns[a:b], ways.root[own])
            later[own, at] -= through[own]
            for level in range(len(levels) - 2, 1, -1):
                rows, keep = levels[level], np.zeros(n, bool)
                keep[levels[level - 1]] = True
                here = depth[rows] == level
                share = np.where(here, weight + later[rows], 0)
                if not stress:
                    np.divide(share, paths[rows], out=share, where=here)
                route = back.route(rows, keep)
                got = carry(route, share, CHUNK)
                above = depth[route[0]] == level - 1
                later[route[0]] += np.where(above, got if stress else got * paths[route[0]], 0)
            later[own, at] += through[own]
            score += (later * paths if stress else later).sum(axis=1)
            if len(own):
                done[own], done[columns[a:b]] = True, True
                ends = paths if stress else depth >= 0
                missed[own] = ends[own, at]
                beyond[own] = (ends.sum(axis=0) - 1)[at]
                for v, k in zip(own[beyond[own] >= LARGEST], at[beyond[own] >= LARGEST]):
                    rest = ends[:, k].astype(np.float64)
                    rest[ways.way(v)] = 0
                    exact[v] = rest.sum()
        # On the way to a root, all paths pass: those to what is further on the way, and those from the root on.
        passing = np.where(done & (ways.depth > 0), chosen * np.where(np.isnan(exact), beyond - ways.below(missed), exact), 0)
        score += np.where(done, ways.depth * (through - chosen) + ways.above(passing) - passing, 0)
        some = score != 0
        yield _rows(id=ids[some], score=score[some])

    return in_tasks(edges, sources, count, work, "id long, score double")


def reached(edges: DataFrame, sources: DataFrame, count: int, widest: int) -> DataFrame:
    """(id, c, s) of each source: how many vertices it reaches, itself included, and the sum of their distances. Sources are bits."""

    def work(ids, src, dst, times, columns, task, tasks):
        n = len(ids)
        out = Layout(src, dst, times, n)
        for a, b in blocks(len(columns), n, task, tasks, widest, 64 * CELLS):
            k, words = np.arange(b - a), -(-(b - a) // 64)
            seen = np.zeros((n, words), np.uint64)
            np.bitwise_or.at(seen, (columns[a:b], k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
            rows, level = np.unique(columns[a:b]), 0
            values = seen[rows]
            c, s = np.ones(b - a, np.int64), np.zeros(b - a, np.int64)
            while len(rows):
                level += 1
                route = out.route(rows)
                new = carry(route, values, CHUNK, np.bitwise_or)
                new &= ~seen[route[0]]
                some = new.any(axis=1)
                rows, values = route[0][some], new[some]
                seen[rows] |= values
                step = max(1, 16 * CHUNK // (64 * words))
                for i in range(0, len(rows), step):
                    bits = np.unpackbits(values[i : i + step].astype("<u8").view(np.uint8), axis=1, bitorder="little", count=b - a)
                    found = bits.sum(axis=0, dtype=np.int64)
                    c += found
                    s += level * found
            yield _rows(id=ids[columns[a:b]], c=c, s=s)

    return in_tasks(edges, sources, count, work, "id long, c long, s long")


def likeliest(edges: DataFrame, count: int, turns: int, digits: int, since: int = 1) -> DataFrame:
    """(turn, id, label): the likeliest label of each vertex with edges after each turn, from since on, of averaging distributions over neighbours.
    Probabilities are rounded to these digits, half away from zero; of equal ones it is the least label.

    After some turns the distribution is the mean of the first ones of the vertices that as many steps at random lead to. A task
    follows these walks from blocks of vertices, and has only rows for where they are."""

    def work(ids, src, dst, times, columns, task, tasks):
        n = len(ids)
        degree, loop = np.bincount(src, times, n), src == dst
        owners = np.flatnonzero(degree > 0)
        # The first distribution: 1 for itself, and one edge's share for each neighbour. A self loop assigns its own entry over the 1.
        own = np.ones(n)
        own[src[loop]] = 1 / degree[src[loop]]
        out = Layout(src, dst, times, n)
        first = out if out.times is None and not loop.any() else Layout(src[~loop], dst[~loop], np.ones(len(src) - int(loop.sum())), n)
        kept: list[tuple[Layout, np.ndarray, tuple]] = []

        def route(layout: Layout, rows: np.ndarray) -> tuple:
            """The last ones are kept, as vertices near each other soon reach the same."""
            found = next((way for of, at, way in kept if of is layout and np.array_equal(at, rows)), None)
            if found is None:
                found = layout.route(rows)
                kept[:] = [(layout, rows, found), *kept[:2]]
            return found

        unit = 10.0**digits
        for a, b in blocks(len(owners), 1, task, tasks, WIDEST, CELLS):
            stack = [(0, owners[a:b], owners[a:b], np.eye(b - a))]
            while stack:
                turn, starts, rows, values = stack.pop()
                steps = route(out, rows)
                fit = max(1, CELLS // max(1, len(rows), len(steps[0])))
                if len(starts) > fit:
                    stack += [(turn, starts[i : i + fit], rows, values[:, i : i + fit].copy()) for i in range(0, len(starts), fit)]
                    continue
                share = values / degree[rows, None]
                following = carry(steps, share, CHUNK)
                if turn >= since:
                    near = (steps[0], following) if first is out else ((ends := route(first, rows))[0], carry(ends, share, CHUNK))
                    labels = np.union1d(rows, near[0])
                    p = np.zeros((len(labels), len(starts)))
                    p[np.searchsorted(labels, rows)] = own[rows, None] * values
                    p[np.searchsorted(labels, near[0])] += near[1]
                    p *= unit
                    most = p.max(axis=0, initial=0)
                    units = np.floor(most)
                    units += most - units >= 0.5
                    # The first that is rounded to as much; one that is rounded to 0 has to be there, too.
                    best = (p >= np.maximum(units - 0.5, np.nextafter(0, 1))).argmax(axis=0) if len(labels) else np.zeros(0, int)
                    some = most > 0
                    yield _rows(turn=np.full(int(some.sum()), turn, np.int32), id=ids[starts[some]], label=ids[labels[best[some]]])
                if turn < turns:
                    live = degree[steps[0]] > 0
                    if live.any():
                        stack.append((turn + 1, starts, steps[0][live], following[live]))

    return in_tasks(edges, None, count, work, "turn int, id long, label long")
