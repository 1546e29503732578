"""Traversals in blocks within tasks, and the same over tables, against plain computations."""

import math
import random
from collections import Counter, deque

import numpy as np
import pytest

from arcweave.operators import centrality, components
from arcweave.plans import blocks

from .graphs import both, build, values


def _drawn(n, edges, seed):
    """Repeated edges, loops, edges to ids that are no vertices, and vertices without edges."""
    draw = random.Random(seed)
    pairs = [(draw.randrange(n - 5), draw.randrange(n - 5)) for _ in range(edges)]
    return pairs + pairs[: edges // 5] + [(3, 3), (4, n + 7)] + [(i, i + 1) for i in range(n - 5, n - 2)]


def _plain(n, edges):
    """Betweenness, stress and closeness by one traversal per source."""
    out = {}
    for (a, b), times in Counter(edges).items():
        if a != b and b < n:
            out.setdefault(a, []).append((b, times))
    between, stress, close = [0.0] * n, [0] * n, [0.0] * n
    for source in range(n):
        depth, paths, order, queue = {source: 0}, Counter({source: 1}), [], deque([source])
        while queue:
            a = queue.popleft()
            order.append(a)
            for b, times in out.get(a, []):
                if b not in depth:
                    depth[b] = depth[a] + 1
                    queue.append(b)
                if depth[b] == depth[a] + 1:
                    paths[b] += paths[a] * times
        share, later = Counter(), Counter()
        for a in reversed(order):
            for b, times in out.get(a, []):
                if depth[b] == depth[a] + 1:
                    share[a] += paths[a] * times / paths[b] * (1 + share[b])
                    later[a] += times * (1 + later[b])
            if a != source:
                between[a] += share[a]
                stress[a] += paths[a] * later[a]
        total = sum(depth.values())
        close[source] = (len(depth) - 1) ** 2 / ((n - 1) * total) if total else 0.0
    return between, stress, close


@pytest.fixture(params=["one block", "many blocks", "tables"])
def way(request, monkeypatch):
    """By tasks with a block each, by tasks with several blocks and small pieces, and by joined tables with hubs."""
    if request.param == "many blocks":
        for constant, value in (("CELLS", 150), ("WIDEST", 3), ("CHUNK", 7), ("LEAST_COLUMNS", 4)):
            monkeypatch.setattr(blocks, constant, value)
    elif request.param == "tables":
        from arcweave.plans import adjacency

        monkeypatch.setattr(blocks, "MOST_EDGES", 0)
        monkeypatch.setattr(adjacency, "LEAST_HUB", 20)
    return request.param


N = 40
CASES = [(60, 1), (400, 2)]


@pytest.mark.parametrize("edges, seed", CASES)
def test_betweenness(spark, way, edges, seed):
    drawn = _drawn(N, edges, seed)
    got, expected = values(centrality.betweenness(build(spark, N, drawn, directed=True))), _plain(N, drawn)[0]
    assert got == pytest.approx(dict(enumerate(expected)))


def test_no_tables_of_pairs(spark, monkeypatch):
    """Traversals within tasks write tables of edges, sources and scores only, none per level."""
    from arcweave.plans import adjacency

    monkeypatch.setattr(adjacency.Trail, "append", None)
    g = build(spark, 30, [(i, i + 1) for i in range(29)], directed=True)
    assert values(centrality.betweenness(g)) == {i: i * (29 - i) for i in range(30)}


def _labels(n, edges, turns, stable):
    """Labels by the rule: all distributions, turn by turn. Also the number of turns made."""
    out = {}
    for (a, b), times in Counter(edges).items():
        out.setdefault(a, []).append((b, times))
    degree = {a: sum(times for _, times in x) for a, x in out.items()}
    p = {a: {a: 1.0} | {b: 1 / degree[a] for b, _ in x} for a, x in out.items()}
    labels, quiet = None, 0
    for turn in range(1, turns + 1):
        following = {}
        for a, x in out.items():
            sums = Counter()
            for b, times in x:
                for label, q in p.get(b, {}).items():
                    sums[label] += q * times
            if sums:
                following[a] = {label: q / degree[a] for label, q in sums.items()}
        p = following
        new = {a: min(x, key=lambda label: (-math.floor(x[label] * 1e7 + 0.5), label)) for a, x in p.items()}
        quiet = quiet + 1 if labels is not None and all(labels.get(a) == label for a, label in new.items()) else 0
        labels = new
        if quiet >= stable:
            break
    return {a: labels.get(a, a) for a in range(n)}, turn


@pytest.mark.parametrize("edges, seed", CASES)
def test_label_propagation_until_stable(spark, way, edges, seed):
    drawn = _drawn(N, edges, seed)
    assert values(components.label_propagation(build(spark, N, drawn, directed=True))) == _labels(N, drawn, components.LP_TURNS, components.LP_STABLE)[0]


def test_labels_that_are_stable_late(spark, way):
    """A ring with a tail, where labels still move after the turns that are made first."""
    drawn = both([(i, (i + 1) % 9) for i in range(9)] + [(i, i + 1) for i in range(8, 20)])
    expected, turn = _labels(21, drawn, components.LP_TURNS, components.LP_STABLE)
    assert turn > 2 * components.LP_STABLE
    assert values(components.label_propagation(build(spark, 21, drawn))) == expected


def test_labels_without_tables_of_pairs(spark, monkeypatch):
    """Turns within tasks lay out no edges for a loop of joins."""
    monkeypatch.setattr(components, "Adjacency", None)
    drawn = _drawn(N, 400, 2)
    g = build(spark, N, drawn, directed=True)
    assert values(components.label_propagation(g)) == _labels(N, drawn, components.LP_TURNS, components.LP_STABLE)[0]


@pytest.mark.parametrize("edges, seed", CASES)
def test_closeness(spark, way, edges, seed):
    drawn = _drawn(N, edges, seed)
    g, expected = build(spark, N, drawn, directed=True), dict(enumerate(_plain(N, drawn)[2]))
    assert values(centrality.closeness(g)) == pytest.approx(expected)
    assert values(centrality.closeness(g, batch=7)) == pytest.approx(expected)


def test_closeness_without_tables_of_pairs(spark, monkeypatch):
    """More sources than a word has bits, and no table per level."""
    from arcweave.plans import adjacency

    monkeypatch.setattr(adjacency.Trail, "append", None)
    drawn = _drawn(150, 300, 3)
    assert values(centrality.closeness(build(spark, 150, drawn, directed=True))) == pytest.approx(dict(enumerate(_plain(150, drawn)[2])))


def test_labels_after_some_turns(spark, way, monkeypatch):
    """The labels after three turns, which are not stable, without a loop of joins where tasks do the turns."""
    if way != "tables":
        monkeypatch.setattr(components, "Adjacency", None)
    drawn = _drawn(N, 100, 4)
    expected = [_labels(N, drawn, turns, components.LP_STABLE)[0] for turns in (3, components.LP_TURNS)]
    assert expected[0] != expected[1]
    assert values(components.label_propagation(build(spark, N, drawn, directed=True), turns=3)) == expected[0]


@pytest.mark.parametrize("edges, seed", CASES)
def test_stress(spark, way, edges, seed):
    drawn = _drawn(N, edges, seed)
    assert values(centrality.stress(build(spark, N, drawn, directed=True), batch=16)) == dict(enumerate(_plain(N, drawn)[1]))


def test_stress_without_tables_of_pairs(spark, monkeypatch):
    from arcweave.plans import adjacency

    monkeypatch.setattr(adjacency.Trail, "append", None)
    drawn = _drawn(N, 400, 2)
    assert values(centrality.stress(build(spark, N, drawn, directed=True))) == dict(enumerate(_plain(N, drawn)[1]))


def _in_process(monkeypatch, make, n, pairs):
    """Rows of a single task, run here, and the cells that it passes along edges."""
    cells, carry = [0], blocks.carry

    def counted(route, values, *rest):
        cells[0] += len(route[2]) * values.shape[1]
        return carry(route, values, *rest)

    monkeypatch.setattr(blocks, "carry", counted)
    monkeypatch.setattr(blocks, "in_tasks", lambda edges, sources, count, work, schema: work)
    src, dst = np.array(pairs, np.int32).T
    rows = [row for batch in make()(np.arange(n), src, dst, np.ones(len(src), np.int64), np.arange(n), 0, 1) for row in batch.to_pylist()]
    return rows, cells[0]


def test_labels_follow_what_is_near(monkeypatch):
    """Many components: a turn's work is in proportion to what vertices reach, not to all pairs of vertices and edges."""
    n = 2400
    pairs = both([(i, i - i % 8 + (i + 1) % 8) for i in range(n)])
    rows, cells = _in_process(monkeypatch, lambda: blocks.likeliest(None, n, 3, components.LP_DIGITS), n, pairs)
    assert {r["id"]: r["label"] for r in rows if r["turn"] == 3} == _labels(n, pairs, 3, components.LP_STABLE)[0]
    assert cells < n * len(pairs)


def test_packed_numbers():
    for values in ([], [0, 1, -128], [127, 128], [-40_000, 3], [2**31, -1, 7], [2**63 - 1, -(2**63)]):
        packed = blocks.pa.py_buffer(blocks._narrow(np.array(values, np.int64)))
        assert blocks._widened(packed).tolist() == values


@pytest.mark.parametrize("ids", [[5, 3, 9], [0, 2**40, -7], []])
def test_places(ids):
    found, places = blocks._places(np.array(ids, np.int64))
    assert found.tolist() == sorted(ids) and found[places].tolist() == ids


def test_carry_over_many_edges():
    """An end with very many edges beside ends with few, weighted and in small pieces."""
    draw = np.random.default_rng(1)
    src, dst = draw.integers(0, 30, 900), np.where(np.arange(900) < 700, 4, draw.integers(0, 30, 900))
    times, values = draw.integers(1, 4, 900), draw.random((30, 5))
    ends, *_ = route = blocks.Layout(src.astype(np.int32), dst.astype(np.int32), times, 30).route(np.arange(30))
    expected = np.zeros((30, 5))
    np.add.at(expected, dst, values[src] * times[:, None])
    for chunk in (7, 60, 1 << 14):
        assert blocks.carry(route, values, chunk) == pytest.approx(expected[ends])


def _with_ways(seed):
    """Ways into roots that others lead back to, trees of ways, a ring with ways into it, and repeated edges."""
    draw = random.Random(seed)
    pairs = [(i, draw.randrange(60)) for i in range(15, 45)] + [(draw.randrange(15), draw.randrange(60)) for _ in range(40)]
    return pairs + [(i, 45 + (i - 44) % 6) for i in range(45, 51)] + [(51, 46), (52, 51), (53, 51), (54, 47), (54, 47)]


@pytest.mark.parametrize("seed, largest", [*((seed, blocks.LARGEST) for seed in range(6)), (6, 0)])
@pytest.mark.parametrize("of_stress", [True, False])
def test_sources_with_a_single_way(monkeypatch, of_stress, seed, largest):
    monkeypatch.setattr(blocks, "LARGEST", largest)
    pairs = [(a, b) for a, b in _with_ways(seed) if a != b]
    counted = Counter(pairs)
    src, dst = np.array(list(counted), np.int32).T
    monkeypatch.setattr(blocks, "in_tasks", lambda edges, sources, count, work, schema: work)
    monkeypatch.setattr(blocks, "WIDEST", 4)
    got = Counter()
    for task in range(3):
        for batch in blocks.dependencies(None, None, 60, of_stress, 4)(np.arange(60), src, dst, np.array(list(counted.values())), np.arange(60), task, 3):
            for row in batch.to_pylist():
                got[row["id"]] += row["score"]
    assert [got[i] for i in range(60)] == pytest.approx(_plain(60, pairs)[1 if of_stress else 0])


def test_some_sources_with_a_single_way(monkeypatch):
    """Scores of sources by themselves add up to those of all, also of sources that are given twice."""
    counted = Counter((a, b) for a, b in _with_ways(7) if a != b)
    src, dst = np.array(list(counted), np.int32).T
    monkeypatch.setattr(blocks, "in_tasks", lambda edges, sources, count, work, schema: work)
    work = blocks.dependencies(None, None, 60, True, 4)

    def scores(sources):
        return Counter({r["id"]: r["score"] for batch in work(np.arange(60), src, dst, np.array(list(counted.values())), np.array(sources), 0, 1) for r in batch.to_pylist()})

    single = [scores([i]) for i in range(60)]
    assert sum(single, Counter()) == scores(range(60))
    assert single[20] + single[20] + single[52] == scores([20, 20, 52])


def test_stress_takes_sources_of_a_way_at_once(monkeypatch):
    """Ways of 30 vertices, whose ends lead to the starts of some: work is for the ends only."""
    draw = random.Random(5)
    users, copies = 12, 30
    n = users * copies
    pairs = sorted({(u + users * k, u + users * (k + 1)) for u in range(users) for k in range(copies - 1)} | {(n - users + u, draw.randrange(users)) for u in range(users) for _ in range(3)})
    rows, cells = _in_process(monkeypatch, lambda: blocks.dependencies(None, None, n, True, blocks.WIDEST), n, pairs)
    assert {i: 0 for i in range(n)} | {r["id"]: r["score"] for r in rows} == dict(enumerate(_plain(n, pairs)[1]))
    assert cells < n * len(pairs)
