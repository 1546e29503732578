"""Known results on structured graphs, for algorithms and their special cases."""

import random

import pytest
from pyspark.sql import functions as F

from arcweave.graph import UNREACHED, UNREACHED_HOPS, Graph
from arcweave.operators import analyze, centrality, components, flow, generate, partition, ranking, structure, transform, traversal
from arcweave.plans import adjacency, vertex_program

from .graphs import both, build, chain, complete, grid, star, values, wheel


@pytest.mark.parametrize("direction", ["push", "pull", "auto"])
def test_bfs(spark, direction):
    assert values(traversal.bfs(build(spark, 8, chain(8)), 5, direction=direction)) == {i: abs(i - 5) for i in range(8)}
    assert values(traversal.bfs(build(spark, 30, star(30)), 7, direction=direction)) == {i: 0 if i == 7 else 1 if i == 0 else 2 for i in range(30)}
    assert values(traversal.bfs(build(spark, 20, complete(20)), 0, direction=direction)) == {i: int(i > 0) for i in range(20)}


def test_bfs_special_cases(spark):
    alone = build(spark, 5, [])
    assert values(traversal.bfs(alone, 3)) == {i: 0 if i == 3 else UNREACHED_HOPS for i in range(5)}
    assert values(traversal.bfs(alone, 3, unreachable=None))[0] is None
    with pytest.raises(ValueError):
        traversal.bfs(alone, 5)
    with pytest.raises(ValueError):
        ranking.pagerank(build(spark, 0, []))
    # An end that is no vertex, a self loop and a repeated edge.
    odd = build(spark, 3, [(0, 9), (9, 2), (0, 0), (0, 1), (0, 1)], directed=True)
    assert values(traversal.bfs(odd, 0)) == {0: 0, 1: 1, 2: UNREACHED_HOPS}


def test_trees(spark):
    tree = values(traversal.bfs_tree(build(spark, 10, chain(10)), 4))
    assert tree == {i: i + 1 if i < 4 else i - 1 if i > 4 else 4 for i in range(10)}
    g = build(spark, 30, star(30))
    tree = traversal.bfs_tree(g, 3)
    assert values(tree) == {i: 3 if i in (0, 3) else 0 for i in range(30)}
    assert set(traversal.validate_tree(g, tree, 3).first()) == {0}
    cycle = spark.createDataFrame([(0, 0), (1, 2), (2, 1)], "id long, parent long")
    found = traversal.validate_tree(build(spark, 3, chain(3)), cycle, 0).first()
    assert found.no_path == 2 and found.one_end == 2 and found.bad_root == 0
    assert values(traversal.bfs_tree(build(spark, 3, []), 0)) == {0: 0, 1: UNREACHED, 2: UNREACHED}


def test_shortest_paths(spark):
    g = build(spark, 15, grid(3, 5, lambda a, b: abs(a - b)), weighted=True)
    assert values(traversal.sssp(g, 0)) == {i: i for i in range(15)}
    g = build(spark, 15, grid(3, 5, lambda a, b: a + b), weighted=True)
    assert list(dict(sorted(values(traversal.sssp(g, 0)).items())).values()) == [0, 1, 4, 9, 16, 5, 8, 13, 20, 29, 20, 25, 32, 41, 52]
    with pytest.raises(ValueError):
        traversal.sssp(build(spark, 3, chain(3)), 0)
    pairs = {(r.src, r.dst): r.distance for r in traversal.apsp(build(spark, 8, star(8, 1), weighted=True)).collect()}
    assert pairs == {(a, b): 0 if a == b else 1 if 0 in (a, b) else 2 for a in range(8) for b in range(8)}
    assert values(traversal.sssp(build(spark, 2, [(0, 1, 5), (0, 1, 3)], directed=True, weighted=True), 0)) == {0: 0, 1: 3}


def test_connectivity(spark):
    g = build(spark, 6, chain(3) + both([(4, 5)]))
    assert tuple(traversal.st_connectivity(g, 0, 2).first()) == (0, 2, True, 2)
    assert tuple(traversal.st_connectivity(g, 0, 5).first()) == (0, 5, False, None)


def test_components(spark):
    parts = chain(10) + [(a + 10, b + 10) for a, b in chain(10)] + [(a + 20, b + 20) for a, b in chain(11)] + [(a + 31, b + 31) for a, b in chain(9)]
    g = build(spark, 40, parts)
    first = lambda i: 0 if i < 10 else 10 if i < 20 else 20 if i < 31 else 31
    assert values(components.connected_components(g)) == {i: first(i) for i in range(40)}
    found = [tuple(r) for r in components.component_stats(g).orderBy("component").collect()]
    assert found == [(0, 10, 18, False), (1, 10, 18, False), (2, 11, 20, True), (3, 9, 16, False)]
    assert [tuple(r) for r in components.component_stats(build(spark, 1, [(0, 0)], directed=True)).collect()] == [(0, 1, 1, True)]
    one_way = build(spark, 4, [(3, 2), (2, 1), (0, 1)], directed=True)
    assert values(components.connected_components(one_way, "out")) == {0: 0, 1: 0, 2: 2, 3: 3}


def test_label_propagation(spark):
    g = build(spark, 15, grid(3, 5))
    assert [x for _, x in sorted(values(components.label_propagation(g)).items())] == [6, 6, 7, 8, 8] * 3
    assert set(values(components.label_propagation(build(spark, 9, star(9)))).values()) == {0}
    assert set(values(components.label_propagation(build(spark, 12, wheel(12)))).values()) == {0}
    assert values(components.label_propagation(build(spark, 3, both([(0, 1)]))))[2] == 2


def test_label_propagation_runs_until_labels_are_stable(spark):
    """The registered query against the rule in numpy, where three turns are not enough."""
    import numpy as np

    from arcweave.plans import graph_queries
    from arcweave.plans.graphs import graph

    folder = "/root/testdata/sf0.01"
    pairs = np.array(graph(spark, folder, "transitions").edges.select("src", "dst").collect())
    ids, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(pairs.shape)
    walk = np.zeros((len(ids), len(ids)))
    np.add.at(walk, (ends[:, 0], ends[:, 1]), 1)
    walk /= np.maximum(walk.sum(axis=1, keepdims=True), 1)
    p, turns = walk + np.eye(len(ids)) * (walk.sum(axis=1) > 0), []
    while len(turns) < components.LP_TURNS and not (len(turns) > components.LP_STABLE and all((x == turns[-1]).all() for x in turns[-1 - components.LP_STABLE :])):
        p = walk @ p
        turns.append(np.where(walk.sum(axis=1) > 0, np.argmax(np.round(p, components.LP_DIGITS), axis=1), np.arange(len(ids))))
    assert len(turns) > 3 and (turns[2] != turns[-1]).any()
    assert values(graph_queries.QUERIES["label_propagation_stable"](spark, folder)) == {int(ids[i]): int(ids[x]) for i, x in enumerate(turns[-1])}


def test_pagerank(spark):
    got = values(ranking.pagerank(build(spark, 100, chain(100))))
    assert [round(got[i], 10) for i in (0, 1, 2, 99)] == [0.0083862783, 0.0154199984, 0.0149037430, 0.0083862783]
    assert round(sum(got.values()), 10) == 1.4348312062
    one_way = [(i, i + 1) for i in range(99)]
    got = values(ranking.pagerank(build(spark, 100, one_way, directed=True)))
    assert [round(got[i], 10) for i in (0, 1, 2, 99)] == [0.0015, 0.002775, 0.00385875, 0.01]
    g = build(spark, 15, grid(3, 5))
    push, pull = values(ranking.pagerank(g)), values(ranking.pagerank_incoming(g))
    assert all(abs(push[i] - pull[i]) < 1e-12 for i in push) and round(push[0], 10) == 0.0882615127
    assert values(ranking.pagerank(build(spark, 1, []))) == {0: 1.0}
    even = build(spark, 6, complete(6))
    normal = values(ranking.pagerank(even, first_normalized=True))
    assert all(abs(r - 1 / 6) < 1e-12 for r in normal.values())
    start = spark.createDataFrame([(0, 1.0)], "id long, rank double")
    assert values(ranking.pagerank(even, start=start, rounds=1))[0] == pytest.approx(0.15 / 6)


def test_structure(spark):
    n = 12
    got = values(structure.clustering_coefficient(build(spark, n, wheel(n))))
    assert got[0] == pytest.approx(2 / (n - 2)) and all(got[i] == pytest.approx(2 / 3) for i in range(1, n))
    assert set(values(structure.clustering_coefficient(build(spark, 9, complete(9)))).values()) == {1.0}
    assert set(values(structure.clustering_coefficient(build(spark, 9, star(9)))).values()) == {0.0}
    assert set(values(structure.triangle_count(build(spark, 5, complete(5)))).values()) == {6}


def _peeled(n, edges, start, step):
    """The rounds by peeling wave by wave."""
    there, out, threshold, turn = set(range(n)), {}, start, 0
    while there:
        sums = {v: sum(w for a, b, w in edges if a == v and b in there) for v in there}
        wave = {v for v in there if sums[v] <= threshold}
        if wave:
            out |= dict.fromkeys(wave, turn)
            there -= wave
        else:
            threshold, turn = threshold + step, turn + 1
    return out


def test_cores(spark):
    g = build(spark, 15, grid(3, 5, lambda a, b: a + b), weighted=True)
    in_order = lambda df: [x for _, x in sorted(values(df).items())]
    assert in_order(structure.pcore(g)) == [6, 10, 14, 18, 18, 26, 30, 34, 38, 38, 26, 30, 34, 38, 38]
    assert in_order(structure.pcore(g, step=5)) == [2, 2, 3, 4, 4, 6, 6, 7, 8, 8, 6, 6, 7, 8, 8]
    assert set(in_order(structure.pcore(build(spark, 8, complete(8, 1), weighted=True)))) == {7}
    assert in_order(structure.pcore(build(spark, 1, [(0, 0, 10)], weighted=True))) == [1]
    draw = random.Random(3)
    edges = both([(a, b, draw.randint(1, 9)) for a in range(25) for b in range(a) if draw.random() < 0.25])
    for start, step in ((0, 1), (10, 7)):
        assert values(structure.pcore(build(spark, 25, edges, weighted=True), start, step)) == _peeled(25, edges, start, step)
    with pytest.raises(ValueError):
        structure.pcore(build(spark, 3, [(0, 1, 1)], directed=True, weighted=True))


def _augmented(n, edges, s, t):
    room = [[0] * n for _ in range(n)]
    for a, b, c in edges:
        room[a][b] += c if a != b else 0
    total = 0
    while True:
        back, queue = {s: s}, [s]
        for u in queue:
            for v in range(n):
                if room[u][v] and v not in back:
                    back[v] = u
                    queue.append(v)
        if t not in back:
            return total
        v, path = t, []
        while v != s:
            path.append((back[v], v))
            v = back[v]
        least = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= least
            room[b][a] += least
        total += least


def _frames(draw, size, count):
    """Frames of a grid behind each other: strong links within a frame, weak ones at random to the next."""
    at = lambda f, r, c: (f * size + r) * size + c
    edges = []
    for f in range(count):
        for r in range(size):
            for c in range(size):
                edges += [(at(f, r, c), at(f, r + x, c + y), 40) for x, y in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= r + x < size and 0 <= c + y < size]
                if f + 1 < count:
                    edges.append((at(f, r, c), at(f + 1, draw.randrange(size), draw.randrange(size)), draw.randint(1, 20)))
    return size * size * count, edges


def _levels(draw, rows, columns):
    """Levels of vertices between a source and a sink, three links from each to the next level."""
    edges = [(0, 1 + r, 300) for r in range(rows)] + [(1 + (columns - 1) * rows + r, 1 + columns * rows, 300) for r in range(rows)]
    edges += [(1 + c * rows + r, 1 + (c + 1) * rows + draw.randrange(rows), draw.randint(2, 300)) for c in range(columns - 1) for r in range(rows) for _ in range(3)]
    return 2 + columns * rows, edges


def test_flow(spark):
    draw = random.Random(7)
    dense = [(a, b, draw.randint(1, 1000)) for a in range(20) for b in range(a + 1, 20)]
    both_ways = [(a, b, draw.randint(1, 20)) for a in range(12) for b in range(12) if draw.random() < 0.3]
    for n, edges in ((12, both_ways), (20, dense), _frames(draw, 2, 4), _levels(draw, 4, 4)):
        assert flow.maxflow(build(spark, n, edges, directed=True, weighted=True), 0, n - 1).first().flow == _augmented(n, edges, 0, n - 1)
    small = [(0, 1, 3), (0, 2, 2), (1, 2, 5), (1, 3, 2), (2, 3, 3)]
    g = build(spark, 4, small, directed=True, weighted=True)
    assert tuple(flow.maxflow(g, 0, 3).first()) == (0, 3, 5)
    one_way = build(spark, 12, [(i, i + 1, 12 - i) for i in range(11)] + [(0, 11, 5), (3, 3, 9), (20, 11, 9)], directed=True, weighted=True)
    assert flow.maxflow(one_way, 0, 11).first().flow == 7
    assert flow.maxflow(build(spark, 3, [(0, 1, 4)], directed=True, weighted=True), 0, 2).first().flow == 0
    with pytest.raises(ValueError):
        flow.maxflow(g, 1, 1)


def test_centralities(spark):
    one_way = build(spark, 8, [(i, i + 1) for i in range(7)], directed=True)
    assert values(centrality.betweenness(one_way)) == {i: i * (7 - i) for i in range(8)}
    n = 12
    assert values(centrality.betweenness(build(spark, n, star(n)), batch=5)) == {i: (n - 1) * (n - 2) if i == 0 else 0 for i in range(n)}
    grid15 = build(spark, 15, grid(3, 5))
    got = values(centrality.betweenness(grid15))
    assert [round(got[i], 6) for i in range(8)] == [3.9, 24.133333, 30.6, 24.133333, 3.9, 14.733333, 45.6, 56.0]
    got = values(centrality.stress(grid15))
    assert [got[i] for i in range(8)] == [16, 108, 136, 108, 16, 74, 200, 246]
    got = values(centrality.closeness(grid15))
    assert [round(got[i], 8) for i in range(8)] == [0.31111111, 0.38888889, 0.42424242, 0.38888889, 0.31111111, 0.35, 0.4516129, 0.5]
    path = build(spark, 6, chain(6))
    assert values(centrality.stress(path)) == {i: 2 * i * (5 - i) for i in range(6)}
    assert set(values(centrality.betweenness(build(spark, 4, []))).values()) == {0.0}
    assert centrality.samples(path, -1.0).count() == 1 and centrality.sample_count(1000, 1.0) == 9


def test_hubs_are_salted(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 500)] + [(i, 0) for i in range(1, 500)], "src long, dst long")
    with adjacency.Adjacency(edges, "src", least_hub=50) as out:
        assert out.hubs.count() == 1 and out.hubs.first()[1] > 4
        state = spark.createDataFrame([(0,), (7,), (None,)], "id long")
        got = sorted((r.id, r.dst) for r in out.join(state).collect())
    assert got == sorted([(0, i) for i in range(1, 500)] + [(7, 0)])


def test_vertex_program(spark):
    g = build(spark, 30, star(30))
    degrees = vertex_program.run(g, F.lit(0).cast("long"), F.lit(1).cast("long"), "sum", F.coalesce("message", F.lit(0)), max_steps=1)
    assert values(degrees) == {i: 29 if i == 0 else 1 for i in range(30)}
    seen = []
    vertex_program.run(build(spark, 4, chain(4)), F.col("id"), F.col("state"), "min", F.least("state", "message"), before_step=seen.append)
    assert seen == list(range(1, len(seen) + 1)) and len(seen) >= 3


def test_transforms(spark):
    g = build(spark, 10, chain(10))
    first = transform.induced_subgraph(g, spark.createDataFrame([(i,) for i in range(5)], "id long"))
    assert (first.vertex_count(), first.edge_count()) == (5, 8)
    even = transform.induced_subgraph(build(spark, 10, star(10)), spark.createDataFrame([(i,) for i in range(0, 10, 2)], "id long"))
    assert (even.vertex_count(), even.edge_count()) == (5, 8) and values(even.vertices.withColumn("x", F.lit(1))).keys() == set(range(5))
    with pytest.raises(ValueError):
        transform.reverse(g)
    with pytest.raises(ValueError):
        transform.undirected(g)
    permuted = transform.permuted(g)
    assert values(permuted.vertices.withColumn("x", F.lit(1))).keys() == set(range(10)) and permuted.edge_count() == 18
    weighted = transform.random_weights(g)
    assert weighted.edges.where("weight < 0 or weight > 9").count() == 0
    lists = transform.adjacency(build(spark, 3, [(0, 2, 7), (0, 1, 9)], directed=True, weighted=True))
    assert {r.id: (r.neighbours, r.weights) for r in lists.collect()} == {0: ([1, 2], [9, 7]), 1: ([], []), 2: ([], [])}
    hub = build(spark, 30, star(30) + [(0, 3)])
    for down in (False, True):
        chunks = sorted((r.id, r.chunk, r.neighbours) for r in transform.adjacency(hub, descending=down, most=8).collect())
        whole = sorted([*range(1, 30), 3], reverse=down)
        assert [c for c in chunks if c[0] == 0] == [(0, i, whole[8 * i : 8 * i + 8]) for i in range(4)] and chunks[4:] == [(i, 0, [0]) for i in range(1, 30)]
    swapped = transform.residual(build(spark, 2, [(0, 1, 7)], directed=True, weighted=True)).orderBy("src").collect()
    assert [tuple(r) for r in swapped] == [(0, 1, 7, True), (1, 0, 0, False)]


def test_partitions(spark):
    g = build(spark, 40, star(40))
    sizes = lambda df: [r[1] for r in df.groupBy("pid").count().orderBy("pid").collect()]
    assert sizes(partition.by_fractions(g, (0.25, 0.25, 0.5))) == [10, 10, 20]
    assert set(values(partition.by_hash(g, 3)).values()) <= {0, 1, 2}
    down = values(partition.by_degree(g, (0.5, 0.5), descending=True))
    assert down[0] == 0 and sum(p == 0 for p in down.values()) == 1
    # Ascending, the leaves fill; of the end of the order, the hub alone is more than the share.
    taken = values(partition.by_degree(g, (0.5, 0.5), from_end=0.1))
    assert taken[0] == 0
    assert sizes(partition.by_degree(build(spark, 9, complete(9)), 3)) == [3, 3, 3]
    alone = build(spark, 6, chain(4))
    assert values(partition.by_degree(alone, (0.5, 0.2, 0.3), singletons=True)) == {0: 0, 3: 0, 1: 0, 2: 2, 4: 1, 5: 1}
    assert values(partition.by_degree(alone, (0.5, 0.5))) == {4: 0, 5: 0, 0: 0, 3: 0, 1: 0, 2: 1}
    # Of equal degrees, the smaller id comes first in both orders; a share that is not reached takes all that is left.
    assert values(partition.by_degree(alone, (0.3, 0.3, 0.4), descending=True)) == {1: 0, 2: 1, 0: 2, 3: 2, 4: 2, 5: 2}
    assert values(partition.by_degree(alone, (0.3, 0.7, 0.0), descending=True)) == {1: 0, 2: 1, 0: 1, 3: 1, 4: 1, 5: 1}
    with pytest.raises(ValueError):
        partition.by_degree(alone, 1, singletons=True)
    for bad in ((), (0.5, 0.2), (-0.5, 1.5)):
        with pytest.raises(ValueError):
            partition.by_fractions(g, bad)
    with pytest.raises(ValueError):
        partition.by_hash(g, 0)
    spread = partition.shuffled_among(partition.by_degree(g, (0.5, 0.3, 0.2)), 0, 2)
    assert spread.where("pid > 2").count() == 0
    one = spark.createDataFrame([(i, 0) for i in range(40)], "id long, pid int")
    assert partition.modularity(g, one).first()[0] == 0.0


def test_generators(spark):
    for g in (generate.rmat(spark, 6, block_edges=100), generate.uniform(spark, 6), generate.kronecker(spark, 6)):
        row = analyze.summary(g).first()
        assert (row.vertex_count, row.edge_count, row.self_loops, row.dangling_edges) == (62, 992, 0, 0)
    again = generate.rmat(spark, 6, block_edges=100).edges.exceptAll(generate.rmat(spark, 6, block_edges=100).edges)
    assert again.isEmpty()
    blocks = generate.bter(spark, [(0, 3), (1, 400), (2, 30), (6, 700)])
    row = analyze.summary(blocks).first()
    assert row.vertex_count == 1133 and row.is_symmetric and row.self_loops == 0
    got = values(structure.degree(blocks))
    # By hand, three quarters of the vertices of degree one have a link, and degrees are about those asked for.
    assert min(got[i] for i in range(300)) >= 1 and 0.8 < sum(got[i] for i in range(430, 1130)) / (700 * 6) < 1.2
    dense, loose = (values(structure.clustering_coefficient(generate.bter(spark, [(6, 700)], clustering=lambda d, most: rho))) for rho in (0.9, 0.3))
    assert sum(dense.values()) > sum(loose.values()) > 0
    assert generate.falling(2, 50) > generate.falling(10, 50) > generate.falling(50, 50)
    assert analyze.summary(generate.bter(spark, [(1, 10)], by_hand=1.0)).first().edge_count == 10
    with pytest.raises(ValueError):
        generate.rmat(spark, 1)


def test_rmat_ids_do_not_reveal_degrees(spark):
    """By ids as drawn, the vertices of the first eighth have most of the edges."""
    drawn = generate._drawn(spark, 9, 16, generate.SEED, generate.RMAT, generate.NOISE, generate.BLOCK)
    g = generate.rmat(spark, 9)
    share = lambda x: x.edges.where(f"src < {(1 << 9) // 8}").count() / x.edge_count()
    assert share(drawn) > 0.35 and share(g) < 0.25
    same = lambda x: values(analyze.degree_distribution(x), "degree")
    assert same(drawn) == same(g)


def test_pull_max_and_idle_programs(spark):
    g = build(spark, 30, star(30))
    far = vertex_program.run(g, F.when(F.col("id") == 7, 0).cast("long"), F.col("state") + 1, "min", F.col("message"), gather=F.col("state").isNull())
    assert values(far) == {i: 0 if i == 7 else 1 if i == 0 else 2 for i in range(30)}
    assert set(values(vertex_program.run(g, F.col("id"), F.col("state"), "max", F.greatest("state", "message"))).values()) == {29}
    count = vertex_program.run(build(spark, 3, [(0, 1)], directed=True), F.lit(5).cast("long"), F.lit(1).cast("long"), "sum", F.coalesce("message", F.lit(0)), idle=True, max_steps=1)
    assert values(count) == {0: 0, 1: 1, 2: 0}
    with pytest.raises(ValueError):
        vertex_program.run(g, F.col("id"), F.col("state"), "min", F.col("message"), against=F.col("state"), gather=F.lit(True))


def test_ledger(spark):
    """Against a dictionary, with tables put together at every chance."""
    from arcweave.plans.ledger import Ledger

    draw = random.Random(4)
    for rule in ("once", "least", "newest"):
        book = {i: draw.randint(0, 99) for i in range(20)}
        with Ledger(spark.createDataFrame(list(book.items()), "id long, x long"), ["id"], ["x"], rule, least_rows=30) as known:
            for turn in range(14):
                rows = {draw.randint(0, 60): draw.randint(0, 99) for _ in range(draw.choice((1, 2, 12)))}
                rows = {k: v for k, v in rows.items() if rule != "once" or k not in book}
                if not rows:
                    continue
                asked = spark.createDataFrame([(k,) for k in range(62)], "id long")
                if turn % 5 == 0:
                    assert {r.id: r.known for r in known.beside(asked).collect()} == {k: book.get(k) for k in range(62)}
                entry = known.add(spark.createDataFrame([(k, v, "more") for k, v in rows.items()], "id long, x long, other string"))
                assert entry.rows == len(rows) and {r.id: r.x for r in entry.df.collect()} == rows
                book |= {k: min(v, book.get(k, v)) if rule == "least" else v for k, v in rows.items()}
            assert {r.id: r.x for r in known.all().collect()} == book and len(known.entries) <= 9


def test_tables_that_no_result_reads_are_removed(spark):
    from arcweave.plans import iterate

    before = set(iterate._KEPT)
    result = traversal.sssp(build(spark, 6, chain(6, 2), weighted=True), 0)
    made = set(iterate._KEPT) - before
    assert values(result) == {i: 2 * i for i in range(6)} and made and made == {p for p in made if p.rsplit("/", 1)[-1] in iterate._tables_of(result)}
    iterate.release(result)
    assert set(iterate._KEPT) == before
    with pytest.raises(ValueError):
        traversal.sssp(build(spark, 3, [(0, 1, -1)], directed=True, weighted=True), 0)
    assert set(iterate._KEPT) == before


def test_no_folder_of_our_own_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from arcweave.plans import iterate

    for master, allowed in (("spark://host:7077", False), ("local-cluster[3,2,3000]", False), ("yarn", False), ("local[4]", True)):
        settings = {}
        conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__)
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
        if allowed:
            assert iterate.shared_folder(fake).startswith("file://")
        else:
            with pytest.raises(ValueError):
                iterate.shared_folder(fake)


def test_orders(spark):
    from arcweave.functions import ordering

    draw = random.Random(2)
    rows = [(i, draw.randint(0, 30), draw.choice([None, 1, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, x long")
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = sorted(ordering.with_running(df, ["-k", "id"], index="i", sums={"before": "x"}).collect(), key=lambda r: r.i)
    total = 0
    for i, (r, e) in enumerate(zip(got, expected)):
        assert (r.i, r.id, r.x, r.before) == (i, e[0], e[2], total)
        total += e[2] or 0
    after = {r.id: (r.b, r.y) for r in ordering.with_previous(df, ["-k", "id"], {"b": "id", "y": "x"}).collect()}
    assert after == {e[0]: (expected[i - 1][0], expected[i - 1][2]) if i else (None, None) for i, e in enumerate(expected)}
    assert ordering.with_running(df.limit(0), ["id"], index="i", sums={"s": "x"}).count() == ordering.with_previous(df.limit(0), ["id"], {"b": "x"}).count() == 0
    assert [r.k for r in sorted(ordering.places(df.orderBy("k"), "p").collect(), key=lambda r: r.p)] == sorted(r[1] for r in rows)


def test_spread_is_even_and_the_same_in_sql(spark, duck):
    from arcweave.functions.spread import spread, spread_sql

    df = spark.range(4000).select("id", (F.col("id") * 7 + 3_000_000_000).alias("b"))
    ours = df.select(spread(9, "id", "b")).toPandas().iloc[:, 0]
    theirs = duck.execute(f"SELECT {spread_sql(9, 'a', 'b')} FROM (SELECT range AS a, range * 7 + 3000000000 AS b FROM range(4000)) ORDER BY a").fetchdf().iloc[:, 0]
    assert (ours == theirs).all() and ours.nunique() > 3990
    assert all(300 < n < 500 for n in (ours % 10).value_counts()) and all(300 < n < 500 for n in (ours // (2**32 // 10)).clip(upper=9).value_counts())


def test_directions(spark):
    for directed, edges, word in ((True, [(0, 1)], "directed"), (False, both([(0, 1)]), "undirected"), (True, both([(0, 1)]), "labelled"), (False, [(0, 1)], "invalid")):
        assert analyze.direction(build(spark, 2, edges, directed=directed)).first().direction.startswith(word)


def test_triangles_of_hot_vertices(spark):
    """A vertex that many point to meets them in several tasks."""
    from arcweave.operators.structure import _closed

    draw = random.Random(3)
    pairs = [(a, b) for a in range(60) for b in range(a) if draw.random() < 0.15] + [(i, 100 + i) for i in range(60)]
    g = build(spark, 160, both(pairs) + [(5, 5), (1, 0)])
    assert {r.id: r.triangles for r in _closed(g, least_rows=0).collect()} == {r.id: r.triangles for r in structure.triangle_count(g).collect() if r.triangles}
    assert values(centrality.closeness(g, batch=50)) == values(centrality.closeness(g))


def test_extra_columns_and_clashing_names(spark):
    vertices = spark.createDataFrame([(i, "x", 1) for i in range(3)], "id long, src string, _hub int")
    edges = spark.createDataFrame([(0, 1, "a", 3), (1, 2, "b", 4)], "src long, dst long, id string, cost int")
    assert values(traversal.bfs(Graph(vertices, edges), 0)) == {0: 0, 1: 1, 2: 2}


def test_lookup_join(spark):
    from arcweave.functions.lookup import lookup_join

    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 0), (2, 1), (3, 0), (None, 5)], "k long, x long")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, y string")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, rows.join(table, "k", how).select("k", "x", "y").collect()), key=repr)
        assert sorted(map(tuple, lookup_join(rows, "k", table, how, least_rows=10).select("k", "x", "y").collect()), key=repr) == plain
