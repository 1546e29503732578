"""The command line: create, alter, analyze and run."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .graph import UNREACHED, UNREACHED_HOPS, Graph
from .operators import analyze, centrality, components, generate, partition, ranking, structure, transform, traversal
from .plans.iterate import cut
from .plans.timing import COLUMNS, Timers
from .session import local_session
from .sources import binary, store, text

ALTER = {
    "binary": lambda g: g,
    "permute": transform.permuted,
    "reverse": transform.reverse,
    "undirected": transform.undirected,
    "sort-vertices": transform.sorted_by_degree,
    "sort-nbrs": lambda g: g,  # the store keeps edges in order of source and neighbour
    "random-weights": transform.random_weights,
    "remove-singletons": transform.remove_singletons,
}


def _first_source(graph: Graph, seed: int) -> int:
    """A vertex with out-edges, by hash order."""
    row = centrality.samples(graph, centrality.SINGLE, seed).first()
    if row is None:
        raise ValueError("no vertex has an out-edge")
    return row[0]


def _single(graph: Graph, source: int):
    return centrality.betweenness(graph, sources=graph.vertices.where(F.col("id") == source))


#: The algorithm, and how many edges a run of it counts as traversed.
RUN = {
    "bfs": (traversal.bfs, "reached"),
    "pagerank": (lambda g, s: ranking.pagerank(g), ranking.ROUNDS),
    "sssp": (traversal.sssp, "reached"),
    "betweenness": (_single, 2),
    "bfs-tree": (traversal.bfs_tree, "reached"),
    "clustering": (lambda g, s: structure.clustering_coefficient(g), 1),
    "components": (lambda g, s: components.connected_components(g), 1),
}


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="arcweave", description=__doc__)
    parser.add_argument("--cores", type=int, default=8)
    parser.add_argument("--memory", default="8g")
    commands = parser.add_subparsers(dest="command", required=True)
    create = commands.add_parser("create", help="a synthetic graph")
    create.add_argument("kind", choices=("rmat", "uniform", "kronecker"))
    create.add_argument("out")
    create.add_argument("-s", "--scale", type=int, default=20)
    create.add_argument("-e", "--edge-factor", type=int, default=16)
    create.add_argument("--weighted", action="store_true", help="with random weights")
    create.add_argument("--seed", type=int, default=generate.SEED)
    alter = commands.add_parser("alter", help="a graph from a graph")
    alter.add_argument("change", choices=sorted(ALTER))
    alter.add_argument("graph")
    alter.add_argument("out")
    alter.add_argument("--descending", action="store_true", help="neighbours from the largest down, in the store")
    alter.add_argument("--format", choices=("store", "binary", "text", "graphml"), default="store")
    look = commands.add_parser("analyze", help="counts, orders and distributions")
    look.add_argument("graph")
    look.add_argument("--degrees", help="write the degree distribution here")
    run = commands.add_parser("run", help="time an algorithm")
    run.add_argument("algorithm", choices=sorted(RUN))
    run.add_argument("graph")
    run.add_argument("-r", "--repeat", type=int, default=1)
    run.add_argument("--source", type=int, help="by default one with out-edges, another for each repeat")
    run.add_argument("--partitioner", choices=("random", "asc", "dsc"), help="assign vertices to partitions first, and print their statistics")
    run.add_argument("--fractions", type=lambda x: [float(f) for f in x.split(",")], default=[0.5, 0.5], help="one for each partition, with commas between")
    run.add_argument("--singletons", action="store_true", help="vertices without out-edges have a partition of their own")
    run.add_argument("--from-end", type=float, default=0.0, help="share of the edges that is taken from the other end of the order")
    run.add_argument("--randomized", action="store_true", help="spread vertices over all partitions but the last")
    run.add_argument("--out", help="write the last result here, as Parquet")
    return parser.parse_args()


def _partitions(graph: Graph, args: argparse.Namespace):
    if args.partitioner == "random":
        return partition.by_fractions(graph, args.fractions)
    labels = partition.by_degree(graph, args.fractions, args.partitioner == "dsc", args.singletons, args.from_end)
    return partition.shuffled_among(labels, 0, len(args.fractions) - 1) if args.randomized and len(args.fractions) > 2 else labels


def _write(graph: Graph, path: str, form: str) -> None:
    {"store": store.write_graph, "binary": binary.write_binary, "text": text.write_text, "graphml": text.write_graphml}[form](graph, path)


def main() -> None:
    args = _arguments()
    spark = local_session(args.cores, args.memory)
    if args.command == "create":
        make = {"rmat": generate.rmat, "uniform": generate.uniform, "kronecker": generate.kronecker}[args.kind]
        made = make(spark, args.scale, args.edge_factor, args.seed)
        store.write_graph(transform.random_weights(made, args.seed) if args.weighted else made, args.out)
    elif args.command == "alter":
        changed = ALTER[args.change](store.load(spark, args.graph))
        if args.format == "store":
            store.write_graph(changed, args.out, descending=args.descending)
        else:
            _write(changed, args.out, args.format)
    elif args.command == "analyze":
        given = store.load(spark, args.graph)
        graph = given.written()
        # The places of rows are those in the file, as it is read; the store, of many files, has none.
        neighbours = lambda _: analyze.neighbour_order(given.edges.withColumn("pos", F.monotonically_increasing_id()))
        placed = [] if store.is_store(spark, args.graph) else [neighbours]
        for result in (analyze.summary, analyze.direction, analyze.repeated_edges, analyze.singletons_and_leaves, analyze.degree_order, *placed):
            for name, value in result(graph).first().asDict().items():
                print(f"{name}\t{value}")
        if args.degrees:
            text.write_degree_distribution(analyze.degree_distribution(graph), args.degrees)
    else:
        setup = Timers(spark)
        with setup.phase("init"):
            graph = store.load(spark, args.graph, weighted=args.algorithm == "sssp").written()
            edges = graph.edge_count()
        if args.partitioner:
            with setup.phase("par"):
                labels = cut(_partitions(graph, args))
        print("\t".join(f"time_{name}:{ms:.2f}" for name, ms in setup.ms.items()))
        if args.partitioner:
            for row in partition.partition_stats(graph, labels).orderBy("pid").collect():  # one row per partition
                print("\t".join(f"{k}:{v}" for k, v in row.asDict().items()))
        algorithm, counted = RUN[args.algorithm]
        print("source\t" + "\t".join(COLUMNS))
        for turn in range(args.repeat):
            timers = Timers(spark)
            with timers.phase("init"):
                source = args.source if args.source is not None else _first_source(graph, generate.SEED + turn)
            with timers.phase("exec"):
                result = algorithm(graph, source)
            with timers.phase("aggr"):
                rows = result.count()
            if counted == "reached":
                column = result.columns[1]
                unreached = UNREACHED_HOPS if column == "cost" else UNREACHED
                traversed = traversal.traversed_edges(graph, result.select("id", F.col(column).alias("cost")), unreached).first()[0]
            else:
                traversed = counted * edges
            measured = timers.row(traversed)
            print(f"{source}\t" + "\t".join(f"{measured[c]:.6f}" if c == "exec_rate" else f"{measured[c]:.0f}" if c == "trv_edges" else f"{measured[c]:.2f}" for c in COLUMNS), flush=True)
        if args.out:
            print(f"{rows} rows to {args.out}")
            result.write.parquet(args.out)


if __name__ == "__main__":
    main()
