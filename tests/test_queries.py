"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

from arcweave.plans import registry

from .conftest import DATA

#: Queries whose plans differ where keys are hot, vertices are hubs or a loop has many tables.
SPLIT = (
    "bfs_tree_stored", "sssp", "cc_out", "connected_components_stored", "pagerank_stored", "triangle_count", "pcore", "degree_sorted_adjacency", "maxflow",
    "partition_edges", "pregel_components", "pregel_gathered_levels", "remove_singletons", "betweenness", "value_lookup",
)


@pytest.fixture(autouse=True)
def compiled(spark):
    """Queries run as users run them, with whole stages compiled."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", SPLIT)
def test_as_sql_with_low_thresholds(name, same_as_sql, monkeypatch):
    from arcweave.functions import lookup
    from arcweave.plans import adjacency, ledger

    for module, constant, value in ((adjacency, "LEAST_HUB", 20), (lookup, "LEAST_ROWS", 50), (ledger, "LEAST_ROWS", 40), (ledger, "LEAST_ENTRIES", 3)):
        monkeypatch.setattr(module, constant, value)
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_summary_counts_delivered_edges_that_end_nowhere(spark, duck):
    row = registry.QUERIES["graph_summary_delivered"](spark, DATA).first()
    ids = "(SELECT id FROM vertices UNION ALL SELECT id FROM core_vertices)"
    nowhere = duck.execute(f"SELECT count(*) FROM (SELECT DISTINCT pos, src, dst, weight FROM edges) WHERE src IS NOT NULL AND dst NOT IN {ids}").fetchone()[0]
    assert row.dangling_edges == nowhere > 0
    assert row.edge_count - nowhere == registry.QUERIES["graph_summary"](spark, DATA).first().edge_count


@pytest.mark.parametrize("name", ["rmat", "bter"])
def test_generators_at_the_default_scale(spark, name):
    from arcweave.operators import generate

    rows = registry.QUERIES[name](spark, DATA).collect()
    vertices = (1 << generate.SCALE) - 2
    assert sum(r.vertex_count for r in rows) == vertices
    edges = sum(r.degree * r.vertex_count for r in rows)
    assert edges == 16 * vertices > generate.BLOCK if name == "rmat" else edges > generate.BLOCK


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
