"""The subpackage's queries against SQL where there is one; the others run and are whole."""

import pytest

from arcweave.llm import queries

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(name, spark):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() > 0 or name.endswith("_found")


def test_whole_tables(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    assert queries.p6_ids(spark, DATA).count() == documents.count()
    pieces = queries.p8_pieces(spark, DATA)
    assert pieces.select("doc_id").distinct().count() == documents.where("text is not null").select("doc_id").distinct().count()


def test_mix_shortfalls_by_brute_force(spark):
    from arcweave.llm import tokens

    sizes = {}
    for r in tokens.count_tokens(spark.read.parquet(f"{DATA}/documents.parquet"), ["source"], "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + r.n_tokens
    total = sum(sizes.values())
    expected = {r.source for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect() if r.max_repeats * sizes.get(r.source, 0) < r.target_share * total}
    assert {r.source for r in queries.p7_found(spark, DATA).collect()} == expected


def test_curriculum_moves_tokens_but_keeps_shares(spark):
    from arcweave.llm import mixing

    folder = "/root/testdata/sf0.01"
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    tokens = lambda rows: {s: sum(r.n_tokens for r in rows if r.source == s) for s in {r.source for r in rows}}
    rows, plain = queries.p7_mix(spark, folder).collect(), mixing.mix(read("documents"), read("mix_targets")).documents.collect()
    assert tokens(rows) == tokens(plain) and {(r.doc_id, r.repeat) for r in rows} == {(r.doc_id, r.repeat) for r in plain}
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    before = 0
    for r in rows:
        assert r.first_token == before
        before += r.n_tokens
    # Integrals of the schedules up to a half and a quarter.
    parts = {(0.5, 1.5): (0.375, 0.15625), (1.5, 0.5): (0.625, 0.34375), (0.5, 1.5, 0.5): (0.5, 0.1875)}
    whole, seen = tokens(rows), set()
    for source, weights in queries.schedules(read("mix_targets")).items():
        own = [r for r in rows if r.source == source]
        for upto, part in zip((0.5, 0.25), parts[weights]):
            if own:
                assert abs(sum(r.n_tokens for r in own if r.position < upto) - part * whole[source]) <= max(r.n_tokens for r in own)
                seen.add(weights)
    assert seen == set(queries.CURRICULUM)


def test_boundaries_by_brute_force(spark):
    from .test_splitting import _coarsest

    expected = set()
    from arcweave.llm import bpe

    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        if r.text and len(bpe.encoder().encode_bytes([r.text.encode()])[0]) > 1024:
            expected.add((r.doc_id, _coarsest(r.text, 1024)))
    assert {tuple(r) for r in queries.p8_found(spark, DATA).collect()} == expected
