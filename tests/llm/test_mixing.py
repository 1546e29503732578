"""Mixes: shares, repeats, order and what cannot be reached."""

import pytest

from arcweave.llm import mixing, tokens

DOCUMENTS = "doc_id long, source string, text string, position double"


def made(spark, counts, words=3):
    rows = [(1000 * i + k, s, "word " * (words + k % 5), 0.0) for i, (s, n) in enumerate(counts.items()) for k in range(n)]
    rows += [(90_001, None, "lost words", 0.0), (90_002, "unlisted", "more lost words", 0.0), (90_003, "a", None, 0.0), (90_004, "a", "", 0.0)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def targets(spark):
    rows = [("a", 0.5, 2, 1), ("b", 0.2, 5, 1), ("c", 0.3, 2, 1), ("none", 0.0, 4, 1), ("missing", 0.0, 4, 1), ("zero", 0.1, 0, 1), (None, 0.4, 3, 1)]
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, supply int")


@pytest.mark.parametrize("bucket_rows", [7, 20_000])
def test_mix(spark, targets, bucket_rows):
    documents = made(spark, {"a": 300, "b": 40, "c": 20, "zero": 5})
    mix = mixing.mix(documents, targets, bucket_rows=bucket_rows)
    sizes = {(r.doc_id, r.source): r.n_tokens for r in tokens.count_tokens(documents, ["doc_id", "source"], "text").collect()}
    total = sum(sizes.values())
    supply = {s: sum(n for (_, t), n in sizes.items() if t == s) for s in "abc"}
    rows = mix.ordered().collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    report = {r.source: r for r in mix.report.collect()}
    assert set(report) == {"a", "b", "c", "none", "missing", "zero"}
    for s, share, repeats in (("a", 0.5, 2), ("b", 0.2, 5), ("c", 0.3, 2)):
        own = [r for r in rows if r.source == s]
        reached, largest = sum(r.n_tokens for r in own), max(n for (_, t), n in sizes.items() if t == s)
        times = {}
        for r in own:
            times.setdefault(r.doc_id, []).append(r.repeat)
        assert all(sorted(t) == list(range(len(t))) and len(t) <= repeats for t in times.values())
        assert max(map(len, times.values())) - min(map(len, times.values()) if len(times) == sum(t == s and n > 0 for (_, t), n in sizes.items()) else [0]) <= 1
        short = repeats * supply[s] < share * total
        assert report[s].short == short and report[s].tokens == reached
        assert reached == repeats * supply[s] if short else share * total <= reached < share * total + largest
        # A third of the way through, about a third of the source's tokens have come.
        third = sum(r.n_tokens for r in own if r.position < 1 / 3)
        assert abs(third - reached / 3) <= largest
    assert report["c"].short and report["zero"].short and not report["missing"].short
    assert sum(r.share for r in report.values()) == pytest.approx(1)


def test_same_mix_whatever_the_partitions(spark, targets):
    documents = made(spark, {"a": 60, "b": 30, "c": 10})
    first = [tuple(r) for r in mixing.mix(documents, targets, bucket_rows=9).ordered().collect()]
    second = [tuple(r) for r in mixing.mix(documents.repartition(5), targets, bucket_rows=9).ordered().collect()]
    assert first == second


def test_schedule(spark, targets):
    documents = made(spark, {"a": 400, "b": 300, "c": 20})
    rows = mixing.mix(documents, targets, {"a": [0.0, 1.0], "b": [1.0, 1.0, 0.0]}).documents.collect()
    for source, upto, part in (("a", 0.5, 0.25), ("a", 0.8, 0.64), ("b", 0.5, 2 / 3), ("b", 0.75, 2 / 3 + 1 / 4)):
        own = [r for r in rows if r.source == source]
        assert sum(r.n_tokens for r in own if r.position < upto) / sum(r.n_tokens for r in own) == pytest.approx(part, abs=0.02)
    for bad in ([1.0], [1.0, -1.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            mixing.mix(documents, targets, {"a": bad})


def test_course_and_checks(spark, targets):
    from pyspark.sql import functions as F

    documents = made(spark, {"a": 400, "b": 300, "c": 20, "zero": 3})
    mix = mixing.mix(documents, targets, {"a": [0.0, 1.0]})
    course = {(r.source, r.part): (r.tokens, r.expected) for r in mix.course(4).collect()}
    whole = {r.source: r for r in mix.report.collect()}
    assert len(course) == 4 * 6 and course[("zero", 2)] == (0, 0.0)
    for i, part in enumerate((1 / 16, 3 / 16, 5 / 16, 7 / 16)):
        assert course[("a", i)][1] == pytest.approx(part * min(whole["a"].demand, whole["a"].max_repeats * whole["a"].supply))
    assert sum(course[("a", i)][0] for i in range(4)) == whole["a"].tokens
    assert set(mix.checked().first()) == {0}
    placed = mix.documents
    late = placed.withColumn("position", F.when(F.col("first_token") == 0, 1.0).otherwise(F.col("position")))
    gap = placed.where(F.col("first_token") != placed.where("first_token > 100").agg(F.min("first_token")).first()[0])
    often = placed.withColumn("repeat", F.col("repeat") + 9)
    other = placed.withColumn("position", F.col("position") / 2)
    for wrong, name in ((late, "unordered"), (gap, "gaps"), (often, "over_repeats"), (other, "off_course")):
        assert mixing.Mix(wrong, mix.report, mix._plan).checked().first()[name] > 0


def test_nothing_to_mix(spark, targets):
    empty = spark.createDataFrame([], DOCUMENTS)
    mix = mixing.mix(empty, targets)
    assert mix.documents.count() == 0 and set(mix.checked().first()) == {0}
    assert {r.source: (r.tokens, r.share, r.short) for r in mix.report.collect()}["a"] == (0, 0.0, False)
    none = mixing.mix(made(spark, {"a": 3}), targets.limit(0))
    assert none.documents.count() == 0 and none.report.count() == 0
    odd = spark.createDataFrame([("a", None, 2), ("a", 0.5, None), ("b", -1.0, -1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.mix(made(spark, {"a": 3, "b": 3}), odd).report.collect()}
    assert report["a"].target_share == 0.5 and report["a"].max_repeats == 2 and report["b"].tokens == 0


def test_repeated_rows(spark, targets):
    documents = made(spark, {"a": 5, "c": 5})
    twice = mixing.mix(documents.union(documents), targets).report.collect()
    assert {r.source: r.supply for r in twice}["c"] == 2 * {r.source: r.supply for r in mixing.mix(documents, targets).report.collect()}["c"]
