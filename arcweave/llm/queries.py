"""The queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut
from . import frequent, mixing, percentiles, splitting, terms, tokens

FIELDS = ("exec", "exec_rate", "alpha")
WANTED = (0.1, 0.5, 0.9, 0.99)
#: Weights over the course of the mix: rising, falling, and highest in the middle; taken in turn by the sources in order of name.
CURRICULUM = ((0.5, 1.5), (1.5, 0.5), (0.5, 1.5, 0.5))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.heavy_tails(_read(spark, sf_dir, "bench_runs"), "config_id", FIELDS)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by day, combined, then answered."""
    runs = _read(spark, sf_dir, "bench_runs")
    days = percentiles.sketches(runs, [F.col("config_id"), F.to_date("started_at").alias("day")], FIELDS)
    return percentiles.percentiles(percentiles.merge(days, ["config_id"]), WANTED)


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many percentiles of p1_percentiles are out of their bound, by counts over all values."""
    return percentiles.misplaced(_read(spark, sf_dir, "bench_runs"), "config_id", cut(p1_percentiles(spark, sf_dir)), WANTED)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.top_values(_read(spark, sf_dir, "edges"), "src", 40).select(F.col("value").alias("src"))


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.top_values(_read(spark, sf_dir, "edges"), "src", 1000)


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _read(spark, sf_dir, "edges")
    return terms.marked(terms.value_counts(edges, ["src", "dst"]), edges.count()).withColumnRenamed("value", "id")


def p5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, and pairs of src and dst: the sequences of up to two terms of a row."""
    return terms.row_counts(_read(spark, sf_dir, "edges"), ["src", "dst"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_counts(spark, sf_dir).where("mark is not null").select("id", "mark")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_ids(spark, sf_dir).where(F.size("ids") == 0).select("doc_id")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).ordered()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report


def p7_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each source in each tenth of the mix's course, and what its integrated weight asks for."""
    return _mix(spark, sf_dir).course()


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the order of the mix, its repeats and its course."""
    return _mix(spark, sf_dir).checked()


def schedules(targets: DataFrame) -> dict[str, tuple[float, ...]]:
    """A schedule of CURRICULUM for each listed source."""
    sources = sorted({r.source for r in targets.select("source").collect() if r.source is not None})  # the rows of the targets
    return {s: CURRICULUM[i % len(CURRICULUM)] for i, s in enumerate(sources)}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_report(spark, sf_dir).where("short").select("source")


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    """The mix with weights that change along its course."""
    targets = _read(spark, sf_dir, "mix_targets")
    return mixing.mix(_read(spark, sf_dir, "documents"), targets, schedules(targets))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the pieces of all documents."""
    return splitting.checked(_read(spark, sf_dir, "documents"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(_read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splitting.pieces(_read(spark, sf_dir, "documents"), with_text=False)
    return found.where("piece = 0 and boundary is not null").select("doc_id", "boundary")


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p1_bounds, p4_found, p4_top, p5_found, p5_counts, p5_sequences, p6_found, p6_ids, p7_found, p7_mix, p7_curriculum, p7_checks, p7_report, p8_found, p8_pieces, p8_checks)}

_P5 = """
    WITH cells AS (SELECT src AS id, pos, 1 AS new FROM edges
                   UNION ALL SELECT dst, pos, CASE WHEN dst = src THEN 0 ELSE 1 END FROM edges),
         counts AS (SELECT id, count(*) AS occurrences, CAST(sum(new) AS BIGINT) AS records FROM cells WHERE id IS NOT NULL GROUP BY id),
         marks AS (SELECT *, CASE WHEN records <= 2 THEN 'rare'
                                  WHEN records * 100 >= 2 * (SELECT count(*) FROM edges) THEN 'common' END AS mark FROM counts)
"""

ORACLE_SQL = {
    "p1_found": """
        WITH v AS (SELECT config_id, unnest([{'field': 'exec', 'v': exec}, {'field': 'exec_rate', 'v': exec_rate},
                          {'field': 'alpha', 'v': CAST(alpha AS DOUBLE)}], recursive := true) FROM bench_runs)
        SELECT config_id, field FROM v WHERE v IS NOT NULL AND isfinite(v) GROUP BY config_id, field
        HAVING count(*) >= 40 AND quantile_cont(v, 0.9) > 4 * quantile_cont(v, 0.5)""",
    "p1_bounds": """
        WITH v AS (SELECT config_id, unnest([{'field': 'exec', 'v': exec}, {'field': 'exec_rate', 'v': exec_rate},
                          {'field': 'alpha', 'v': CAST(alpha AS DOUBLE)}], recursive := true) FROM bench_runs)
        SELECT config_id, field, count(*) FILTER (v IS NOT NULL AND isfinite(v)) AS n, 0::BIGINT AS outside FROM v GROUP BY config_id, field""",
    "p4_found": "SELECT src FROM edges WHERE src IS NOT NULL GROUP BY src ORDER BY count(*) DESC, src LIMIT 40",
    "p4_top": "SELECT src AS value, count(*) AS n FROM edges WHERE src IS NOT NULL GROUP BY src ORDER BY n DESC, value LIMIT 1000",
    "p5_found": _P5 + "SELECT id, mark FROM marks WHERE mark IS NOT NULL",
    "p5_counts": _P5 + "SELECT id, occurrences, records, mark FROM marks",
    "p5_sequences": _P5 + """SELECT id AS t1, NULL::BIGINT AS t2, 1 AS length, occurrences, records FROM counts
        UNION ALL SELECT src, dst, 2, count(*), count(*) FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst""",
    "p6_found": "SELECT doc_id FROM documents WHERE text IS NULL OR text = ''",
    "p7_checks": "SELECT 0::BIGINT AS unordered, 0::BIGINT AS gaps, 0::BIGINT AS over_repeats, 0::BIGINT AS off_course",
    "p8_checks": """
        SELECT count(text) AS documents, 0::BIGINT AS over_limit, 0::BIGINT AS over_limit_alone, 0::BIGINT AS not_joined, 0::BIGINT AS not_whole,
               0::BIGINT AS not_of_text, 0::BIGINT AS wrong_cut, 0::BIGINT AS wrong_boundary FROM documents""",
}
