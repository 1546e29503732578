"""Queries on raw records and on keys that hold most rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed
from ..sources import records


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.load_lines(read(spark, sf_dir, "raw_edge_lines"), read(spark, sf_dir, "graph_headers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.failed(p2_records(spark, sf_dir)).select("line_id", "reason")


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.loaded(p2_records(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.heavy_keys(read(spark, sf_dir, "edges"), "src").selectExpr("key AS src")


def p3_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyed.per_key(read(spark, sf_dir, "edges"), "src", "weight").withColumnRenamed("key", "src")
    return found.withColumn("value_sum", F.col("value_sum").cast("string"))  # all digits, however many


QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p3_found, p3_per_key)}

_RECORDS = r"""
    WITH parsed AS (
        SELECT line_id, l.graph_id, weighted, vertex_count,
               NOT regexp_full_match(line, '[ \t\r:]*(("[^"]*"|[^" \t\r:]+)([ \t\r:]+|$))*') AS bad_quotes,
               list_transform(regexp_extract_all(line, '"[^"]*"|[^" \t\r:]+'), lambda f: replace(f, '"', '')) AS f
        FROM raw_edge_lines l JOIN graph_headers USING (graph_id)
        WHERE NOT starts_with(line, '#') AND NOT regexp_full_match(line, '[ \t\r:]*')),
    judged AS (
        SELECT *, CASE
            WHEN bad_quotes THEN 'quoting'
            WHEN len(f) <> CASE WHEN weighted THEN 3 ELSE 2 END THEN 'column_count'
            WHEN NOT regexp_full_match(f[1], '[0-9]+') OR length(ltrim(f[1], '0')) > 18
                 OR TRY_CAST(f[1] AS HUGEINT) >= vertex_count THEN 'source'
            WHEN weighted AND (NOT regexp_full_match(f[3], '[0-9]+(\.[0-9]+)?') OR CAST(f[3] AS DOUBLE) > 4294967294) THEN 'weight'
            END AS reason FROM parsed)
"""

ORACLE_SQL = {
    "p2_found": _RECORDS + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_loaded": _RECORDS + """
        SELECT line_id, graph_id, CAST(f[1] AS BIGINT) AS src, TRY_CAST(f[2] AS BIGINT) AS dst,
               CASE WHEN weighted THEN CAST(floor(CAST(f[3] AS DOUBLE)) AS BIGINT) ELSE 1 END AS weight
        FROM judged WHERE reason IS NULL""",
    "p3_found": """
        SELECT src FROM edges WHERE src IS NOT NULL GROUP BY src HAVING count(*) * 100 >= (SELECT count(*) FROM edges)""",
    "p3_per_key": """
        SELECT src, count(*) AS n_rows, count(weight) AS n_values, CAST(sum(weight) AS VARCHAR) AS value_sum,
               min(weight) AS value_min, max(weight) AS value_max
        FROM edges WHERE src IS NOT NULL GROUP BY src""",
}
