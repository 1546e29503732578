"""Lines of graph files to edges, with what cannot be loaded set apart.

A line is one record.  Its separators are made one space each outside quotes, and the record is parsed by Python's csv
reader in strict mode, whose exceptions are failures of quoting; then the number of fields is checked, and only then are
the fields turned into numbers.  Lines go through in Arrow batches, partition by partition, without a shuffle; the
headers, one per file, are joined before.

Defined results: a null line, one that begins with '#', and one of separators only are no records and have no row; a
line whose file has no header, or none that says what is needed, fails with 'header'; a node id or weight of any length
is read; the fraction of a weight is cut off, as weights are whole numbers; a file without weights gives weight 1; a
destination that is not made of digits, or is beyond 64 bits, is null; repeated lines are loaded again; other columns
are left out, so their names don't matter; empty tables have no rows.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship

# The format of the lines.
SEPARATORS = " \t\r:"
LARGEST_WEIGHT = 4294967294
REASONS = ("quoting", "column_count", "source", "weight", "header")

_QUOTED_OR_SEPARATORS = re.compile(rf'"[^"]*"|[{SEPARATORS}]+')
_DIGITS = re.compile(r"[0-9]+")
_WEIGHT = re.compile(r"([0-9]+)(?:\.([0-9]+))?")
_LARGEST_LONG = 2**63 - 1
_SCHEMA = "line_id bigint, graph_id int, src bigint, dst bigint, weight bigint, reason string, line string"


def _one_space(match: re.Match) -> str:
    text = match[0]
    return text if text[0] == '"' else " "


def fields_of(line: str) -> list[str] | None:
    """The fields of a record; None if the line is no record. Raises csv.Error if its quoting is broken."""
    if line.startswith("#"):
        return None
    line = _QUOTED_OR_SEPARATORS.sub(_one_space, line).strip(" ")
    if not line:
        return None
    stand_in = ""
    if "\n" in line:  # an ordinary character here, but not for the reader
        stand_in = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in line)
        line = line.replace("\n", stand_in)
    fields = next(csv.reader((line,), delimiter=" ", strict=True))
    if '"' in line:
        for field in fields:
            if '"' in field:
                raise csv.Error("a quote inside a field")
    return [f.replace(stand_in, "\n") for f in fields] if stand_in else fields


def whole_number(text: str, below: int = _LARGEST_LONG + 1) -> int | None:
    """The number if it is made of digits alone and below the bound. Text longer than the bound's is not converted."""
    if not _DIGITS.fullmatch(text):
        return None
    text = text.lstrip("0") or "0"
    if len(text) > 19:
        return None
    number = int(text)
    return number if number < below else None


def weight_of(text: str) -> int | None:
    match = _WEIGHT.fullmatch(text)
    if not match:
        return None
    number = whole_number(match[1], LARGEST_WEIGHT + 1)
    if number == LARGEST_WEIGHT and match[2] and match[2].strip("0"):
        return None
    return number


def parse(line: str, vertex_count: int | None, weighted: bool | None):
    """(src, dst, weight, reason); None if the line is no record."""
    try:
        fields = fields_of(line)
    except csv.Error:
        return None, None, None, "quoting"
    if fields is None:
        return None
    if vertex_count is None or weighted is None:
        return None, None, None, "header"
    if len(fields) != (3 if weighted else 2):
        return None, None, None, "column_count"
    src = whole_number(fields[0], vertex_count)
    if src is None:
        return None, None, None, "source"
    weight = weight_of(fields[2]) if weighted else 1
    if weight is None:
        return None, None, None, "weight"
    return src, whole_number(fields[1]), weight, None


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        rows: list[tuple] = []
        for line_id, graph_id, line, vertex_count, weighted in zip(*(c.to_pylist() for c in batch.columns)):
            record = parse(line, vertex_count, weighted)
            if record is not None:
                rows.append((line_id, graph_id, *record, line if record[3] else None))
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["line_id", "graph_id", "src", "dst", "weight", "reason", "line"])


def load_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per record of lines(line_id, graph_id, line): (line_id, graph_id, src, dst, weight, reason, line).

    reason and line are null for what was loaded; for failed records src, dst and weight are null. headers(graph_id,
    vertex_count, weighted) has one row per file.
    """
    given = lines.select(F.col("line_id").cast("long"), F.col("graph_id").cast("int"), "line").where("line is not null")
    known = headers.where("graph_id is not null").select(F.col("graph_id").cast("int").alias("graph_id"), F.col("vertex_count").cast("long"), "weighted")
    ship(lines.sparkSession)
    joined = given.join(known, "graph_id", "left").select("line_id", "graph_id", "line", "vertex_count", "weighted")
    return joined.mapInArrow(_run, _SCHEMA)


def loaded(records: DataFrame) -> DataFrame:
    return records.where("reason is null").select("line_id", "graph_id", "src", "dst", "weight")


def failed(records: DataFrame) -> DataFrame:
    return records.where("reason is not null").select("line_id", "graph_id", "reason", "line")
