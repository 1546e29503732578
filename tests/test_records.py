"""Records that load, and those that fail with their reason."""

import random
import re

import pytest

from arcweave.sources import records


@pytest.mark.parametrize(
    ("line", "weighted", "result"),
    [
        ("1 2 3", True, (1, 2, 3, None)),
        ("\t: 1\r2::3 \r", True, (1, 2, 3, None)),
        ('"1" "2" "3"', True, (1, 2, 3, None)),
        ("1 2", False, (1, 2, 1, None)),
        ("1 2", True, (None, None, None, "column_count")),
        ("1 2 3", False, (None, None, None, "column_count")),
        ("1", False, (None, None, None, "column_count")),
        ('1 "2 3', True, (None, None, None, "quoting")),
        ('"1"x 2', False, (None, None, None, "quoting")),
        ('1"2" 3', False, (None, None, None, "quoting")),
        ('"1""2" 3', False, (None, None, None, "quoting")),
        ('"" 3', False, (None, None, None, "source")),
        ('"1 1" 2', False, (None, None, None, "source")),
        ("100 2", False, (None, None, None, "source")),
        ("-1 2", False, (None, None, None, "source")),
        ("1.0 2", False, (None, None, None, "source")),
        ("٣ 2", False, (None, None, None, "source")),
        ("1\x0b 2", False, (None, None, None, "source")),
        ("1\n 2", False, (None, None, None, "source")),
        ("1 2\n3", False, (1, None, 1, None)),
        ("0000000000000000000000000000007 2", False, (7, 2, 1, None)),
        ("9" * 5000 + " 2", False, (None, None, None, "source")),
        ("1 2 4294967294", True, (1, 2, 4294967294, None)),
        ("1 2 4294967294.0", True, (1, 2, 4294967294, None)),
        ("1 2 4294967294.01", True, (None, None, None, "weight")),
        ("1 2 4294967295", True, (None, None, None, "weight")),
        ("1 2 3.75", True, (1, 2, 3, None)),
        ("1 2 3.", True, (None, None, None, "weight")),
        ("1 2 .5", True, (None, None, None, "weight")),
        ("1 2 -3", True, (None, None, None, "weight")),
        ("1 2 3e1", True, (None, None, None, "weight")),
        ("1 2 " + "3" * 200_000, True, (None, None, None, "weight")),
        ("1 99999999999999999999 3", True, (1, None, 3, None)),
        ("", True, None),
        (" \t:\r", True, None),
        ("# 1 2 3", True, None),
        (" # 2", False, (None, None, None, "source")),
        ('"#" 2', False, (None, None, None, "source")),
    ],
)
def test_parse(line, weighted, result):
    records.csv.field_size_limit(2**31 - 1)
    assert records.parse(line, 100, weighted) == result


def _by_hand(line):
    """Fields by a scan, or None for broken quoting."""
    fields, i, separators = [], 0, " \t\r:"
    while i < len(line):
        if line[i] in separators:
            i += 1
        elif line[i] == '"':
            end = line.find('"', i + 1)
            if end < 0 or (end + 1 < len(line) and line[end + 1] not in separators):
                return None
            fields.append(line[i + 1 : end])
            i = end + 1
        else:
            field = re.match(r"[^ \t\r:]+", line[i:])[0]
            if '"' in field:
                return None
            fields.append(field)
            i += len(field)
    return fields


def test_fields_by_hand():
    draw = random.Random(5)
    for _ in range(20_000):
        line = "".join(draw.choice('"" \t\r:12a\n#') for _ in range(draw.randint(0, 12)))
        if line.startswith("#") or not line.strip(" \t\r:"):
            assert records.fields_of(line) is None
            continue
        try:
            got = records.fields_of(line)
        except records.csv.Error:
            got = None
        assert got == _by_hand(line), line


def test_load(spark):
    headers = spark.createDataFrame([(1, 100, True, 9), (2, 100, False, 9), (3, None, True, 9)], "graph_id int, vertex_count long, weighted boolean, line int")
    rows = [(1, 1, "1 2 3", "x"), (2, 2, "1 2", "x"), (2, 2, "1 2", "x"), (3, 1, "a 2 3", "x"), (4, 3, "1 2 3", "x"), (5, 9, "1 2", "x"), (6, None, "1 2", "x"), (7, 1, None, "x"), (8, 9, "# x", "x")]
    lines = spark.createDataFrame(rows, "line_id long, graph_id int, line string, reason string")
    got = records.load_lines(lines, headers)
    assert sorted((r.line_id, r.src, r.dst, r.weight) for r in records.loaded(got).collect()) == [(1, 1, 2, 3), (2, 1, 2, 1), (2, 1, 2, 1)]
    assert sorted((r.line_id, r.reason) for r in records.failed(got).collect()) == [(3, "source"), (4, "header"), (5, "header"), (6, "header")]
    assert records.load_lines(lines.limit(0), headers).count() == 0
    assert {r.reason for r in records.failed(records.load_lines(lines, headers.limit(0))).collect()} == {"header"}
