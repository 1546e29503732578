"""The command line, in the session of the tests."""

import sys

import pytest

from arcweave import __main__ as command
from arcweave.plans.timing import COLUMNS
from arcweave.sources import store


def run(monkeypatch, *words):
    monkeypatch.setattr(sys, "argv", ["arcweave", *map(str, words)])
    command.main()


def test_create_alter_analyze_run(spark, tmp_path, monkeypatch, capsys):
    run(monkeypatch, "create", "rmat", tmp_path / "g", "-s", 5, "-e", 4)
    assert store.read_graph(spark, str(tmp_path / "g")).edge_count() == 120
    run(monkeypatch, "alter", "undirected", tmp_path / "g", tmp_path / "u")
    assert not store.read_graph(spark, str(tmp_path / "u")).directed
    run(monkeypatch, "alter", "permute", tmp_path / "g", tmp_path / "p.bin", "--format", "binary")
    assert store.load(spark, str(tmp_path / "p.bin")).edge_count() == 120
    capsys.readouterr()
    run(monkeypatch, "analyze", tmp_path / "u", "--degrees", tmp_path / "d")
    said = capsys.readouterr().out
    assert "edge_count\t240" in said and "direction\tundirected" in said and "neighbour_order" not in said
    run(monkeypatch, "analyze", tmp_path / "p.bin")
    assert "neighbour_order\tascending" in capsys.readouterr().out
    run(monkeypatch, "run", "bfs", tmp_path / "u", "--out", tmp_path / "r")
    said = capsys.readouterr().out.splitlines()
    names, figures = (line.split("\t") for line in said[1:3])
    assert tuple(names[1:]) == COLUMNS and len(figures) == 15 and float(figures[names.index("exec")]) > 0
    assert float(figures[names.index("comp")]) + float(figures[names.index("comm")]) == pytest.approx(float(figures[names.index("exec")]), abs=0.02)
    run(monkeypatch, "create", "uniform", tmp_path / "w", "-s", 5, "-e", 4, "--weighted")
    run(monkeypatch, "alter", "sort-nbrs", tmp_path / "w", tmp_path / "down", "--descending")
    assert store.read_graph(spark, str(tmp_path / "down")).weighted
    run(monkeypatch, "run", "sssp", tmp_path / "w", "--partitioner", "dsc", "--fractions", "0.4,0.3,0.3", "--from-end", "0.1", "--randomized")
    said = capsys.readouterr().out
    assert "time_par" in said and said.count("pid:") == 3
    assert spark.read.parquet(str(tmp_path / "r")).count() == 30
