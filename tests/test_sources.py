"""Readers and writers of graphs."""

import struct

import numpy as np
import pytest

from arcweave.graph import Graph
from arcweave.operators import analyze
from arcweave.sources import binary, store, text
from arcweave.streaming import degrees

from .graphs import build, chain, grid


def rows(df):
    return sorted(map(tuple, df.collect()))


def written(path, content):
    path.write_text(content)
    return str(path)


def test_text_with_lines_that_fail(spark, tmp_path):
    content = "# Nodes: 4\n# Edges: 6\n# Directed\n0 1 5.9\n\n9 1 2\n0:3\n 2\t1 4\r\n\"0 1 2\n1 2 x\n"
    g, bad = text.read_text_apart(spark, written(tmp_path / "bad.graph", content), weighted=True)
    assert g.directed and g.vertex_count() == 4 and rows(g.edges) == [(0, 1, 5), (2, 1, 4)]
    assert [(r.reason, r.line) for r in bad.orderBy("line_id").collect()] == [("source", "9 1 2"), ("column_count", "0:3"), ("quoting", '"0 1 2'), ("weight", "1 2 x")]
    with pytest.raises(ValueError):
        text.read_text_apart(spark, written(tmp_path / "v.graph", "# Nodes: 1 Y\n# Edges: 0\n# Directed\n0 1\n"))


def test_text(spark, tmp_path):
    path = written(tmp_path / "a.graph", "#Nodes: 4 Y \n# edges:3\n#DIRECTED\n0 7\n2 8\n3\n# comment\n0 1 5.9\n\n0:3\n 2\t1 4\r\n")
    g = text.read_text(spark, path, weighted=True)
    assert g.directed and g.valued
    assert rows(g.edges) == [(0, 1, 5), (0, 3, 1), (2, 1, 4)]
    assert rows(g.vertices) == [(0, 7), (1, 0), (2, 8), (3, 0)]
    assert rows(text.read_text(spark, path).edges) == [(0, 1), (0, 3), (2, 1)]
    with pytest.raises(ValueError):
        text.read_text(spark, written(tmp_path / "b.graph", "# Nodes: 2\n# Edges: 2\n# Undirected\n0 1\n"))
    with pytest.raises(ValueError):
        text.read_text(spark, written(tmp_path / "c.graph", "0 1\n"))
    with pytest.raises(ValueError):
        text.read_text(spark, written(tmp_path / "d.graph", "# Nodes: 2\n# Edges: 1\n# Undirected\n5 1\n"))
    nothing = text.read_text(spark, written(tmp_path / "e.graph", "# Nodes: 5\n# Edges: 0\n# Undirected\n"))
    assert (nothing.vertex_count(), nothing.edge_count(), nothing.directed) == (5, 0, False)


def test_text_round_trip(spark, tmp_path):
    g = build(spark, 15, grid(3, 5, lambda a, b: a + b), weighted=True)
    text.write_text(g, str(tmp_path / "g"))
    again = text.read_text(spark, text.concatenated(spark, str(tmp_path / "g")), weighted=True)
    assert rows(again.edges) == rows(g.edges) and again.vertex_count() == 15 and not again.directed


def test_store(spark, tmp_path):
    g = build(spark, 6, [(0, 1, 5), (0, 1, 5), (4, 4, 1)], directed=True, weighted=True)
    store.write_graph(g, str(tmp_path / "s"))
    again = store.load(spark, str(tmp_path / "s"))
    assert rows(again.edges) == rows(g.edges) and rows(again.vertices) == rows(g.vertices)
    assert (again.directed, again.weighted, again.valued) == (True, True, False)


def test_binary(spark, tmp_path):
    edges = [(0, 1, 5), (0, 3, 6), (2, 2, 7), (2, 0, 8), (2, 3, 9), (5, 1, 4)]
    vertices = spark.createDataFrame([(i, 10 * i) for i in range(7)], "id long, value long")
    g = Graph(vertices, spark.createDataFrame(edges, "src long, dst long, weight long"), True, True, True)
    path = str(tmp_path / "g.tbin")
    binary.write_binary(g, path)
    for size in (1, 2, 4, 1 << 20):
        again = binary.read_binary(spark, path, weighted=True, slice_edges=size)
        assert rows(again.edges) == sorted(edges) and rows(again.vertices) == [(i, 10 * i) for i in range(7)]
    assert rows(store.load(spark, path).edges) == sorted((a, b) for a, b, _ in edges)
    bare = struct.pack("<3I", binary.MAGIC, 4, 8) + struct.pack("<I", 2) + struct.pack("<Q", 1) + bytes([0, 0, 0])
    bare += np.array([0, 1, 1], "<u8").tobytes() + np.array([1], "<u4").tobytes()
    (tmp_path / "h.tbin").write_bytes(bare)
    again = binary.read_binary(spark, str(tmp_path / "h.tbin"), weighted=True)
    assert rows(again.edges) == [(0, 1, 1)] and not again.directed
    with pytest.raises(ValueError):
        binary.layout(written(tmp_path / "i.tbin", "no graph, but long enough"))


def test_other_formats(spark, tmp_path):
    listed = text.read_edge_list(spark, written(tmp_path / "l.txt", "# ids\n100\t7\n7 50\n"))
    assert rows(listed.edges) == [(0, 1), (2, 0)] and listed.vertex_count() == 3
    matrix = text.read_sparse_matrix(spark, written(tmp_path / "m.txt", "# size\n1 2 1\n3 1 1\n"))
    assert rows(matrix.edges) == [(1, 2), (3, 1)] and matrix.vertex_count() == 4
    g = build(spark, 3, chain(3))
    text.write_graphml(g, str(tmp_path / "x"))
    import xml.dom.minidom

    parts = sorted((tmp_path / "x").glob("*/part-*"), key=lambda p: (p.parent.name, p.name))
    document = xml.dom.minidom.parseString("".join(p.read_text() for p in parts))
    assert len(document.getElementsByTagName("edge")) == 4 and len(document.getElementsByTagName("node")) == 3
    text.write_degree_distribution(analyze.degree_distribution(g), str(tmp_path / "d"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part-*"))) == "1\t2\n2\t1\n"


def test_stream(spark, tmp_path):
    made = "SELECT * FROM VALUES (1L, 2L, 1L, 1L, TIMESTAMP '2024-01-01 01:00:00'), (1L, 3L, 1L, 2L, TIMESTAMP '2024-01-01 02:00:00'), (1L, 3L, 1L, 2L, TIMESTAMP '2024-01-01 03:00:00'), (NULL, 3L, 1L, 3L, TIMESTAMP '2024-01-01 02:00:00'), (2L, 3L, 1L, 4L, TIMESTAMP '2024-01-09 02:00:00') AS t(src, dst, weight, pos, loaded_at)"
    spark.sql(made).coalesce(1).write.parquet(str(tmp_path / "in"))
    edges = degrees.edge_stream(spark, str(tmp_path / "in"))
    query = degrees.windowed_degrees(edges).writeStream.outputMode("append").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.id, r.degree) for r in spark.sql("SELECT * FROM windowed").collect()] == [(1, 2)]
    query = degrees.running_degrees(edges).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "k")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.id, r.degree) for r in spark.sql("SELECT * FROM running").collect()) == [(1, 3), (2, 1)]
