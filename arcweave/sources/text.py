"""Graphs as text: three header lines, optional vertex lines, edge lines.

    # Nodes: 15 [Y]
    # Edges: 44
    # Directed | # Undirected
    id value          (only with Y: ascending ids, the last vertex always there)
    src dst [weight]

Separators are space, tab, carriage return and colon.  The header, and with Y the number of the last vertex line, decide
how a line is read; edges are parsed where they lie, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from . import records

_HEADER = re.compile(r"^#[ \t\r:]*(nodes|edges|directed|undirected)[ \t\r:]*(\d*)[ \t\r:]*([yY]?)", re.IGNORECASE)


def header(spark: SparkSession, path: str) -> dict:
    """vertex_count, edge_count, directed and valued, from the first lines."""
    out: dict = {"valued": False}
    for (line,) in spark.read.text(path).limit(3).collect():
        match = _HEADER.match(line)
        if not match:
            raise ValueError(f"no header line: {line[:80]!r}")
        word = match[1].lower()
        if word == "nodes":
            out |= {"vertex_count": int(match[2]), "valued": bool(match[3])}
        elif word == "edges":
            out["edge_count"] = int(match[2])
        else:
            out["directed"] = word == "directed"
    if len(out) < 4:
        raise ValueError("the header is incomplete")
    return out


def read_text(spark: SparkSession, path: str, weighted: bool = False, check: bool = True) -> Graph:
    """The graph of a file. Weights are read if asked for, else left out; a fraction is cut off, a missing weight is 1.

    check: raise ValueError when the number of edges differs from the header's, or a source is no vertex.
    """
    head = header(spark, path)
    fields = F.split(F.regexp_replace("value", r"^[ \t\r:]+|[ \t\r:]+$", ""), r"[ \t\r:]+")
    rows = spark.read.text(path).where("value not like '#%'").select(fields.alias("f"), F.monotonically_increasing_id().alias("_at")).where("f[0] <> ''")
    n = head["vertex_count"]
    values = None
    if head["valued"]:
        # Vertex lines end with the line of the last vertex, the first line to begin with its id.
        last = rows.where(F.col("f")[0].cast("long") == n - 1).agg(F.min("_at")).first()[0]
        values = rows.where(F.col("_at") <= last).select(F.col("f")[0].cast("long").alias("id"), F.coalesce(F.try_element_at("f", F.lit(2)).cast("long"), F.lit(0)).alias("value"))
        rows = rows.where(F.col("_at") > last)
    columns = [F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst")]
    if weighted:
        columns.append(F.coalesce(F.floor(F.try_element_at("f", F.lit(3)).cast("double")).cast("long"), F.lit(1)).alias("weight"))
    edges = rows.select(*columns)
    vertices = spark.range(n).select("id")
    if values is not None:
        vertices = vertices.join(values, "id", "left").select("id", F.coalesce("value", F.lit(0)).alias("value"))
    if check:
        found, bad = edges.agg(F.count(F.lit(1)), F.count(F.when((F.col("src") < 0) | (F.col("src") >= n), 1))).first()
        if found != head["edge_count"] or bad:
            raise ValueError(f"{found} edges, {head['edge_count']} in the header, {bad} of them without a vertex")
    return Graph(vertices, edges, head["directed"], weighted, head["valued"])


def read_text_apart(spark: SparkSession, path: str, weighted: bool = False) -> tuple[Graph, DataFrame]:
    """The graph of the lines that can be loaded, and (line_id, reason, line) of those that cannot, as in records.load_lines();
    line_id rises with the place in the file. For files without vertex lines; with weighted, every edge line has a weight."""
    head = header(spark, path)
    if head["valued"]:
        raise ValueError("the file has vertex lines")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.lit(0).alias("graph_id"), F.col("value").alias("line"))
    headers = spark.range(1).select(F.lit(0).alias("graph_id"), F.lit(head["vertex_count"]).alias("vertex_count"), F.lit(weighted).alias("weighted"))
    found = records.load_lines(lines, headers)
    edges = records.loaded(found).select("src", "dst", *["weight"] * weighted)
    return Graph(spark.range(head["vertex_count"]).select("id"), edges, head["directed"], weighted), records.failed(found).select("line_id", "reason", "line")


def write_text(graph: Graph, path: str) -> None:
    """A directory with a header file, vertex lines and edge lines, whose names sort in the order of the format.

    Ids are expected to be dense. Edges are sorted by source.
    """
    n, m = graph.vertex_count(), graph.edge_count()
    spark = graph.spark
    lines = [f"# Nodes: {n}" + (" Y" if graph.valued else ""), f"# Edges: {m}", "# Directed" if graph.directed else "# Undirected"]
    head = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in lines))).alias("line"))
    head.coalesce(1).write.text(f"{path}/0-header")
    if graph.valued:
        graph.vertices.orderBy("id").select(F.concat_ws(" ", "id", F.coalesce("value", F.lit(0))).alias("line")).write.text(f"{path}/1-vertices")
    graph.edges.orderBy("src", "dst").select(F.concat_ws(" ", *graph.edges.columns).alias("line")).write.text(f"{path}/2-edges")


def concatenated(spark: SparkSession, path: str) -> str:
    """One file of a small written graph, for tools that want one. Returns its path; the parts stay."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    root = hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = hadoop.fs.Path(f"{path}.graph" if not path.endswith("/") else f"{path[:-1]}.graph")
    out = fs.create(target, True)
    for part in ("0-header", "1-vertices", "2-edges"):
        folder = hadoop.fs.Path(f"{path}/{part}")
        if fs.exists(folder):
            for name in sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
                source = fs.open(hadoop.fs.Path(name))
                hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                source.close()
    out.close()
    return target.toString()


def read_edge_list(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    """Any ids, comment lines from '#', separators as above: ids are replaced by dense ones in order."""
    from ..functions.ordering import with_running
    from ..operators.transform import renumbered
    from ..plans.iterate import cut

    fields = F.split(F.trim(F.regexp_replace("value", r"[ \t\r:]+", " ")), " ")
    rows = cut(spark.read.text(path).where("value not like '#%' and trim(value) <> ''").select(fields[0].cast("long").alias("src"), fields[1].cast("long").alias("dst")))
    graph = Graph.of_edges(rows, directed)
    return renumbered(graph, cut(with_running(graph.vertices, ["id"], index="new")))


def read_sparse_matrix(spark: SparkSession, path: str) -> Graph:
    """Rows of 'i j value' from 1 on, '#' or '%' comments: an edge i -> j for each, the value dropped, and a vertex 0."""
    fields = F.split(F.trim(F.regexp_replace("value", r"[ \t\r:]+", " ")), " ")
    rows = spark.read.text(path).where("value not like '#%' and value not like '\\%%' and trim(value) <> ''")
    edges = rows.select(fields[0].cast("long").alias("src"), fields[1].cast("long").alias("dst"))
    most = edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0
    return Graph(spark.range(most + 1).select("id"), edges)


def write_graphml(graph: Graph, path: str, name: str = "G") -> None:
    """A directory of text parts that, in order of name, are one GraphML document."""
    kind = "directed" if graph.directed else "undirected"
    spark = graph.spark
    top = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + f'<graph id="{name}" edgedefault="{kind}">'
    spark.range(1).select(F.lit(top).alias("line")).coalesce(1).write.text(f"{path}/0-top")
    graph.vertices.orderBy("id").select(F.format_string('<node id="n%d"/>', "id").alias("line")).write.text(f"{path}/1-nodes")
    graph.edges.orderBy("src", "dst").select(F.format_string('<edge source="n%d" target="n%d"/>', "src", "dst").alias("line")).write.text(f"{path}/2-edges")
    spark.range(1).select(F.lit("</graph>\n</graphml>").alias("line")).coalesce(1).write.text(f"{path}/3-end")


def write_degree_distribution(distribution: DataFrame, path: str) -> None:
    """degree, tab, vertex_count; rows with vertices only, by degree."""
    distribution.where("vertex_count > 0").orderBy("degree").select(F.concat_ws("\t", "degree", "vertex_count").alias("line")).write.text(path)
