"""The graph: a DataFrame of vertices and one of stored, directed edges."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.iterate import cut

# What stands for "not reached".
UNREACHED_HOPS = 65535
UNREACHED = 4294967295


@dataclass(frozen=True)
class Graph:
    """vertices(id[, value]) and edges(src, dst[, weight]), all BIGINT.

    Isolated vertices are legal, so vertices are not derived from edges. An undirected edge is two rows. Repeated edges
    and self loops are kept. Other columns of the DataFrames are dropped, whatever their names.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    weighted: bool = False
    valued: bool = False

    def __post_init__(self) -> None:
        ids = [F.col("id").cast("long").alias("id")] + [F.col("value").cast("long").alias("value")] * self.valued
        ends = [F.col(c).cast("long").alias(c) for c in ("src", "dst", *["weight"] * self.weighted)]
        object.__setattr__(self, "vertices", self.vertices.select(*ids))
        object.__setattr__(self, "edges", self.edges.select(*ends))

    @classmethod
    def of_edges(cls, edges: DataFrame, directed: bool = True, weighted: bool = False) -> Graph:
        """The graph of the edges' ends. Edges are written once; rows with a null end are no edges."""
        edges = cut(edges.where("src is not null and dst is not null"))
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return cls(cut(ids), edges, directed, weighted)

    @property
    def spark(self):
        return self.edges.sparkSession

    def written(self) -> Graph:
        """The same graph, computed once."""
        return replace(self, vertices=cut(self.vertices), edges=cut(self.edges))

    def with_weights(self) -> DataFrame:
        """Edges with a weight, 1 by default."""
        return self.edges if self.weighted else self.edges.withColumn("weight", F.lit(1).cast("long"))

    def reversed_edges(self) -> DataFrame:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)

    def vertex_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def require(self, *vertices: int) -> None:
        """Raise ValueError unless the graph is not empty and has these vertices."""
        have = {r[0] for r in self.vertices.where(F.col("id").isin(list(vertices))).collect()} if vertices else set()
        missing = [v for v in vertices if v not in have]
        if missing:
            raise ValueError(f"no such vertex: {missing}")
        if not vertices and self.vertices.isEmpty():
            raise ValueError("the graph is empty")
