"""One object for the usual steps: read, renumber, compress, search, rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import basics, compress, traversal
from .sources import edges as sources


@dataclass
class Graph:
    edges: DataFrame

    @classmethod
    def from_edges(cls, df: DataFrame, src: str = "src", dst: str = "dst") -> Graph:
        return cls(sources.edges_from(df, src, dst))

    @classmethod
    def read_text(cls, spark: SparkSession, path: str) -> Graph:
        return cls(sources.read_text(spark, path))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Graph:
        """The links of a compressed table."""
        return cls(compress.open_compressed(spark, path).edges())

    def write_text(self, path: str) -> None:
        sources.write_text(self.edges, path)

    def stats(self) -> DataFrame:
        return basics.stats(self.edges)

    def renumbered(self, start: int = 0) -> Graph:
        return Graph(basics.renumber(self.edges, start))

    def compress(self, **options) -> compress.Compressed:
        return compress.compress(self.edges, **options)

    def bfs(self, start: int, ordered: bool = False) -> DataFrame:
        return traversal.bfs_ordered(self.edges, start) if ordered else traversal.bfs(self.edges, start)

    def pagerank(self, iterations: int = 5, alpha: float = 0.15, compat: bool = False) -> DataFrame:
        return traversal.pagerank(self.edges, iterations, alpha, compat)
