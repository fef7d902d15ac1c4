"""Breadth-first search and PageRank as loops of DataFrame jobs over links kept partitioned by their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import basics
from .ordering import cut, numbered


def _in_range(links: DataFrame, starts: list[int]) -> None:
    top = links.agg(F.max(F.greatest("src", "dst")).alias("top")).first()["top"]
    if wrong := [s for s in starts if top is None or not 0 <= s <= top]:
        raise ValueError(f"starts must be between 0 and {top}, not {wrong[0]}")


def bfs(edges: DataFrame, start: int | list[int], max_levels: int | None = None) -> DataFrame:
    """(node, level): the fewest links from a start; starts are in it themselves, with level 0."""
    spark = edges.sparkSession
    starts = sorted({start} if isinstance(start, int) else set(start))
    links = edges.select("src", "dst").repartition("src").persist()
    try:
        _in_range(links, starts)
        seen = cut(spark.createDataFrame([(s, 0) for s in starts], "node bigint, level int"))
        front, level = seen.select("node"), 0
        while max_levels is None or level < max_levels:
            level += 1
            new = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
            new = cut(new.join(seen.select("node"), "node", "left_anti"))
            if new.isEmpty():
                break
            seen = seen.union(new.withColumn("level", F.lit(level)))
            if level % 8 == 0:
                seen = cut(seen)
            front = new
        return cut(seen)
    finally:
        links.unpersist()


def bfs_ordered(edges: DataFrame, start: int) -> DataFrame:
    """(node, level, visit_pos): first in, first out, neighbours in ascending order."""
    spark = edges.sparkSession
    links = edges.select("src", "dst").repartition("src").persist()
    try:
        _in_range(links, [start])
        seen = cut(spark.createDataFrame([(start, 0, 0)], "node bigint, level int, visit_pos bigint"))
        front, level, done = seen, 0, 1
        while True:
            level += 1
            met = front.join(links, front["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("visit_pos").alias("parent"))
            new = cut(met.join(seen.select("node"), "node", "left_anti"))
            n = new.count()
            if not n:
                break
            front = cut(numbered(new, ["parent", "node"], "visit_pos", done).select("node", F.lit(level).alias("level"), "visit_pos"))
            done += n
            seen = seen.union(front)
            if level % 8 == 0:
                seen = cut(seen)
        return cut(seen)
    finally:
        links.unpersist()


def pagerank(edges: DataFrame, iterations: int = 5, alpha: float = 0.15, compat: bool = False) -> DataFrame:
    """(node, rank) for all ids up to the greatest. alpha is the share of random jumps.

    What is missing to a sum of 1 is dealt out evenly after each round, which is what nodes without successors hold back.
    compat: ranks start at 0, a link has weight 1 if it is its source's only one and else 0, and nodes without successors get
    nothing but the dealt share.
    """
    if not 0 <= alpha <= 1 or iterations < 0:
        raise ValueError("alpha is between 0 and 1, iterations 0 or more")
    own = edges.select("src", "dst").repartition("src").persist()  # statistics, degrees and links without another shuffle
    nodes = links = None
    try:
        n = basics.num_ids(own)
        if not n:
            return edges.sparkSession.createDataFrame([], "node bigint, rank double")
        degree = basics.out_degrees(own).withColumnRenamed("src", "of")
        weight: Column = F.when(F.col("degree") == 1, 1.0).otherwise(0.0) if compat else 1.0 / F.col("degree")
        links = own.join(degree, F.col("src") == F.col("of")).select("src", "dst", weight.alias("weight")).filter("weight > 0").persist()
        nodes = edges.sparkSession.range(n).withColumnRenamed("id", "node")
        if compat:
            nodes = nodes.join(degree, F.col("node") == F.col("of"), "left").select("node", F.col("of").isNotNull().alias("has_succ"))
        nodes = nodes.persist()
        ranks = nodes.select("node", F.lit(0.0 if compat else 1.0 / n).alias("rank"))
        share = 0.0
        for _ in range(iterations):
            ranks = ranks.withColumn("rank", F.col("rank") + F.lit(share))
            come = ranks.join(links, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("weight")).alias("come"))
            new = F.lit(alpha / n) + F.lit(1 - alpha) * F.coalesce("come", F.lit(0.0))
            if compat:
                rows = nodes.join(ranks, "node").join(come, F.col("node") == F.col("dst"), "left")
                rows = rows.select("node", F.when(F.col("has_succ"), new).otherwise(F.col("rank")).alias("rank"))
            else:
                rows = nodes.join(come, F.col("node") == F.col("dst"), "left").select("node", new.alias("rank"))
            ranks = cut(rows)
            share = (1.0 - ranks.agg(F.sum("rank")).first()[0]) / n
        if not iterations:
            ranks = cut(ranks)
        return ranks.withColumn("rank", F.col("rank") + F.lit(share))
    finally:
        for df in (links, nodes, own):
            if df is not None:
                df.unpersist()


def top_rank(ranks: DataFrame, k: int = 1) -> DataFrame:
    """The k nodes of highest rank, the smallest ids of equal ones."""
    return ranks.orderBy(F.desc("rank"), "node").limit(k)
