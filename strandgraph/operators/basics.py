"""Statistics, renumbering, adjacency lists and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import zigzag, zigzag_inverse
from .ordering import numbered


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: max_id, num_ids (max_id + 1), links, max_degree. No links: max_id null, the others 0."""
    by_source = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.max("dst").alias("top"))
    total = by_source.agg(F.greatest(F.max("src"), F.max("top")).alias("max_id"), F.sum("degree").alias("links"), F.max("degree").alias("max_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return total.select("max_id", zero(F.col("max_id") + 1).alias("num_ids"), zero(F.col("links")).alias("links"), zero(F.col("max_degree")).alias("max_degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return out_degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def used_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def sinks(edges: DataFrame) -> DataFrame:
    """Ids that are used and have no successor."""
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src = dst")


def num_ids(edges: DataFrame) -> int:
    """The greatest id and 1; 0 without links. One pass without a shuffle."""
    top = edges.agg(F.max(F.greatest("src", "dst")).alias("top")).first()["top"]
    return 0 if top is None else top + 1


def universe(edges: DataFrame, ids: int | None = None) -> DataFrame:
    """All ids from 0 to the greatest one. ids: num_ids(edges), if known."""
    return edges.sparkSession.range(num_ids(edges) if ids is None else ids).withColumnRenamed("id", "node")


def has_successors(edges: DataFrame) -> DataFrame:
    """(node, has_succ) for every id up to the greatest one."""
    sources = edges.select(F.col("src").alias("of")).distinct()
    return universe(edges).join(sources, F.col("node") == F.col("of"), "left").select("node", F.col("of").isNotNull().alias("has_succ"))


def renumber_map(edges: DataFrame, start: int = 0) -> DataFrame:
    """(old_id, new_id): the used ids, in their order, without gaps from start on."""
    return numbered(used_ids(edges).withColumnRenamed("node", "old_id"), ["old_id"], "new_id", start).select("old_id", "new_id")


def renumber(edges: DataFrame, start: int = 0) -> DataFrame:
    of = renumber_map(edges, start)
    a = of.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src"))
    b = of.select(F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, succ) for nodes with successors, those ascending."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("succ"))


def adjacency_filled(edges: DataFrame, ids: int | None = None) -> DataFrame:
    """adjacency() with empty lists for all other ids up to the greatest one."""
    lists = adjacency(edges).withColumnRenamed("node", "of")
    empty = F.array().cast("array<bigint>")
    return universe(edges, ids).join(lists, F.col("node") == F.col("of"), "left").select("node", F.coalesce("succ", empty).alias("succ"))


def successors(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("src") == node).select("dst")


def gaps(edges: DataFrame) -> DataFrame:
    """(src, dst, pos, gap): the first gap is the zig-zag of the difference to src, others are dst - previous - 1."""
    order = Window.partitionBy("src").orderBy("dst")
    before = F.lag("dst").over(order)
    gap = F.when(before.isNull(), zigzag(F.col("src"), F.col("dst"))).otherwise(F.col("dst") - before - 1)
    return edges.select("src", "dst", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), gap.alias("gap"))


def from_gaps(rows: DataFrame) -> DataFrame:
    """(src, dst) of (src, pos, gap)."""
    step = F.when(F.col("pos") == 0, zigzag_inverse(F.col("src"), F.col("gap"))).otherwise(F.col("gap") + 1)
    order = Window.partitionBy("src").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("src", F.sum(step).over(order).alias("dst"))


def list_gaps(node: Column, succ: Column) -> Column:
    """The gaps of a list as an array, without leaving the row."""
    return F.transform(succ, lambda x, i: F.when(i == 0, zigzag(node, x)).otherwise(x - F.get(succ, i - 1) - 1))
