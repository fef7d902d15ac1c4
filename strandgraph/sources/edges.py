"""Edge lists: tables (src, dst) of whole numbers from 0 on, a set of directed links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edges_from(df: DataFrame, src: str, dst: str) -> DataFrame:
    """The distinct links of two columns; rows with a null or negative id are no links."""
    pair = df.select(df[src].cast("bigint").alias("src"), df[dst].cast("bigint").alias("dst"))
    return pair.filter("src >= 0 AND dst >= 0").distinct()


def read_text(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Links of a text file, two numbers a line with any white space between them; lines with the comment mark are skipped.

    A line without two numbers raises an error when it is read.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("bigint")
    rows = lines.select(number(0).alias("src"), number(1).alias("dst"), "value")
    wrong = F.col("src").isNull() | F.col("dst").isNull()
    told = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("bigint")
    return edges_from(rows.select(F.when(wrong, told).otherwise(F.col("src")).alias("src"), "dst"), "src", "dst")


def write_text(edges: DataFrame, path: str) -> None:
    """Sorted by (src, dst) over all files, one space between the numbers."""
    edges.orderBy("src", "dst").select(F.concat_ws(" ", "src", "dst")).write.mode("errorifexists").text(path)


def read_ordered(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(file, block, line, src, dst): the lines of text files as they come, with what gives their order; nothing is made distinct."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    parts = F.split("value", r"\s+")
    kept = lines.filter(~F.col("value").startswith(comment) & (F.col("value") != ""))
    return kept.select("file", "block", "line", F.get(parts, F.lit(0)).cast("bigint").alias("src"), F.get(parts, F.lit(1)).cast("bigint").alias("dst"))


def out_of_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows (src, dst) that don't come after the row before them, by (src, dst), where columns order give the rows' order;
    only equal rows may tie in it."""
    from ..operators.ordering import numbered

    placed = numbered(rows.select(*dict.fromkeys([*order, "src", "dst"])), order, "place")
    before = placed.select((F.col("place") + 1).alias("place"), F.struct("src", "dst").alias("before"))
    return placed.join(before, "place").filter(F.col("before") >= F.struct("src", "dst")).select("place", "src", "dst")


def unsorted(rows: DataFrame, place: str) -> DataFrame:
    """The rows (src, dst) that don't come after the one before them of the same source, in the order of column place."""
    from pyspark.sql import Window

    before = F.lag("dst").over(Window.partitionBy("src").orderBy(place))
    return rows.withColumn("before", before).filter("before >= dst")
