"""Reference lists, copy masks, blocks, intervals and residuals as relational operators, without a bound on chains.

Masks follow the ascending order of the reference list here; compress.py has the format with the decoded order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .basics import gaps
from .ordering import numbered


def list_ranks(edges: DataFrame) -> DataFrame:
    """(src, r): the place of each list that isn't empty among those, from 1 on."""
    return numbered(edges.select("src").distinct(), ["src"], "r", 1).select("src", "r")


def window_candidates(edges: DataFrame, ws: int) -> DataFrame:
    """(src, ref_src): the ws lists before each list that aren't empty."""
    ranks = list_ranks(edges)
    a = ranks.select("src", F.explode(F.sequence(F.col("r") - ws, F.col("r") - 1)).alias("ref_r"))
    return a.join(ranks.select(F.col("src").alias("ref_src"), F.col("r").alias("ref_r")), "ref_r").select("src", "ref_src")


def overlap_scores(edges: DataFrame, ws: int) -> DataFrame:
    """(src, ref_src, ref_r, common): successors shared with each of the ws lists before, if any.

    A band join as an equality join: ranks are cut into bands of ws, and a list meets its own band and the one before, so a
    successor that very many lists share makes at most 2 * ws pairs for each of them.
    """
    ranked = edges.join(list_ranks(edges), "src").withColumn("band", F.floor(F.col("r") / ws))
    a = ranked.select("src", "dst", "r", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    b = ranked.select(F.col("src").alias("ref_src"), "dst", F.col("r").alias("ref_r"), "band")
    near = a.join(b, ["dst", "band"]).filter((F.col("ref_r") < F.col("r")) & (F.col("ref_r") >= F.col("r") - ws))
    return near.groupBy("src", "ref_src", "ref_r").agg(F.count(F.lit(1)).alias("common"))


def reference_choice(edges: DataFrame, ws: int) -> DataFrame:
    """(src, ref_src, common): the list before with most shared successors, the oldest of equal ones."""
    best = F.max(F.struct("common", (-F.col("ref_r")).alias("age"), "ref_src"))
    return overlap_scores(edges, ws).groupBy("src").agg(best.alias("best")).select("src", F.col("best.ref_src").alias("ref_src"), F.col("best.common").alias("common"))


def copy_mask(edges: DataFrame, choice: DataFrame) -> DataFrame:
    """(src, ref_src, dst, pos, copied): each element of a chosen reference list in its order, and whether src has it too."""
    order = Window.partitionBy("ref_src").orderBy("dst")
    listed = edges.select(F.col("src").alias("ref_src"), "dst").withColumn("pos", (F.row_number().over(order) - 1).cast("bigint"))
    own = edges.select(F.col("src").alias("own"), F.col("dst").alias("own_dst"))
    mask = choice.select("src", "ref_src").join(listed, "ref_src")
    mask = mask.join(own, (F.col("src") == F.col("own")) & (F.col("dst") == F.col("own_dst")), "left")
    return mask.select("src", "ref_src", "dst", "pos", F.col("own").isNotNull().alias("copied"))


def copy_blocks(mask: DataFrame) -> DataFrame:
    """(src, block, copied, size): runs of the mask from block 0 on; if the first element isn't copied, block 0 is empty and left out."""
    order = Window.partitionBy("src").orderBy("pos")
    was = F.coalesce(F.lag("copied").over(order), F.lit(True))
    runs = mask.withColumn("turn", (F.col("copied") != was).cast("int"))
    runs = runs.withColumn("block", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("src", "block", "copied").agg(F.count(F.lit(1)).alias("size"))


def intervals(edges: DataFrame, th: int) -> DataFrame:
    """(src, low, high, size): maximal runs of th or more successive ids among the successors."""
    if th < 2:
        raise ValueError("intervals have two elements at least")
    island = F.col("dst") - F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    runs = edges.withColumn("island", island).groupBy("src", "island").agg(F.min("dst").alias("low"), F.max("dst").alias("high"), F.count(F.lit(1)).alias("size"))
    return runs.filter(F.col("size") >= th).select("src", "low", "high", "size")


def interval_codes(found: DataFrame, th: int) -> DataFrame:
    """(src, low, left_value, sign, length_value): what is written of each interval; only a list's first has a sign."""
    before = F.lag("high").over(Window.partitionBy("src").orderBy("low"))
    left = F.when(before.isNull(), F.abs(F.col("low") - F.col("src"))).otherwise(F.col("low") - before - 2)
    sign = F.when(before.isNull(), (F.col("low") < F.col("src")).cast("int"))
    return found.select("src", "low", left.alias("left_value"), sign.alias("sign"), (F.col("size") - th).alias("length_value"))


def extras(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """The links that a copy mask doesn't give."""
    return edges.join(mask.filter("copied").select("src", "dst"), ["src", "dst"], "left_anti")


def residuals(edges: DataFrame, mask: DataFrame, th: int) -> DataFrame:
    """(src, dst, pos, gap): links that are neither copied nor in an interval of the rest."""
    rest = extras(edges, mask)
    order = Window.partitionBy("src").orderBy("dst")
    marked = rest.withColumn("island", F.col("dst") - F.row_number().over(order))
    marked = marked.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("src", "island")))
    return gaps(marked.filter(F.col("size") < th).select("src", "dst"))


