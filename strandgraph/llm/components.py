"""Connected components of links between whole-number ids, as DataFrame jobs.

Each round every node takes the least label among its neighbours, then the label that its label has by now; rounds end
when nothing changes, after about the logarithm of the longest chain. Joins on hot nodes have an exchange on both sides,
so adaptive execution can split them; minima are taken before the shuffle. Nothing but a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, gather: bool = False) -> DataFrame:
    """(node, component): the least id that each node of links (a, b) reaches. Nodes without links aren't in it. gather: checkpoints
    have files by their size."""
    cut = common.gathered if gather else common.cut
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = cut(both.distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        step = cut(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "low").alias("label"), F.col("label").alias("was")))
        of = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jump = step.join(of, step["label"] == of["at"]).select("node", F.col("further").alias("label"), "was")
        labels = cut(jump)
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
