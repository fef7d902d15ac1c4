"""Global ranks and running sums without a window in one task: order by range, then add what the partitions before hold."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the session's spark.checkpoint.dir; a local folder only where that is unset and Spark runs in
    one process, as executors elsewhere couldn't read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from the checkpoint folder from now on."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before this one in the order. Rows must not tie in it."""
    parted = df.withColumn("part_value", value.cast("bigint")).repartitionByRange(*order).withColumn("part_id", F.spark_partition_id())
    parted = cut(parted)
    totals = parted.groupBy("part_id").agg(F.sum("part_value").alias("part_sum"))
    # one row a partition, so a single task is enough for these
    before = Window.orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("part_id").alias("start_id"), F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("part_start"))
    own = Window.partitionBy("part_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parted.join(F.broadcast(starts), F.col("part_id") == F.col("start_id"))
    return joined.withColumn(name, F.col("part_start") + F.coalesce(F.sum("part_value").over(own), F.lit(0))).drop("part_value", "part_id", "start_id", "part_start")


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with the place of each row in the order, from start on."""
    return running_sum(df, order, F.lit(1), name).withColumn(name, F.col(name) + start)
