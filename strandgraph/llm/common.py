"""Shared helpers: table access, checkpoints, distinct column names, bounded memo tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Hashable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
#: A word, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a file of a gathered table, about.
FILE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Make checkpoint() usable: the folder is the session's spark.checkpoint.dir; a local one only where that is unset and Spark
    runs in one process, as executors elsewhere couldn't read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a reliable checkpoint that every executor can read again."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """cut(df) in files by its size, as hundreds of partitions may hold little and Hadoop's local file system starts processes for
    each file. All partitions are made as they are and kept on the executors' disks; only then are they put together."""
    held = df.select("*").persist(StorageLevel.DISK_ONLY)
    try:
        held.count()
        size = held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # as measured, now that it's kept
        return cut(held.coalesce(max(1, -(-size // FILE_BYTES))))
    finally:
        held.unpersist()


def anew(key: Column) -> Column:
    """A whole-number key with its bits flipped. A join on it deals out both sides, also one that is summed up by the key, as only
    then adaptive execution can split the rows of a hot key; a checkpoint of the sums would do so too, at a file a partition."""
    return F.bitwise_not(key)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores before it until it clashes (in any case) with no column of df."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


_resident: dict[Hashable, Any] = {}


def resident(name: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: the tables of one operator at a time, made anew when another one's come."""
    if name not in _resident:
        _resident.clear()
        _resident[name] = make()
    return _resident[name]


def release() -> None:
    """For tasks that need memory and none of those tables."""
    _resident.clear()


class Memo:
    """A function's results by key, at most 2 * size of them: the older half goes when the younger half is full."""

    def __init__(self, function: Callable[[Any], Any], size: int):
        self.function, self.size, self.young, self.old = function, size, {}, {}

    def __call__(self, key: Hashable) -> Any:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.function(key)
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value
