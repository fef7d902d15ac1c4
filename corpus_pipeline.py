"""A corpus pipeline of five stages over documents: rules, near duplicates, repeated passages, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again for the next. All but
the last return the columns of documents. Empty documents and those with fewer than 20 words go in the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandgraph.llm import minhash, mixing, quality_rules, sentencepieces, substring_dedup
from strandgraph.llm.common import table, with_checkpoints

SHINGLE = 5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, SHINGLE)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).drop("copy")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(docs)


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", passages),
    ("mixing", mixture),
    ("encoding", encoding),
]

#: SQL can express neither the stages on hashed windows nor the encoder; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; what is between them lies in the checkpoint folder."""
    with_checkpoints(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
