import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def edges(spark):
    def make(pairs):
        return spark.createDataFrame(list(pairs), "src bigint, dst bigint")

    return make


#: 20 links that have a chain of references, masks with zeros, intervals, single successors, sinks, id gaps and successor 0.
TOY = [(1, 2), (1, 3), (1, 4), (1, 5), (1, 9), (2, 2), (2, 3), (2, 5), (2, 9), (2, 10), (2, 11), (2, 12), (3, 1), (5, 2), (5, 3), (5, 9), (5, 10), (5, 12), (5, 13), (9, 0)]


@pytest.fixture
def toy(edges):
    return edges(TOY)
