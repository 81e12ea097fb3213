"""One Spark session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import __spark_entry__

    __spark_entry__.ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def make_docs(spark):
    """A ``docs`` frame of (path, text) pairs, with ids from 1 in the given order."""
    from sondage import model
    from sondage.model import language_of
    from pyspark.sql import functions as F

    def make(files, mtime=0):
        rows = [(k, p, len(t.encode()), mtime, 0, 1, t) for k, (p, t) in enumerate(files, 1)]
        df = spark.createDataFrame(rows, "doc_id bigint, path string, size bigint, mtime bigint, flags int, segment_id int, text string")
        return df.withColumn("language", language_of(F.col("path"))).select([c.split()[0] for c in model.DOCS.split(", ")])

    return make
