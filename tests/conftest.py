from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .appName("trailscope-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    # Tests own their checkpoint folder only because none is configured here.
    if not session.conf.get("spark.checkpoint.dir", None):
        ckpt = tempfile.mkdtemp(prefix="trailscope-ckpt-", dir="/tmp")
        session.sparkContext.setCheckpointDir(ckpt)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def edge(spark):
    from tests.edge_fixture import edge_tables

    return edge_tables(spark)
