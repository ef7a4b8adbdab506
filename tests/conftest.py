from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> Iterator[SparkSession]:
    from tarnlake.session import build_session

    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
    }
    session = build_session("tarnlake-tests", "local[8,2]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture(scope="session")
def lake(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    """The sample lake, loaded twice: the second load must change nothing."""
    from tarnlake.sources.samples import load_sample_lake

    folder = str(tmp_path_factory.mktemp("lake"))
    load_sample_lake(spark, folder)
    load_sample_lake(spark, folder)
    return spark


def rows(df: DataFrame) -> list[tuple]:
    """The rows of a small result, in the order they come."""
    return [tuple(r) for r in df.collect()]
