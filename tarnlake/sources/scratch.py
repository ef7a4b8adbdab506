"""Folders for what a job has to write and read again."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="tarnlake-")
    return _local_roots[context.applicationId]


def application_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tarnlake/{spark.sparkContext.applicationId}"


def run_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own for one run of one job. Nothing is created yet."""
    return f"{application_folder(spark)}/{label}-{uuid4().hex[:12]}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a run folder and return it read back, free of its lineage and its sources."""
    spark = df.sparkSession
    folder = run_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system it lives on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_application(spark: SparkSession) -> None:
    """Delete every run folder of this application; DataFrames that read them become unusable."""
    remove_folder(spark, application_folder(spark))
