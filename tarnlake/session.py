"""Session settings. Library code works on any session; these are the defaults we run with."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # Adaptive execution only merges shuffle partitions; 16,384 of 256 MB carry a shuffle of 4 TB.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "tarnlake", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the defaults above; ``settings`` (dotted names via ``**{}``) win over them.

    Where a number of shuffle partitions is given, no other initial number is set.
    """
    defaults = dict(DEFAULTS)
    if "spark.sql.shuffle.partitions" in settings:
        del defaults["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_settings(shuffle_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a job that shuffles about ``shuffle_bytes``.

    AQE merges small shuffle partitions but never makes more than it started with, so the starting
    number has to be high enough for the largest shuffle; the advisory size then sets the final one.
    """
    partitions = max(cores, -(-shuffle_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


@contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Set SQL settings for the actions run inside the block, then put the old ones back.

    Settings belong to the session, so this is for a session that nobody else uses meanwhile; the library
    itself writes on sessions of its own (``own_session``).
    """
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def own_session(spark: SparkSession, settings: dict[str, str] | None = None) -> SparkSession:
    """A session of the same application and catalog with the settings of ``spark`` and those given.

    Its settings and its current database are its own, so nothing has to be put back and nobody waits.
    """
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and other.conf.get(key, None) != value and spark.conf.isModifiable(key):
            other.conf.set(key, value)
    for key, value in (settings or {}).items():
        other.conf.set(key, value)
    other.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    return other


@contextmanager
def under(df: DataFrame, settings: dict[str, str]) -> Iterator[DataFrame]:
    """The same rows on a session of their own with ``settings``; the rows themselves where they hold already."""
    spark = df.sparkSession
    if all(spark.conf.get(key, None) == value for key, value in settings.items()):
        yield df
        return
    name = f"rows_{uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        yield own_session(spark, settings).table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


ADAPTIVE = {"spark.sql.adaptive.enabled": "true"}
