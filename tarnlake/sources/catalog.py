"""Databases and tables in the session catalog."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnlake.session import own_session
from tarnlake.sources.scratch import run_folder


def text_literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def identifier(table: str) -> str:
    return ".".join(f"`{part}`" for part in table.split("."))


def create_database(
    spark: SparkSession, name: str, comment: str | None = None, location: str | None = None
) -> None:
    """Create a database unless it is there."""
    statement = f"CREATE DATABASE IF NOT EXISTS {identifier(name)}"
    if comment is not None:
        statement += f" COMMENT {text_literal(comment)}"
    if location is not None:
        statement += f" LOCATION {text_literal(location)}"
    spark.sql(statement)


def drop_database(spark: SparkSession, name: str) -> None:
    """Drop an empty database; Spark refuses one that still holds tables."""
    spark.sql(f"DROP DATABASE {identifier(name)}")


def using_database(spark: SparkSession, name: str) -> SparkSession:
    """A session of its own in which unqualified names are resolved in ``name``; ``spark`` stays where it is."""
    other = own_session(spark)
    other.catalog.setCurrentDatabase(name)
    return other


@contextmanager
def temporary_database(spark: SparkSession, label: str, comment: str | None = None) -> Iterator[tuple[str, str]]:
    """A database in the scratch folder, dropped with its tables and their files after the block.

    Yields its name and a folder of its own for external files, which outlive it. Results read from
    its managed tables are settled inside the block.
    """
    name = f"tarnlake_{label}_{uuid4().hex[:12]}"
    create_database(spark, name, comment, run_folder(spark, f"{label}-database"))
    try:
        yield name, run_folder(spark, label)
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {identifier(name)} CASCADE")


def create_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    fmt: str | None = "parquet",
    partition_by: Sequence[str] = (),
    path: str | None = None,
    compression: str | None = None,
    if_not_exists: bool = True,
) -> None:
    """Declare a table with its column types and comments.

    ``fmt=None`` leaves the format to the session. ``path`` makes the table external: dropping it
    keeps its files. ``compression`` is the codec new files are written with.
    """
    lines = []
    for field in schema.fields:
        line = f"`{field.name}` {field.dataType.simpleString()}"
        if field.metadata.get("comment"):
            line += f" COMMENT {text_literal(field.metadata['comment'])}"
        lines.append(line)
    statement = f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{identifier(table)} ({', '.join(lines)})"
    if fmt is not None:
        statement += f" USING {fmt}"
    if compression is not None:
        statement += f" OPTIONS ('compression'={text_literal(compression)})"
    if partition_by:
        statement += f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})"
    if path is not None:
        statement += f" LOCATION {text_literal(path)}"
    spark.sql(statement)


def drop_table(spark: SparkSession, table: str, if_exists: bool = True) -> None:
    spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{identifier(table)}")


def find_partitions(spark: SparkSession, table: str) -> None:
    """Register the partition folders found under the table's location."""
    spark.sql(f"ALTER TABLE {identifier(table)} RECOVER PARTITIONS")


def partition_spec(values: Mapping[str, str | None]) -> str:
    """The PARTITION clause of one partition; Spark casts the texts to the columns' types."""
    return ", ".join(f"`{c}`={'NULL' if v is None else text_literal(v)}" for c, v in values.items())


def move_partition(spark: SparkSession, table: str, values: Mapping[str, str | None], folder: str) -> None:
    """Point one partition at another folder: one catalog change, the old files stay."""
    spec = partition_spec(values)
    spark.sql(f"ALTER TABLE {identifier(table)} PARTITION ({spec}) SET LOCATION {text_literal(folder)}")


def drop_partitions(spark: SparkSession, table: str, listed: Sequence[Mapping[str, str | None]]) -> None:
    """Drop partitions, a thousand in a statement; an external table's files stay."""
    for at in range(0, len(listed), 1000):
        specs = ", ".join(f"PARTITION ({partition_spec(values)})" for values in listed[at : at + 1000])
        spark.sql(f"ALTER TABLE {identifier(table)} DROP IF EXISTS {specs}")


def _named(spark: SparkSession, table: str):
    """The session's catalog object and the table's name in it, for what no statement gives in one go."""
    state = spark._jsparkSession.sessionState()
    return state.catalog(), state.sqlParser().parseTableIdentifier(identifier(table))


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    catalog, name = _named(spark, table)
    names = catalog.getTableMetadata(name).partitionColumnNames().mkString("\0")
    return names.split("\0") if names else []


def add_partitions(spark: SparkSession, table: str, listed: Sequence[tuple[Mapping[str, str | None], str]]) -> None:
    """Add partitions over existing folders, a thousand in a statement; those already there stay as they are."""
    for at in range(0, len(listed), 1000):
        parts = [f"PARTITION ({partition_spec(v)}) LOCATION {text_literal(f)}" for v, f in listed[at : at + 1000]]
        spark.sql(f"ALTER TABLE {identifier(table)} ADD IF NOT EXISTS {' '.join(parts)}")


def partition_folders(spark: SparkSession, table: str) -> list[tuple[dict[str, str | None], str]]:
    """The values and the folder of every partition, from the catalog alone.

    No statement lists the folders of all partitions, so the session's catalog object is asked.
    """
    catalog, name = _named(spark, table)
    keys, found = partition_columns(spark, table), []
    listed = catalog.listPartitions(name, spark._jvm.scala.Option.empty()).iterator()
    path = spark._jvm.org.apache.hadoop.fs.Path
    while listed.hasNext():
        part = listed.next()
        spec = part.spec()
        values = {k: spec.apply(k) for k in keys}
        folder = path(part.location()).toString()
        found.append(({k: None if v == NULL_PARTITION else v for k, v in values.items()}, folder))
    return found


def list_databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {identifier(database)}")


def list_partitions(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {identifier(table)}")


NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of NULL


def partition_values(spark: SparkSession, table: str, column: str) -> list[str | None]:
    """The values of a partition column, from the catalog alone."""
    found = set()
    for (spec,) in list_partitions(spark, table).collect():
        named = dict(part.split("=", 1) for part in spec.split("/"))
        value = unquote(named[column])
        found.add(None if value == NULL_PARTITION else value)
    return list(found)


def table_facts(spark: SparkSession, table: str) -> dict[str, str]:
    """The catalog's facts about a table: Type, Provider, Location and so on."""
    facts: dict[str, str] = {}
    detailed = False
    for name, value, _ in spark.sql(f"DESCRIBE FORMATTED {identifier(table)}").collect():
        detailed = detailed or name == "# Detailed Table Information"
        if detailed and name:
            facts[name] = value
    return facts
