"""Loading tables: append, replace, replace partitions, publish.

Partitioned writes are spread with the REBALANCE hint. A partition column alone would send all rows
of one value to one task, and no hint at all would have every task write a small file into every
partition; with the hint adaptive execution splits the large values over several tasks and puts many
small ones into one. Spark drops the hint while adaptive execution is off, so it is switched on for
the write, on a session of its own. The hint costs a shuffle of the rows, which ``clustered=True`` saves where they already
come by partition.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.session import ADAPTIVE, under
from tarnlake.sources.catalog import identifier, partition_columns, table_facts, text_literal
from tarnlake.sources.notes import read_note, write_note
from tarnlake.sources.partitions import change_partitions, finish_pending, point_table, written_partitions

DYNAMIC = {"spark.sql.sources.partitionOverwriteMode": "dynamic"}


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Rows written out in code."""
    return spark.createDataFrame(rows, schema)


def spread(df: DataFrame, partition_by: Sequence[str], clustered: bool = False) -> DataFrame:
    """Spread rows for a partitioned write. ``clustered`` rows, read from a table stored by the same
    columns, are left as they come: they need no shuffle to be written back by them."""
    if clustered or not partition_by:
        return df
    return df.hint("rebalance", *[F.col(f"`{c}`") for c in partition_by])


def append(df: DataFrame, table: str, clustered: bool = False) -> None:
    """Add rows by position, like INSERT INTO. Running it twice adds them twice."""
    spark = df.sparkSession
    rows = df.toDF(*spark.table(table).columns)
    keys = partition_columns(spark, table)
    with under(rows, ADAPTIVE) as own:
        spread(own, keys, clustered).write.insertInto(table)
    spark.catalog.refreshTable(table)


def append_partition(df: DataFrame, table: str, column: str, value: str) -> None:
    """Add rows to one named partition; ``df`` holds the other columns by position. No shuffle."""
    partition = f"`{column}`={text_literal(value)}"
    statement = f"INSERT INTO {identifier(table)} PARTITION ({partition}) SELECT * FROM {{rows}}"
    df.sparkSession.sql(statement, rows=df)


def write_files(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    compression: str = "snappy",
    mode: str = "errorifexists",
    clustered: bool = False,
    **options: str,
) -> None:
    """Write files, in ``column=value`` folders where ``partition_by`` is given."""
    with under(df, ADAPTIVE) as own:
        writer = spread(own, partition_by, clustered).write.format(fmt).mode(mode)
        writer = writer.option("compression", compression).options(**options)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Read files under a declared schema, so a text ``dt`` taken from folder names stays text."""
    return spark.read.schema(schema).format(fmt).load(path)


def replace_table(
    df: DataFrame,
    table: str,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    compression: str = "snappy",
    clustered: bool = False,
) -> str:
    """Make ``df`` the whole content of ``table``; any number of runs gives the same rows.

    Each load writes a folder of its own under ``path`` and the table is pointed at it once the
    write has finished, so a failed load leaves the old rows in place. Returns the new folder;
    folders of earlier loads stay for readers still on them.
    """
    folder = f"{path}/load-{uuid4().hex[:12]}"
    write_files(df, folder, fmt, partition_by, compression, clustered=clustered)
    data = [f for f in df.schema.fields if f.name not in partition_by]
    keys = [df.schema[c] for c in partition_by]
    point_table(df.sparkSession, table, T.StructType(data + keys), folder, fmt, partition_by)
    return folder


def replace_partitions(df: DataFrame, table: str, clustered: bool = False) -> None:
    """Replace the partitions ``df`` has rows for and leave the others; columns match by name.

    The rows go to a load folder of their own inside the table's, hidden from readers of its path; then the partitions
    are pointed at it as one set (``change_partitions``). A failed write changes nothing, and a driver lost
    between two partitions leaves a note from which the next load carries on. Old files stay until
    ``retire_folders``. Readers go through the catalog; for readers of plain folders there is ``publish``.
    """
    spark = df.sparkSession
    keys = partition_columns(spark, table)
    if not keys:
        raise ValueError(f"{table} is not partitioned; use replace_table")
    finish_pending(spark, table)
    facts = table_facts(spark, table)
    folder = f"{facts['Location']}/_load-{uuid4().hex[:12]}"
    codec = re.search(r"compression=(\w+)", facts.get("Storage Properties", ""))
    rows = stored_as(df, table)
    write_files(rows, folder, facts["Provider"].lower(), keys, codec.group(1) if codec else "snappy", clustered=clustered)
    change_partitions(spark, table, written_partitions(spark, folder, len(keys)))


def stored_as(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns and types of ``table``; refused where Spark would refuse to store it."""
    spark = df.sparkSession
    schema = spark.table(table).schema
    rows = df.select(*[f"`{f.name}`" for f in schema.fields])
    if [f.dataType for f in rows.schema.fields] == [f.dataType for f in schema.fields]:
        return rows
    # Storing no rows raises what storing them would.
    spark.sql(f"INSERT INTO {identifier(table)} SELECT * FROM {{none}}", none=rows.limit(0))
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def publish(
    df: DataFrame, path: str, partition_by: Sequence[str], whole: bool = False, clustered: bool = False
) -> None:
    """Write Snappy Parquet in ``column=value`` folders at a fixed path for readers of files.

    Only partitions with rows in ``df`` are replaced, so publishing again changes nothing;
    ``whole=True`` also removes the partitions ``df`` lacks, and empties the folder first: readers that must not see
    that read a ``publish_set``. Partition values are written as text.
    """
    text = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in partition_by})
    write_files(
        text,
        path,
        partition_by=partition_by,
        mode="overwrite",
        clustered=clustered,
        partitionOverwriteMode="static" if whole else "dynamic",
    )


MANIFEST = "_manifest.json"


def publish_set(df: DataFrame, path: str, partition_by: Sequence[str], clustered: bool = False) -> str:
    """Publish ``df`` as the whole set of files at ``path``, for readers that must never meet a part of one.

    Each load is written to a folder of its own under ``path``, in the layout of ``publish``; the manifest, a small
    JSON file whose ``current`` names that folder, is then replaced in one rename. A reader that takes the
    folder from the manifest has one whole load; older loads stay until ``retire_folders``. Returns the folder.
    """
    folder = f"{path}/load-{uuid4().hex[:12]}"
    text = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in partition_by})
    write_files(text, folder, partition_by=partition_by, clustered=clustered)
    write_note(df.sparkSession, f"{path}/{MANIFEST}", {"current": folder.rsplit("/", 1)[1]})
    return folder


def published_set(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The current load of a published set."""
    manifest = read_note(spark, f"{path}/{MANIFEST}")
    if manifest is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return read_files(spark, f"{path}/{manifest['current']}", schema)
