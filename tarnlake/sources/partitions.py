"""Pointing a table at new files: the whole table, or any number of its partitions as one set.

A catalog changes one partition at a time, so a set of changes is noted down in the table's folder before the first of
them and the note is removed after the last. Readers meet old and new partitions meanwhile, each of them whole, and
always a table. If the driver is lost in between, the next load of the table carries on from the note, so a set
is never left half done; ``finish_pending`` does the same at any time.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.sources.catalog import (
    NULL_PARTITION,
    add_partitions,
    create_table,
    drop_partitions,
    drop_table,
    identifier,
    list_partitions,
    move_partition,
    table_facts,
    text_literal,
)
from tarnlake.sources.notes import file_system, hadoop_path, read_note, remove_note, write_note

PENDING = "_pending.json"
Values = Mapping[str, str | None]
STATIC_PARTITIONS = 1000
STATEMENTS_AT_ONCE = 8


def spec_of(name: str) -> dict[str, str | None]:
    """The values in a partition's name, ``a=1/b=x``, unescaped."""
    parts = (part.split("=", 1) for part in name.split("/"))
    return {unquote(k): None if v == NULL_PARTITION else unquote(v) for k, v in parts}


def written_partitions(spark: SparkSession, folder: str, levels: int) -> list[tuple[dict[str, str | None], str]]:
    """The partitions that a partitioned write left under ``folder``, with their folders, from a listing of folders."""
    files = file_system(spark, folder)
    names = [""]
    for _ in range(levels):
        inside = []
        for name in names:
            for status in files.listStatus(hadoop_path(spark, f"{folder}/{name}" if name else folder)):
                part = status.getPath().getName()
                if status.isDirectory() and not part.startswith(("_", ".")) and "=" in part:
                    inside.append(f"{name}/{part}" if name else part)
        names = inside
    return [(spec_of(name), f"{folder}/{name}") for name in names]


def change_partitions(
    spark: SparkSession,
    table: str,
    moved: Sequence[tuple[Values, str]],
    dropped: Sequence[Values] = (),
    location: str | None = None,
) -> None:
    """Point partitions at new folders, adding those the table lacks, drop others, then move the table's own location."""
    if moved or dropped or location:
        note = {"moved": [[dict(v), f] for v, f in moved], "dropped": [dict(v) for v in dropped], "location": location}
        write_note(spark, f"{table_facts(spark, table)['Location']}/{PENDING}", note)
        finish_pending(spark, table)


def finish_pending(spark: SparkSession, table: str) -> bool:
    """Carry out what a load has noted down and not finished; whether there was anything."""
    note = f"{table_facts(spark, table)['Location']}/{PENDING}"
    pending = read_note(spark, note)
    if pending is None:
        return False
    there = {_frozen(spec_of(name)) for (name,) in list_partitions(spark, table).collect()}
    known = [(values, folder) for values, folder in pending["moved"] if _frozen(values) in there]
    new = [(values, folder) for values, folder in pending["moved"] if _frozen(values) not in there]
    with ThreadPoolExecutor(STATEMENTS_AT_ONCE) as pool:  # a statement for each partition; they do not touch each other
        for moved in [pool.submit(move_partition, spark, table, *one) for one in known]:
            moved.result()
    add_partitions(spark, table, new)
    drop_partitions(spark, table, pending["dropped"])
    if pending["location"]:
        spark.sql(f"ALTER TABLE {identifier(table)} SET LOCATION {text_literal(pending['location'])}")
    remove_note(spark, note)
    spark.catalog.refreshTable(table)
    return True


def _frozen(values: Values) -> frozenset:
    return frozenset(values.items())


def point_table(
    spark: SparkSession, table: str, schema: T.StructType, path: str, fmt: str, partition_by: Sequence[str] = ()
) -> None:
    """Make ``table`` an external table over the finished files at ``path``.

    An external table that is already declared like this only changes its location, in one catalog change; if it is
    partitioned, partition by partition: present ones move, new ones are added, those without files go last. Only a
    table of another declaration is dropped and declared again.
    """
    found = written_partitions(spark, path, len(partition_by)) if partition_by else []
    dropped: list[Values] = []
    if not _declared(spark, table, schema, fmt, partition_by):
        drop_table(spark, table)
        create_table(spark, table, schema, fmt, partition_by, path, if_not_exists=False)
    elif not partition_by:
        spark.sql(f"ALTER TABLE {identifier(table)} SET LOCATION {text_literal(path)}")
    else:
        finish_pending(spark, table)
        new = {_frozen(values) for values, _ in found}
        present = (spec_of(name) for (name,) in list_partitions(spark, table).collect())
        dropped = [values for values in present if _frozen(values) not in new]
    if partition_by:
        change_partitions(spark, table, found, dropped, path)


def _declared(spark: SparkSession, table: str, schema: T.StructType, fmt: str, partition_by: Sequence[str]) -> bool:
    """Whether ``table`` is an external table of these columns, comments, format and partition columns."""
    if not spark.catalog.tableExists(table):
        return False
    columns = [(c.name, c.dataType, c.description, c.isPartition) for c in spark.catalog.listColumns(table)]
    wanted = [(f.name, f.dataType.simpleString(), f.metadata.get("comment"), f.name in partition_by) for f in schema.fields]
    facts = table_facts(spark, table)
    return columns == wanted and (facts["Type"], facts["Provider"].lower()) == ("EXTERNAL", fmt)


def listed_partitions(spark: SparkSession, schema: T.StructType, keys: Sequence[str], listed: Iterable[Values]) -> DataFrame:
    """Partition values as rows of the key columns' types."""
    texts = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    rows = spark.createDataFrame([tuple(values[k] for k in keys) for values in listed], texts)
    return rows.select(*[F.col(f"`{k}`").cast(schema[k].dataType).alias(k) for k in keys])


def rows_of_partitions(df: DataFrame, wanted: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """The rows of ``df`` in the partitions listed in ``wanted`` (one row per partition).

    One plan for any number of partitions: a join on plain equality, which Spark turns into a pruning of the
    folders while the query runs. Partitions with a NULL in their key are found by a second, null-safe join of
    the rows that have one; if none is wanted, it is left out.
    """
    keys = [by] if isinstance(by, str) else list(by)
    wanted = wanted.select(*[f"`{k}`" for k in keys])
    found = df.join(wanted.dropna(subset=keys), keys, "left_semi")
    any_null: Column = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys])
    null_keys = wanted.filter(any_null)
    if null_keys.isEmpty():
        return found
    other = null_keys.toDF(*[f"_wanted_{i}" for i in range(len(keys))])
    same = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"_wanted_{i}")) for i, k in enumerate(keys)])
    return found.unionByName(df.filter(any_null).join(other, same, "left_semi"))


def in_partitions(df: DataFrame, listed: Sequence[Values], keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` in the listed partitions; up to a thousand are named in the plan and pruned before it runs."""
    if len(listed) > STATIC_PARTITIONS:
        return rows_of_partitions(df, listed_partitions(df.sparkSession, df.schema, keys, listed), keys)
    if len(keys) == 1:
        return df.filter(_is_one_of(df, keys[0], [values[keys[0]] for values in listed]))
    by_first: dict[str | None, list[Values]] = {}
    for values in listed:
        by_first.setdefault(values[keys[0]], []).append(values)
    found: Column = F.lit(False)
    for first, inside in by_first.items():
        rest = [reduce(Column.__and__, [_is_one_of(df, k, [v[k]]) for k in keys[1:]]) for v in inside]
        found |= _is_one_of(df, keys[0], [first]) & reduce(Column.__or__, rest)
    return df.filter(found)


def _is_one_of(df: DataFrame, key: str, texts: Sequence[str | None]) -> Column:
    column, kind = F.col(f"`{key}`"), df.schema[key].dataType
    named = column.isin([F.lit(text).cast(kind) for text in texts if text is not None])
    return column.isNull() | named if None in texts else named
