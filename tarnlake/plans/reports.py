"""The lake's reports as functions of a table, so they run on any table with the same shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.counts import row_count
from tarnlake.functions.money import money_avg, money_sum
from tarnlake.sources import catalog
from tarnlake.sources.scratch import settle
from tarnlake.sources.tables import append


def headcount_and_mean(df: DataFrame, group: str, amount: str, mean_name: str) -> DataFrame:
    """Rows and mean amount per group, highest rounded mean first; the group breaks ties."""
    return (
        df.groupBy(group)
        .agg(row_count().alias("headcount"), F.round(money_avg(amount), 2).alias(mean_name))
        .orderBy(F.desc(mean_name), group)
    )


def first_days_stored(spark: SparkSession, table: str, day: str, amount: str, days: int = 10) -> DataFrame:
    """``first_days`` of a catalog table partitioned by the text column ``day`` alone.

    The first days come from the catalog's list of partitions, so no file is opened to find them, and only their
    folders are read. Partitions without rows are passed over: as long as too few of the listed ones hold rows
    (which the footers of those few tell), twice as many are taken.
    """
    listed = sorted(catalog.partition_values(spark, table, day), key=lambda value: (value is not None, value))
    taken = days
    while True:
        stored = spark.table(table).filter(_is_one_of(day, listed[:taken]))
        if taken >= len(listed) or stored.select(day).distinct().count() >= days:
            return first_days(stored, day, amount, days)
        taken *= 2


def _is_one_of(column: str, values: Sequence[str | None]) -> Column:
    named = F.col(column).isin([value for value in values if value is not None])
    return F.col(column).isNull() | named if None in values else named


def first_days(df: DataFrame, day: str, amount: str, days: int = 10) -> DataFrame:
    """Orders and gross merchandise value of the first days."""
    return (
        df.groupBy(day)
        .agg(row_count().alias("orders"), F.round(money_sum(amount), 2).alias("gmv"))
        .orderBy(day)
        .limit(days)
    )


def total_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(row_count().alias(name))


def smoke_round_trip(rows: DataFrame, label: str = "smoke") -> DataFrame:
    """Create a database and table, insert, select all, drop both; returns what was selected."""
    spark = rows.sparkSession
    with catalog.temporary_database(spark, label) as (database, _):
        table = f"{database}.t1"
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        catalog.create_table(spark, table, schema, fmt=None)
        append(rows, table)
        selected = settle(spark.table(table).select("*"), label)
        catalog.drop_table(spark, table, if_exists=False)
    return selected


def partition_listing(spark: SparkSession, table: str) -> DataFrame:
    return catalog.list_partitions(spark, table)


def catalog_listing(spark: SparkSession, database: str) -> DataFrame:
    """The tables of one database, next to the database they are listed under."""
    databases = catalog.list_databases(spark).filter(F.col("namespace") == database)
    tables = catalog.list_tables(spark, database).filter(~F.col("isTemporary"))
    return databases.join(tables, "namespace").select("namespace", "tableName")
