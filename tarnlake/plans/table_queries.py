"""Catalog statements and loads, run on the given tables and checked by reading them back.

Each query works in a database and folder of its own, so it can run any number of times at once.
Databases are dropped again; tables that a result is read from are external, so their files stay
until the application's scratch folder is cleared.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.counts import row_count
from tarnlake.functions.dates import day_text
from tarnlake.functions.money import money_sum
from tarnlake.operators.audit import table_counts
from tarnlake.operators.compaction import compact_partitions, file_inventory
from tarnlake.operators.compare import sync_plan
from tarnlake.operators.sync import sync_partitions
from tarnlake.plans import reports
from tarnlake.plans.registry import query, read
from tarnlake.session import own_session
from tarnlake.sources import catalog
from tarnlake.sources.partitions import point_table
from tarnlake.sources.retire import retire_folders
from tarnlake.sources.scratch import run_folder, settle
from tarnlake.sources.tables import (
    DYNAMIC,
    append,
    append_partition,
    publish,
    publish_set,
    published_set,
    read_files,
    replace_partitions,
    replace_table,
    write_files,
)

DAY = "2024-01-15"


def plain(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])


def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.withColumn("dt", day_text(events, "ts"))


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.withColumn("dt", day_text(orders, "o_orderdate").substr(1, 7))


EVENTS_SQL = "SELECT *, cast(cast(ts AS date) AS varchar) AS dt FROM events"


# Databases


@query("d1_create_database", "SELECT 1 AS databases, count(*) AS customers FROM customer")
def create_database_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    with catalog.temporary_database(spark, "d1") as (database, _):
        catalog.create_database(spark, database)
        catalog.create_table(spark, f"{database}.customer", plain(customers.schema))
        append(customers, f"{database}.customer")
        named = catalog.list_databases(spark).filter(F.col("namespace") == database)
        named = named.agg(row_count().cast("int").alias("databases"))
        loaded = spark.table(f"{database}.customer").agg(row_count().alias("customers"))
        return settle(loaded.select(named.scalar().alias("databases"), "customers"), "d1")


@query("d2_database_comment", "SELECT 'orders of the shop' AS comment, count(*) AS orders FROM orders")
def database_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    with catalog.temporary_database(spark, "d2", comment="orders of the shop") as (database, _):
        catalog.create_table(spark, f"{database}.orders", plain(orders.schema))
        append(orders, f"{database}.orders")
        comment = F.lit(spark.catalog.getDatabase(database).description).alias("comment")
        counted = reports.total_rows(spark.table(f"{database}.orders"), "orders")
        return settle(counted.select(comment, "orders"), "d2")


@query("d3_use_database", "SELECT o_orderstatus, count(*) AS cnt FROM orders GROUP BY o_orderstatus")
def use_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    with catalog.temporary_database(spark, "d3") as (database, _):
        inside = catalog.using_database(spark, database)
        orders = read(inside, sf_dir, "orders")
        catalog.create_table(inside, "orders", plain(orders.schema))
        append(orders, "orders")
        counted = inside.sql("SELECT o_orderstatus, count(*) AS cnt FROM orders GROUP BY o_orderstatus")
        return settle(counted, "d3")


@query(
    "d14_drop_database",
    "SELECT true AS refused_while_full, true AS dropped_when_empty, count(*) AS suppliers FROM supplier",
)
def drop_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier")
    with catalog.temporary_database(spark, "d14") as (database, _):
        table = f"{database}.supplier"
        catalog.create_table(spark, table, plain(suppliers.schema))
        append(suppliers, table)
        counted = settle(reports.total_rows(spark.table(table), "suppliers"), "d14")
        try:
            catalog.drop_database(spark, database)
            refused = False
        except AnalysisException as error:
            refused = error.getCondition() == "SCHEMA_NOT_EMPTY"
        catalog.drop_table(spark, table)
        catalog.drop_database(spark, database)
        dropped = not spark.catalog.databaseExists(database)
    return counted.select(
        F.lit(refused).alias("refused_while_full"), F.lit(dropped).alias("dropped_when_empty"), "suppliers"
    )


@query("d15_list_databases", "SELECT true AS listed, count(*) AS parts FROM part")
def list_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    with catalog.temporary_database(spark, "d15") as (database, _):
        catalog.create_table(spark, f"{database}.part", plain(parts.schema))
        append(parts, f"{database}.part")
        listed = catalog.list_databases(spark).agg(F.bool_or(F.col("namespace") == database).alias("listed"))
        counted = reports.total_rows(spark.table(f"{database}.part"), "parts")
        return settle(counted.select(listed.scalar().alias("listed"), "parts"), "d15")


# Tables


@query(
    "d4_table_columns",
    """
    SELECT 'c_custkey' AS column_name, 'bigint' AS data_type, 'Unique customer ID' AS comment,
           count(c_custkey) AS filled FROM customer
    UNION ALL SELECT 'c_name', 'string', NULL, count(c_name) FROM customer
    UNION ALL SELECT 'c_nationkey', 'int', NULL, count(c_nationkey) FROM customer
    UNION ALL SELECT 'c_acctbal', 'double', 'Balance (it''s signed)', count(c_acctbal) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', '市场', count(c_mktsegment) FROM customer
    """,
)
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    comments = {"c_custkey": "Unique customer ID", "c_acctbal": "Balance (it's signed)", "c_mktsegment": "市场"}
    schema = T.StructType(
        [
            T.StructField(f.name, f.dataType, True, {"comment": comments[f.name]} if f.name in comments else {})
            for f in customers.schema.fields
        ]
    )
    with catalog.temporary_database(spark, "d4") as (database, _):
        table = f"{database}.customer"
        catalog.create_table(spark, table, schema, if_not_exists=False)
        append(customers, table)
        lines = [
            F.struct(
                F.lit(c.name).alias("column_name"),
                F.lit(c.dataType).alias("data_type"),
                F.lit(c.description).cast("string").alias("comment"),
                F.count(F.col(c.name)).alias("filled"),
            )
            for c in spark.catalog.listColumns(table)
        ]
        return settle(spark.table(table).agg(F.array(*lines).alias("lines")).select(F.inline("lines")), "d4")


@query("d5_create_if_not_exists", "SELECT c_mktsegment, count(*) AS cnt FROM customer GROUP BY c_mktsegment")
def create_if_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    with catalog.temporary_database(spark, "d5") as (database, _):
        table = f"{database}.customer"
        catalog.create_table(spark, table, plain(customers.schema))
        append(customers, table)
        catalog.create_table(spark, table, plain(customers.schema))
        return settle(spark.table(table).groupBy("c_mktsegment").agg(row_count().alias("cnt")), "d5")


def _through_table(df: DataFrame, label: str, fmt: str) -> DataFrame:
    """Load an external table, drop it and read the files it leaves."""
    spark = df.sparkSession
    with catalog.temporary_database(spark, label) as (database, folder):
        table, path = f"{database}.rows", f"{folder}/files"
        catalog.create_table(spark, table, plain(df.schema), fmt, path=path, compression="snappy")
        append(df, table)
        catalog.drop_table(spark, table)
    return read_files(spark, path, df.schema, fmt)


@query("d6_parquet_table", "SELECT * FROM orders")
def parquet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_table(read(spark, sf_dir, "orders"), "d6", "parquet")


@query("d7_snappy_files", "SELECT 'snappy.parquet' AS suffix, count(*) AS cnt FROM lineitem")
def snappy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _through_table(read(spark, sf_dir, "lineitem"), "d7", "parquet")
    suffix = F.regexp_extract(F.col("_metadata.file_name"), r"\.(.*)$", 1).alias("suffix")
    return files.select(suffix).groupBy("suffix").agg(row_count().alias("cnt"))


@query("d8_orc_table", "SELECT * FROM customer")
def orc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_table(read(spark, sf_dir, "customer"), "d8", "orc")


@query("d9_default_format", "SELECT 'parquet' AS provider, count(*) AS cnt FROM part")
def default_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    with catalog.temporary_database(spark, "d9") as (database, _):
        table = f"{database}.part"
        catalog.create_table(spark, table, plain(parts.schema), fmt=None)
        append(parts, table)
        provider = F.lit(catalog.table_facts(spark, table)["Provider"]).alias("provider")
        return settle(spark.table(table).agg(row_count().alias("cnt")).select(provider, "cnt"), "d9")


@query("d10_partitioned_table", EVENTS_SQL)
def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dated_events(spark, sf_dir)
    with catalog.temporary_database(spark, "d10") as (database, folder):
        table, path = f"{database}.events", f"{folder}/files"
        catalog.create_table(spark, table, plain(events.schema), partition_by=["dt"], path=path)
        append(events, table)
    return read_files(spark, path, events.schema)


@query("d11_external_table", "SELECT 'EXTERNAL' AS kind, count(*) AS cnt FROM orders")
def external_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    with catalog.temporary_database(spark, "d11") as (database, folder):
        table = f"{database}.orders"
        catalog.create_table(spark, table, plain(orders.schema), path=f"{folder}/files")
        append(orders, table)
        kind = F.lit(catalog.table_facts(spark, table)["Type"]).alias("kind")
        return settle(spark.table(table).agg(row_count().alias("cnt")).select(kind, "cnt"), "d11")


@query("d12_drop_external_keeps_files", "SELECT * FROM supplier")
def drop_external_keeps_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier")
    with catalog.temporary_database(spark, "d12") as (database, folder):
        table, path = f"{database}.supplier", f"{folder}/files"
        catalog.create_table(spark, table, plain(suppliers.schema), path=path)
        append(suppliers, table)
        catalog.drop_table(spark, table)
        catalog.drop_table(spark, table)
    return read_files(spark, path, suppliers.schema)


@query("d13_drop_table", "SELECT count(*) AS cnt, 0 AS tables_left, true AS second_drop_failed FROM part")
def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    with catalog.temporary_database(spark, "d13") as (database, _):
        table = f"{database}.part"
        catalog.create_table(spark, table, plain(parts.schema))
        append(parts, table)
        counted = settle(reports.total_rows(spark.table(table), "cnt"), "d13")
        catalog.drop_table(spark, table, if_exists=False)
        left = len(spark.catalog.listTables(database))
        try:
            catalog.drop_table(spark, table, if_exists=False)
            failed = False
        except AnalysisException as error:
            failed = error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND"
    return counted.select("cnt", F.lit(left).alias("tables_left"), F.lit(failed).alias("second_drop_failed"))


@query(
    "d16_list_tables",
    """
    SELECT 'customer' AS tbl, count(*) AS cnt FROM customer
    UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'part', count(*) FROM part
    """,
)
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    with catalog.temporary_database(spark, "d16") as (database, _):
        for name in ("customer", "orders", "part"):
            rows = read(spark, sf_dir, name)
            catalog.create_table(spark, f"{database}.{name}", plain(rows.schema))
            append(rows, f"{database}.{name}")
        listed = catalog.list_tables(spark, database).select(F.col("tableName").alias("tbl"))
        counts = table_counts({t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database)})
        return settle(listed.join(counts, "tbl").select("tbl", "cnt"), "d16")


@query(
    "w7_catalog_listing",
    "SELECT 'orders' AS table_name, count(*) AS cnt FROM orders UNION ALL SELECT 'events', count(*) FROM events",
)
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with catalog.temporary_database(spark, "w7") as (database, _):
        for name in ("orders", "events"):
            rows = read(spark, sf_dir, name)
            catalog.create_table(spark, f"{database}.{name}", plain(rows.schema))
            append(rows, f"{database}.{name}")
        listing = reports.catalog_listing(spark, database).select(F.col("tableName").alias("table_name"))
        counts = table_counts({name: spark.table(f"{database}.{name}") for name in ("orders", "events")})
        return settle(listing.join(counts, listing.table_name == counts.tbl).select("table_name", "cnt"), "w7")


@query(
    "w6_partitions",
    "SELECT DISTINCT concat('dt=', cast(cast(ts AS date) AS varchar)) AS partition_spec FROM events",
)
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dated_events(spark, sf_dir)
    with catalog.temporary_database(spark, "w6") as (database, _):
        catalog.create_table(spark, f"{database}.events", plain(events.schema), partition_by=["dt"])
        append(events, f"{database}.events")
        listing = reports.partition_listing(spark, f"{database}.events")
        return settle(listing.select(F.col("partition").alias("partition_spec")), "w6")


@query(
    "d17_partitions_with_rows",
    """
    SELECT concat('dt=', substr(cast(o_orderdate AS varchar), 1, 7)) AS partition_spec, count(*) AS cnt
    FROM orders GROUP BY 1
    """,
)
def partitions_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = dated_orders(spark, sf_dir)
    with catalog.temporary_database(spark, "d17") as (database, folder):
        table = f"{database}.orders"
        write_files(orders, f"{folder}/files", partition_by=["dt"])
        schema = plain(orders.schema)
        point_table(spark, table, schema, f"{folder}/files", "parquet", ["dt"])
        listing = catalog.list_partitions(spark, table).select(F.col("partition").alias("partition_spec"))
        months = spark.table(table).groupBy(F.concat(F.lit("dt="), "dt").alias("partition_spec"))
        counts = months.agg(row_count().alias("cnt"))
        return settle(listing.join(counts, "partition_spec"), "d17")


@query(
    "d18_session_setting",
    "SELECT cast(cast(ts AS date) AS varchar) AS dt, count(*) AS cnt FROM events GROUP BY 1",
)
def session_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwriting with one day's rows keeps the other days only under the dynamic setting."""
    events = dated_events(spark, sf_dir)
    with catalog.temporary_database(spark, "d18") as (database, _):
        table = f"{database}.events"
        catalog.create_table(spark, table, plain(events.schema), partition_by=["dt"])
        append(events, table)
        dynamic = own_session(spark, DYNAMIC)
        dated_events(dynamic, sf_dir).filter(F.col("dt") == DAY).write.mode("overwrite").insertInto(table)
        return settle(dynamic.table(table).groupBy("dt").agg(row_count().alias("cnt")), "d18")


# Loads


@query(
    "s2_append_twice",
    "SELECT event_type, 2 * count(*) AS cnt FROM events GROUP BY event_type",
)
def append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    with catalog.temporary_database(spark, "s2") as (database, folder):
        table = f"{database}.events"
        catalog.create_table(spark, table, plain(events.schema), path=f"{folder}/files")
        append(events, table)
        append(events, table)
    loaded = read_files(spark, f"{folder}/files", events.schema)
    return loaded.groupBy("event_type").agg(row_count().alias("cnt"))


@query(
    "s3_append_static_partition",
    f"""
    SELECT cast(cast(ts AS date) AS varchar) AS dt, count(*) AS cnt FROM events GROUP BY 1
    UNION ALL SELECT 'all', count(*) FROM events
    """,
)
def append_static_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days in one load, then every row again into one named partition."""
    events = dated_events(spark, sf_dir)
    with catalog.temporary_database(spark, "s3") as (database, folder):
        table = f"{database}.events"
        catalog.create_table(spark, table, plain(events.schema), partition_by=["dt"], path=f"{folder}/files")
        append(events, table)
        append_partition(events.drop("dt"), table, "dt", "all")
    return read_files(spark, f"{folder}/files", events.schema).groupBy("dt").agg(row_count().alias("cnt"))


@query("s4_parquet_roundtrip", "SELECT * FROM lineitem")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    folder = run_folder(spark, "s4")
    write_files(lines, folder)
    return read_files(spark, folder, lines.schema)


@query("s5_partitioned_roundtrip", EVENTS_SQL)
def partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dated_events(spark, sf_dir)
    folder = run_folder(spark, "s5")
    write_files(events, folder, partition_by=["dt"])
    return read_files(spark, folder, events.schema)


@query("s6_orc_roundtrip", "SELECT * FROM part")
def orc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    folder = run_folder(spark, "s6")
    write_files(parts, folder, "orc")
    return read_files(spark, folder, parts.schema, "orc")


@query(
    "p6_literal_to_double",
    "SELECT o_orderkey, o_totalprice FROM orders",
)
def literal_to_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals stored into a DOUBLE column."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    decimals = orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)"))
    with catalog.temporary_database(spark, "p6") as (database, folder):
        table = f"{database}.orders"
        catalog.create_table(spark, table, plain(orders.schema), path=f"{folder}/files")
        append(decimals, table)
    return read_files(spark, f"{folder}/files", orders.schema)


@query(
    "g6_group_by_partition_column",
    """
    SELECT cast(cast(ts AS date) AS varchar) AS dt, count(*) AS cnt,
           cast(sum(cast(value AS decimal(18, 2))) AS double) AS total
    FROM events GROUP BY 1
    """,
)
def group_by_partition_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dated_events(spark, sf_dir)
    folder = run_folder(spark, "g6")
    write_files(events, folder, partition_by=["dt"])
    days = read_files(spark, folder, events.schema).groupBy("dt")
    return days.agg(row_count().alias("cnt"), money_sum("value").alias("total"))


@query(
    "w2_monthly_gmv_first10_stored",
    """
    SELECT substr(cast(o_orderdate AS varchar), 1, 7) AS dt, count(*) AS orders,
           cast(sum(cast(o_totalprice AS decimal(18, 2))) AS double) AS gmv
    FROM orders GROUP BY 1 ORDER BY dt LIMIT 10
    """,
)
def monthly_gmv_first10_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first groups of a table stored by them: other folders are not opened for the sum."""
    orders = dated_orders(spark, sf_dir)
    with catalog.temporary_database(spark, "w2") as (database, folder):
        table = f"{database}.orders"
        write_files(orders, folder, partition_by=["dt"])
        catalog.create_table(spark, table, plain(orders.schema), partition_by=["dt"], path=folder)
        catalog.find_partitions(spark, table)
        return settle(reports.first_days_stored(spark, table, "dt", "o_totalprice"), "w2-result").orderBy("dt")


@query(
    "w2_first10_stored_odd_days",
    """
    WITH named AS (
        SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'null' WHEN '2-HIGH' THEN '__null__' WHEN '3-MEDIUM' THEN NULL
               ELSE substr(cast(o_orderdate AS varchar), 1, 4) END AS dt, o_totalprice FROM orders
    )
    SELECT dt, count(*) AS orders, cast(sum(cast(o_totalprice AS decimal(18, 2))) AS double) AS gmv
    FROM named GROUP BY 1 ORDER BY dt NULLS FIRST LIMIT 10
    """,
)
def first10_stored_odd_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days stored as NULL and as the text ``null`` are two days."""
    orders, kind = read(spark, sf_dir, "orders"), F.col("o_orderpriority")
    year = F.date_format("o_orderdate", "yyyy")
    day = F.when(kind == "1-URGENT", "null").when(kind == "2-HIGH", "__null__").when(kind != "3-MEDIUM", year)
    with catalog.temporary_database(spark, "w2n") as (database, folder):
        table = f"{database}.orders"
        replace_table(orders.select("o_totalprice", day.alias("dt")), table, folder, partition_by=["dt"])
        return settle(reports.first_days_stored(spark, table, "dt", "o_totalprice"), "w2-result").orderBy("dt")


@query("r1_replace_load", "SELECT * FROM orders")
def replace_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded twice, dropped, loaded again: still one copy of every row."""
    orders = read(spark, sf_dir, "orders")
    with catalog.temporary_database(spark, "r1") as (database, folder):
        table, path = f"{database}.orders", f"{folder}/orders"
        replace_table(orders, table, path)
        replace_table(orders, table, path)
        catalog.drop_table(spark, table)
        replace_table(orders, table, path)
        location = catalog.table_facts(spark, table)["Location"]
    return read_files(spark, location, orders.schema)


@query("r1_replace_and_retire", "SELECT count(*) AS orders, 2 AS retired FROM orders")
def replace_and_retire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads, of which the first two are retired."""
    orders = read(spark, sf_dir, "orders")
    with catalog.temporary_database(spark, "r1r") as (database, folder):
        table, path = f"{database}.orders", f"{folder}/orders"
        for _ in range(3):
            replace_table(orders, table, path)
        retired = retire_folders(spark, path, [table], older_than=0)
        counted = reports.total_rows(spark.table(table), "orders")
        return settle(counted.select("orders", F.lit(len(retired)).alias("retired")), "r1-retired")


@query(
    "r1_replace_partitioned_load",
    "SELECT *, substr(cast(o_orderdate AS varchar), 1, 7) AS dt FROM orders",
)
def replace_partitioned_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = dated_orders(spark, sf_dir)
    with catalog.temporary_database(spark, "r1p") as (database, folder):
        table, path = f"{database}.orders", f"{folder}/orders"
        replace_table(orders, table, path, partition_by=["dt"])
        replace_table(orders, table, path, partition_by=["dt"])
        location = catalog.table_facts(spark, table)["Location"]
    return read_files(spark, location, orders.schema)


@query(
    "r2_replace_partitions",
    f"""
    SELECT cast(cast(ts AS date) AS varchar) AS dt, count(*) AS cnt FROM events
    WHERE cast(ts AS date) <> date '{DAY}' OR event_type = 'view' GROUP BY 1
    """,
)
def replace_touched_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything loaded twice, then one day replaced by its views."""
    events = dated_events(spark, sf_dir)
    with catalog.temporary_database(spark, "r2") as (database, folder):
        table = f"{database}.events"
        catalog.create_table(spark, table, plain(events.schema), partition_by=["dt"], path=f"{folder}/files")
        replace_partitions(events, table)
        replace_partitions(events, table)
        replace_partitions(events.filter((F.col("dt") == DAY) & (F.col("event_type") == "view")), table)
        return settle(spark.table(table).groupBy("dt").agg(row_count().alias("cnt")), "r2-result")


@query("r4_publish", EVENTS_SQL)
def publish_for_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dated_events(spark, sf_dir)
    folder = run_folder(spark, "r4")
    publish(events, folder, ["dt"])
    publish(events, folder, ["dt"])
    return read_files(spark, folder, events.schema)


@query("r4_publish_set", EVENTS_SQL)
def publish_whole_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part first, then everything: a reader of the manifest has the later load alone."""
    events = dated_events(spark, sf_dir)
    folder = run_folder(spark, "r4s")
    publish_set(events.filter(F.col("dt") == DAY), folder, ["dt"])
    publish_set(events, folder, ["dt"])
    return published_set(spark, folder, events.schema)


@query(
    "s8_published_layout",
    """
    SELECT concat('o_orderstatus=', o_orderstatus) AS folder, 'snappy.parquet' AS suffix, count(*) AS cnt
    FROM orders GROUP BY o_orderstatus
    """,
)
def published_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders and files an outside reader finds."""
    path = run_folder(spark, "s8")
    publish(read(spark, sf_dir, "orders"), path, ["o_orderstatus"])
    file = F.col("_metadata.file_path")
    files = spark.read.parquet(path).select(
        F.regexp_extract(file, "/([^/]*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract(F.col("_metadata.file_name"), r"\.(c000\.)?(.*)$", 2).alias("suffix"),
    )
    return files.groupBy("folder", "suffix").agg(row_count().alias("cnt"))


ROWS_A_TASK = 1 << 21


def _by_tasks(rows: DataFrame, least: int) -> DataFrame:
    """The rows dealt to ``least`` tasks, or to more where these would have to sort more than ``ROWS_A_TASK`` each."""
    return rows.repartition(max(least, -(-rows.count() // ROWS_A_TASK)))


@query(
    "r13_compaction",
    "SELECT cast(cast(ts AS date) AS varchar) AS dt, count(*) AS cnt, true AS fewer_files FROM events GROUP BY 1",
)
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written by several tasks that each add a file to every day, then compacted."""
    events = dated_events(spark, sf_dir)
    with catalog.temporary_database(spark, "r13") as (database, _):
        table = f"{database}.events"
        catalog.create_table(spark, table, plain(events.schema), partition_by=["dt"])
        append(_by_tasks(events, 5), table, clustered=True)
        before = compact_partitions(spark, table)
        after = file_inventory(spark.table(table), ["dt"])
        compared = after.alias("a").join(before.alias("b"), "dt", "left")
        fewer = F.coalesce(F.col("a.files") < F.col("b.files"), F.lit(False))
        return settle(compared.select("dt", F.col("a.rows").alias("cnt"), fewer.alias("fewer_files")), "r13-result")


def _compacted(spark: SparkSession, rows: DataFrame, label: str, key: str) -> DataFrame:
    """Rows per partition of a table in many files, after compaction, and whether all but one file are gone."""
    with catalog.temporary_database(spark, label) as (database, _):
        table = f"{database}.t"
        catalog.create_table(spark, table, plain(rows.schema), partition_by=[key])
        append(_by_tasks(rows, 3), table, clustered=True)
        compact_partitions(spark, table)
        left = file_inventory(spark.table(table), [key])
        return settle(left.select(key, F.col("rows").alias("cnt"), (F.col("files") == 1).alias("one_file")), label)


@query("r13_compaction_int_key", "SELECT l_linenumber, count(*) AS cnt, true AS one_file FROM lineitem GROUP BY 1")
def compaction_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber")
    return _compacted(spark, lines, "r13n", "l_linenumber")


CITIES = {"1-URGENT": "北京", "2-HIGH": "上海/浦东", "3-MEDIUM": "a=b c%"}


@query(
    "r13_compaction_text_key",
    """
    SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '北京' WHEN '2-HIGH' THEN '上海/浦东'
           WHEN '3-MEDIUM' THEN 'a=b c%' END AS city, count(*) AS cnt, true AS one_file
    FROM orders GROUP BY 1
    """,
)
def compaction_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in Chinese, keys that folder names escape, and NULL."""
    orders = read(spark, sf_dir, "orders")
    names = F.create_map(*[F.lit(x) for pair in CITIES.items() for x in pair])
    return _compacted(spark, orders.select("o_orderkey", names[F.col("o_orderpriority")].alias("city")), "r13t", "city")


def _stale_copy(events: DataFrame) -> DataFrame:
    """A copy as an earlier run might have left it: it ends on the 20th, lacks one day's errors, has
    one day's clicks with another value, and holds a day the source does not."""
    day, kind = F.col("dt"), F.col("event_type")
    lacking = (day > "2024-01-20") | ((day == "2024-01-05") & (kind == "error"))
    value = F.when((day == "2024-01-07") & (kind == "click"), F.col("value") + 1).otherwise(F.col("value"))
    copy = events.filter(~lacking).withColumn("value", value)
    return copy.union(events.filter(day == "2024-01-09").withColumn("dt", F.lit("2023-12-31")))


STALE_SQL = f"""
    src AS ({EVENTS_SQL}),
    dst AS (
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN dt = '2024-01-07' AND event_type = 'click' THEN value + 1 ELSE value END AS value, props, dt
        FROM src WHERE NOT (dt > '2024-01-20' OR (dt = '2024-01-05' AND event_type = 'error'))
        UNION ALL
        SELECT event_id, ts, user_id, event_type, value, props, '2023-12-31' FROM src WHERE dt = '2024-01-09'
    )
"""


@query(
    "r3_sync_plan",
    f"""
    WITH {STALE_SQL},
    s AS (SELECT dt, count(*) AS n FROM src GROUP BY dt),
    d AS (SELECT dt, count(*) AS n FROM dst GROUP BY dt),
    off AS ((SELECT * FROM src EXCEPT ALL SELECT * FROM dst) UNION ALL (SELECT * FROM dst EXCEPT ALL SELECT * FROM src))
    SELECT k.dt, coalesce(s.n, 0) AS src_rows, coalesce(d.n, 0) AS dst_rows,
           CASE WHEN d.n IS NULL THEN 'missing' WHEN s.n IS NULL THEN 'extra' ELSE 'changed' END AS status
    FROM (SELECT DISTINCT dt FROM off) k LEFT JOIN s ON s.dt = k.dt LEFT JOIN d ON d.dt = k.dt
    """,
)
def plan_of_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dated_events(spark, sf_dir)
    return sync_plan(events, _stale_copy(events), "dt")


@query(
    "r3_sync_plan_row_counts",
    f"""
    WITH {STALE_SQL},
    s AS (SELECT dt, count(*) AS n FROM src GROUP BY dt),
    d AS (SELECT dt, count(*) AS n FROM dst GROUP BY dt)
    SELECT coalesce(s.dt, d.dt) AS dt, coalesce(s.n, 0) AS src_rows, coalesce(d.n, 0) AS dst_rows,
           CASE WHEN d.n IS NULL THEN 'missing' WHEN s.n IS NULL THEN 'extra' ELSE 'changed' END AS status
    FROM s FULL JOIN d ON s.dt = d.dt WHERE s.n IS DISTINCT FROM d.n
    """,
)
def plan_of_sync_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dated_events(spark, sf_dir)
    return sync_plan(events, _stale_copy(events), "dt", contents=False)


@query("r3_sync_copy_drop_extra", EVENTS_SQL)
def sync_copy_drop_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions that the source does not have are removed as well, so the copy ends up equal."""
    events = dated_events(spark, sf_dir)
    with catalog.temporary_database(spark, "r3x") as (database, folder):
        table = f"{database}.events"
        catalog.create_table(spark, table, plain(events.schema), partition_by=["dt"], path=f"{folder}/files")
        append(_stale_copy(events), table)
        sync_partitions(events, table, drop_extra=True)
        return settle(spark.table(table), "r3-result")


@query(
    "r3_sync_copy",
    f"WITH {STALE_SQL} SELECT * FROM src UNION ALL SELECT * FROM dst WHERE dt = '2023-12-31'",
)
def sync_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dated_events(spark, sf_dir)
    with catalog.temporary_database(spark, "r3") as (database, folder):
        table = f"{database}.events"
        catalog.create_table(spark, table, plain(events.schema), partition_by=["dt"], path=f"{folder}/files")
        append(_stale_copy(events), table)
        sync_partitions(events, table, "dt")
        return settle(spark.table(table), "r3-result")


@query(
    "r3_sync_twice_by_ledger",
    f"""
    WITH src AS ({EVENTS_SQL})
    SELECT 'first' AS run, dt, count(*) AS src_rows, cast(0 AS bigint) AS dst_rows, 'missing' AS status FROM src GROUP BY dt
    UNION ALL
    SELECT 'second', dt, cast(count(*) FILTER (event_type = 'view') AS bigint), count(*), 'changed' FROM src WHERE dt = '{DAY}' GROUP BY dt
    """,
)
def sync_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans of two runs from one table to another; before the second, one day of the source is cut to its views."""
    events = dated_events(spark, sf_dir)
    with catalog.temporary_database(spark, "r3l") as (database, folder):
        src, dst = f"{database}.src", f"{database}.dst"
        replace_table(events, src, f"{folder}/src", partition_by=["dt"])
        catalog.create_table(spark, dst, plain(events.schema), partition_by=["dt"])
        first = sync_partitions(src, dst)
        replace_partitions(events.filter((F.col("dt") == DAY) & (F.col("event_type") == "view")), src)
        second = sync_partitions(src, dst)
        if not sync_partitions(src, dst).isEmpty():
            raise RuntimeError("two syncs left a difference")
        named = [plan.select(F.lit(run).alias("run"), "*") for run, plan in (("first", first), ("second", second))]
        return settle(named[0].unionByName(named[1]), "r3-plans")
