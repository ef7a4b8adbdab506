"""Catalog statements, loads, publishing, sync and compaction."""

from __future__ import annotations

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators import compact, compact_partitions, compaction, file_inventory
from tarnlake.operators.sync import sync_partitions
from tarnlake.plans import reports, table_queries
from tarnlake.session import session_conf, shuffle_settings
from tarnlake.sources import catalog, scratch, tables

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType(), True, {"comment": "it's a key \\ 键"}),
        T.StructField("v", T.StringType()),
        T.StructField("dt", T.StringType(), True, {"comment": "YYYY-MM-DD"}),
    ]
)
DATA = [(1, "a", "2024-01-01"), (2, "b", "2024-01-01"), (3, "c", "2024-01-02"), (4, "中文", None)]


@pytest.fixture
def database(spark):
    with catalog.temporary_database(spark, "test") as (name, folder):
        yield name, folder


@pytest.fixture
def data(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def files(folder: str, pattern: str = "**/*.parquet") -> list[str]:
    return sorted(glob.glob(f"{folder}/{pattern}", recursive=True))


def table_rows(spark, table):
    return sorted(rows(spark.table(table)), key=str)


def test_database_statements(spark, tmp_path):
    name = "tarnlake_statements"
    catalog.create_database(spark, name, comment="it's one", location=str(tmp_path / "db"))
    catalog.create_database(spark, name, comment="another")
    assert spark.catalog.getDatabase(name).description == "it's one"
    before = spark.catalog.currentDatabase()
    inside = catalog.using_database(spark, name)
    catalog.create_table(inside, "t1", SCHEMA)
    assert spark.catalog.tableExists(f"{name}.t1") and inside.catalog.currentDatabase() == name
    assert spark.catalog.currentDatabase() == before
    assert (name,) in rows(catalog.list_databases(spark))
    assert rows(catalog.list_tables(spark, name).select("tableName")) == [("t1",)]
    with pytest.raises(AnalysisException, match="SCHEMA_NOT_EMPTY"):
        catalog.drop_database(spark, name)
    catalog.drop_table(spark, f"{name}.t1", if_exists=False)
    catalog.drop_table(spark, f"{name}.t1")
    with pytest.raises(AnalysisException, match="TABLE_OR_VIEW_NOT_FOUND"):
        catalog.drop_table(spark, f"{name}.t1", if_exists=False)
    catalog.drop_database(spark, name)
    assert not spark.catalog.databaseExists(name)


def test_create_table_keeps_types_and_comments(spark, database):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    catalog.create_table(spark, table, T.StructType([T.StructField("other", T.LongType())]))
    columns = spark.catalog.listColumns(table)
    assert [(c.name, c.dataType, c.isPartition) for c in columns] == [
        ("id", "int", False), ("v", "string", False), ("dt", "string", True)
    ]
    assert [c.description for c in columns] == ["it's a key \\ 键", None, "YYYY-MM-DD"]
    with pytest.raises(AnalysisException, match="TABLE_OR_VIEW_ALREADY_EXISTS"):
        catalog.create_table(spark, table, SCHEMA, if_not_exists=False)


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_append_adds_each_time(spark, database, data, fmt):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, fmt, ["dt"], compression="snappy")
    tables.append(data, table)
    assert table_rows(spark, table) == sorted(DATA, key=str)
    tables.append(data, table)
    assert spark.table(table).count() == 8
    location = catalog.table_facts(spark, table)["Location"].removeprefix("file:")
    assert all(f".snappy.{fmt}" in f for f in files(location, f"**/*.{fmt}"))


def test_append_matches_columns_by_position(spark, database, data):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA)
    tables.append(data.toDF("x", "y", "z"), table)
    assert table_rows(spark, table) == sorted(DATA, key=str)


def test_append_partition(spark, database, data):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    tables.append_partition(data.drop("dt"), table, "dt", "it's")
    assert {r.dt for r in spark.table(table).collect()} == {"it's"}
    assert rows(catalog.list_partitions(spark, table)) == [("dt=it%27s",)]


def test_stored_decimals_become_doubles(spark, database):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, T.StructType([T.StructField("x", T.DoubleType())]))
    tables.append(spark.sql("SELECT 92500.00BD AS x"), table)
    assert spark.table(table).dtypes == [("x", "double")] and rows(spark.table(table)) == [(92500.0,)]


def test_stored_text_does_not_become_a_number(spark, database):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, T.StructType([T.StructField("x", T.DoubleType())]))
    with pytest.raises(AnalysisException, match="CANNOT_SAFELY_CAST"):
        tables.append(spark.sql("SELECT '1' AS x"), table)


def test_dropping_an_external_table_keeps_its_files_and_reloading_doubles(spark, database, data):
    table, path = f"{database[0]}.t", f"{database[1]}/files"
    for times in (1, 2):
        catalog.create_table(spark, table, SCHEMA, path=path)
        tables.append(data, table)
        assert spark.table(table).count() == times * len(DATA)
        catalog.drop_table(spark, table)


@pytest.mark.parametrize("partition_by", [[], ["dt"]])
def test_replace_table_any_number_of_times(spark, database, data, partition_by):
    table, path = f"{database[0]}.t", f"{database[1]}/t"
    tables.replace_table(data, table, path, partition_by=partition_by)
    tables.replace_table(data, table, path, partition_by=partition_by)
    assert table_rows(spark, table) == sorted(DATA, key=str)
    catalog.drop_table(spark, table)
    tables.replace_table(data, table, path, partition_by=partition_by)
    assert table_rows(spark, table) == sorted(DATA, key=str)
    assert {c.name: c.description for c in spark.catalog.listColumns(table)}["id"] == "it's a key \\ 键"


def test_replace_table_changes_only_the_location_of_the_same_table(spark, database, data):
    table, path = f"{database[0]}.t", f"{database[1]}/t"
    first = tables.replace_table(data, table, path)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('kept'='yes')")
    second = tables.replace_table(data, table, path)
    assert first != second and catalog.table_facts(spark, table)["Location"].endswith(second)
    assert "kept=yes" in catalog.table_facts(spark, table)["Table Properties"]
    tables.replace_table(data.withColumn("more", F.lit(1)), table, path)
    assert spark.table(table).columns == ["id", "v", "dt", "more"]
    tables.replace_table(data, table, path, "orc")
    assert catalog.table_facts(spark, table)["Provider"].lower() == "orc"
    assert table_rows(spark, table) == sorted(DATA, key=str)


def test_replace_table_over_a_managed_table(spark, database, data):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA)
    tables.append(data, table)
    tables.replace_table(data, table, f"{database[1]}/t")
    assert catalog.table_facts(spark, table)["Type"] == "EXTERNAL"
    assert table_rows(spark, table) == sorted(DATA, key=str)


def test_a_lost_task_is_run_again_without_doubling_rows(spark, database, data):
    def lost_once(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        for batch in batches:
            yield batch
        if context.attemptNumber() == 0:
            raise RuntimeError("lost")

    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    many = spark.range(0, 1000, 1, 4).selectExpr("int(id) AS id", "'x' AS v", "concat('2024-01-0', id % 5 + 1) AS dt")
    flaky = many.mapInPandas(lost_once, many.schema)
    tables.replace_partitions(flaky, table)
    tables.append(flaky, table, clustered=True)
    counts = spark.table(table).groupBy("id").count().groupBy("count").count()
    assert rows(counts) == [(2, 1000)]


def test_replace_table_from_itself(spark, database, data):
    table, path = f"{database[0]}.t", f"{database[1]}/t"
    tables.replace_table(data, table, path, partition_by=["dt"])
    tables.replace_table(spark.table(table).filter("id > 1"), table, path, partition_by=["dt"])
    assert sorted(r.id for r in spark.table(table).collect()) == [2, 3, 4]


def test_failed_replace_keeps_the_old_rows(spark, database, data):
    table, path = f"{database[0]}.t", f"{database[1]}/t"
    tables.replace_table(data, table, path)
    broken = data.withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(broken.withColumn("id", F.col("id").cast("int")), table, path)
    assert table_rows(spark, table) == sorted(DATA, key=str)


def test_replace_partitions_leaves_the_others(spark, database, data):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    tables.replace_partitions(data, table)
    tables.replace_partitions(data, table)
    assert table_rows(spark, table) == sorted(DATA, key=str)
    new = spark.createDataFrame([("2024-01-01", 9, "z"), ("2024-01-03", 5, "n")], "dt string, id int, v string")
    tables.replace_partitions(new, table)
    assert sorted(r.id for r in spark.table(table).collect()) == [3, 4, 5, 9]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_replace_partitions_with_nothing_changes_nothing(spark, database, data):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    tables.append(data, table)
    tables.replace_partitions(data.limit(0), table)
    assert table_rows(spark, table) == sorted(DATA, key=str)


def test_a_partition_without_rows(spark, database):
    """It is listed, but it is no group, and it does not use up one of the first days."""
    table = f"{database[0]}.t"
    schema = T.StructType([T.StructField("amount", T.DoubleType()), SCHEMA["dt"]])
    catalog.create_table(spark, table, schema, partition_by=["dt"])
    days = [(1.5, "2024-01-02"), (2.5, "2024-01-03"), (3.5, "2024-01-04")]
    tables.append(spark.createDataFrame(days, schema), table)
    spark.sql(f"ALTER TABLE {table} ADD PARTITION (dt='2024-01-01')")
    assert catalog.list_partitions(spark, table).count() == 4
    found = reports.first_days_stored(spark, table, "dt", "amount", days=2)
    assert rows(found) == [("2024-01-02", 1, 1.5), ("2024-01-03", 1, 2.5)]
    assert {r.dt for r in file_inventory(spark.table(table), ["dt"]).collect()} == {d for _, d in days}


def test_replace_partitions_needs_partitions(spark, database, data):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA)
    with pytest.raises(ValueError, match="not partitioned"):
        tables.replace_partitions(data, table)


def test_publish_layout(spark, data, tmp_path):
    path = str(tmp_path / "published")
    tables.publish(data, path, ["dt"])
    tables.publish(data, path, ["dt"])
    folders = {os.path.basename(os.path.dirname(f)) for f in files(path)}
    assert folders == {"dt=2024-01-01", "dt=2024-01-02", "dt=__HIVE_DEFAULT_PARTITION__"}
    for file in files(path):
        meta = pq.ParquetFile(file)
        assert meta.schema_arrow.names == ["id", "v"]
        assert meta.metadata.row_group(0).column(0).compression == "SNAPPY"
    assert sorted(rows(tables.read_files(spark, path, SCHEMA)), key=str) == sorted(DATA, key=str)


def test_published_files_in_another_reader(spark, data, tmp_path):
    path = str(tmp_path / "published")
    tables.publish(data, path, ["dt"])
    query = f"SELECT id, v, dt FROM read_parquet('{path}/*/*.parquet', hive_partitioning=true, hive_types_autocast=false)"
    assert sorted(duckdb.connect().execute(query).fetchall(), key=str) == sorted(DATA, key=str)


def test_statements_as_sql_text(spark, tmp_path):
    """The surface a SQL client uses, without any helper."""
    run = spark.sql
    run(f"CREATE DATABASE IF NOT EXISTS sql_text LOCATION '{tmp_path}/db'")
    before = spark.catalog.currentDatabase()
    try:
        run("USE sql_text")
        run("CREATE TABLE IF NOT EXISTS t1 (id INT, name STRING)")
        run("INSERT INTO t1 VALUES (1, 'hello'), (2, 'world')")
        assert sorted(rows(run("SELECT * FROM t1"))) == [(1, "hello"), (2, "world")]
        run("CREATE TABLE o (order_id STRING, amount DOUBLE COMMENT 'CNY') USING parquet PARTITIONED BY (dt STRING)")
        run("INSERT INTO o PARTITION (dt='2024-01-02') VALUES ('b', 398.00)")
        run("INSERT INTO o PARTITION (dt='2024-01-01') VALUES ('a', 5699.00), ('c', 0.10)")
        found = run("SELECT dt, COUNT(*) AS orders, ROUND(SUM(amount), 2) AS gmv FROM o GROUP BY dt ORDER BY dt LIMIT 10")
        assert rows(found) == [("2024-01-01", 2, 5699.1), ("2024-01-02", 1, 398.0)]
        assert rows(run("SHOW PARTITIONS o")) == [("dt=2024-01-01",), ("dt=2024-01-02",)]
        union = run("SELECT 't1' AS tbl, COUNT(*) AS cnt FROM t1 UNION ALL SELECT 'o', COUNT(*) FROM o")
        assert sorted(rows(union)) == [("o", 3), ("t1", 2)]
        run("DROP TABLE t1")
        run("DROP TABLE IF EXISTS o")
    finally:
        spark.catalog.setCurrentDatabase(before)
    run("DROP DATABASE sql_text")


def test_publish_part_and_whole(spark, data, tmp_path):
    path = str(tmp_path / "published")
    tables.publish(data, path, ["dt"])
    day = data.filter("dt = '2024-01-02'")
    tables.publish(day, path, ["dt"])
    assert tables.read_files(spark, path, SCHEMA).count() == 4
    tables.publish(day, path, ["dt"], whole=True)
    assert rows(tables.read_files(spark, path, SCHEMA)) == [DATA[2]]


def test_published_dates_stay_text(spark, tmp_path):
    dated = spark.sql("SELECT 1 AS id, DATE'2024-01-01' AS dt")
    tables.publish(dated, str(tmp_path / "p"), ["dt"])
    read = tables.read_files(spark, str(tmp_path / "p"), T.StructType([SCHEMA["id"], SCHEMA["dt"]]))
    assert rows(read) == [(1, "2024-01-01")]


SMALL_SHUFFLES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB"}


def hot_rows(spark):
    """Thirty days; one of them holds a third of the rows."""
    day = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 30 + 1)
    return spark.range(0, 300_000, 1, 8).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.format_string("2024-01-%02d", day).alias("dt")
    )


def test_a_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    with session_conf(spark, SMALL_SHUFFLES):
        tables.write_files(hot_rows(spark), str(tmp_path / "hot"), partition_by=["dt"])
    per_day = {}
    for file in files(str(tmp_path / "hot")):
        size = pq.ParquetFile(file).metadata.num_rows
        per_day.setdefault(os.path.basename(os.path.dirname(file)), []).append(size)
    assert sum(map(sum, per_day.values())) == 300_000
    hot = per_day["dt=2024-01-01"]
    assert sum(hot) == 100_000 and len(hot) == 8 and max(hot) == 12_500  # one piece per map task


def test_small_partitions_share_tasks_with_adaptive_execution_off(spark, data, tmp_path):
    with session_conf(spark, {"spark.sql.adaptive.enabled": "false"}):
        tables.write_files(data.repartition(8), str(tmp_path / "few"), partition_by=["dt"])
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
        compact(spark.range(0, 1000, 1, 16), str(tmp_path / "one"))
    assert len(files(str(tmp_path / "few"))) == 3 and len(files(str(tmp_path / "one"))) == 1


def test_clustered_rows_are_written_without_a_shuffle(spark, tmp_path):
    stored, copy = str(tmp_path / "stored"), str(tmp_path / "copy")
    tables.write_files(hot_rows(spark), stored, partition_by=["dt"])
    rows_of_table = tables.read_files(spark, stored, hot_rows(spark).schema)
    assert "rebalance" in tables.spread(rows_of_table, ["dt"])._jdf.queryExecution().analyzed().toString().lower()
    tables.publish(rows_of_table, copy, ["dt"], clustered=True)
    assert len(files(copy)) <= 2 * len(files(stored))
    assert sorted(rows(tables.read_files(spark, copy, rows_of_table.schema))) == sorted(rows(rows_of_table))


def test_small_partitions_share_tasks(spark, data, tmp_path):
    tables.write_files(data.repartition(8), str(tmp_path / "few"), partition_by=["dt"])
    assert len(files(str(tmp_path / "few"))) == 3


def test_compact_splits_hot_and_merges_small(spark, tmp_path):
    many = str(tmp_path / "many")
    hot_rows(spark).write.partitionBy("dt").parquet(many)
    before = spark.read.parquet(many)
    scans = {"spark.sql.files.maxPartitionBytes": "512KB", "spark.sql.files.openCostInBytes": "0"}
    with session_conf(spark, scans):
        compact(before, str(tmp_path / "compacted"), ["dt"], target_bytes=1 << 20)
    after = spark.read.parquet(str(tmp_path / "compacted"))
    assert sorted(rows(after.select("id", "v", F.col("dt").cast("string")))) == sorted(rows(hot_rows(spark)))
    inventory = {str(r.dt): r.files for r in file_inventory(after, ["dt"]).collect()}
    assert inventory["2024-01-01"] > 1 and len(files(str(tmp_path / "compacted"))) < len(files(many)) / 2


def test_compact_without_partitions(spark, tmp_path):
    spark.range(0, 1000, 1, 16).write.parquet(str(tmp_path / "many"))
    compact(spark.read.parquet(str(tmp_path / "many")), str(tmp_path / "one"))
    assert len(files(str(tmp_path / "one"))) == 1
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "one")).collect()) == list(range(1000))


def test_compact_partitions(spark, database):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    for row in [*DATA, (5, "e", "a/b"), (6, "f", "a/b")]:
        tables.append(spark.createDataFrame([row], SCHEMA), table)
    expected = table_rows(spark, table)
    inventory = {r.dt: (r.files, r.rows) for r in file_inventory(spark.table(table), ["dt"]).collect()}
    assert inventory == {"2024-01-01": (2, 2), "2024-01-02": (1, 1), None: (1, 1), "a/b": (2, 2)}
    done = compact_partitions(spark, table)
    assert {(r.dt, r.files) for r in done.collect()} == {("2024-01-01", 2), ("a/b", 2)}
    assert table_rows(spark, table) == expected
    inventory = {r.dt: r.files for r in file_inventory(spark.table(table), ["dt"]).collect()}
    assert inventory["2024-01-01"] == 1
    assert compact_partitions(spark, table).isEmpty()
    tables.replace_partitions(spark.createDataFrame([(7, "g", "2024-01-01")], SCHEMA), table)
    tables.append(spark.createDataFrame([(8, "h", "2024-01-01")], SCHEMA), table)
    assert sorted(r.id for r in spark.table(table).filter("dt = '2024-01-01'").collect()) == [7, 8]
    assert spark.table(table).count() == 6


def _written(spark, table):
    found = spark.table(table).select("dt", F.col("_metadata.file_path").alias("file")).distinct()
    return {r.dt: r.file for r in found.collect()}


def test_sync_copies_only_what_differs(spark, database, data):
    """Also with a NULL partition."""
    source = data.union(spark.createDataFrame([(5, "new", "2024-01-04")], SCHEMA))
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    stale = [DATA[0], (2, "B", "2024-01-01"), DATA[2], (4, "old", None), (6, "gone", "2023-12-31")]
    tables.append(spark.createDataFrame(stale, SCHEMA), table)
    before = _written(spark, table)
    plan = sync_partitions(source, table, "dt")
    assert set(rows(plan)) == {
        ("2024-01-01", 2, 2, "changed"),
        ("2024-01-04", 1, 0, "missing"),
        (None, 1, 1, "changed"),
        ("2023-12-31", 0, 1, "extra"),
    }
    assert table_rows(spark, table) == sorted([*rows(source), stale[-1]], key=str)
    after = _written(spark, table)
    assert {d for d in after if after[d] != before.get(d)} == {"2024-01-01", "2024-01-04", None}
    again = sync_partitions(source, table, "dt")
    assert rows(again) == [("2023-12-31", 0, 1, "extra")]
    assert _written(spark, table) == after


def test_sync_by_row_count(spark, database, data):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    tables.append(data.filter("id <> 2").withColumn("v", F.lit("?")), table)
    assert rows(sync_partitions(data, table, "dt", contents=False)) == [("2024-01-01", 2, 1, "changed")]
    assert sorted(r.v for r in spark.table(table).collect()) == ["?", "?", "a", "b"]


def test_sync_drops_extra_partitions_when_told(spark, database, data):
    table = f"{database[0]}.t"
    path = f"{database[1]}/files"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"], path=path)
    tables.append(data.union(spark.createDataFrame([(6, "gone", "2023-12-31")], SCHEMA)), table)
    assert rows(sync_partitions(data, table, "dt")) == [("2023-12-31", 0, 1, "extra")]
    assert rows(sync_partitions(data, table, "dt", drop_extra=True)) == [("2023-12-31", 0, 1, "extra")]
    assert sync_partitions(data, table, "dt", drop_extra=True).isEmpty()
    assert table_rows(spark, table) == sorted(DATA, key=str)
    assert spark.read.schema(SCHEMA).parquet(path).count() == len(DATA)


TWO_LEVELS = T.StructType(
    [T.StructField("id", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("m", T.DateType())]
)


def _two_levels(spark):
    return spark.range(60).selectExpr(
        "int(id) AS id", "int(if(id % 5 = 0, NULL, 2020 + id % 3)) AS y", "date_add(date'2024-01-01', int(id % 2)) AS m"
    )


def test_sync_of_two_levels_converges(spark, database):
    source = _two_levels(spark)
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, TWO_LEVELS, partition_by=["y", "m"])
    tables.append(source.withColumn("m", F.expr("date_add(m, 1)")), table)
    with pytest.raises(ValueError, match="partitioned by"):
        sync_partitions(source, table, "y")
    sync_partitions(source, table, drop_extra=True)
    assert sync_partitions(source, table, drop_extra=True).isEmpty()
    assert sorted(rows(spark.table(table)), key=str) == sorted(rows(source), key=str)


def test_compaction_of_typed_and_odd_partitions(spark, database):
    for i, (schema, keys, frame) in enumerate(
        [
            (TWO_LEVELS, ["y", "m"], _two_levels(spark)),
            (
                T.StructType([T.StructField("id", T.IntegerType()), T.StructField("city", T.StringType())]),
                ["city"],
                spark.range(60).selectExpr("int(id) AS id", "element_at(array('北京', 'a/b=c d%', 'Beijing', NULL), int(id % 4) + 1) AS city"),
            ),
        ]
    ):
        table = f"{database[0]}.c{i}"
        catalog.create_table(spark, table, schema, partition_by=keys)
        for part in range(3):
            tables.append(frame.filter(F.col("id").between(part * 20, part * 20 + 19)), table)
        expected = sorted(rows(spark.table(table)), key=str)
        groups = spark.table(table).select(*keys).distinct().count()
        done = compact_partitions(spark, table)
        assert done.count() == groups and all(r.files > 1 for r in done.collect())
        assert sorted(rows(spark.table(table)), key=str) == expected
        assert {r.files for r in file_inventory(spark.table(table), keys).collect()} == {1}
        assert compact_partitions(spark, table).isEmpty()


def test_a_compacting_task_keeps_pieces_open_instead_of_sorting(spark, database, monkeypatch):
    """One task gets all partitions, more than it has files open at once; a key is NULL."""
    table, asked, real = f"{database[0]}.open", [], compaction.under
    monkeypatch.setattr(compaction, "under", lambda df, settings: asked.append(settings) or real(df, settings))
    some = spark.range(0, 400, 1, 3).selectExpr("id", "nullif(cast(id % 20 AS int), 0) AS k")
    with session_conf(spark, {"spark.sql.shuffle.partitions": "1"}):
        tables.replace_table(some, table, f"{database[1]}/open", partition_by=["k"], clustered=True)
        assert compact_partitions(spark, table).count() == 20
    assert asked and all(int(s["spark.sql.maxConcurrentOutputFileWriters"]) > 0 for s in asked)
    assert table_rows(spark, table) == sorted(rows(some), key=str)
    assert {r["files"] for r in file_inventory(spark.table(table), ["k"]).collect()} == {1}


def test_rows_before_compaction_come_from_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(table_queries, "ROWS_A_TASK", 100)
    assert [table_queries._by_tasks(spark.range(n), 3).rdd.getNumPartitions() for n in (0, 300, 301, 1000)] == [3, 3, 4, 10]


def test_compaction_merges_tiny_files_beside_a_big_one_and_then_stops(spark, database):
    table = f"{database[0]}.t"
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("dt", T.StringType())])
    catalog.create_table(spark, table, schema, partition_by=["dt"])
    big = spark.range(0, 300_000, 1, 1).selectExpr("id", "rand(1) AS x", "'a' AS dt")
    tables.append(big, table, clustered=True)
    for k in range(8):
        tables.append(spark.range(2).selectExpr(f"id + {k} AS id", "0.5D AS x", "'a' AS dt"), table, clustered=True)
    target = 1 << 20
    before = file_inventory(spark.table(table), ["dt"]).first()
    assert compact_partitions(spark, table, target).count() == 1
    after = file_inventory(spark.table(table), ["dt"]).first()
    assert after.files < before.files and after.rows == before.rows
    assert compact_partitions(spark, table, target).isEmpty()
    tables.append(spark.range(2).selectExpr("id", "0.5D AS x", "'a' AS dt"), table, clustered=True)
    assert file_inventory(spark.table(table), ["dt"]).first().files > after.files


def test_threads_use_a_database_each(spark, sf_dir):
    from tarnlake.plans import QUERIES

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(lambda _: sorted(rows(QUERIES["d3_use_database"](spark, sf_dir))), range(12)))
    assert all(x == found[0] for x in found)


def test_a_static_overwrite_beside_replace_partitions(spark, database):
    many = spark.range(0, 3000, 1, 4).selectExpr("int(id) AS id", "'x' AS v", "concat('2024-01-0', id % 5 + 1) AS dt")
    one, two = (f"{database[0]}.t{i}" for i in range(2))
    for name in (one, two):
        catalog.create_table(spark, name, SCHEMA, partition_by=["dt"])
        tables.append(many, name)
    with ThreadPoolExecutor(2) as pool:
        replaced = [pool.submit(tables.replace_partitions, many.filter("dt = '2024-01-01'"), one) for _ in range(3)]
        many.limit(10).write.mode("overwrite").insertInto(two)
        for job in replaced:
            job.result()
    assert spark.table(one).count() == 3000 and spark.table(two).count() == 10


def test_settle_outlives_its_source(spark, data):
    spark.createDataFrame(DATA, SCHEMA).createOrReplaceTempView("gone")
    kept = scratch.settle(spark.table("gone"), "test")
    spark.catalog.dropTempView("gone")
    assert sorted(rows(kept), key=str) == sorted(DATA, key=str)


def test_scratch_is_the_folder_the_session_names(spark):
    assert scratch.run_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/tarnlake/")


class _Cluster:
    """What ``scratch_root`` asks of a session, on a cluster that names no folder."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "yarn"


def test_no_machine_local_scratch_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(_Cluster)


def test_remove_folder(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    scratch.remove_folder(spark, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_session_conf_is_put_back(spark):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), session_conf(spark, {key: "dynamic"}):
        assert spark.conf.get(key) == "dynamic"
        raise KeyError
    assert spark.conf.get(key) == before


def test_threads_that_share_a_session_do_not_undo_each_other(spark, database):
    """A replace that runs while another ends must still leave the other partitions alone."""
    many = spark.range(0, 2000, 1, 4).selectExpr("int(id) AS id", "'x' AS v", "concat('2024-01-0', id % 5 + 1) AS dt")
    names = [f"{database[0]}.t{i}" for i in range(4)]
    for name in names:
        catalog.create_table(spark, name, SCHEMA, partition_by=["dt"])
        tables.append(many, name)

    def replace(name):
        for day in ("2024-01-01", "2024-01-02"):
            tables.replace_partitions(many.filter(F.col("dt") == day), name)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(replace, names))
    assert [spark.table(name).count() for name in names] == [2000] * 4
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_shuffle_settings():
    found = shuffle_settings(shuffle_bytes=100 << 40, cores=8000)
    assert found["spark.sql.shuffle.partitions"] == "409600"
    assert shuffle_settings(1 << 20, cores=8)["spark.sql.shuffle.partitions"] == "8"
