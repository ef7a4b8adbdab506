"""Loads and compactions that are stopped half way, readers that look on meanwhile, and what a second sync opens."""

from __future__ import annotations

import re
import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators import compact_partitions, compaction, file_inventory, sync
from tarnlake.operators.sync import sync_partitions
from tarnlake.sources import catalog, notes, partitions, tables
from tarnlake.sources.retire import retire_folders

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("dt", T.StringType())])
DAYS = ["2024-01-01", "2024-01-02", "null", None, "a/b %"]


@pytest.fixture
def database(spark):
    with catalog.temporary_database(spark, "repoint") as (name, folder):
        yield name, folder


def load(spark, version: str, days=DAYS, each: int = 3):
    data = [(i, version, day) for day in days for i in range(each)]
    return spark.createDataFrame(data, SCHEMA)


def content(spark, table) -> dict:
    """Versions and rows of every day."""
    found = spark.table(table).groupBy("dt", "v").count().collect()
    return {(r["dt"], r["v"]): r["count"] for r in found}


class Lost(RuntimeError):
    pass


def stop_after(monkeypatch, module, name: str, calls: int):
    """The driver is lost in the call after so many."""
    real, made = getattr(module, name), []

    def stopping(*args, **kwargs):
        if len(made) >= calls:
            raise Lost
        made.append(1)
        return real(*args, **kwargs)

    monkeypatch.setattr(module, name, stopping)


@pytest.mark.parametrize("calls", [0, 1, 3])
def test_a_stopped_replace_is_finished_by_the_next(spark, database, monkeypatch, calls):
    monkeypatch.setattr(partitions, "STATEMENTS_AT_ONCE", 1)
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    tables.replace_partitions(load(spark, "old"), table)
    with monkeypatch.context() as stopped:
        stop_after(stopped, partitions, "move_partition", calls)
        with pytest.raises(Lost):
            tables.replace_partitions(load(spark, "new", [*DAYS[:4], "2024-01-09"]), table)
    found = content(spark, table)
    assert all(n == 3 for n in found.values()) and len(found) == len(DAYS)  # each day old or new, none both
    assert sum(v == "new" for _, v in found) == calls
    tables.replace_partitions(load(spark, "later", ["2024-01-01"], 2), table)
    expected = {("2024-01-01", "later"): 2, **{(d, "new"): 3 for d in [*DAYS[1:4], "2024-01-09"]}, ("a/b %", "old"): 3}
    assert content(spark, table) == expected
    assert not partitions.finish_pending(spark, table)


def test_a_failed_write_changes_nothing(spark, database):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    tables.replace_partitions(load(spark, "old"), table)
    broken = load(spark, "new").withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        tables.replace_partitions(broken.withColumn("v", F.col("v").cast("string")), table)
    assert content(spark, table) == {(d, "old"): 3 for d in DAYS} and not partitions.finish_pending(spark, table)


def test_replace_partitions_keeps_format_types_and_refusals(spark, database):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, "orc", ["dt"], compression="zlib")
    tables.replace_partitions(load(spark, "x").withColumn("id", F.col("id").cast("int")), table)
    assert spark.table(table).schema["id"].dataType == T.LongType() and spark.table(table).count() == 15
    files = [r["f"] for r in spark.table(table).select(F.col("_metadata.file_name").alias("f")).distinct().collect()]
    assert files and all(".zlib.orc" in f for f in files)
    with pytest.raises(Exception, match="CANNOT_SAFELY_CAST"):
        tables.replace_partitions(load(spark, "y").withColumn("id", F.lit("1")), table)


def looking_on(spark, look, change) -> list:
    """What ``look`` gives, again and again, while ``change`` runs."""
    seen, failed, end = [], [], threading.Event()

    def read():
        while not end.is_set():
            try:
                seen.append(look())
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        change()
    finally:
        end.set()
        reader.join()
    assert not failed, failed[0]
    return seen


def test_a_reader_meets_whole_partitions_while_a_table_is_replaced(spark, database):
    table, path = f"{database[0]}.t", f"{database[1]}/t"
    tables.replace_table(load(spark, "0"), table, path, partition_by=["dt"])
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('kept'='yes')")

    def change():
        for version in "123":
            days = DAYS if version == "2" else DAYS[:3]
            tables.replace_table(load(spark, version, days), table, path, partition_by=["dt"])

    for found in looking_on(spark, lambda: content(spark, table), change):
        assert all(n == 3 for n in found.values()) and len({d for d, _ in found}) == len(found) and len(found) >= 3
    assert content(spark, table) == {(d, "3"): 3 for d in DAYS[:3]}
    assert "kept=yes" in catalog.table_facts(spark, table)["Table Properties"]  # it was never dropped
    retired = retire_folders(spark, path, [table], older_than=0)
    assert len(retired) == 3 and content(spark, table) == {(d, "3"): 3 for d in DAYS[:3]}


def test_a_stopped_replace_of_a_table_is_finished_by_the_next(spark, database, monkeypatch):
    monkeypatch.setattr(partitions, "STATEMENTS_AT_ONCE", 1)
    table, path = f"{database[0]}.t", f"{database[1]}/t"
    tables.replace_table(load(spark, "old"), table, path, partition_by=["dt"])
    with monkeypatch.context() as stopped:
        stop_after(stopped, partitions, "move_partition", 1)
        with pytest.raises(Lost):
            tables.replace_table(load(spark, "new", DAYS[:3]), table, path, partition_by=["dt"])
    assert partitions.finish_pending(spark, table)
    assert content(spark, table) == {(d, "new"): 3 for d in DAYS[:3]}


def test_replace_table_with_no_rows_and_other_keys(spark, database):
    table, path = f"{database[0]}.t", f"{database[1]}/t"
    tables.replace_table(load(spark, "a"), table, path, partition_by=["dt"])
    tables.replace_table(load(spark, "b").limit(0), table, path, partition_by=["dt"])
    assert content(spark, table) == {} and catalog.list_partitions(spark, table).isEmpty()
    tables.replace_table(load(spark, "c"), table, path, partition_by=["v", "dt"])
    assert spark.table(table).columns == ["id", "v", "dt"] and spark.table(table).count() == 15
    tables.replace_table(load(spark, "d"), table, path, partition_by=["v", "dt"])
    assert {v for _, v in content(spark, table)} == {"d"}


def test_loads_inside_a_table_are_retired(spark, database):
    table, path = f"{database[0]}.t", f"{database[1]}/t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"], path=path)
    for version in ("a", "b"):
        tables.replace_partitions(load(spark, version), table)
    assert len(retire_folders(spark, path, [table], older_than=0)) == 1
    assert content(spark, table) == {(d, "b"): 3 for d in DAYS}


def test_a_reader_of_a_published_set_meets_one_whole_load(spark, tmp_path):
    path = str(tmp_path / "set")
    tables.publish_set(load(spark, "0"), path, ["dt"])

    def change():
        for version in "1234":
            tables.publish_set(load(spark, version, DAYS if version in "24" else DAYS[:2]), path, ["dt"])

    def look():
        return {(r["v"], r["n"]) for r in tables.published_set(spark, path, SCHEMA).groupBy("v").agg(F.count("*").alias("n")).collect()}

    for found in looking_on(spark, look, change):
        assert found in ([{(v, 15)} for v in "024"] + [{(v, 6)} for v in "13"])
    assert len(retire_folders(spark, path, [], older_than=0)) == 4 and look() == {("4", 15)}
    with pytest.raises(FileNotFoundError):
        tables.published_set(spark, str(tmp_path / "none"), SCHEMA)


def opened(df) -> set[str]:
    return {re.sub(".*/(dt=[^/]*)/.*", r"\1", f) for f in df.inputFiles()}


def test_a_second_sync_reads_only_what_changed(spark, database, monkeypatch):
    src, dst = f"{database[0]}.src", f"{database[0]}.dst"
    tables.replace_table(load(spark, "a"), src, f"{database[1]}/src", partition_by=["dt"])
    catalog.create_table(spark, dst, SCHEMA, partition_by=["dt"])
    assert {r["status"] for r in sync_partitions(src, dst).collect()} == {"missing"}
    read = []
    real = sync.row_hash
    monkeypatch.setattr(sync, "row_hash", lambda df, columns: read.append(opened(df)) or real(df, columns))
    assert sync_partitions(src, dst).isEmpty() and read == []  # nothing is opened
    tables.replace_partitions(load(spark, "b", ["null"]), src)
    assert rows(sync_partitions(src, dst)) == [("null", 3, 3, "changed")]
    assert read == [{"dt=null"}]
    read.clear()
    tables.replace_partitions(load(spark, "c", [None], 1), dst)
    assert rows(sync_partitions(src, dst)) == [(None, 3, 1, "changed")]
    assert read == [{"dt=__HIVE_DEFAULT_PARTITION__"}]
    assert content(spark, dst) == content(spark, src)


def test_a_ledger_that_does_not_fit_is_ignored(spark, database):
    src, other, dst = (f"{database[0]}.{name}" for name in ("src", "other", "dst"))
    for name, version in ((src, "a"), (other, "b")):
        tables.replace_table(load(spark, version), name, f"{database[1]}/{name}", partition_by=["dt"])
    catalog.create_table(spark, dst, SCHEMA, partition_by=["dt"])
    sync_partitions(src, dst)
    assert sync_partitions(other, dst).count() == len(DAYS) and content(spark, dst) == content(spark, other)
    assert sync_partitions(spark.table(src), dst).count() == len(DAYS)  # rows of any origin
    ledger = f"{catalog.table_facts(spark, dst)['Location']}/{sync.LEDGER}"
    for broken in (["no ledger"], {"columns": "other", "source": src, "partitions": [[], []]}):
        notes.write_note(spark, ledger, broken)
        assert sync_partitions(src, dst).isEmpty()
    tables.append(load(spark, "a", ["2024-01-01"], 1), dst)  # a file more
    assert rows(sync_partitions(src, dst)) == [("2024-01-01", 3, 4, "changed")]
    spark.sql(f"ALTER TABLE {dst} ADD COLUMNS (w INT)")
    tables.replace_table(load(spark, "a").select("id", "v", F.lit(None).cast("int").alias("w"), "dt"), src, f"{database[1]}/s2", partition_by=["dt"])
    assert sync_partitions(src, dst).isEmpty()


def test_sync_without_a_ledger_and_with_a_removed_folder(spark, database):
    dst = f"{database[0]}.dst"
    catalog.create_table(spark, dst, SCHEMA, partition_by=["dt"])
    sync_partitions(load(spark, "a"), dst, ledger=False)
    path = f"{catalog.table_facts(spark, dst)['Location']}/{sync.LEDGER}"
    assert notes.read_note(spark, path) is None
    sync_partitions(load(spark, "a"), dst)
    assert notes.read_note(spark, path) is not None
    from tarnlake.sources.scratch import remove_folder

    folder = dict((v["dt"], f) for v, f in catalog.partition_folders(spark, dst))["2024-01-02"]
    remove_folder(spark, folder)
    spark.catalog.refreshTable(dst)
    assert rows(sync_partitions(load(spark, "a"), dst)) == [("2024-01-02", 3, 0, "missing")]
    assert content(spark, dst) == {(d, "a"): 3 for d in DAYS}


def many_files(spark, table):
    for version in ("a", "b", "c"):
        tables.append(load(spark, version), table)


def test_a_stopped_compaction_continues(spark, database, monkeypatch):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    many_files(spark, table)
    expected = content(spark, table)
    with monkeypatch.context() as stopped:
        stop_after(stopped, compaction, "_compact_batch", 2)
        with pytest.raises(Lost):
            compact_partitions(spark, table, at_once=2)
    assert content(spark, table) == expected
    batches = []
    real = compaction._compact_batch
    monkeypatch.setattr(compaction, "_compact_batch", lambda *args: batches.append(len(args[3])) or real(*args))
    done = compact_partitions(spark, table, at_once=2)
    assert batches == [1]  # four of the five days were noted
    assert {(r["dt"], r["files"]) for r in done.collect()} == {(d, 3) for d in DAYS}
    assert content(spark, table) == expected
    assert {r["files"] for r in file_inventory(spark.table(table), ["dt"]).collect()} == {1}
    assert compact_partitions(spark, table, at_once=2).isEmpty()


@pytest.mark.parametrize("calls", [0, 2])
def test_a_compaction_stopped_between_partitions_is_finished(spark, database, monkeypatch, calls):
    monkeypatch.setattr(partitions, "STATEMENTS_AT_ONCE", 1)
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    many_files(spark, table)
    expected = content(spark, table)
    with monkeypatch.context() as stopped:
        stop_after(stopped, partitions, "move_partition", calls)
        with pytest.raises(Lost):
            compact_partitions(spark, table)
    assert content(spark, table) == expected
    compact_partitions(spark, table)
    assert content(spark, table) == expected
    assert {r["files"] for r in file_inventory(spark.table(table), ["dt"]).collect()} == {1}


def test_compaction_compares_what_it_wrote(spark, database, monkeypatch):
    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    many_files(spark, table)
    expected = content(spark, table)
    real = compaction.read_files
    monkeypatch.setattr(compaction, "read_files", lambda *args: real(*args).filter("id <> 1 OR dt <> 'null'"))
    with pytest.raises(RuntimeError, match="unchanged"):
        compact_partitions(spark, table)
    monkeypatch.undo()
    assert content(spark, table) == expected and file_inventory(spark.table(table), ["dt"]).first()["files"] == 3


def test_a_listing_takes_only_some_folders_at_a_time(spark, database, monkeypatch):
    from tarnlake.operators import files

    table = f"{database[0]}.t"
    catalog.create_table(spark, table, SCHEMA, partition_by=["dt"])
    tables.append(load(spark, "a"), table)
    listed = []
    real = files._listed
    monkeypatch.setattr(files, "_listed", lambda spark, folders: listed.append(len(folders)) or real(spark, folders))
    found = list(files.folder_facts(spark, catalog.partition_folders(spark, table), {"n": F.count("*")}, 2))
    assert listed == [2, 2, 1] and {v["dt"] for v, _, _ in found} == set(DAYS)
