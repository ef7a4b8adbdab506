"""Every registered query against its SQL, and the plans of the ones that matter at scale."""

from __future__ import annotations

import re

import duckdb
import pytest
from conftest import SF_DIR

from tarnlake.plans import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def _sorted(found: list[tuple]) -> list[tuple]:
    return sorted(found, key=lambda row: tuple((v is None, "" if v is None else v) for v in row))


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    found = [tuple(row[c] for c in names) for row in df.collect()]
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    expected = [tuple(row[columns.index(c)] for c in names) for row in cursor.fetchall()]
    if re.search(r"ORDER BY [^)]*$", ORACLES[name].strip()):
        assert found == expected
    else:
        assert _sorted(found) == _sorted(expected)


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


READS = {
    "g1_count_rows": "struct<>",
    "w1_segment_headcount_avg": "struct<c_acctbal:double,c_mktsegment:string>",
    "w2_daily_gmv_first10": "struct<o_totalprice:double,o_orderdate:timestamp_ntz>",
    "g4_grouped_sum": "struct<l_suppkey:bigint,l_extendedprice:double>",
    "r6_partition_inventory": "struct<ts:timestamp_ntz>",
    "r7_domain_violations": "struct<o_orderstatus:string>",
    "r11_duplicate_keys": "struct<l_orderkey:bigint,l_linenumber:int>",
}


@pytest.mark.parametrize("name", sorted(READS))
def test_scan_reads_only_the_columns_it_needs(spark, sf_dir, name):
    assert re.findall(r"ReadSchema: (\S+)", plan_of(QUERIES[name](spark, sf_dir))) == [READS[name]]


SHUFFLES = {
    "w2_daily_gmv_first10": 1,
    "g4_grouped_sum": 1,
    "r3_sync_plan": 1,
    "r6_partition_inventory": 1,
    "r7_domain_violations_many_columns": 2,  # rows outside are grouped, then the groups taken apart
    "r8_formula_violation_count": 3,
    "r11_duplicate_keys": 1,
    "r12_table_diff": 1,
}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_number_of_shuffles(spark, sf_dir, name):
    from tarnlake.session import session_conf

    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = plan_of(QUERIES[name](spark, sf_dir))
    tree = plan.split("\n\n")[0]
    assert len(re.findall(r"\bExchange\b", tree)) == SHUFFLES[name], tree


LAZY = sorted(n for n in QUERIES if not re.match(r"(d\d|s\d|w2_monthly|w5|w6|w7|r1_|r2_|r4_|r13|r3_sync_copy|p6|g6)", n))


@pytest.mark.parametrize("name", LAZY)
def test_no_python_pairs_or_single_partition_sorts(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_top_days_keep_only_ten_rows_per_task(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["w2_daily_gmv_first10"](spark, sf_dir))


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["r12_table_diff"](spark, sf_dir))
    assert "Not(EqualTo(o_orderstatus,F))" in plan and "Not(EqualTo(o_orderstatus,O))" in plan


def test_listed_partitions_prune_folders(spark, sf_dir, tmp_path):
    from tarnlake.operators.sync import rows_of_partitions
    from tarnlake.plans.table_queries import dated_events
    from tarnlake.sources.tables import read_files, write_files

    events = dated_events(spark, sf_dir)
    write_files(events, str(tmp_path / "e"), partition_by=["dt"])
    stored = read_files(spark, str(tmp_path / "e"), events.schema)
    wanted = spark.createDataFrame([("2024-01-02",), ("2024-01-05",)], "dt string")
    plan = plan_of(rows_of_partitions(stored, wanted.filter("dt > ''"), "dt"))
    assert "dynamicpruning" in plan


def test_domain_filter_reaches_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["r7_domain_violations_many_columns"](spark, sf_dir))
    assert "Expand" not in plan and re.search(r"PushedFilters: \[Or\(", plan)


def test_stored_days_come_from_the_catalog(spark, sf_dir):
    from tarnlake.plans.reports import first_days_stored
    from tarnlake.plans.table_queries import dated_orders, plain
    from tarnlake.sources import catalog
    from tarnlake.sources.tables import write_files

    orders = dated_orders(spark, sf_dir)
    with catalog.temporary_database(spark, "days") as (database, folder):
        write_files(orders, folder, partition_by=["dt"])
        catalog.create_table(spark, f"{database}.o", plain(orders.schema), partition_by=["dt"], path=folder)
        catalog.find_partitions(spark, f"{database}.o")
        plan = plan_of(first_days_stored(spark, f"{database}.o", "dt", "o_totalprice"))
    assert plan.split("\n\n")[0].count("Scan parquet") == 1 and "Subquery" not in plan


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["dt", "orders", "gmv"] and found.count() == 10
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
