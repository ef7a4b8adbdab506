"""Audits on hand-made edge cases and against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake.operators import (
    domain_audit,
    duplicate_keys,
    formula_audit,
    orphan_keys,
    orphan_rows,
    partition_key_audit,
    row_count_audit,
    sync_plan,
    table_diff,
)
from tarnlake.plans import reports
from tarnlake.session import session_conf

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
KEYS = st.one_of(st.none(), st.integers(0, 4))
TEXTS = st.one_of(st.none(), st.sampled_from(["x", "y"]))
TABLES = st.lists(st.tuples(KEYS, TEXTS, TEXTS), max_size=12)
SCHEMA = "k int, p string, q string"


def _by_key(table):
    groups = defaultdict(Counter)
    for key, *values in table:
        groups[key][tuple(values)] += 1
    return groups


@FEW
@given(TABLES, TABLES)
def test_table_diff_against_brute_force(spark, a, b):
    groups_a, groups_b = _by_key(a), _by_key(b)
    expected = set()
    for key in groups_a.keys() | groups_b.keys():
        if groups_a.get(key) != groups_b.get(key):
            side = "only_a" if key not in groups_b else "only_b" if key not in groups_a else "changed"
            expected.add((key, side))
    found = rows(table_diff(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["k"]))
    assert len(found) == len(expected) and set(found) == expected


@FEW
@given(TABLES, TABLES)
def test_sync_plan_against_brute_force(spark, src, dst):
    groups_s, groups_d = _by_key(src), _by_key(dst)
    expected = set()
    for key in groups_s.keys() | groups_d.keys():
        s, d = groups_s.get(key), groups_d.get(key)
        if s != d:
            status = "missing" if d is None else "extra" if s is None else "changed"
            expected.add((key, sum((s or {}).values()), sum((d or {}).values()), status))
    found = rows(sync_plan(spark.createDataFrame(src, SCHEMA), spark.createDataFrame(dst, SCHEMA), "k"))
    assert len(found) == len(expected) and set(found) == expected


@FEW
@given(st.lists(KEYS, max_size=12), st.lists(KEYS, max_size=8))
def test_orphans_against_brute_force(spark, child, parent):
    known = {k for k in parent if k is not None}
    expected = Counter(k for k in child if k not in known)
    child_df = spark.createDataFrame([(k,) for k in child], "k int")
    parent_df = spark.createDataFrame([(k,) for k in parent], "id int")
    assert dict(rows(orphan_keys(child_df, parent_df, "k", "id"))) == dict(expected)
    assert Counter(r[0] for r in rows(orphan_rows(child_df, parent_df, "k", "id"))) == expected


@FEW
@given(TABLES)
def test_domain_audit_against_brute_force(spark, table):
    allowed = {"k": [0, 3], "p": ["x"], "q": ["x", "y"]}
    expected = Counter()
    for row in table:
        for (name, values), value in zip(allowed.items(), row, strict=True):
            if value not in values:
                expected[name, None if value is None else str(value)] += 1
    found = rows(domain_audit(spark.createDataFrame(table, SCHEMA), allowed))
    assert {(name, value): n for name, value, n in found} == dict(expected) and len(found) == len(expected)


@FEW
@given(TABLES)
def test_duplicate_keys_against_brute_force(spark, table):
    expected = {key: n for key, n in Counter((k, p) for k, p, _ in table).items() if n > 1}
    found = rows(duplicate_keys(spark.createDataFrame(table, SCHEMA), ["k", "p"]))
    assert {(k, p): n for k, p, n in found} == expected and len(found) == len(expected)


AMOUNTS = st.one_of(st.none(), st.integers(-3, 3).map(float))


@FEW
@given(st.lists(st.tuples(AMOUNTS, AMOUNTS), max_size=12))
def test_formula_audit_against_brute_force(spark, pairs):
    def off(a, b):
        return (a is None) != (b is None) or (a is not None and abs(a - b) > 1.5)

    df = spark.createDataFrame(pairs, "a double, b double")
    found = rows(formula_audit(df, F.col("a"), F.col("b"), 1.5).select("a", "b"))
    assert Counter(found) == Counter(p for p in pairs if off(*p))


def test_table_diff_widens_types_and_ignores_column_order(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("x", 1)], "v string, k bigint")
    assert rows(table_diff(a, b, ["k"])) == []


def test_copies_that_agree_shuffle_bucket_sums_only(spark, monkeypatch):
    from tarnlake.operators import compare

    a = spark.range(0, 50_000, 1, 8).select((F.col("id") % 20_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    b = a.repartition(3)
    buckets = compare.unequal_buckets(a, b, ["k"])
    plan = buckets._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "partial_sum" in plan  # of sums, made where the rows are
    assert buckets.isEmpty()
    received = []
    real = compare.compare_groups
    monkeypatch.setattr(compare, "compare_groups", lambda x, y, *rest: received.append((x.count(), y.count())) or real(x, y, *rest))
    assert table_diff(a, b, ["k"]).isEmpty() and received == [(0, 0)]
    c = b.withColumn("v", F.when(F.col("k") == 77, "other").otherwise(F.col("v"))).union(spark.range(1).selectExpr("NULL AS k", "'x' AS v"))
    assert sorted(rows(table_diff(a, c, ["k"])), key=str) == [(77, "changed"), (None, "only_b")]
    assert max(received[1]) < 50


def test_table_diff_refuses_other_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 2)], "k int, w int")
    try:
        table_diff(a, b, ["k"])
    except ValueError as error:
        assert "'v'" in str(error) and "'w'" in str(error)
    else:
        raise AssertionError("columns differ")


def test_table_diff_of_a_hot_key_makes_no_pairs(spark):
    """Both sides hold 200,000 copies of one key; pairing them would make 4e10 rows."""
    a = spark.range(0, 600_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("v")
    )
    b = a.withColumn("v", F.when(F.col("k") == 5, -1).otherwise(F.col("v")))
    assert rows(table_diff(a, a, ["k"])) == []
    assert rows(table_diff(a, b, ["k"])) == [(5, "changed")]


def test_a_hot_child_key_is_split(spark):
    """A third of the child rows share one orphan key, a third of the parent rows another key."""
    small = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1000)
    child = spark.range(0, 300_000, 1, 8).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    parent = spark.range(0, 9_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("id"))
    with session_conf(spark, small):
        found = orphan_rows(child, parent, "k", "id").agg(
            F.count("*"), F.count_if(F.col("k") == -1), F.max(F.length("v"))
        )
        expected = sum(1 for i in range(300_000) if i % 3 == 0 or i % 1000 >= 500)
        assert rows(found) == [(expected, 100_000, 64)]
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()


def test_few_orphan_keys_are_broadcast(spark):
    child = spark.range(0, 300_000, 1, 8).select((F.col("id") % 1000).alias("k"), "id")
    found = orphan_rows(child, spark.range(990), "k", "id")
    assert found.count() == 3_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_domain_audit_reports_null_and_every_type(spark):
    df = spark.createDataFrame(
        [("a", 1.0, True), ("b", 2.5, False), (None, None, None), ("a", 1.0, True)], "s string, d double, f boolean"
    )
    found = domain_audit(df, {"s": ["a"], "d": [1], "f": [True]})
    expected = {
        ("s", "b", 1), ("s", None, 1), ("d", "2.5", 1), ("d", None, 1), ("f", "false", 1), ("f", None, 1),
    }
    assert set(rows(found)) == expected and found.count() == 6


def test_domain_audit_with_an_empty_list(spark):
    df = spark.createDataFrame([("a",), (None,)], "s string")
    assert set(rows(domain_audit(df, {"s": []}))) == {("s", "a", 1), ("s", None, 1)}


def test_formula_audit_nulls_and_tolerance(spark):
    data = [(1, 1.0, 1.0), (2, 1.0, 1.004), (3, 1.0, 1.02), (4, None, 1.0), (5, 1.0, None), (6, None, None)]
    df = spark.createDataFrame(data, "id int, a double, b double")
    found = formula_audit(df, F.col("a"), F.col("b"), 0.01)
    assert sorted(r.id for r in found.collect()) == [3, 4, 5]


def test_partition_key_audit_reports_bad_text(spark):
    data = [("2024-01-01", "2024-01-01 10:00:00"), ("2024-01-01", "2024-01-02 00:00:00"),
            ("2024-01-01", "never"), (None, "2024-01-02 00:00:00"), (None, None)]
    found = partition_key_audit(spark.createDataFrame(data, "dt string, ts string"), "dt", "ts")
    assert set(rows(found)) == {
        ("2024-01-01", "2024-01-02", 1), ("2024-01-01", None, 1), (None, "2024-01-02", 1)
    }


def test_duplicate_keys_counts_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")], "k int, v string")
    assert set(rows(duplicate_keys(df, ["k", "v"]))) == {(1, "a", 2), (None, "c", 2)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert rows(reports.total_rows(empty, "n")) == [(0,)]
    assert rows(reports.headcount_and_mean(empty, "k", "x", "m")) == []
    assert rows(row_count_audit({"t": empty}, {"t": 0})) == [("t", 0, 0, True)]
    assert rows(domain_audit(empty, {"k": ["a"]})) == []
    assert rows(table_diff(empty, empty, ["k"])) == []


def test_report_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 2.0)], "k string, x double")
    found = rows(reports.headcount_and_mean(df, "k", "x", "m"))
    assert found == [("d", 1, 2.0), ("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, None)]


def test_sort_order_of_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), ("2024-01-01", None)], "dt string, x double")
    assert rows(reports.first_days(df, "dt", "x")) == [(None, 1, 1.0), ("2024-01-01", 1, None)]
