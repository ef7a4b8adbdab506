"""Money sums, fingerprints and text dates against brute force."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake.functions import day_text, event_time, money_avg, money_sum, row_hash, typed, typed_report

FEW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _sum(spark, values, **options):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return df.agg(money_sum("x", **options)).first()[0]


@FEW
@given(st.lists(st.integers(-(10**13), 10**13), min_size=1, max_size=40))
def test_money_sum_is_exact_in_any_order(spark, units):
    values = [u / 10_000 for u in units]
    expected = float(Decimal(sum(units)).scaleb(-4))
    assert _sum(spark, values) == expected
    assert _sum(spark, random.sample(values, len(values))) == expected


def test_money_sum_where_a_double_sum_drifts(spark):
    cents = spark.range(0, 3_000_000, 1, 8).select((F.col("id") % 1000 / 100).alias("x"))
    assert cents.agg(money_sum("x")).first()[0] == 14_985_000.0
    large = spark.createDataFrame([(90_000_000_000.1,)] * 10 + [(0.01,)] * 3, "x double")
    assert large.agg(money_sum("x")).first()[0] == 900_000_000_001.03


def test_money_sum_of_nulls_and_nothing(spark):
    assert _sum(spark, [None, None]) is None
    assert _sum(spark, []) is None
    assert _sum(spark, [None, -1.25]) == -1.25


def test_money_sum_adds_what_has_no_units_as_doubles(spark):
    assert _sum(spark, [1e300, -1e300, 0.25, None]) == 0.25
    assert _sum(spark, [1e300]) == 1e300
    assert _sum(spark, [1e300, 1.0]) == 1e300
    assert _sum(spark, [math.inf, 1.0]) == math.inf
    assert math.isnan(_sum(spark, [math.nan, 1.0]))


@pytest.mark.parametrize("decimals", [6, 9])
def test_sums_below_a_unit_are_the_same_in_any_order(spark, decimals):
    r = random.Random(decimals)
    values = [r.randrange(-(10**12), 10**12) / 10**decimals for _ in range(20_000)] + [1e-13, -3e-15, 0.1, 1e7 / 3]
    data = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "x double, k int").persist()
    found = set()
    for n in (1, 3, 8):
        dealt = data.repartition(n, F.rand(n))
        totals = dealt.groupBy("k").agg(money_sum("x").alias("s"), money_avg("x").alias("m")).orderBy("k").collect()
        found.add(tuple((t["s"].hex(), t["m"].hex()) for t in totals))
    assert len(found) == 1
    expected = [sum(Decimal(v) for v in values[k::3]) for k in range(3)]
    assert all(math.isclose(float.fromhex(s), float(e), rel_tol=1e-12) for (s, _), e in zip(found.pop(), expected))
    data.unpersist()


def test_money_sum_decimals(spark):
    assert _sum(spark, [0.000001] * 7, decimals=6) == 0.000007
    assert _sum(spark, [1.005, 1.005]) == 2.01


def test_money_avg(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0), ("b", None)], "k string, x double")
    found = df.groupBy("k").agg(money_avg("x").alias("m")).orderBy("k")
    assert rows(found) == [("a", 1.5), ("b", None)]


@pytest.mark.parametrize("value", [1.005, 2.675, -1.005, 0.125, 1e-9, 12345.675])
def test_round_is_half_up_on_the_decimal_text(spark, value):
    expected = float(Decimal(repr(value)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert spark.range(1).select(F.round(F.lit(value), 2)).first()[0] == expected


def _hashes(spark, data, schema):
    df = spark.createDataFrame(data, schema)
    return [r[0] for r in df.select(row_hash(df, df.columns)).collect()]


def test_row_hash_sees_which_column_is_null(spark):
    a, b, c = _hashes(spark, [("x", None), (None, "x"), ("x", None)], "p string, q string")
    assert a != b and a == c


def test_row_hash_of_nested_values(spark):
    found = _hashes(spark, [(["x", None],), ([None, "x"],), ([],), (None,)], "p array<string>")
    assert len(set(found)) == 4


def test_typed_dates_and_times(spark):
    data = [
        ("2024-02-29", "2024-01-01 23:59:59"),
        ("2023-02-29", "2024-01-01 24:00:00"),
        ("2024-2-3", "2024-01-01T10:00:00"),
        ("2024-13-01", "2024-01-01"),
        ("soon", ""),
        (None, None),
    ]
    df = spark.createDataFrame(data, "d string, t string")
    kinds = {"d": "date", "t": "timestamp"}
    found = typed(df, kinds)
    assert found.dtypes == [("d", "date"), ("t", "timestamp_ntz")]
    assert rows(found) == [(dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 23, 59, 59))] + [(None, None)] * 5
    assert rows(typed_report(df, kinds)) == [("d", 5, 4), ("t", 5, 4)]


def test_typed_does_not_depend_on_the_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00",)], "t string")
        assert rows(typed(df, {"t": "timestamp"})) == [(dt.datetime(2024, 3, 10, 2, 30),)]
        assert rows(df.select(day_text(df, "t"))) == [("2024-03-10",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_day_text_of_every_kind(spark):
    df = spark.sql(
        "SELECT DATE'2024-01-05' AS a, TIMESTAMP_NTZ'2024-01-05 23:00:00' AS b, '2024-01-05 01:02:03' AS c, 'x' AS e"
    )
    found = df.select(*[day_text(df, c).alias(c) for c in df.columns])
    assert rows(found) == [("2024-01-05", "2024-01-05", "2024-01-05", None)]


def test_money_sum_loses_nothing(spark):
    small = spark.range(0, 100_000, 1, 8)
    found = small.agg(
        money_sum(F.lit(0.00004)).alias("a"), money_sum(F.lit(0.00006)).alias("b"), money_avg(F.lit(0.00006)).alias("c")
    ).first()
    assert found.a == pytest.approx(4.0, rel=1e-12) and found.b == pytest.approx(6.0, rel=1e-12)
    assert found.c == pytest.approx(0.00006, rel=1e-12)


@FEW
@given(st.lists(st.one_of(st.integers(-(10**9), 10**9), st.integers(-(10**17), 10**17)), min_size=1, max_size=30), st.randoms())
def test_money_sum_of_amounts_on_both_sides_of_the_unit_limit(spark, amounts, shuffled):
    """2^50 units of four decimals are 1.1e11; whole amounts far above it still add up exactly."""
    values = [float(a) for a in amounts]
    expected = float(sum(int(v) for v in values))
    assert _sum(spark, values) == expected
    shuffled.shuffle(values)
    assert _sum(spark, values) == expected


def test_equal_maps_hash_alike_in_any_order(spark):
    df = spark.sql(
        """SELECT map('a', 1, 'b', 2) AS m, array(named_struct('x', map(1, map('p', 1, 'q', 2)))) AS d
           UNION ALL SELECT map('b', 2, 'a', 1), array(named_struct('x', map(1, map('q', 2, 'p', 1))))
           UNION ALL SELECT map('a', 2, 'b', 1), array(named_struct('x', map(1, map('p', 2, 'q', 1))))
           UNION ALL SELECT NULL, NULL UNION ALL SELECT map(), array()"""
    )
    found = [tuple(r) for r in df.select(row_hash(df, ["m"]), row_hash(df, ["d"])).collect()]
    assert found[0] == found[1] and len(set(found)) == 4


def test_one_set_of_forms_for_times(spark):
    texts = ["2024-01-05 03:00:00", "2024-1-5 03:00:00", "2024-01-05T03:00:00", "2024-01-05 03:00:00.125", "2024-01-05"]
    bad = ["2024-13-01 00:00:00", "soon", "", "2024-01-05 03:00", None, "20240105"]
    df = spark.createDataFrame([(t,) for t in texts + bad], "ts string")
    found = [tuple(r) for r in df.select(event_time(df, "ts"), day_text(df, "ts")).collect()]
    assert all(time is not None and day == "2024-01-05" for time, day in found[: len(texts)])
    assert all(row == (None, None) for row in found[len(texts) :])
    report = typed_report(df, {"ts": "timestamp"}).first()
    assert (report.filled, report.bad) == (10, 8)  # strict: unpadded text, T and bare days are not well formed
