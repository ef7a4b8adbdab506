"""Checks on tables. Each returns what it found.

Everything is grouped before it is joined, so a key that holds a third of all rows is reduced to one
row per map task before it is shuffled. No join side is broadcast by hand: Spark does it when its
size estimate, or the shuffle size adaptive execution measured, is below the threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.counts import row_count
from tarnlake.functions.dates import day_text, event_time
from tarnlake.sources.scratch import settle

def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: tbl, cnt. Counts read no column, only file footers."""
    counts = [df.agg(row_count().alias("cnt")).select(F.lit(name).alias("tbl"), "cnt") for name, df in tables.items()]
    return reduce(DataFrame.union, counts)


def row_count_audit(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """tbl, expected, actual, ok for every expected table; all of them, right or wrong."""
    counts = [
        tables[name]
        .agg(row_count().alias("actual"))
        .select(F.lit(name).alias("tbl"), F.lit(rows).cast("bigint").alias("expected"), "actual")
        for name, rows in expected.items()
    ]
    return reduce(DataFrame.union, counts).withColumn("ok", F.col("expected") == F.col("actual"))


def partition_inventory(df: DataFrame, by: str, time: str) -> DataFrame:
    """Rows and first and last event time per partition.

    Times kept as text are compared as times (malformed text counts as a row only): the least of a
    number is kept in a hash table, the least of a text would have every row sorted first.
    """
    times = df.select(by, event_time(df, time).alias("time"))
    return times.groupBy(by).agg(
        row_count().alias("rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


def domain_audit(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """column, value, n for values outside the allowed lists; NULL is outside every list.

    The scan is filtered with the columns' own types, so the test reaches the files; the rows outside are grouped
    by the audited columns, and only those groups are taken apart into one row per column outside.
    """
    outside = {}
    for name, values in allowed.items():
        column = F.col(f"`{name}`")
        listed = [F.lit(value).cast(df.schema[name].dataType) for value in values]
        outside[name] = column.isNull() | ~column.isin(listed)
    groups = (
        df.filter(reduce(Column.__or__, outside.values()))
        .groupBy(*[f"`{name}`" for name in allowed])
        .agg(row_count().alias("_n"))
    )
    found = [
        F.when(off, F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").cast("string").alias("value")))
        for name, off in outside.items()
    ]
    pairs = groups.select("_n", F.inline(F.array_compact(F.array(*found))))
    return pairs.groupBy("column", "value").agg(F.sum("_n").alias("n"))


def formula_audit(df: DataFrame, lhs: Column, rhs: Column, tolerance: float) -> DataFrame:
    """Rows where the two sides differ by more than ``tolerance``, with recorded, computed, diff.

    A NULL on one side only is a difference; NULL on both is not. The difference is compared in billionths, so
    that a tolerance of 0.01 allows 100.03 against 100.02, whose double difference is slightly more.
    """
    sides = df.withColumns({"recorded": lhs, "computed": rhs})
    diff = F.col("recorded") - F.col("computed")
    over = F.rint(F.abs(diff) * 1e9) > F.lit(float(round(tolerance * 1e9)))
    off = ~F.col("recorded").eqNullSafe(F.col("computed")) & F.coalesce(over, F.lit(True))
    return sides.filter(off).withColumn("diff", diff)


def orphan_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child key values with no parent and their number of rows: key, n. A NULL key has no parent."""
    keys = child.groupBy(F.col(f"`{child_key}`").alias("key")).agg(row_count().alias("n"))
    parents = parent.select(F.col(f"`{parent_key}`").alias("key")).distinct()
    return keys.join(parents, "key", "left_anti")


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The child rows themselves.

    The orphan keys are settled first. If they are few, Spark broadcasts them and no child row is
    shuffled; if not, both join sides are plain shuffles, which is the form in which adaptive
    execution splits a hot child key. (A side that is still being grouped is never split.)
    """
    keys = settle(orphan_keys(child, parent, child_key, parent_key), "orphan-keys").select("key")
    return child.join(keys, child[child_key].eqNullSafe(keys["key"]), "left_semi")


def partition_key_audit(df: DataFrame, by: str, event_time: str) -> DataFrame:
    """Partition values that differ from the day of the event time: key, event_day, n."""
    found = df.select(F.col(f"`{by}`").cast("string").alias("key"), day_text(df, event_time).alias("event_day"))
    return (
        found.filter(~F.col("key").eqNullSafe(F.col("event_day")))
        .groupBy("key", "event_day")
        .agg(row_count().alias("n"))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with n."""
    return df.groupBy(*keys).agg(row_count().alias("n")).filter(F.col("n") > 1)
