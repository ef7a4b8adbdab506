"""Comparing two copies of a table group by group, without joining them.

Both copies are stacked and grouped once. Joining them would pair every copy of a repeated key with
every other and send a hot key to one task; grouping reduces each group to one row per map task, and
treats NULL keys as equal.

A diff by keys first compares some ten thousand buckets of keys, whose sums are made map-side, and then shuffles the
rows of unequal buckets only: copies that agree shuffle nothing but bucket sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.fingerprint import row_hash, spread_hash
from tarnlake.sources.scratch import settle

BUCKETS = 1 << 16


def compare_groups(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key: rows_a, rows_b and ``same``, whether both hold the same rows in any order.

    ``same`` compares row counts and 64-bit row hashes, so it misses a real difference with
    probability 2^-64. Without ``values`` it compares counts alone and no value column is read.
    """
    columns = [f"`{c}`" for c in [*keys, *values]]
    both = a.select(*columns, F.lit(1).alias("_side")).unionByName(b.select(*columns, F.lit(-1).alias("_side")))
    sides = {
        "rows_a": F.count_if(F.col("_side") == 1),
        "rows_b": F.count_if(F.col("_side") == -1),
    }
    balances = {}
    if values:
        for i, part in enumerate(spread_hash(row_hash(both, list(values)))):
            balances[f"_balance_{i}"] = F.sum(part * F.col("_side"))
    grouped = both.groupBy(*[f"`{k}`" for k in keys]).agg(
        *[measure.alias(name) for name, measure in {**sides, **balances}.items()]
    )
    same = F.col("rows_a") == F.col("rows_b")
    for name in balances:
        same &= F.col(name) == 0
    return grouped.select(*[f"`{k}`" for k in keys], "rows_a", "rows_b", same.alias("same"))


def _values(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> list[str]:
    if set(a.columns) != set(b.columns):
        raise ValueError(f"different columns: {sorted(set(a.columns) ^ set(b.columns))}")
    return [c for c in a.columns if c not in keys]


def unequal_buckets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The buckets of keys that hold other rows in ``a`` than in ``b``; at most ``BUCKETS`` rows of one long."""
    whole = [*keys, *_values(a, b, keys)]
    both = a.select(*[f"`{c}`" for c in whole], F.lit(1).alias("_side"))
    both = both.unionByName(b.select(*[f"`{c}`" for c in whole], F.lit(-1).alias("_side")))
    bucket = F.pmod(row_hash(both, list(keys)), F.lit(BUCKETS)).alias("_bucket")
    sums = [F.sum(part * F.col("_side")).alias(f"_balance_{i}") for i, part in enumerate(spread_hash(row_hash(both, whole)))]
    grouped = both.groupBy(bucket).agg(F.sum("_side").alias("_rows"), *sums)
    equal = F.col("_rows") == 0
    for i in range(len(sums)):
        equal &= F.col(f"_balance_{i}") == 0
    return grouped.filter(~equal).select("_bucket")


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that differ, with side: 'only_a', 'only_b' or 'changed'. Keys may repeat.

    Like ``compare_groups`` it misses a real difference in a bucket or a group with probability 2^-64. Columns are
    hashed with the type that both sides' types meet in.
    """
    values = _values(a, b, keys)
    a, b = alike(a, b)
    buckets = F.broadcast(settle(unequal_buckets(a, b, keys), "unequal-buckets"))  # at most BUCKETS longs
    inside = [
        df.withColumn("_bucket", F.pmod(row_hash(df, list(keys)), F.lit(BUCKETS))).join(buckets, "_bucket", "left_semi").drop("_bucket")
        for df in (a, b)
    ]
    compared = compare_groups(*inside, keys, values).filter(~F.col("same"))
    side = F.when(F.col("rows_b") == 0, "only_a").when(F.col("rows_a") == 0, "only_b").otherwise("changed")
    return compared.select(*[f"`{k}`" for k in keys], side.alias("side"))


def alike(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the same columns, each of the type that a union of the two gives it."""
    merged = a.limit(0).unionByName(b.limit(0)).schema
    columns = [(f.name, f.dataType) for f in merged.fields]
    return tuple(df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns]) for df in (a, b))


def sync_plan(src: DataFrame, dst: DataFrame, by: str, contents: bool = True) -> DataFrame:
    """Partitions of ``src`` and ``dst`` that differ: by, src_rows, dst_rows, status.

    status is 'missing' or 'changed', to be copied, or 'extra' for one only ``dst`` has.
    ``contents=False`` compares row counts alone, reading footers instead of the tables.
    """
    values = _values(src, dst, [by]) if contents else []
    return statuses(compare_groups(src, dst, [by], values).filter(~F.col("same")), [by])


def statuses(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that differ, with src_rows, dst_rows and status."""
    status = F.when(F.col("rows_b") == 0, "missing").when(F.col("rows_a") == 0, "extra").otherwise("changed")
    return compared.select(
        *[f"`{k}`" for k in keys],
        F.col("rows_a").alias("src_rows"),
        F.col("rows_b").alias("dst_rows"),
        status.alias("status"),
    )
