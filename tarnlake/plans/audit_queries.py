"""Audits of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.counts import row_count
from tarnlake.functions.dates import day_text, typed, typed_report
from tarnlake.functions.money import money_sum
from tarnlake.operators.audit import (
    domain_audit,
    duplicate_keys,
    formula_audit,
    orphan_keys,
    orphan_rows,
    partition_inventory,
    partition_key_audit,
    row_count_audit,
)
from tarnlake.operators.compare import table_diff
from tarnlake.plans.registry import query, read


@query(
    "r5_row_count_audit",
    """
    SELECT e.tbl, e.expected, a.cnt AS actual, e.expected = a.cnt AS ok
    FROM (VALUES ('region', cast(5 AS bigint)), ('nation', 26), ('orders', 15000), ('lineitem', 60000))
         AS e(tbl, expected)
    JOIN (SELECT 'region' AS tbl, count(*) AS cnt FROM region UNION ALL SELECT 'nation', count(*) FROM nation
          UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem) a
      ON a.tbl = e.tbl
    """,
)
def audit_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = {"region": 5, "nation": 26, "orders": 15000, "lineitem": 60000}
    return row_count_audit({name: read(spark, sf_dir, name) for name in expected}, expected)


@query(
    "r6_partition_inventory",
    """
    SELECT cast(cast(ts AS date) AS varchar) AS dt, count(*) AS rows, min(ts) AS first_time, max(ts) AS last_time
    FROM events GROUP BY 1
    """,
)
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return partition_inventory(events.select(day_text(events, "ts").alias("dt"), "ts"), "dt", "ts")


@query(
    "r7_domain_violations",
    """
    SELECT 'o_orderstatus' AS column, o_orderstatus AS value, count(*) AS n FROM orders
    WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O') GROUP BY o_orderstatus
    """,
)
def order_status_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_audit(read(spark, sf_dir, "orders"), {"o_orderstatus": ["F", "O"]})


@query(
    "r7_domain_violations_many_columns",
    """
    SELECT 'l_returnflag' AS column, l_returnflag AS value, count(*) AS n FROM lineitem
    WHERE l_returnflag NOT IN ('A', 'N') GROUP BY l_returnflag
    UNION ALL
    SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem WHERE l_linestatus NOT IN ('O') GROUP BY l_linestatus
    UNION ALL
    SELECT 'l_linenumber', cast(l_linenumber AS varchar), count(*) FROM lineitem
    WHERE l_linenumber NOT IN (1, 2, 3, 4, 5) GROUP BY l_linenumber
    """,
)
def line_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = {"l_returnflag": ["A", "N"], "l_linestatus": ["O"], "l_linenumber": [1, 2, 3, 4, 5]}
    return domain_audit(read(spark, sf_dir, "lineitem"), allowed)


LINE_TOTALS_SQL = """
    SELECT l_orderkey, round(sum(cast(l_extendedprice AS decimal(14, 2)) * (1 - cast(l_discount AS decimal(4, 2)))
           * (1 + cast(l_tax AS decimal(4, 2)))), 2) AS total
    FROM lineitem GROUP BY l_orderkey
"""


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders next to the total of their lines, NULL for orders without lines.

    Lines are summed before the join: one row per order on both sides, so no key is hot in it, and the sums
    come partitioned as the join wants them.
    """
    lines = read(spark, sf_dir, "lineitem")
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    charge = F.rint(charge * 1e6) / 1e6  # products of cents and per cents, without what doubles add to them
    totals = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(money_sum(charge, decimals=6), 2).alias("line_total")
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(totals, "o_orderkey", "left")


@query(
    "r8_formula_violations",
    f"""
    SELECT o_orderkey, o_totalprice AS recorded, cast(t.total AS double) AS computed
    FROM orders LEFT JOIN ({LINE_TOTALS_SQL}) t ON t.l_orderkey = o_orderkey
    WHERE t.total IS NULL OR abs(cast(o_totalprice AS decimal(18, 2)) - t.total) > 0.01
    """,
)
def total_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formula_audit(order_totals(spark, sf_dir), F.col("o_totalprice"), F.col("line_total"), 0.01)
    return found.select("o_orderkey", "recorded", "computed")


@query(
    "r8_formula_violation_count",
    f"""
    SELECT count(*) AS n FROM orders LEFT JOIN ({LINE_TOTALS_SQL}) t ON t.l_orderkey = o_orderkey
    WHERE t.total IS NULL OR abs(cast(o_totalprice AS decimal(18, 2)) - t.total) > 0.01
    """,
)
def total_formula_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = order_totals(spark, sf_dir)
    return formula_audit(totals, F.col("o_totalprice"), F.col("line_total"), 0.01).agg(row_count().alias("n"))


@query(
    "r9_orphan_keys",
    """
    SELECT o_custkey AS key, count(*) AS n FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment <> 'BUILDING')
    GROUP BY o_custkey
    """,
)
def orders_without_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = read(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    return orphan_keys(read(spark, sf_dir, "orders"), kept, "o_custkey", "c_custkey")


@query(
    "r9_orphan_rows",
    "SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
)
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_rows(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    "r10_partition_key_audit",
    """
    SELECT cast(cast(ts + INTERVAL 8 HOUR AS date) AS varchar) AS key, cast(cast(ts AS date) AS varchar) AS event_day,
           count(*) AS n
    FROM events WHERE cast(ts + INTERVAL 8 HOUR AS date) <> cast(ts AS date) GROUP BY 1, 2
    """,
)
def shifted_partition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events filed under their day eight hours east, checked against the day of their time."""
    events = read(spark, sf_dir, "events")
    local_day = (F.col("ts") + F.expr("INTERVAL 8 HOURS")).cast("date").cast("string")
    return partition_key_audit(events.select("ts", local_day.alias("dt")), "dt", "ts")


@query(
    "r10_late_shipments",
    """
    SELECT count(*) AS n FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
    WHERE cast(l_shipdate AS date) < cast(o_orderdate AS date)
    """,
)
def late_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dated before their order. Order keys are unique; both sides are plain shuffles, so a hot order splits."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("shipped"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"))
    early = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("shipped < ordered")
    return early.agg(row_count().alias("n"))


@query(
    "r11_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "r12_table_diff",
    """
    WITH a AS (SELECT * FROM orders WHERE o_orderstatus <> 'F'),
    b AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                 CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
                 o_orderdate, o_orderpriority
          FROM orders WHERE o_orderstatus <> 'O')
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
           CASE WHEN b.o_orderkey IS NULL THEN 'only_a' WHEN a.o_orderkey IS NULL THEN 'only_b'
                ELSE 'changed' END AS side
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice
    """,
)
def diff_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edition lacks the filled orders, the other the open ones and has other prices at low priority."""
    orders = read(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    repriced = F.when(F.col("o_orderpriority") == "5-LOW", price + 1).otherwise(price)
    a = orders.filter(F.col("o_orderstatus") != "F")
    b = orders.filter(F.col("o_orderstatus") != "O").withColumn("o_totalprice", repriced)
    return table_diff(a, b, ["o_orderkey"])


@query(
    "r12_table_diff_repeated_keys",
    """
    WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
                      CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE l_tax END AS l_tax,
                      l_returnflag, l_linestatus, l_shipdate FROM lineitem),
    off AS ((SELECT * FROM lineitem EXCEPT ALL SELECT * FROM b)
            UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM lineitem))
    SELECT DISTINCT l_orderkey, l_linenumber, 'changed' AS side FROM off
    """,
)
def diff_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line keys repeat; every copy of a key is compared, in any order."""
    lines = read(spark, sf_dir, "lineitem")
    tax = F.when(F.col("l_returnflag") == "R", F.lit(0.5)).otherwise(F.col("l_tax"))
    return table_diff(lines, lines.withColumn("l_tax", tax), ["l_orderkey", "l_linenumber"])


@query(
    "r14_typed_text_dates",
    """
    SELECT try_cast(concat('2024-02-', lpad(cast(p_size AS varchar), 2, '0')) AS date) AS d, count(*) AS n
    FROM part GROUP BY 1
    """,
)
def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes 1 to 50 read as days of February; those past its end become NULL."""
    text = F.concat(F.lit("2024-02-"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    days = typed(read(spark, sf_dir, "part").select(text.alias("d")), {"d": "date"})
    return days.groupBy("d").agg(row_count().alias("n"))


@query(
    "r14_typed_report",
    """
    SELECT 'ts' AS column, count(*) AS filled, 0 AS bad FROM events
    UNION ALL
    SELECT 'day', count(*), count(*) FILTER (WHERE CAST(user_id AS bigint) NOT BETWEEN 10 AND 31) FROM events
    """,
)
def typed_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text are all well formed; user numbers read as days of January mostly are not."""
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    day = F.concat(F.lit("2024-01-"), F.col("user_id").cast("string")).alias("day")
    return typed_report(read(spark, sf_dir, "events").select(ts, day), {"ts": "timestamp", "day": "date"})
