"""Scans, projections, aggregates, sorts, unions and the whole reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.counts import row_count
from tarnlake.functions.dates import day_text
from tarnlake.functions.money import money_avg, money_sum
from tarnlake.operators.audit import table_counts
from tarnlake.plans import reports
from tarnlake.plans.registry import query, read


@query("p1_all_columns", "SELECT * FROM customer")
def all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("*")


@query("p2_column_list", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("p3_literal_column", "SELECT 'orders' AS tbl, count(*) AS cnt FROM orders")
def literal_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").agg(row_count().alias("cnt")).select(F.lit("orders").alias("tbl"), "cnt")


@query("p4_alias", "SELECT event_type AS kind, count(*) AS headcount FROM events GROUP BY event_type")
def alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(row_count().alias("headcount"))


@query(
    "p5_round_half_up",
    # HALF_UP on the shortest decimal text of the double, which is what Spark's round does.
    """
    SELECT l_orderkey, l_linenumber,
           cast(round(cast(cast(l_extendedprice * (1 - l_discount) AS varchar) AS decimal(38, 18)), 2) AS double) AS net
    FROM lineitem
    """,
)
def round_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(net, 2).alias("net"))


@query("g1_count_rows", "SELECT count(*) AS cnt FROM lineitem")
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").agg(row_count().alias("cnt"))


@query("g2_grouped_count", "SELECT l_suppkey, count(*) AS cnt FROM lineitem GROUP BY l_suppkey")
def grouped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(row_count().alias("cnt"))


@query(
    "g3_grouped_mean",
    """
    SELECT l_returnflag, round(avg(cast(l_extendedprice AS decimal(18, 2))), 2) AS avg_price
    FROM lineitem GROUP BY l_returnflag
    """,
)
def grouped_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").agg(F.round(money_avg("l_extendedprice"), 2).alias("avg_price"))


@query(
    "g4_grouped_sum",
    """
    SELECT l_suppkey, cast(sum(cast(l_extendedprice AS decimal(18, 2))) AS double) AS sum_price
    FROM lineitem GROUP BY l_suppkey
    """,
)
def grouped_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey").agg(money_sum("l_extendedprice").alias("sum_price"))


@query(
    "g4_grouped_sum_small_amounts",
    "SELECT l_suppkey, sum(l_quantity) / 1048576 AS sum_small FROM lineitem GROUP BY l_suppkey",
)
def grouped_sum_of_small_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts far below a unit of four decimals, down to a millionth."""
    small = (F.col("l_quantity") / F.lit(1048576.0)).alias("small")
    return read(spark, sf_dir, "lineitem").select("l_suppkey", small).groupBy("l_suppkey").agg(money_sum("small").alias("sum_small"))


@query("g5_group_by_data_column", "SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type")
def group_by_data_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(row_count().alias("cnt"))


@query("o1_sort_ascending", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def sort_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query(
    "o2_sort_by_rounded_alias",
    """
    SELECT l_suppkey, round(avg(cast(l_extendedprice AS decimal(18, 2))), 2) AS avg_price
    FROM lineitem GROUP BY l_suppkey ORDER BY avg_price DESC, l_suppkey
    """,
)
def sort_by_rounded_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = read(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    means = means.agg(F.round(money_avg("l_extendedprice"), 2).alias("avg_price"))
    return means.orderBy(F.desc("avg_price"), "l_suppkey")


@query(
    "o3_sort_and_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def sort_and_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "u1_bag_union",
    """
    SELECT c_custkey AS id, c_name AS label FROM customer
    UNION ALL SELECT p_partkey, p_name FROM part
    UNION ALL SELECT s_suppkey, s_name FROM supplier
    """,
)
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return customers.union(parts).union(suppliers)


@query(
    "s1_literal_rows",
    """
    SELECT t.code, t.label, count(o.o_orderkey) AS orders
    FROM (VALUES ('F', 'filled'), ('O', 'open'), ('P', 'part filled'), ('X', 'unknown')) AS t(code, label)
    LEFT JOIN orders o ON o.o_orderstatus = t.code
    GROUP BY t.code, t.label
    """,
)
def literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.sql(
        "SELECT * FROM VALUES ('F', 'filled'), ('O', 'open'), ('P', 'part filled'), ('X', 'unknown') AS t(code, label)"
    )
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(row_count().alias("n"))
    return labels.join(counts, "code", "left").select("code", "label", F.coalesce("n", F.lit(0)).alias("orders"))


@query("s7_no_table", "SELECT 1 AS one, (SELECT count(*) FROM orders) AS orders")
def no_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT 1 AS one, (SELECT count(*) FROM {orders}) AS orders", orders=read(spark, sf_dir, "orders")
    )


@query(
    "s9_sql_text",
    "SELECT event_type, count(*) AS cnt, max(value) AS top FROM events GROUP BY event_type",
)
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement as a client sends it, answered as a lazy DataFrame."""
    statement = "SELECT event_type, count(*) AS cnt, max(value) AS top FROM {events} GROUP BY event_type"
    return spark.sql(statement, events=read(spark, sf_dir, "events"))


@query(
    "w1_segment_headcount_avg",
    """
    SELECT c_mktsegment, count(*) AS headcount,
           round(avg(cast(c_acctbal AS decimal(18, 2))), 2) AS avg_acctbal
    FROM customer GROUP BY c_mktsegment ORDER BY avg_acctbal DESC, c_mktsegment
    """,
)
def segment_headcount_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.headcount_and_mean(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "avg_acctbal")


@query(
    "w2_daily_gmv_first10",
    """
    SELECT cast(cast(o_orderdate AS date) AS varchar) AS dt, count(*) AS orders,
           cast(sum(cast(o_totalprice AS decimal(18, 2))) AS double) AS gmv
    FROM orders GROUP BY 1 ORDER BY dt LIMIT 10
    """,
)
def daily_gmv_first10(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    dated = orders.select(day_text(orders, "o_orderdate").alias("dt"), "o_totalprice")
    return reports.first_days(dated, "dt", "o_totalprice")


@query(
    "w3_table_counts",
    """
    SELECT 'lineitem' AS tbl, count(*) AS cnt FROM lineitem
    UNION ALL SELECT 'nation', count(*) FROM nation
    UNION ALL SELECT 'events', count(*) FROM events
    """,
)
def counts_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_counts({name: read(spark, sf_dir, name) for name in ("lineitem", "nation", "events")})


@query("w4_total", "SELECT count(*) AS total_customers FROM customer")
def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.total_rows(read(spark, sf_dir, "customer"), "total_customers")


@query("w5_smoke_round_trip", "SELECT c_custkey AS id, c_name AS name FROM customer")
def smoke_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    return reports.smoke_round_trip(customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
