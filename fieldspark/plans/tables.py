"""The driver's tables as tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NATIONS, PRIORITIES, MONTHS = 25, 5, 84
KINDS = ("click", "error", "purchase", "signup", "view")
DAYS = 31


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(column: str):
    return ((F.year(column) - 1995) * 12 + F.month(column) - 1).cast("int")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i0 nation, i1 priority, t month, v sum of prices. Sums by customer come first, so the join
    with customers meets one row a customer, priority and month."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).alias("p"), month("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("v"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy(F.col("c_nationkey").cast("int").alias("i0"), (F.col("p").cast("int") - 1).alias("i1"), "t").agg((F.sum("v") / F.lit(1e4)).alias("v"))


SALES = "sales AS (SELECT c_nationkey::INT AS i0, (substr(o_orderpriority, 1, 1)::INT - 1)::INT AS i1, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t, sum(o_totalprice) / 1e4::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i0 user, i1 kind of event, t day, v sum of values."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")) - 1
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("int").alias("i0"), kind.cast("int").alias("i1"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("t")).agg(F.sum("value").alias("v"))


ACTIVITY = f"activity AS (SELECT user_id::INT AS i0, (list_position({list(KINDS)!r}, event_type) - 1)::INT AS i1, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, sum(value) AS v FROM events GROUP BY 1, 2, 3)"


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject flag pair, i0 supplier, t month, v sum of quantities."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("subject"), (F.col("l_suppkey") - 1).cast("int").alias("i0"), month("l_shipdate").alias("t")).agg(F.sum("l_quantity").alias("v"))


SHIPMENTS = "shipments AS (SELECT l_returnflag || l_linestatus AS subject, (l_suppkey - 1)::INT AS i0, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS t, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, tube, label."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("cell"), F.col("embedding").cast("array<double>").alias("tube"), "label")


def places(spark: SparkSession, sf_dir: str, table: str = "wells") -> DataFrame:
    """Grid places from suppliers (wells, one subject a nation) or customers (sensors) on 100 x 100."""
    if table == "wells":
        s = read(spark, sf_dir, "supplier")
        return s.select(F.col("s_nationkey").cast("string").alias("subject"), F.col("s_suppkey").cast("long").alias("well_idx"), (F.col("s_suppkey") * 37 % 101).cast("int").alias("row"), (F.col("s_suppkey") * 53 % 103).cast("int").alias("col"))
    c = read(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return c.select((F.col("c_custkey") * 29 % 100).cast("int").alias("row"), (F.col("c_custkey") * 61 % 99).cast("int").alias("col")).distinct()


WELLS = "wells AS (SELECT s_nationkey::VARCHAR AS subject, s_suppkey::BIGINT AS well_idx, (s_suppkey * 37 % 101)::INT AS row, (s_suppkey * 53 % 103)::INT AS col FROM supplier)"
SENSORS = "sensors AS (SELECT DISTINCT (c_custkey * 29 % 100)::INT AS row, (c_custkey * 61 % 99)::INT AS col FROM customer WHERE c_mktsegment = 'BUILDING')"
