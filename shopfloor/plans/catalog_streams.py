"""Catalogue entries for the stream tables (W1-W5), run as batch queries over
the driver's tables (the stream runs the same plans; see tests). Window
bounds are returned as ``yyyy-MM-dd HH:mm:ss`` text (UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from ..streaming import tables as W
from ..streaming.sources import query_events_from_table, transactions_from_sales
from . import oracle
from .catalog import register
from .warehouse import Warehouse

_TS = "yyyy-MM-dd HH:mm:ss"


def _text_windows(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": F.date_format("window_start", _TS),
                           "window_end": F.date_format("window_end", _TS)})


def _events(spark: SparkSession, d: str) -> DataFrame:
    return query_events_from_table(read_table(spark, d, "events"))


_QUERY_EVENTS_SQL = """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS db_name,
       'predefined' AS query_type, props AS query_key, event_type <> 'error' AS success,
       value AS elapsed_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS executed_at, ts
FROM events"""


@register("stream_w1_query_metrics", f"""
WITH q AS ({_QUERY_EVENTS_SQL}),
b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS ws, db_name, query_type,
             CAST(round(elapsed_ms * 100) AS BIGINT) AS cents, executed_at FROM q
      WHERE db_name IS NOT NULL AND query_type IS NOT NULL)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end,
       db_name, query_type, COUNT(*) AS execution_count,
       CAST((2 * SUM(cents) + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 100 AS avg_elapsed_ms,
       MAX(executed_at) AS last_executed_at
FROM b GROUP BY ws, db_name, query_type""")
def stream_w1_query_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _text_windows(W.query_metrics(_events(spark, d)))


@register("stream_w2_failed_queries", f"""
WITH q AS ({_QUERY_EVENTS_SQL})
SELECT event_id, db_name, query_type, query_key, elapsed_ms, executed_at FROM q
WHERE success = FALSE""")
def stream_w2_failed_queries(spark: SparkSession, d: str) -> DataFrame:
    return W.failed_queries(_events(spark, d))


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return transactions_from_sales(Warehouse.open(spark, d).sales())


@register("stream_w3_sales_by_product_location", oracle.with_ctes("""
SELECT product_name AS product, state AS location, COUNT(*) AS order_count,
       CAST(SUM(sales_amount) AS DOUBLE) AS total_sale
FROM sales WHERE product_name IS NOT NULL AND state IS NOT NULL
GROUP BY product_name, state"""))
def stream_w3(spark: SparkSession, d: str) -> DataFrame:
    return W.sales_by_product_location(_tx(spark, d)).withColumn(
        "total_sale", F.col("total_sale").cast("double"))


@register("stream_w4_sales_by_customer", oracle.with_ctes("""
SELECT customer_name AS cust_id, COUNT(*) AS order_count,
       CAST(SUM(sales_amount) AS DOUBLE) AS total_spent
FROM sales WHERE customer_name IS NOT NULL GROUP BY customer_name"""))
def stream_w4(spark: SparkSession, d: str) -> DataFrame:
    return W.sales_by_customer(_tx(spark, d)).withColumn(
        "total_spent", F.col("total_spent").cast("double"))


@register("stream_w5_sales_windowed", oracle.with_ctes("""
SELECT strftime(CAST(order_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(CAST(order_date AS TIMESTAMP) + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S')
         AS window_end,
       product_name AS product, COUNT(*) AS order_count,
       CAST(SUM(sales_amount) AS DOUBLE) AS total_sale
FROM sales WHERE product_name IS NOT NULL GROUP BY order_date, product_name"""))
def stream_w5(spark: SparkSession, d: str) -> DataFrame:
    return _text_windows(W.sales_windowed(_tx(spark, d))).withColumn(
        "total_sale", F.col("total_sale").cast("double"))
