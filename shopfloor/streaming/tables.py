"""The five stream tables (W1-W5) and how they run.

Every function takes a streaming or a batch DataFrame: the same plan is a
Structured Streaming aggregation with state in the checkpoint, or a batch
query over the same rows. Windowed tables carry a watermark (default 24
hours, ksqlDB's grace when none is set) so late rows count until then and
the state of closed windows is dropped; the running totals (W3, W4) have
no time bound, so their state grows with the number of keys, as in the
reference. Rows whose group key is null are dropped (W8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_GRACE = "24 hours"


def _keys_present(df: DataFrame, *keys: str) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


def _watermarked(df: DataFrame, grace: str | None) -> DataFrame:
    return df.withWatermark("event_time", grace) if grace else df


def query_metrics(events: DataFrame, size: str = "5 minutes",
                  grace: str | None = DEFAULT_GRACE) -> DataFrame:
    """Per tumbling window, database and query type: executions, mean
    elapsed time rounded half-up to 2 decimals (the mean of the exact
    2-decimal values, so the rounding never sees binary noise), latest
    execution time (text maximum)."""
    src = _keys_present(_watermarked(events, grace), "db_name", "query_type")
    g = (src.groupBy(F.window("event_time", size).alias("w"), "db_name", "query_type")
         .agg(F.count(F.lit(1)).alias("execution_count"),
              F.round(F.avg(F.col("elapsed_ms").cast("decimal(18,2)")), 2).cast("double")
              .alias("avg_elapsed_ms"),
              F.max("executed_at").alias("last_executed_at")))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "db_name", "query_type", "execution_count", "avg_elapsed_ms",
                    "last_executed_at")


def failed_queries(events: DataFrame) -> DataFrame:
    """Failed executions, stateless filter and projection."""
    return (events.where(F.col("success") == F.lit(False))
            .select("event_id", "db_name", "query_type", "query_key", "elapsed_ms",
                    "executed_at"))


def sales_by_product_location(tx: DataFrame) -> DataFrame:
    """Running order count and total per (product, location)."""
    return (_keys_present(tx, "product", "location").groupBy("product", "location")
            .agg(F.count(F.lit(1)).alias("order_count"), F.sum("sale").alias("total_sale")))


def sales_by_customer(tx: DataFrame) -> DataFrame:
    """Running order count and total per customer."""
    return (_keys_present(tx, "cust_id").groupBy("cust_id")
            .agg(F.count(F.lit(1)).alias("order_count"), F.sum("sale").alias("total_spent")))


def sales_windowed(tx: DataFrame, size: str = "1 minute",
                   grace: str | None = DEFAULT_GRACE) -> DataFrame:
    """Per tumbling window and product: order count and total."""
    src = _keys_present(_watermarked(tx, grace), "product")
    g = (src.groupBy(F.window("event_time", size).alias("w"), "product")
         .agg(F.count(F.lit(1)).alias("order_count"), F.sum("sale").alias("total_sale")))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "product", "order_count", "total_sale")


# Key columns of each table, for the keyed upsert of update-mode output.
TABLE_KEYS = {
    "query_metrics": ["window_start", "window_end", "db_name", "query_type"],
    "sales_by_product_location": ["product", "location"],
    "sales_by_customer": ["cust_id"],
    "sales_windowed": ["window_start", "window_end", "product"],
}
