"""Nested layout: one record per sale with embedded structs, and its questions.

Record shape: sales_fact_id, sales_amount, quantity, profit_amount,
product{product_name, category}, customer{customer_name},
date{day, month, month_name, year}, location{state, region}, ship_mode.
Amounts stay exact decimals (the reference stores floats); sums are cast
to double at the end, so results do not depend on summation order.

The questions group on struct fields; where the reference accepts
older record shapes with ``$ifNull`` chains, ``first_field`` coalesces
whichever of those fields the schema has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import money
from ..plans.storage import LARGE_CODEC, Storage


def nested_records(sales: DataFrame) -> DataFrame:
    """One nested record per order line."""
    return sales.select(
        "sales_fact_id", "sales_amount", "quantity", "profit_amount",
        F.struct("product_name", "category").alias("product"),
        F.struct("customer_name").alias("customer"),
        F.struct("day", "month", "month_name", "year").alias("date"),
        F.struct("state", "region").alias("location"),
        "ship_mode",
    )


def write_nested(records: DataFrame, storage: Storage, name: str = "nested") -> DataFrame:
    """Replace the whole record set on load (drop, then insert)."""
    return storage.write(records, name, "sales", codec=LARGE_CODEC)


def build_nested(sales: DataFrame, storage: Storage, name: str = "nested") -> DataFrame:
    return write_nested(nested_records(sales), storage, name)


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    node: T.DataType = schema
    for part in path.split("."):
        if not isinstance(node, T.StructType) or part not in node.fieldNames():
            return None
        node = node[part].dataType
    return node


def first_field(df: DataFrame, *paths: str, cast: str | None = None) -> Column:
    """``$ifNull`` over alternative field paths: the first non-null of those present.

    Older record shapes kept a plain value where the current one has a
    sub-record; only paths holding a plain value take part."""
    present = [F.col(p) for p in paths
               if (t := field_type(df.schema, p)) is not None and not isinstance(t, T.StructType)]
    if cast:
        present = [c.cast(cast) for c in present]
    if not present:
        return F.lit(None).cast(cast or "string")
    return present[0] if len(present) == 1 else F.coalesce(*present)


# ---------------------------------------------------------------------------
# The ten questions
# ---------------------------------------------------------------------------

def q1_top_products(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("product.product_name").alias("product_name"))
            .agg(money(F.sum("sales_amount")).alias("revenue"))
            .orderBy(F.desc("revenue"), "product_name").limit(10))


def q2_monthly_revenue(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("date.year").alias("year"), F.col("date.month").alias("month"),
                           F.col("date.month_name").alias("month_name"))
            .agg(money(F.sum("sales_amount")).alias("revenue"))
            .orderBy("year", "month")
            .select("revenue", "year", "month_name"))


def q3_top_customers(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("customer.customer_name").alias("customer_name"))
            .agg(money(F.sum("sales_amount")).alias("total_spent"))
            .orderBy(F.desc("total_spent"), "customer_name").limit(10))


def q4_revenue_by_category(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("product.category").alias("category"))
            .agg(money(F.sum("sales_amount")).alias("total_sales"))
            .orderBy(F.desc("total_sales"), "category"))


def q5_profit_by_state(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("location.state").alias("state"))
            .agg(money(F.sum("profit_amount")).alias("total_profit"))
            .orderBy(F.desc("total_profit"), "state"))


def _product_sales_profit(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("product.product_name").alias("product_name"))
            .agg(money(F.sum("sales_amount")).alias("total_sales"),
                 money(F.sum("profit_amount")).alias("total_profit")))


def q6_high_sales_low_profit(nested: DataFrame) -> DataFrame:
    return (_product_sales_profit(nested)
            .orderBy(F.desc("total_sales"), F.asc("total_profit"), "product_name").limit(10))


def q7_low_sales_high_profit(nested: DataFrame) -> DataFrame:
    return (_product_sales_profit(nested)
            .orderBy(F.asc("total_sales"), F.desc("total_profit"), "product_name").limit(10))


def q8_profit_ratio_by_ship_mode(nested: DataFrame) -> DataFrame:
    mode = first_field(nested, "ship_mode.ship_mode_name", "ship_mode_name", "ship_mode")
    g = (nested.groupBy(mode.alias("ship_mode"))
         .agg(F.sum("profit_amount").alias("p"), F.sum("sales_amount").alias("s"))
         .where(F.col("ship_mode").isNotNull()))
    ratio = F.when(F.col("s") == 0, F.lit(None).cast("double")).otherwise(money("p") / money("s"))
    return (g.select("ship_mode", ratio.alias("profit_ratio"))
            .orderBy(F.desc("profit_ratio"), "ship_mode"))


def q9_most_frequent_customers(nested: DataFrame) -> DataFrame:
    name = first_field(nested, "customer.customer_name", "customer_name", "customer")
    return (nested.groupBy(name.alias("customer_name"))
            .agg(F.count(F.lit(1)).alias("order_count"))
            .where(F.col("customer_name").isNotNull())
            .orderBy(F.desc("order_count"), "customer_name").limit(10))


def q10_lowest_profit_months(nested: DataFrame) -> DataFrame:
    year = first_field(nested, "date.year", "year", cast="int")
    month = first_field(nested, "date.month_name", "date.month", "month", cast="string")
    return (nested.groupBy(year.alias("year"), month.alias("month"))
            .agg(money(F.sum("profit_amount")).alias("total_profit"))
            .where(F.col("year").isNotNull() & F.col("month").isNotNull())
            .orderBy("total_profit", "year", "month").limit(10))


QUESTIONS = {
    "q1_top_products": q1_top_products,
    "q2_monthly_revenue": q2_monthly_revenue,
    "q3_top_customers": q3_top_customers,
    "q4_revenue_by_category": q4_revenue_by_category,
    "q5_profit_by_state": q5_profit_by_state,
    "q6_high_sales_low_profit": q6_high_sales_low_profit,
    "q7_low_sales_high_profit": q7_low_sales_high_profit,
    "q8_profit_ratio_by_ship_mode": q8_profit_ratio_by_ship_mode,
    "q9_most_frequent_customers": q9_most_frequent_customers,
    "q10_lowest_profit_months": q10_lowest_profit_months,
}
