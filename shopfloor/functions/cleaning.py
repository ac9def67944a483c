"""Order-line cleaning (C1-C10) as column expressions.

Every rule of the reference's row cleaner is a built-in expression, so the
whole cleaning runs inside whole-stage codegen; a row is accepted or
rejected with a reason column, never dropped silently. Regular-expression
guards make Spark's lenient parsers accept exactly what the reference's
parsers accept (see README for the documented differences).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import calendar_cols, sale_id

# Fixed values that must equal the reference's: the CSV header names it reads,
# the date formats it tries (in this order), and the optional columns with
# their defaults.
REQUIRED = ["Order ID", "Order Date", "Ship Mode", "Customer Name", "State", "Region",
            "Category", "Product Name", "Sales", "Quantity", "Profit"]
OPTIONAL = ["Customer ID", "Segment", "Country", "City", "Postal Code", "Product ID",
            "Sub-Category", "Discount"]
DATE_FORMATS = [("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
                ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
                ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$")]

FLOAT_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
INT_TEXT = r"^\s*[+-]?\d+\s*$"
# Amounts as they were written, up to ten decimals; the reference's NUMERIC has no scale of its own.
AMOUNT = "decimal(28,10)"


def text(c: str) -> Column:
    """A text field as the reference sees it: '' when empty, trimmed."""
    return F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))


def parse_order_date(raw: Column) -> Column:
    """First of the three formats that fits the trimmed text, else null."""
    t = F.trim(raw)
    tries = [F.when(t.rlike(guard), F.try_to_date(t, fmt)) for fmt, guard in DATE_FORMATS]
    return F.coalesce(*tries)


def parse_float(raw: Column) -> Column:
    """A decimal number in the reference's accepted spelling, else null."""
    return F.when(raw.rlike(FLOAT_TEXT), F.trim(raw).try_cast("double"))


def parse_amount(raw: Column) -> Column:
    """C3 for money: the decimal number as written, else null (also beyond 18 digits before the point)."""
    return F.when(raw.rlike(FLOAT_TEXT), F.trim(raw).try_cast(AMOUNT))


def parse_int(raw: Column) -> Column:
    """An integer (``3.0`` is not one), else null."""
    return F.when(raw.rlike(INT_TEXT), F.trim(raw).try_cast("int"))


def clean_columns(df: DataFrame, line_col: str = "line_no",
                  corrupt_col: str | None = "_corrupt") -> DataFrame:
    """Typed columns plus ``reject_reason`` (null for a good row).

    A required column that the frame lacks, or that ``_missing`` names for the
    row's file, is the row's reason; such rows have a result like any other."""
    cols = set(df.columns)
    lacking = [c for c in REQUIRED if c not in cols]
    for c in lacking:
        df = df.withColumn(c, F.lit(None).cast("string"))
    raw = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in REQUIRED}
    order_date = parse_order_date(raw["Order Date"])
    sales = parse_amount(raw["Sales"])
    quantity = parse_int(raw["Quantity"])
    profit = parse_amount(raw["Profit"])
    raw_discount = (F.coalesce(F.col("`Discount`"), F.lit("")) if "Discount" in cols
                    else F.lit(""))
    of_file = F.col("_missing") if "_missing" in cols else F.lit(None).cast("string")
    missing = F.lit(", ".join(lacking)) if lacking else of_file
    discount = F.when(F.trim(raw_discount) == "", F.lit(0.0)).otherwise(parse_float(raw_discount))
    corrupt = F.col(corrupt_col).isNotNull() if corrupt_col and corrupt_col in cols else F.lit(False)

    reason = (F.when(missing.isNotNull(), F.concat(F.lit("missing column: "), missing))
              .when(corrupt, F.lit("short or malformed row"))
              .when(order_date.isNull(), F.lit("bad order date"))
              .when(sales.isNull(), F.lit("bad sales"))
              .when(quantity.isNull(), F.lit("bad quantity"))
              .when(profit.isNull(), F.lit("bad profit"))
              .when(discount.isNull(), F.lit("bad discount")))

    def opt(c: str) -> Column:
        return text(c) if c in cols else F.lit("")

    order_id = text("Order ID")
    out = df.select(
        *([F.col("file")] if "file" in cols else []),
        F.col(line_col).alias("line_no"),
        sale_id(order_id, F.col(line_col)).alias("sales_fact_id"),
        order_id.alias("order_id"),
        order_date.alias("order_date"),
        text("Ship Mode").alias("ship_mode"),
        opt("Customer ID").alias("customer_id"),
        text("Customer Name").alias("customer_name"),
        opt("Segment").alias("segment"),
        opt("Country").alias("country"),
        opt("City").alias("city"),
        text("State").alias("state"),
        opt("Postal Code").alias("postal_code"),
        text("Region").alias("region"),
        opt("Product ID").alias("product_id"),
        text("Category").alias("category"),
        opt("Sub-Category").alias("sub_category"),
        text("Product Name").alias("product_name"),
        sales.alias("sales_amount"),
        quantity.alias("quantity"),
        discount.alias("discount"),
        profit.alias("profit_amount"),
        reason.alias("reject_reason"),
    )
    return calendar_cols(out, "order_date")


def clean_rows(df: DataFrame, line_col: str = "line_no",
               corrupt_col: str | None = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """C4: (accepted rows, skipped rows with their reason)."""
    checked = clean_columns(df, line_col, corrupt_col)
    good = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    keep = [c for c in ("file", "line_no") if c in checked.columns]
    bad = checked.where(F.col("reject_reason").isNotNull()).select(*keep, "reject_reason")
    return good, bad


def skipped_report(skipped: DataFrame) -> DataFrame:
    """The reference reports a skipped row as (file line = index + 2, reason)."""
    where = [F.col("file")] if "file" in skipped.columns else []
    return skipped.select(*where, (F.col("line_no") + 2).alias("line"),
                          F.col("reject_reason").alias("reason"))


EVENT_ORDER = ["sales_fact_id", "order_id", "line_no", "order_date", "year", "month",
               "month_name", "day", "ship_mode", "customer_id", "customer_name", "segment",
               "country", "city", "state", "postal_code", "region", "product_id", "category",
               "sub_category", "product_name", "sales_amount", "quantity", "discount",
               "profit_amount"]


def to_event(good: DataFrame) -> DataFrame:
    """The 25-field event, date as ISO text, in the reference's field order."""
    return good.select(*[F.date_format("order_date", "yyyy-MM-dd").alias(c)
                         if c == "order_date" else F.col(c) for c in EVENT_ORDER])


def event_json(events: DataFrame) -> DataFrame:
    """K1 message shape: key = sale id, value = the event as JSON text."""
    return events.select(F.col("sales_fact_id").alias("key"),
                         F.to_json(F.struct(*events.columns)).alias("value"))
