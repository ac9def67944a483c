"""Column expressions shared by the layouts (all built-in, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sale_id(order_id: str | Column, line_no: str | Column) -> Column:
    """``{order_id}-{line_no}``, the sale id of the nested and graph layouts."""
    return F.concat_ws("-", col_or(order_id), col_or(line_no).cast("string"))


def month_name(date: str | Column) -> Column:
    """Full English month name, unpadded ('January')."""
    return F.date_format(col_or(date), "MMMM")


def calendar_cols(df: DataFrame, date: str = "order_date") -> DataFrame:
    """day, month, year and month_name of a date column."""
    d = F.col(date)
    return df.withColumns({
        "day": F.dayofmonth(d),
        "month": F.month(d),
        "year": F.year(d),
        "month_name": month_name(d),
    })


def money(c: str | Column) -> Column:
    """Final output type of an amount: exact sums are cast to double last."""
    return col_or(c).cast("double")


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / NULLIF(denominator, 0), in double."""
    den = money(denominator)
    return money(numerator) / F.when(den == 0, F.lit(None)).otherwise(den)


def iso_date(year: str | Column, month: str | Column, day: str | Column) -> Column:
    """Zero-padded ``yyyy-mm-dd`` from parts; null when a part is missing or zero."""
    y, m, d = col_or(year), col_or(month), col_or(day)
    ok = (y.isNotNull() & m.isNotNull() & d.isNotNull() & (y != 0) & (m != 0) & (d != 0))
    return F.when(ok, F.format_string("%04d-%02d-%02d", y, m, d))


def plain(df: DataFrame) -> DataFrame:
    """Output types the reference hands to its callers: decimals become
    doubles and dates become ISO strings; everything else is kept."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(field.name))
    return df.select(*cols)
