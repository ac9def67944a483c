"""The reference's uniqueness and not-null constraints, as a report.

Parquet enforces no constraint, so after each load the keys are checked
with one aggregation per table (duplicates are counted, not listed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import NODE_KEYS, Graph
from .star import DIMENSIONS, Star


def check_keys(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """One row: table, key, rows, duplicate key values, rows with a null key."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                    F.max(any_null.cast("int")).alias("_null"))
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.lit(",".join(keys)).alias("key_columns"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("row_count"),
        F.count(F.when(F.col("_n") > 1, True)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("_null") == 1, F.col("_n"))), F.lit(0))
        .cast("long").alias("null_key_rows"),
    )


def star_checks(star: Star) -> DataFrame:
    """Surrogate and natural keys of the five dimensions, the fact's id."""
    parts = []
    for name, (key, natural, _attrs) in DIMENSIONS.items():
        dim = getattr(star, name)
        parts.append(check_keys(dim, name, [key]))
        parts.append(check_keys(dim, name, natural))
    parts.append(check_keys(star.fact_sales, "fact_sales", ["sales_fact_id"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_checks(g: Graph) -> DataFrame:
    parts = [check_keys(g.nodes[label], label, keys) for label, keys in NODE_KEYS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
