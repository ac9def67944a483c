"""Five summaries per layout, and the two ways the reference refreshes them.

Star (M1-M5): replace-all, the five together (M6): written to a new
version folder, then one pointer moves; readers see the old set or the new
one, never a mix. Nested and graph: keyed merge (M7), where groups that no
longer occur in the source stay as they were. Graph summaries also get
SUMMARISES edges to the node they summarise (M8).

Amounts stay exact decimals in the summary tables; ``plain`` turns them
into doubles for callers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money
from ..plans.storage import Storage
from .graph import Graph, hop
from .star import Star

STAR_SUMMARIES = ("summary_monthly_revenue", "summary_category_performance",
                  "summary_region_state_profit", "summary_ship_mode_profitability",
                  "summary_customer_ranking")


def _ratio_or_null(profit: str, revenue: str):
    """profit / NULLIF(revenue, 0), in double."""
    return F.when(F.col(revenue) == 0, F.lit(None).cast("double")).otherwise(
        money(profit) / money(revenue))


# ---------------------------------------------------------------------------
# Star
# ---------------------------------------------------------------------------

def _fact_by(star: Star, key: str, *aggs) -> DataFrame:
    return star.fact_sales.groupBy(key).agg(*aggs)


def star_monthly(star: Star) -> DataFrame:
    per = _fact_by(star, "date_key", F.sum("sales_amount").alias("r"),
                   F.sum("profit_amount").alias("p"), F.count(F.lit(1)).alias("n"))
    return (per.join(star.dim("dim_date"), "date_key")
            .groupBy("year", "month", "month_name")
            .agg(F.sum("r").alias("total_revenue"), F.sum("p").alias("total_profit"),
                 F.sum("n").alias("order_count")))


def star_category(star: Star) -> DataFrame:
    per = _fact_by(star, "product_key", F.sum("sales_amount").alias("r"),
                   F.sum("profit_amount").alias("p"), F.sum("quantity").alias("q"))
    return (per.join(star.dim("dim_product"), "product_key")
            .groupBy("category_name")
            .agg(F.sum("r").alias("total_revenue"), F.sum("p").alias("total_profit"),
                 F.sum("q").alias("units_sold")))


def star_region_state(star: Star) -> DataFrame:
    per = _fact_by(star, "location_key", F.sum("sales_amount").alias("r"),
                   F.sum("profit_amount").alias("p"))
    return (per.join(star.dim("dim_location"), "location_key")
            .groupBy("region", "state")
            .agg(F.sum("r").alias("total_revenue"), F.sum("p").alias("total_profit")))


def star_ship_mode(star: Star) -> DataFrame:
    per = _fact_by(star, "ship_mode_key", F.sum("sales_amount").alias("r"),
                   F.sum("profit_amount").alias("p"))
    g = (per.join(star.dim("dim_ship_mode"), "ship_mode_key")
         .groupBy("ship_mode_name")
         .agg(F.sum("r").alias("total_revenue"), F.sum("p").alias("total_profit")))
    return g.withColumn("profit_ratio", _ratio_or_null("total_profit", "total_revenue"))


def star_customer(star: Star) -> DataFrame:
    per = _fact_by(star, "customer_key", F.sum("sales_amount").alias("total_revenue"),
                   F.count(F.lit(1)).alias("order_count"))
    return (per.join(star.dim("dim_customer"), "customer_key")
            .select("customer_key", "customer_name", "total_revenue", "order_count"))


STAR_BUILDERS = {
    "summary_monthly_revenue": star_monthly,
    "summary_category_performance": star_category,
    "summary_region_state_profit": star_region_state,
    "summary_ship_mode_profitability": star_ship_mode,
    "summary_customer_ranking": star_customer,
}


def refresh_star_summaries(star: Star, storage: Storage, name: str = "star_summaries"
                           ) -> dict[str, DataFrame]:
    """M6: rebuild all five into a fresh version, then publish it at once."""
    version = storage.new_version(name)
    for table, build in STAR_BUILDERS.items():
        build(star).write.mode("overwrite").parquet(storage.path(name, version, table))
    storage.publish(name, version)
    return current_star_summaries(storage, name)


def current_star_summaries(storage: Storage, name: str = "star_summaries"
                           ) -> dict[str, DataFrame]:
    version = storage.current_version(name)
    if version is None:
        return {}
    return {t: storage.read(name, version, t) for t in STAR_BUILDERS}


# ---------------------------------------------------------------------------
# Nested
# ---------------------------------------------------------------------------

def nested_monthly(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("date.year").alias("year"), F.col("date.month").alias("month"))
            .agg(F.min("date.month_name").alias("month_name"),
                 F.sum("sales_amount").alias("total_revenue"),
                 F.sum("profit_amount").alias("total_profit"),
                 F.count(F.lit(1)).alias("order_count")))


def nested_category(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("product.category").alias("category"))
            .agg(F.sum("sales_amount").alias("total_revenue"),
                 F.sum("profit_amount").alias("total_profit"),
                 F.sum("quantity").alias("units_sold")))


def nested_region_state(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("location.region").alias("region"),
                           F.col("location.state").alias("state"))
            .agg(F.sum("sales_amount").alias("total_revenue"),
                 F.sum("profit_amount").alias("total_profit")))


def nested_ship_mode(nested: DataFrame) -> DataFrame:
    g = (nested.groupBy("ship_mode")
         .agg(F.sum("sales_amount").alias("total_revenue"),
              F.sum("profit_amount").alias("total_profit")))
    return g.withColumn("profit_ratio", _ratio_or_null("total_profit", "total_revenue"))


def nested_customer(nested: DataFrame) -> DataFrame:
    return (nested.groupBy(F.col("customer.customer_name").alias("customer_name"))
            .agg(F.sum("sales_amount").alias("total_revenue"),
                 F.count(F.lit(1)).alias("order_count")))


NESTED_BUILDERS = {
    "summary_monthly_revenue": (nested_monthly, ["year", "month"]),
    "summary_category_performance": (nested_category, ["category"]),
    "summary_region_state_profit": (nested_region_state, ["region", "state"]),
    "summary_ship_mode_profitability": (nested_ship_mode, ["ship_mode"]),
    "summary_customer_ranking": (nested_customer, ["customer_name"]),
}


# Nested summary -> its key columns and where a record holds them.
NESTED_SUMMARIES = {
    "summary_monthly_revenue": {"year": "date.year", "month": "date.month"},
    "summary_category_performance": {"category": "product.category"},
    "summary_region_state_profit": {"region": "location.region", "state": "location.state"},
    "summary_ship_mode_profitability": {"ship_mode": "ship_mode"},
    "summary_customer_ranking": {"customer_name": "customer.customer_name"},
}


def finish_nested(name: str, totals: DataFrame) -> DataFrame:
    """The summary's columns from its groups' sums (r, p, q, n and month_name)."""
    columns = {"summary_monthly_revenue": ["month_name", "total_revenue", "total_profit", "order_count"],
               "summary_category_performance": ["total_revenue", "total_profit", "units_sold"],
               "summary_customer_ranking": ["total_revenue", "order_count"]}.get(name, ["total_revenue", "total_profit"])
    source = {"total_revenue": "r", "total_profit": "p", "units_sold": "q", "order_count": "n", "month_name": "month_name"}
    out = totals.select(*NESTED_SUMMARIES[name], *(F.col(source[c]).alias(c) for c in columns))
    if name == "summary_ship_mode_profitability":
        out = out.withColumn("profit_ratio", _ratio_or_null("total_profit", "total_revenue"))
    return out


def merge_by_key(existing: DataFrame | None, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """M7: ``$merge`` / MERGE - matched rows replaced, new rows inserted,
    unmatched existing rows kept. Null-safe on the keys."""
    if existing is None:
        return fresh
    cond = [existing[k].eqNullSafe(fresh[k]) for k in keys]
    kept = existing.join(fresh.select(*keys), cond, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def refresh_merged(storage: Storage, name: str, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Merge ``fresh`` into the current version of ``name`` and publish the
    result as a new version (never overwriting the files being read)."""
    version = storage.current_version(name)
    existing = storage.read(name, version) if version else None
    merged = merge_by_key(existing, fresh, keys)
    new_version = storage.new_version(name)
    merged.write.mode("overwrite").parquet(storage.path(name, new_version))
    storage.publish(name, new_version)
    return storage.read(name, new_version)


# ---------------------------------------------------------------------------
# Graph
# ---------------------------------------------------------------------------

def sums(prefix: str = "") -> list[Column]:
    """The four sums that every summary is finished from, of the measures of rows."""
    return [F.sum(f"{prefix}sales_amount").alias("r"), F.sum(f"{prefix}profit_amount").alias("p"),
            F.sum(f"{prefix}quantity").alias("q"), F.count(F.lit(1)).alias("n")]


def sums_of_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("r", "p", "q", "n")]


def per_end(g: Graph, etype: str) -> DataFrame:
    """Sums per end of the sale edges ``etype``: dst, r, p, q, n. What isn't used is pruned."""
    return hop(g, etype).groupBy("dst").agg(*sums())


def graph_monthly(g: Graph, per_date: DataFrame | None = None) -> DataFrame:
    per_date = per_end(g, "ON_DATE") if per_date is None else per_date
    im = g.edges["IN_MONTH"]
    per_month = (per_date.join(im, per_date.dst == im.src)
                 .groupBy(im.dst.alias("m"))
                 .agg(F.sum("r").alias("total_revenue"), F.sum("p").alias("total_profit"),
                      F.sum("n").alias("order_count")))
    month = g.node("Month")
    return (per_month.join(month, (per_month.m.year == month.year)
                           & (per_month.m.month == month.month))
            .select("year", "month", "month_name", "total_revenue", "total_profit",
                    "order_count"))


def graph_category(g: Graph, per_product: DataFrame | None = None) -> DataFrame:
    per_product = per_end(g, "OF_PRODUCT") if per_product is None else per_product
    ic = g.edges["IN_CATEGORY"]
    return (per_product.join(ic, per_product.dst == ic.src)
            .groupBy(ic.dst.alias("category_name"))
            .agg(F.sum("r").alias("total_revenue"), F.sum("p").alias("total_profit"),
                 F.sum("q").alias("units_sold")))


def graph_state(g: Graph, per_state: DataFrame | None = None) -> DataFrame:
    per_state = per_end(g, "SHIPPED_TO") if per_state is None else per_state
    totals = per_state.select(F.col("dst").alias("state_name"), F.col("r").alias("total_revenue"),
                              F.col("p").alias("total_profit"))
    return (totals.join(g.node("State"), "state_name")
            .select("state_name", "region", "total_revenue", "total_profit"))


def graph_ship_mode(g: Graph, per_mode: DataFrame | None = None) -> DataFrame:
    per_mode = per_end(g, "USES_SHIP_MODE") if per_mode is None else per_mode
    totals = per_mode.select(F.col("dst").alias("ship_mode_name"), F.col("r").alias("total_revenue"),
                             F.col("p").alias("total_profit"))
    return totals.withColumn("profit_ratio", _ratio_or_null("total_profit", "total_revenue"))


def graph_customer(g: Graph, per_customer: DataFrame | None = None) -> DataFrame:
    per_customer = per_end(g, "BY_CUSTOMER") if per_customer is None else per_customer
    return per_customer.select(F.col("dst").alias("customer_name"), F.col("r").alias("total_revenue"),
                               F.col("n").alias("order_count"))


# summary label: (builder, node key columns, summarised label)
GRAPH_BUILDERS = {
    "MonthlyRevenue": (graph_monthly, ["year", "month"], "Month"),
    "CategoryPerformance": (graph_category, ["category_name"], "Category"),
    "StateProfit": (graph_state, ["state_name"], "State"),
    "ShipModeProfitability": (graph_ship_mode, ["ship_mode_name"], "ShipMode"),
    "CustomerRanking": (graph_customer, ["customer_name"], "Customer"),
}


def summarises_edges(summary: DataFrame, keys: list[str]) -> DataFrame:
    """M8: (summary)-[:SUMMARISES]->(node); both ends share the key values."""
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    return summary.select(key.alias("src"), key.alias("dst")).distinct()
