"""Star layout: five dimensions and one fact table, and its ten questions.

Dimension keys are dense and follow natural-key order (``row_number()
OVER (ORDER BY natural key)``), computed without a one-partition window
(``functions.keys``). The fact looks up its five keys by inner joins on
natural keys; a dimension is broadcast only when its exact row count
(known from key assignment) is under the broadcast bound.

Questions aggregate the fact by surrogate key first (partial aggregation,
integer keys, one row per key after the shuffle) and only then join the
dimension, so the fact is never shuffled for a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money, ratio
from ..functions.distinct_sets import distinct_sets
from ..functions.joins import maybe_broadcast
from ..functions.keys import dense_keys
from ..plans.storage import LARGE_CODEC, Storage

DIMENSIONS = {
    # name: (key column, natural key in key order, attribute columns)
    "dim_date": ("date_key", ["year", "month"], ["month_name"]),
    "dim_product": ("product_key", ["product_name", "category_name"], []),
    "dim_customer": ("customer_key", ["customer_name"], []),
    "dim_location": ("location_key", ["state", "region"], []),
    "dim_ship_mode": ("ship_mode_key", ["ship_mode_name"], []),
}

FACT_COLUMNS = ["sales_fact_id", "date_key", "product_key", "customer_key", "location_key",
                "ship_mode_key", "sales_amount", "quantity", "profit_amount", "order_id",
                "line_no"]


@dataclass
class Star:
    dim_date: DataFrame
    dim_product: DataFrame
    dim_customer: DataFrame
    dim_location: DataFrame
    dim_ship_mode: DataFrame
    fact_sales: DataFrame
    rows: dict[str, int] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in (*DIMENSIONS, "fact_sales")}

    def dim(self, name: str) -> DataFrame:
        """A dimension, broadcast-hinted only if its known size allows it."""
        return maybe_broadcast(getattr(self, name), self.rows.get(name))


def star_sources_one_scan(sales: DataFrame, storage: Storage, prefix: str):
    """Distinct natural keys of each dimension (as the staging load selects
    them), from one grouping-sets scan of the staging, with exact counts."""
    s = sales.withColumns({"category_name": F.col("category"),
                           "ship_mode_name": F.col("ship_mode")})
    sets = {"dim_date": ["year", "month", "month_name"],
            "dim_product": ["product_name", "category_name"],
            "dim_customer": ["customer_name"],
            "dim_location": ["state", "region"],
            "dim_ship_mode": ["ship_mode_name"]}
    return distinct_sets(s, sets, storage, f"{prefix}-sets")


def fact_rows(sales: DataFrame, dims: dict[str, DataFrame], rows: dict[str, int],
              fact_id: Column | None = None) -> DataFrame:
    """Look up the five keys of every sale (inner joins, as the star load does).

    Small dimensions come first: their names have become keys where a large one shuffles the sales.
    ``fact_id`` is computed after them (default: the sales' own ``sales_fact_id``)."""
    f = sales.withColumns({
        "year": F.year("order_date"), "month": F.month("order_date"),
        "category_name": F.col("category"), "ship_mode_name": F.col("ship_mode"),
    })
    for name, (key, natural, _attrs) in sorted(DIMENSIONS.items(), key=lambda d: rows.get(d[0], float("inf"))):
        lookup = maybe_broadcast(dims[name].select(key, *natural), rows.get(name))
        f = f.join(lookup, natural, "inner")
    if fact_id is not None:
        f = f.withColumn("sales_fact_id", fact_id)
    return f.select(*FACT_COLUMNS)


def build_star(sales: DataFrame, storage: Storage, prefix: str = "star") -> Star:
    """Write the five dimensions and the fact under ``prefix``; return them.

    ``sales`` must carry ``line_no``; the star's integer ``sales_fact_id``
    is ``line_no + 1`` (rows are inserted in line order).
    """
    dims, rows = {}, {}
    sources = star_sources_one_scan(sales, storage, prefix)
    for name, (key, natural, attrs) in DIMENSIONS.items():
        keyed, n = dense_keys(sources[name], natural, key, storage, f"{prefix}-{name}",
                              known_rows=sources.counts[name])
        dims[name] = storage.write(keyed.select(key, *natural, *attrs), prefix, name)
        rows[name] = n
    # Facts are inserted in line order: id = line_no + 1 when line numbers are
    # global (driver tables), else the load-order number (CSV files).
    fact_id = F.col("fact_seq") if "fact_seq" in sales.columns else F.col("line_no") + 1
    fact = storage.write(fact_rows(sales, dims, rows, fact_id), prefix, "fact_sales", codec=LARGE_CODEC)
    return Star(**dims, fact_sales=fact, rows=rows)


def evolve_fact(fact: DataFrame) -> DataFrame:
    """Add ``order_id`` / ``line_no`` when an older fact lacks them."""
    if "order_id" not in fact.columns:
        fact = fact.withColumn("order_id", F.lit(None).cast("string"))
    if "line_no" not in fact.columns:
        fact = fact.withColumn("line_no", F.lit(None).cast("long"))
    return fact


# ---------------------------------------------------------------------------
# The ten questions
# ---------------------------------------------------------------------------

def _by_key(star: Star, key: str, **aggs) -> DataFrame:
    """Fact pre-aggregated by one surrogate key (map-side partial aggregation)."""
    return star.fact_sales.groupBy(key).agg(*[a.alias(n) for n, a in aggs.items()])


def _joined(star: Star, dim: str, key: str, **aggs) -> DataFrame:
    return _by_key(star, key, **aggs).join(star.dim(dim), key)


def q1_top_products(star: Star) -> DataFrame:
    j = _joined(star, "dim_product", "product_key", s=F.sum("sales_amount"))
    return (j.groupBy("product_name").agg(money(F.sum("s")).alias("revenue"))
            .orderBy(F.desc("revenue"), "product_name").limit(10))


def q2_monthly_revenue(star: Star) -> DataFrame:
    j = _joined(star, "dim_date", "date_key", s=F.sum("sales_amount"))
    return (j.groupBy("year", "month").agg(money(F.sum("s")).alias("revenue"))
            .orderBy("year", "month"))


def q3_top_customers(star: Star) -> DataFrame:
    j = _joined(star, "dim_customer", "customer_key", s=F.sum("sales_amount"),
                n=F.count(F.lit(1)))
    return (j.groupBy("customer_name")
            .agg(money(F.sum("s")).alias("total_spent"), F.sum("n").alias("order_count"))
            .orderBy(F.desc("total_spent"), "customer_name").limit(10))


def q4_revenue_by_category(star: Star) -> DataFrame:
    j = _joined(star, "dim_product", "product_key", s=F.sum("sales_amount"))
    return (j.groupBy(F.col("category_name").alias("category"))
            .agg(money(F.sum("s")).alias("total_sales"))
            .orderBy(F.desc("total_sales"), "category"))


def q5_profit_by_state(star: Star) -> DataFrame:
    j = _joined(star, "dim_location", "location_key", p=F.sum("profit_amount"))
    return (j.groupBy("state").agg(money(F.sum("p")).alias("total_profit"))
            .orderBy(F.desc("total_profit"), "state"))


def _product_sales_profit(star: Star) -> DataFrame:
    j = _joined(star, "dim_product", "product_key", s=F.sum("sales_amount"),
                p=F.sum("profit_amount"))
    return j.groupBy("product_name").agg(money(F.sum("s")).alias("total_sales"),
                                         money(F.sum("p")).alias("total_profit"))


def q6_high_sales_low_profit(star: Star) -> DataFrame:
    return (_product_sales_profit(star)
            .orderBy(F.desc("total_sales"), F.asc("total_profit"), "product_name").limit(10))


def q7_low_sales_high_profit(star: Star) -> DataFrame:
    return (_product_sales_profit(star)
            .orderBy(F.asc("total_sales"), F.desc("total_profit"), "product_name").limit(10))


def q8_profit_ratio_by_ship_mode(star: Star) -> DataFrame:
    j = _joined(star, "dim_ship_mode", "ship_mode_key", s=F.sum("sales_amount"),
                p=F.sum("profit_amount"))
    return (j.groupBy(F.col("ship_mode_name").alias("ship_mode"))
            .agg(ratio(F.sum("p"), F.sum("s")).alias("profit_ratio"))
            .orderBy(F.desc_nulls_first("profit_ratio"), "ship_mode"))


def q9_most_frequent_customers(star: Star) -> DataFrame:
    j = _joined(star, "dim_customer", "customer_key", n=F.count("sales_fact_id"))
    return (j.groupBy("customer_name").agg(F.sum("n").alias("order_count"))
            .orderBy(F.desc("order_count"), "customer_name").limit(10))


def q10_lowest_profit_months(star: Star) -> DataFrame:
    j = _joined(star, "dim_date", "date_key", p=F.sum("profit_amount"))
    return (j.groupBy("year", F.col("month_name").alias("month"))
            .agg(money(F.sum("p")).alias("total_profit"))
            .orderBy("total_profit", "year", "month"))


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
