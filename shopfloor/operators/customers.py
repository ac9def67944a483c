"""Customer and order-line operations on the three layouts.

Deletes never touch the files they read: each returns the layout without
the removed rows (lazy frames) plus a one-row frame of counts; the caller
writes the result to a new version (``plans.maintenance``). Key sets are
joined, not collected: ``left_anti`` / ``left_semi`` with the request
frame, which Catalyst broadcasts when its statistics are small and AQE
re-plans from runtime sizes otherwise.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import iso_date
from .graph import EDGE_ENDS, Graph
from .star import Star

_SALE_EDGES = [e for e, (src, _dst) in EDGE_ENDS.items() if src == "Sale"]


def _count(df: DataFrame, metric: str) -> DataFrame:
    """One (metric, value) row: the row count of ``df``."""
    return df.agg(F.lit(metric).alias("metric"), F.count(F.lit(1)).alias("value"))


def _counts(*parts: tuple[DataFrame, str]) -> DataFrame:
    """Several counts as (metric, value) rows."""
    frames = [_count(df, metric) for df, metric in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------------------
# Lookups
# ---------------------------------------------------------------------------

def search_customers(star: Star, q: str, limit: int = 50) -> DataFrame:
    """Customers whose name contains ``q`` (case-blind), with line count,
    sales and profit (zero when they have no lines); most lines first."""
    pattern = "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    matched = star.dim_customer.where(F.col("customer_name").ilike(pattern))
    per_key = (star.fact_sales.join(matched.select("customer_key"), "customer_key", "left_semi")
               .groupBy("customer_key")
               .agg(F.count("sales_fact_id").alias("n"), F.sum("sales_amount").alias("s"),
                    F.sum("profit_amount").alias("p")))
    return (matched.join(per_key, "customer_key", "left")
            .groupBy("customer_name")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("order_count"),
                 F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("total_sales"),
                 F.coalesce(F.sum("p"), F.lit(0)).cast("double").alias("total_profit"))
            .orderBy(F.desc("order_count"), F.asc("customer_name")).limit(limit))


def customer_lines(nested: DataFrame, name: str | Column, limit: int = 500) -> DataFrame:
    """One customer's order lines, flattened, date as ISO text, at most
    ``limit`` (sorted by sale id before the limit, so the cut is stable)."""
    who = name if isinstance(name, Column) else F.lit(name)
    return (nested.where(F.col("customer.customer_name") == who)
            .select("sales_fact_id",
                    F.col("product.product_name").alias("product_name"),
                    F.col("product.category").alias("category"),
                    iso_date("date.year", "date.month", "date.day").alias("date"),
                    F.col("location.state").alias("state"),
                    "ship_mode",
                    F.col("sales_amount").cast("double").alias("sales_amount"),
                    "quantity",
                    F.col("profit_amount").cast("double").alias("profit_amount"))
            .orderBy("sales_fact_id").limit(limit))


def customer_summary(star: Star, names: DataFrame) -> DataFrame:
    """Totals for each requested name (column ``customer_name``); zeros
    for names the star does not know."""
    keys = star.dim_customer.join(names, "customer_name", "left_semi")
    per_key = (star.fact_sales.join(keys.select("customer_key"), "customer_key", "left_semi")
               .groupBy("customer_key")
               .agg(F.count("sales_fact_id").alias("n"), F.sum("sales_amount").alias("s"),
                    F.sum("profit_amount").alias("p")))
    known = keys.join(per_key, "customer_key", "left")
    return (names.join(known, "customer_name", "left")
            .groupBy("customer_name")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("order_count"),
                 F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("total_sales"),
                 F.coalesce(F.sum("p"), F.lit(0)).cast("double").alias("total_profit")))


# ---------------------------------------------------------------------------
# Customer deletes
# ---------------------------------------------------------------------------

def delete_customers_star(star: Star, names: DataFrame) -> tuple[Star, DataFrame]:
    """Drop the customers named in ``names`` and all their facts.
    Unlike the reference, every same-named customer goes (see README)."""
    keys = star.dim_customer.join(names, "customer_name", "left_semi").select("customer_key")
    gone_facts = star.fact_sales.join(keys, "customer_key", "left_semi")
    counts = _counts((gone_facts, "deleted_facts"), (keys, "deleted_customers"))
    new = replace(star,
                  fact_sales=star.fact_sales.join(keys, "customer_key", "left_anti"),
                  dim_customer=star.dim_customer.join(keys, "customer_key", "left_anti"))
    return new, counts


def delete_customers_nested(nested: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``delete_many`` by customer name."""
    who = nested["customer"]["customer_name"]
    kept = nested.join(names, who == names["customer_name"], "left_anti")
    gone = nested.join(names, who == names["customer_name"], "left_semi")
    return kept, _count(gone, "deleted_count")


def _drop_sales(g: Graph, sale_ids: DataFrame) -> dict[str, DataFrame]:
    """Sale nodes in ``sale_ids`` (column ``sales_fact_id``) with every edge
    that touches them (DETACH DELETE)."""
    ids = sale_ids.select(F.col("sales_fact_id").alias("_id"))
    nodes = dict(g.nodes)
    nodes["Sale"] = g.nodes["Sale"].join(ids, F.col("sales_fact_id") == F.col("_id"),
                                         "left_anti")
    edges = dict(g.edges)
    for etype in _SALE_EDGES:
        edges[etype] = g.edges[etype].join(ids, F.col("src") == F.col("_id"), "left_anti")
    return {"nodes": nodes, "edges": edges}


def delete_customers_graph(g: Graph, names: DataFrame) -> tuple[Graph, DataFrame]:
    """MATCH the customer, OPTIONAL MATCH its sales, DETACH DELETE both.
    ``deleted_sales`` counts sales linked to a customer that exists."""
    # The names come first: a request is small, and the edges of all customers aren't shuffled to meet the nodes.
    asked = g.edges["BY_CUSTOMER"].join(names, F.col("dst") == names["customer_name"], "left_semi")
    sales = (asked.join(g.nodes["Customer"], F.col("dst") == F.col("customer_name"), "left_semi")
             .select(F.col("src").alias("sales_fact_id")).distinct())
    parts = _drop_sales(g, sales)
    parts["nodes"]["Customer"] = g.nodes["Customer"].join(names, "customer_name", "left_anti")
    parts["edges"]["BY_CUSTOMER"] = parts["edges"]["BY_CUSTOMER"].join(
        names, F.col("dst") == names["customer_name"], "left_anti")
    counts = _count(g.nodes["Sale"].join(sales, "sales_fact_id", "left_semi"), "deleted_sales")
    return Graph(parts["nodes"], parts["edges"], g.rows), counts


# ---------------------------------------------------------------------------
# Order-line deletes
# ---------------------------------------------------------------------------

SALE_ID_PATTERN = r"^(.+)-([0-9]+)$"


def parse_sale_ids(ids: DataFrame, col: str = "sales_fact_id") -> DataFrame:
    """Split each id at its last dash into (order_id, line_no); ids
    without a dash, an empty side, or a tail that is no 64-bit number get ``parsed=false``."""
    c = F.col(col)
    line_no = F.regexp_extract(c, SALE_ID_PATTERN, 2).try_cast("long")
    ok = c.rlike(SALE_ID_PATTERN) & line_no.isNotNull()
    return ids.select(
        c.alias("sales_fact_id"),
        F.when(ok, F.regexp_extract(c, SALE_ID_PATTERN, 1)).alias("order_id"),
        F.when(ok, line_no).alias("line_no"),
        ok.alias("parsed"),
    )


def delete_lines_star(star: Star, ids: DataFrame) -> tuple[Star, DataFrame]:
    """Delete facts by (order_id, line_no) parsed from the sale ids."""
    parsed = parse_sale_ids(ids)
    keys = parsed.where("parsed").select("order_id", "line_no").distinct()
    gone = star.fact_sales.join(keys, ["order_id", "line_no"], "left_semi")
    counts = _counts((gone, "deleted_count"), (parsed.where("parsed"), "requested"),
                     (parsed.where(~F.col("parsed")), "unparseable"))
    new = replace(star, fact_sales=star.fact_sales.join(keys, ["order_id", "line_no"],
                                                        "left_anti"))
    return new, counts


def delete_lines_nested(nested: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``delete_many({sales_fact_id: {$in: ids}})``."""
    keys = ids.select("sales_fact_id").distinct()
    gone = nested.join(keys, "sales_fact_id", "left_semi")
    return nested.join(keys, "sales_fact_id", "left_anti"), _count(gone, "deleted_count")


def delete_lines_graph(g: Graph, ids: DataFrame) -> tuple[Graph, DataFrame]:
    """DETACH DELETE the Sale nodes with these ids."""
    keys = ids.select("sales_fact_id").distinct()
    counts = _count(g.nodes["Sale"].join(keys, "sales_fact_id", "left_semi"), "deleted_count")
    parts = _drop_sales(g, keys)
    return Graph(parts["nodes"], parts["edges"], g.rows), counts
