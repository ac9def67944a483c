"""Catalogue entries beyond the thirty layout questions: summaries, customer
operations, deletes. Each entry reads the warehouse written from the given
tables, so its work grows with them.

Requests that need a subject derive it from the data: the *frequent
customer* is the one with the most order lines (ties: smallest name), the
*pending orders* are those with ``o_orderstatus = 'P'`` (cancelled here).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import plain
from ..operators import customers as cust
from ..operators import star as star_ops
from ..operators import summaries as summ
from ..sources.tables import read_table
from ..session import shared_dir
from .catalog import register
from .maintenance import StoredLayouts
from .oracle import PROFIT, SALES, per_group, ratio, with_ctes
from .warehouse import Warehouse

SEARCH_TEXT = "customer#00000012"

# ---------------------------------------------------------------------------
# Shared subjects
# ---------------------------------------------------------------------------


def frequent_customer(wh: Warehouse) -> DataFrame:
    """One-row frame: the customer with the most order lines."""
    return (star_ops.q9_most_frequent_customers(wh.star()).limit(1)
            .select("customer_name"))


def pending_order_ids(wh: Warehouse) -> DataFrame:
    """Sale ids of every line of a pending order."""
    orders = (read_table(wh.spark, wh.sf_dir, "orders").where(F.col("o_orderstatus") == "P")
              .select(F.col("o_orderkey").cast("string").alias("order_id")))
    return wh.sales().join(orders, "order_id", "left_semi").select("sales_fact_id")


TARGET_SQL = """
target AS (SELECT customer_name FROM sales GROUP BY customer_name
           ORDER BY COUNT(*) DESC, customer_name LIMIT 1)"""

PENDING_SQL = """
pending AS (SELECT s.sales_fact_id, s.order_id, s.line_no FROM sales s
            JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = s.order_id
            WHERE o.o_orderstatus = 'P')"""


def _with(body: str, *layers: str, target: bool = False, pending: bool = False) -> str:
    """CTE prelude (sales + layers + optional subjects) followed by ``body``."""
    text = with_ctes("SELECT 1", *layers)
    prelude = text[: text.rindex("\nSELECT 1")]
    extras = ([TARGET_SQL] if target else []) + ([PENDING_SQL] if pending else [])
    for e in extras:
        prelude += "," + e
    return prelude + "\n" + body.strip()


def _wh(spark: SparkSession, d: str) -> Warehouse:
    return Warehouse.open(spark, d)


# ---------------------------------------------------------------------------
# Summaries (M1-M5 x 3 layouts)
# ---------------------------------------------------------------------------

_TOTALS = {"total_revenue": SALES, "total_profit": PROFIT}

# The star's summaries, from the order lines; a customer's key is its place among the names.
_STAR_SUMMARY_SQL = {
    "m1_monthly": per_group({"year": "year", "month": "month", "month_name": "month_name"},
                            {**_TOTALS, "order_count": "COUNT(*)"}),
    "m2_category": per_group({"category_name": "category"}, {**_TOTALS, "units_sold": "CAST(SUM(quantity) AS BIGINT)"}),
    "m3_region_state": per_group({"region": "region", "state": "state"}, _TOTALS),
    "m4_ship_mode": per_group({"ship_mode_name": "ship_mode"},
                              {**_TOTALS, "profit_ratio": ratio("SUM(profit_amount)", "SUM(sales_amount)")}),
    "m5_customer": "SELECT dense_rank() OVER (ORDER BY customer_name NULLS FIRST) AS customer_key, t.* FROM (" + per_group(
        {"customer_name": "customer_name"}, {"total_revenue": SALES, "order_count": "COUNT(*)"}) + ") t",
}

_NESTED_SUMMARY_SQL = {
    "m1_monthly": """
SELECT year, month, MIN(month_name) AS month_name,
       CAST(SUM(sales_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(profit_amount) AS DOUBLE) AS total_profit, COUNT(*) AS order_count
FROM sales GROUP BY year, month""",
    "m2_category": """
SELECT category, CAST(SUM(sales_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(profit_amount) AS DOUBLE) AS total_profit,
       CAST(SUM(quantity) AS BIGINT) AS units_sold
FROM sales GROUP BY category""",
    "m3_region_state": """
SELECT region, state, CAST(SUM(sales_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(profit_amount) AS DOUBLE) AS total_profit
FROM sales GROUP BY region, state""",
    "m4_ship_mode": """
SELECT ship_mode, CAST(SUM(sales_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(profit_amount) AS DOUBLE) AS total_profit,
       CASE WHEN SUM(sales_amount) = 0 THEN NULL
            ELSE CAST(SUM(profit_amount) AS DOUBLE) / CAST(SUM(sales_amount) AS DOUBLE) END
         AS profit_ratio
FROM sales GROUP BY ship_mode""",
    "m5_customer": """
SELECT customer_name, CAST(SUM(sales_amount) AS DOUBLE) AS total_revenue,
       COUNT(*) AS order_count
FROM sales GROUP BY customer_name""",
}

_GRAPH_SUMMARY_SQL = {
    "m1_monthly": """
SELECT m.year, m.month, m.month_name, CAST(SUM(s.sales_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(s.profit_amount) AS DOUBLE) AS total_profit, COUNT(*) AS order_count
FROM sale_node s JOIN on_date od ON od.src = s.sales_fact_id
JOIN in_month im ON im.src = od.dst
JOIN month_node m ON m.year = im.dst_year AND m.month = im.dst_month
GROUP BY m.year, m.month, m.month_name""",
    "m2_category": """
SELECT ic.dst AS category_name, CAST(SUM(s.sales_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(s.profit_amount) AS DOUBLE) AS total_profit,
       CAST(SUM(s.quantity) AS BIGINT) AS units_sold
FROM sale_node s JOIN of_product e ON e.src = s.sales_fact_id
JOIN in_category ic ON ic.src = e.dst GROUP BY ic.dst""",
    "m3_region_state": """
SELECT st.state_name, st.region, CAST(SUM(s.sales_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(s.profit_amount) AS DOUBLE) AS total_profit
FROM sale_node s JOIN shipped_to e ON e.src = s.sales_fact_id
JOIN state_node st ON st.state_name = e.dst GROUP BY st.state_name, st.region""",
    "m4_ship_mode": """
SELECT e.dst AS ship_mode_name, CAST(SUM(s.sales_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(s.profit_amount) AS DOUBLE) AS total_profit,
       CASE WHEN SUM(s.sales_amount) = 0 THEN NULL
            ELSE CAST(SUM(s.profit_amount) AS DOUBLE) / CAST(SUM(s.sales_amount) AS DOUBLE) END
         AS profit_ratio
FROM sale_node s JOIN uses_ship_mode e ON e.src = s.sales_fact_id GROUP BY e.dst""",
    "m5_customer": """
SELECT e.dst AS customer_name, CAST(SUM(s.sales_amount) AS DOUBLE) AS total_revenue,
       COUNT(*) AS order_count
FROM sale_node s JOIN by_customer e ON e.src = s.sales_fact_id GROUP BY e.dst""",
}

_STAR_FNS = dict(zip(_STAR_SUMMARY_SQL, summ.STAR_BUILDERS.values()))
_NESTED_FNS = dict(zip(_NESTED_SUMMARY_SQL, [b for b, _k in summ.NESTED_BUILDERS.values()]))
_GRAPH_FNS = dict(zip(_GRAPH_SUMMARY_SQL, [b for b, _k, _l in summ.GRAPH_BUILDERS.values()]))


def _register_summaries() -> None:
    for key, fn in _STAR_FNS.items():
        register(f"star_{key}", _with(_STAR_SUMMARY_SQL[key]))(
            lambda spark, d, fn=fn: plain(fn(_wh(spark, d).star())))
    for key, fn in _NESTED_FNS.items():
        register(f"nested_{key}", _with(_NESTED_SUMMARY_SQL[key]))(
            lambda spark, d, fn=fn: plain(fn(_wh(spark, d).nested())))
    for key, fn in _GRAPH_FNS.items():
        register(f"graph_{key}", _with(_GRAPH_SUMMARY_SQL[key], "graph"))(
            lambda spark, d, fn=fn: plain(fn(_wh(spark, d).graph())))


_register_summaries()


@register("star_m6_refresh_manifest", _with("""
SELECT 'summary_monthly_revenue' AS table_name, COUNT(*) AS row_count
  FROM (SELECT DISTINCT year, month FROM sales) t
UNION ALL SELECT 'summary_category_performance', COUNT(DISTINCT category) FROM sales
UNION ALL SELECT 'summary_region_state_profit', COUNT(*)
  FROM (SELECT DISTINCT region, state FROM sales) t
UNION ALL SELECT 'summary_ship_mode_profitability', COUNT(DISTINCT ship_mode) FROM sales
UNION ALL SELECT 'summary_customer_ranking', COUNT(DISTINCT customer_name) FROM sales"""))
def star_m6_refresh_manifest(spark: SparkSession, d: str) -> DataFrame:
    """M6: rebuild the five star summaries as one new version, publish it,
    and report the row count of each published table."""
    wh = _wh(spark, d)
    tables = summ.refresh_star_summaries(wh.star(), wh.storage)
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# Stale groups after a delete: gone in the star, kept by the keyed merges
# ---------------------------------------------------------------------------

@register("star_m5_after_customer_delete", _with(
    f"SELECT * FROM ({_STAR_SUMMARY_SQL['m5_customer']}) m WHERE customer_name NOT IN (SELECT customer_name FROM target)",
    target=True))
def star_m5_after_customer_delete(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    new_star, _ = cust.delete_customers_star(wh.star(), frequent_customer(wh))
    return plain(summ.star_customer(new_star))


@register("nested_m7_after_customer_delete", _with(_NESTED_SUMMARY_SQL["m5_customer"]))
def nested_m7_after_customer_delete(spark: SparkSession, d: str) -> DataFrame:
    """Keyed merge of the recomputed customer summary into the old one: the
    deleted customer's row stays, as with ``$merge``."""
    wh = _wh(spark, d)
    before = summ.nested_customer(wh.nested())
    after_nested, _ = cust.delete_customers_nested(wh.nested(), frequent_customer(wh))
    merged = summ.merge_by_key(before, summ.nested_customer(after_nested), ["customer_name"])
    return plain(merged)


@register("graph_m7_after_customer_delete", _with(_GRAPH_SUMMARY_SQL["m5_customer"], "graph"))
def graph_m7_after_customer_delete(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    before = summ.graph_customer(wh.graph())
    after_graph, _ = cust.delete_customers_graph(wh.graph(), frequent_customer(wh))
    merged = summ.merge_by_key(before, summ.graph_customer(after_graph), ["customer_name"])
    return plain(merged)


@register("graph_m8_summarises", _with("""
SELECT 'MonthlyRevenue' AS summary, CAST(year AS VARCHAR) || '-' || CAST(month AS VARCHAR) AS src,
       CAST(year AS VARCHAR) || '-' || CAST(month AS VARCHAR) AS dst
  FROM (SELECT DISTINCT year, month FROM sales) t
UNION ALL SELECT DISTINCT 'CategoryPerformance', category, category FROM sales
UNION ALL SELECT DISTINCT 'StateProfit', state, state FROM sales
UNION ALL SELECT DISTINCT 'ShipModeProfitability', ship_mode, ship_mode FROM sales
UNION ALL SELECT DISTINCT 'CustomerRanking', customer_name, customer_name FROM sales"""))
def graph_m8_summarises(spark: SparkSession, d: str) -> DataFrame:
    """M8: SUMMARISES edges of the five graph summaries (keys as text)."""
    g = _wh(spark, d).graph()
    out = None
    for label, (build, keys, _target) in summ.GRAPH_BUILDERS.items():
        e = summ.summarises_edges(build(g), keys)
        if len(keys) > 1:
            e = e.select(*[F.concat_ws("-", *[F.col(f"{end}.{k}").cast("string") for k in keys])
                           .alias(end) for end in ("src", "dst")])
        e = e.select(F.lit(label).alias("summary"), F.col("src").cast("string").alias("src"),
                     F.col("dst").cast("string").alias("dst"))
        out = e if out is None else out.unionByName(e)
    return out


# ---------------------------------------------------------------------------
# Customer operations
# ---------------------------------------------------------------------------

_CUSTOMER_TOTALS = {"order_count": "COUNT(*)", "total_sales": SALES, "total_profit": PROFIT}


@register("customer_search", _with(per_group(
    {"customer_name": "customer_name"}, _CUSTOMER_TOTALS, "order_count DESC, customer_name", 50,
    f"(SELECT * FROM sales WHERE contains(lower(customer_name), '{SEARCH_TEXT}'))")))
def customer_search(spark: SparkSession, d: str) -> DataFrame:
    return cust.search_customers(_wh(spark, d).star(), SEARCH_TEXT)


@register("customer_lines", _with("""
SELECT sales_fact_id, product_name, category, strftime(order_date, '%Y-%m-%d') AS date, state,
       ship_mode, CAST(sales_amount AS DOUBLE) AS sales_amount, quantity,
       CAST(profit_amount AS DOUBLE) AS profit_amount
FROM sales WHERE customer_name = (SELECT customer_name FROM target)
ORDER BY sales_fact_id LIMIT 500""", target=True))
def customer_lines(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    nested = wh.nested().join(frequent_customer(wh).withColumnRenamed("customer_name", "_who"),
                              F.col("customer.customer_name") == F.col("_who"), "left_semi")
    return cust.customer_lines(nested, F.col("customer.customer_name"))


@register("customer_summary", _with(per_group(
    {"customer_name": "customer_name"}, _CUSTOMER_TOTALS, rows="(SELECT * FROM sales WHERE customer_name IN (FROM target))")
    + " UNION ALL SELECT 'Nobody Known', 0, 0, 0", target=True))
def customer_summary(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    unknown = spark.range(1).select(F.lit("Nobody Known").alias("customer_name"))
    return cust.customer_summary(wh.star(), frequent_customer(wh).unionByName(unknown))


@register("star_delete_customer_counts", _with("""
SELECT 'deleted_facts' AS metric, COUNT(*) AS value FROM sales
 WHERE customer_name IN (SELECT customer_name FROM target)
UNION ALL SELECT 'deleted_customers', COUNT(*) FROM target""", target=True))
def star_delete_customer_counts(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    return cust.delete_customers_star(wh.star(), frequent_customer(wh))[1]


@register("star_q3_after_customer_delete", _with("""
SELECT c.customer_name, CAST(SUM(f.sales_amount) AS DOUBLE) AS total_spent,
       COUNT(*) AS order_count
FROM fact_sales f JOIN dim_customer c ON f.customer_key = c.customer_key
WHERE c.customer_name NOT IN (SELECT customer_name FROM target)
GROUP BY c.customer_name ORDER BY total_spent DESC, customer_name LIMIT 10""", "star",
                                                  target=True))
def star_q3_after_customer_delete(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    return star_ops.q3_top_customers(cust.delete_customers_star(wh.star(),
                                                                frequent_customer(wh))[0])


@register("nested_delete_customer_counts", _with("""
SELECT 'deleted_count' AS metric, COUNT(*) AS value FROM sales
 WHERE customer_name IN (SELECT customer_name FROM target)""", target=True))
def nested_delete_customer_counts(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    return cust.delete_customers_nested(wh.nested(), frequent_customer(wh))[1]


@register("graph_delete_customer_counts", _with("""
SELECT 'deleted_sales' AS metric, COUNT(*) AS value FROM sales
 WHERE customer_name IN (SELECT customer_name FROM target)""", target=True))
def graph_delete_customer_counts(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    return cust.delete_customers_graph(wh.graph(), frequent_customer(wh))[1]


@register("graph_q9_after_customer_delete", _with("""
SELECT e.dst AS customer_name, COUNT(s.sales_fact_id) AS order_count
FROM sale_node s JOIN by_customer e ON e.src = s.sales_fact_id
WHERE e.dst NOT IN (SELECT customer_name FROM target)
GROUP BY e.dst ORDER BY order_count DESC, customer_name LIMIT 10""", "graph", target=True))
def graph_q9_after_customer_delete(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import graph as graph_ops
    wh = _wh(spark, d)
    g, _ = cust.delete_customers_graph(wh.graph(), frequent_customer(wh))
    return graph_ops.q9_most_frequent_customers(g)


# ---------------------------------------------------------------------------
# Order-line deletes (N7-N10): cancel every line of the pending orders
# ---------------------------------------------------------------------------

@register("sale_id_parse", _with("""
SELECT sales_fact_id, order_id, CAST(line_no AS BIGINT) AS line_no, TRUE AS parsed
FROM sales"""))
def sale_id_parse(spark: SparkSession, d: str) -> DataFrame:
    return cust.parse_sale_ids(_wh(spark, d).nested().select("sales_fact_id"))


@register("star_delete_pending_counts", _with("""
SELECT 'deleted_count' AS metric, COUNT(*) AS value FROM pending
UNION ALL SELECT 'requested', COUNT(*) FROM pending
UNION ALL SELECT 'unparseable', 0""", pending=True))
def star_delete_pending_counts(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    return cust.delete_lines_star(wh.star(), pending_order_ids(wh))[1]


@register("star_q5_after_pending_delete", _with("""
SELECT l.state, CAST(SUM(f.profit_amount) AS DOUBLE) AS total_profit
FROM fact_sales f JOIN dim_location l ON f.location_key = l.location_key
WHERE f.line_no NOT IN (SELECT line_no FROM pending)
GROUP BY l.state ORDER BY total_profit DESC""", "star", pending=True))
def star_q5_after_pending_delete(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    return star_ops.q5_profit_by_state(cust.delete_lines_star(wh.star(),
                                                              pending_order_ids(wh))[0])


@register("nested_delete_pending_counts", _with("""
SELECT 'deleted_count' AS metric, COUNT(*) AS value FROM pending""", pending=True))
def nested_delete_pending_counts(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    return cust.delete_lines_nested(wh.nested(), pending_order_ids(wh))[1]


@register("nested_q4_after_pending_delete", _with("""
SELECT category, CAST(SUM(sales_amount) AS DOUBLE) AS total_sales FROM sales
WHERE sales_fact_id NOT IN (SELECT sales_fact_id FROM pending)
GROUP BY category ORDER BY total_sales DESC""", pending=True))
def nested_q4_after_pending_delete(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import nested as nested_ops
    wh = _wh(spark, d)
    return nested_ops.q4_revenue_by_category(
        cust.delete_lines_nested(wh.nested(), pending_order_ids(wh))[0])


@register("graph_delete_pending_counts", _with("""
SELECT 'deleted_count' AS metric, COUNT(*) AS value FROM pending""", pending=True))
def graph_delete_pending_counts(spark: SparkSession, d: str) -> DataFrame:
    wh = _wh(spark, d)
    return cust.delete_lines_graph(wh.graph(), pending_order_ids(wh))[1]


@register("graph_q4_after_pending_delete", _with("""
SELECT ic.dst AS category, CAST(SUM(s.sales_amount) AS DOUBLE) AS total_sales
FROM sale_node s JOIN of_product e ON e.src = s.sales_fact_id
JOIN in_category ic ON ic.src = e.dst
WHERE s.sales_fact_id NOT IN (SELECT sales_fact_id FROM pending)
GROUP BY ic.dst ORDER BY total_sales DESC""", "graph", pending=True))
def graph_q4_after_pending_delete(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import graph as graph_ops
    wh = _wh(spark, d)
    g, _ = cust.delete_lines_graph(wh.graph(), pending_order_ids(wh))
    return graph_ops.q4_revenue_by_category(g)


# ---------------------------------------------------------------------------
# Deletes that persist: the stored layouts are read back after the delete
# ---------------------------------------------------------------------------

_STORED: dict[tuple[str, str, str], StoredLayouts] = {}


def _stored_after(wh: Warehouse, gone: str) -> StoredLayouts:
    """Layouts stored anew, after the delete of the frequent ``customer`` or of the ``pending`` orders' lines. The
    entries of one application that read the same state share it, as they share the warehouse."""
    key = (wh.spark.sparkContext.applicationId, wh.sf_dir, gone)
    if key not in _STORED:
        root = f"{shared_dir(wh.spark)}/stored-{uuid.uuid4().hex}"
        stored = StoredLayouts.create(wh.spark, root, wh.star(), wh.nested(), wh.graph())
        if gone == "customer":
            stored.delete_customers(frequent_customer(wh))
        else:
            stored.delete_lines(pending_order_ids(wh))
        _STORED[key] = stored
    return _STORED[key]


_MONTHS_LEFT_SQL = """
left_over AS (SELECT * FROM sales WHERE NOT ({gone})),
months AS (SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
                  COUNT(*) AS lines, CAST(SUM(sales_amount) AS DOUBLE) AS revenue FROM left_over GROUP BY 1, 2)"""


def _months_sql(gone: str, **subject) -> str:
    body = f"""
SELECT layout, m.* FROM (WITH {_MONTHS_LEFT_SQL.format(gone=gone).lstrip()} SELECT * FROM months) m,
       (VALUES ('star'), ('nested'), ('graph')) AS l(layout)"""
    return _with(body, **subject)


@register("stored_months_after_customer_delete",
          _months_sql("customer_name IN (SELECT customer_name FROM target)", target=True))
def stored_months_after_customer_delete(spark: SparkSession, d: str) -> DataFrame:
    stored = _stored_after(_wh(spark, d), "customer")
    return stored.months()


@register("stored_months_after_pending_delete",
          _months_sql("sales_fact_id IN (SELECT sales_fact_id FROM pending)", pending=True))
def stored_months_after_pending_delete(spark: SparkSession, d: str) -> DataFrame:
    stored = _stored_after(_wh(spark, d), "pending")
    return stored.months()


# ---------------------------------------------------------------------------
# M7, M8: the stored summaries after a delete, kept by the parts it touched
# ---------------------------------------------------------------------------

_SUMMARY_COLUMNS = {"total_revenue": "double", "total_profit": "double", "units_sold": "long", "order_count": "long",
                    "profit_ratio": "double"}
_SUMMARY_MEASURES = {**_TOTALS, "units_sold": "CAST(SUM(quantity) AS BIGINT)", "order_count": "COUNT(*)",
                     "profit_ratio": "CASE WHEN SUM(sales_amount) <> 0 THEN "
                     f"{PROFIT} / {SALES} END"}


def _all_summaries(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """summary, group (keys as text) and all measures, null where a summary has none."""
    frames = []
    for name, (table, keys) in tables.items():
        group = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
        frames.append(table.select(F.lit(name).alias("summary"), group.alias("grp"), *(
            (F.col(c) if c in table.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _SUMMARY_COLUMNS.items())))
    return reduce(DataFrame.unionByName, frames)


def _summaries_sql(groups: dict[str, tuple[str, list[str]]], gone: str, by_hop: bool = False) -> str:
    """The same from the order lines that are left: summary -> (group as text, its measures). By hops, a product's
    lines count in every category that it was ever sold in."""
    parts = []
    for name, (group, measures) in groups.items():
        columns = {c: _SUMMARY_MEASURES[c] if c in measures else "NULL" for c in _SUMMARY_COLUMNS}
        rows = f"(SELECT * FROM sales WHERE NOT ({gone}))"
        if by_hop and group == "category":
            rows = (f"(SELECT s.* EXCLUDE (category), k.category FROM {rows} s "
                    "JOIN (SELECT DISTINCT product_name, category FROM sales) k USING (product_name))")
        parts.append(per_group({"grp": group}, {"summary": f"'{name}'", **columns}, rows=rows))
    return " UNION ALL BY NAME ".join(parts)


_GROUPS = [("year || '|' || month", [*_TOTALS, "order_count"]), ("category", [*_TOTALS, "units_sold"]),
           ("region || '|' || state", [*_TOTALS]), ("ship_mode", [*_TOTALS, "profit_ratio"]),
           ("customer_name", ["total_revenue", "order_count"])]
_GRAPH_GROUPS = dict(zip(summ.GRAPH_BUILDERS, [*_GROUPS[:2], ("state", [*_TOTALS]), *_GROUPS[3:]]))


@register("nested_summaries_after_pending_delete", _with(_summaries_sql(
    dict(zip(summ.NESTED_BUILDERS, _GROUPS)), "sales_fact_id IN (SELECT sales_fact_id FROM pending)"), pending=True))
def nested_summaries_after_pending_delete(spark: SparkSession, d: str) -> DataFrame:
    """The five nested summaries that the stored layouts keep, after the lines of pending orders went."""
    stored = _stored_after(_wh(spark, d), "pending")
    tables = stored.nested_summaries()
    return _all_summaries({name: (tables[name], keys) for name, (_, keys) in summ.NESTED_BUILDERS.items()})


@register("graph_summaries_after_customer_delete", _with(_summaries_sql(
    _GRAPH_GROUPS, "customer_name IN (SELECT customer_name FROM target)", by_hop=True), target=True))
def graph_summaries_after_customer_delete(spark: SparkSession, d: str) -> DataFrame:
    """The five graph summaries that the stored layouts keep, after the most frequent customer went."""
    stored = _stored_after(_wh(spark, d), "customer")
    tables = stored.graph_summaries()
    return _all_summaries({label: (tables[label], keys) for label, (_, keys, _) in summ.GRAPH_BUILDERS.items()})


@register("graph_summarises_after_customer_delete", _with(
    " UNION ALL ".join(f"SELECT DISTINCT '{label}' AS summary, {group} AS src, {group} AS dst FROM sales "
                       "WHERE customer_name NOT IN (SELECT customer_name FROM target)"
                       for label, (group, _) in _GRAPH_GROUPS.items()), target=True))
def graph_summarises_after_customer_delete(spark: SparkSession, d: str) -> DataFrame:
    """M8 after a stored delete: the customer's ranking and its SUMMARISES edge are gone."""
    stored = _stored_after(_wh(spark, d), "customer")
    frames = []
    for label, edges in stored.summarises().items():
        several = len(summ.GRAPH_BUILDERS[label][1]) > 1
        ends = [(F.concat_ws("|", f"{e}.*") if several else F.col(e)).cast("string").alias(e) for e in ("src", "dst")]
        frames.append(edges.select(F.lit(label).alias("summary"), *ends))
    return reduce(DataFrame.unionByName, frames)
