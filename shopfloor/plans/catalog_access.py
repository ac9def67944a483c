"""Catalogue entries: reconcile (R1), ad-hoc access (A1-A6), key checks
(L12), schema evolution (L7), dimensions and facts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import plain
from ..operators import adhoc
from ..operators import checks
from ..operators import graph as graph_ops
from ..operators import nested as nested_ops
from ..operators import star as star_ops
from ..operators.reconcile import keyed, reconcile
from . import oracle
from .catalog import register
from .warehouse import Warehouse


def _wh(spark: SparkSession, d: str) -> Warehouse:
    return Warehouse.open(spark, d)


def _month_label(year: str, month_name: str) -> Column:
    return F.concat_ws(" ", F.col(year).cast("string"), F.col(month_name))


# ---------------------------------------------------------------------------
# Reconcile each question across the three layouts
# ---------------------------------------------------------------------------

# question: (key per layout (star, nested, graph) as Spark columns, the same
#            in SQL, measure per layout)
_NAME = {"q1_top_products": "product_name", "q3_top_customers": "customer_name",
         "q4_revenue_by_category": "category", "q5_profit_by_state": "state",
         "q6_high_sales_low_profit": "product_name",
         "q7_low_sales_high_profit": "product_name",
         "q8_profit_ratio_by_ship_mode": "ship_mode",
         "q9_most_frequent_customers": "customer_name"}
_MEASURE = {"q1_top_products": "revenue", "q2_monthly_revenue": "revenue",
            "q3_top_customers": "total_spent", "q4_revenue_by_category": "total_sales",
            "q5_profit_by_state": "total_profit", "q6_high_sales_low_profit": "total_sales",
            "q7_low_sales_high_profit": "total_sales",
            "q8_profit_ratio_by_ship_mode": "profit_ratio",
            "q9_most_frequent_customers": "order_count",
            "q10_lowest_profit_months": "total_profit"}


def _key_sql(q: str) -> list[str]:
    """Key expression per layout (star, nested, graph), in SQL."""
    if q in _NAME:
        return [_NAME[q]] * 3
    if q == "q2_monthly_revenue":
        return ["CAST(year AS VARCHAR) || ' ' || monthname(make_date(year, month, 1))",
                "CAST(year AS VARCHAR) || ' ' || month_name",
                "CAST(year AS VARCHAR) || ' ' || month"]
    return ["CAST(year AS VARCHAR) || ' ' || month"] * 3


def _key_cols(q: str) -> list[Column]:
    """The same keys as Spark columns (built at call time, not import)."""
    if q in _NAME:
        return [F.col(_NAME[q])] * 3
    if q == "q2_monthly_revenue":
        star_name = F.date_format(F.make_date("year", "month", F.lit(1)), "MMMM")
        return [F.concat_ws(" ", F.col("year").cast("string"), star_name),
                _month_label("year", "month_name"), _month_label("year", "month")]
    return [_month_label("year", "month")] * 3


def _reconcile_sql(q: str) -> str:
    key_sql = _key_sql(q)
    m = _MEASURE[q]
    bodies = [oracle.STAR_SQL[q], oracle.NESTED_SQL[q], oracle.GRAPH_SQL[q]]
    sides = ["star", "nested", "graph"]
    parts = [f"{s}_r AS (SELECT {k} AS key, CAST({m} AS DOUBLE) AS value FROM ({b.strip()}) x)"
             for s, k, b in zip(sides, key_sql, bodies)]
    prelude = oracle.with_ctes("SELECT 1", "star", "graph")
    prelude = prelude[: prelude.rindex("\nSELECT 1")]
    close = ("abs({a} - {b}) <= 1e-9 * greatest(1.0, abs({a}), abs({b}))")
    eq = " AND ".join(close.format(a="star", b=o) for o in ("nested", "graph"))
    only = ("concat_ws(',', CASE WHEN star IS NOT NULL THEN 'star' END, "
            "CASE WHEN nested IS NOT NULL THEN 'nested' END, "
            "CASE WHEN graph IS NOT NULL THEN 'graph' END)")
    return prelude + "," + ",".join(parts) + f"""
SELECT key, star, nested, graph,
       CASE WHEN star IS NOT NULL AND nested IS NOT NULL AND graph IS NOT NULL AND {eq}
              THEN 'match'
            WHEN star IS NOT NULL AND nested IS NOT NULL AND graph IS NOT NULL THEN 'differs'
            ELSE 'only:' || {only} END AS status
FROM (SELECT COALESCE(s.key, n.key, g.key) AS key, s.value AS star, n.value AS nested,
             g.value AS graph
      FROM star_r s FULL OUTER JOIN nested_r n ON n.key = s.key
      FULL OUTER JOIN graph_r g ON g.key = COALESCE(s.key, n.key)) t"""


def reconcile_question(wh: Warehouse, q: str) -> DataFrame:
    key_cols = _key_cols(q)
    m = _MEASURE[q]
    return reconcile({
        "star": keyed(star_ops.QUESTIONS[q](wh.star()), key_cols[0], m),
        "nested": keyed(nested_ops.QUESTIONS[q](wh.nested()), key_cols[1], m),
        "graph": keyed(graph_ops.QUESTIONS[q](wh.graph()), key_cols[2], m),
    })


def _register_reconcile() -> None:
    for q in star_ops.QUESTIONS:
        register(f"reconcile_{q}", _reconcile_sql(q))(
            lambda spark, d, q=q: reconcile_question(_wh(spark, d), q))


_register_reconcile()


# ---------------------------------------------------------------------------
# A1-A6
# ---------------------------------------------------------------------------

_LOSSES_STATEMENT = """
SELECT l.region, d.year, COUNT(DISTINCT c.customer_name) AS buyers,
       SUM(CASE WHEN f.profit_amount < 0 THEN f.quantity ELSE 0 END) AS units_at_loss
FROM fact_sales f
JOIN dim_location l ON l.location_key = f.location_key
JOIN dim_date d ON d.date_key = f.date_key
JOIN dim_customer c ON c.customer_key = f.customer_key
GROUP BY l.region, d.year"""


@register("adhoc_sql_star", oracle.with_ctes(oracle.per_group(
    {"region": "region", "year": "year"},
    {"buyers": "COUNT(DISTINCT customer_name)",
     "units_at_loss": "CAST(COALESCE(SUM(quantity) FILTER (WHERE profit_amount < 0), 0) AS BIGINT)"})))
def adhoc_sql_star(spark: SparkSession, d: str) -> DataFrame:
    """A1: SQL text over four of the star's views, run by Spark SQL."""
    adhoc.register_star(spark, _wh(spark, d).star())
    return spark.sql(_LOSSES_STATEMENT)


@register("adhoc_find_large_sales", oracle.with_ctes("""
SELECT sales_fact_id, product_name AS product_product_name,
       CAST(sales_amount AS DOUBLE) AS sales_amount
FROM sales WHERE sales_amount > 90000 ORDER BY sales_fact_id LIMIT 100"""))
def adhoc_find_large_sales(spark: SparkSession, d: str) -> DataFrame:
    """A2: find(filter, projection) with the default limit of 100."""
    found = adhoc.find(_wh(spark, d).nested(), F.col("sales_amount") > 90000,
                       ["sales_fact_id", "product.product_name", "sales_amount"])
    return plain(found)


@register("adhoc_stages_ship_mode", oracle.with_ctes(oracle.NESTED_SQL[
    "q8_profit_ratio_by_ship_mode"]))
def adhoc_stages_ship_mode(spark: SparkSession, d: str) -> DataFrame:
    """A3: the ship-mode aggregation written as stage functions."""
    nested = _wh(spark, d).nested()
    mode = nested_ops.first_field(nested, "ship_mode.ship_mode_name", "ship_mode_name",
                                  "ship_mode")
    return adhoc.aggregate(
        nested,
        adhoc.group({"_id": mode}, total_profit=F.sum("profit_amount"),
                    total_sales=F.sum("sales_amount")),
        adhoc.match(adhoc.ne_null("_id")),
        adhoc.add_fields(profit_ratio=F.when(F.col("total_sales") == 0, F.lit(None))
                         .otherwise(F.col("total_profit").cast("double")
                                    / F.col("total_sales").cast("double"))),
        adhoc.sort(F.desc("profit_ratio")),
        adhoc.project(F.col("_id").alias("ship_mode"), "profit_ratio"),
    )


def _mixed_shapes(wh: Warehouse) -> DataFrame:
    """A4: records of two shapes in one set - lines of open orders as older
    flat records (top-level customer_name, year, month), the rest nested."""
    from .catalog_more import pending_order_ids
    pending = pending_order_ids(wh)
    sales = wh.sales()
    flat = (sales.join(pending, "sales_fact_id", "left_semi")
            .select("sales_fact_id", "sales_amount", "quantity", "profit_amount",
                    "customer_name", "year", F.col("month_name").alias("month"), "ship_mode"))
    nested = wh.nested().join(pending, "sales_fact_id", "left_anti")
    return adhoc.union_records(nested, flat)


@register("nested_q9_mixed_shapes", oracle.with_ctes(
    oracle.NESTED_SQL["q9_most_frequent_customers"]))
def nested_q9_mixed_shapes(spark: SparkSession, d: str) -> DataFrame:
    return nested_ops.q9_most_frequent_customers(_mixed_shapes(_wh(spark, d)))


@register("nested_q10_mixed_shapes", oracle.with_ctes(
    oracle.NESTED_SQL["q10_lowest_profit_months"]))
def nested_q10_mixed_shapes(spark: SparkSession, d: str) -> DataFrame:
    return nested_ops.q10_lowest_profit_months(_mixed_shapes(_wh(spark, d)))


@register("graph_customers_optional_sales", oracle.with_ctes("""
SELECT c.customer_name, COUNT(e.src) AS sales
FROM (SELECT DISTINCT customer_name FROM sales) c
LEFT JOIN by_customer e ON e.dst = c.customer_name
GROUP BY c.customer_name""", "graph"))
def graph_customers_optional_sales(spark: SparkSession, d: str) -> DataFrame:
    """MATCH (u:Customer) OPTIONAL MATCH (s:Sale)-[:BY_CUSTOMER]->(u)."""
    g = _wh(spark, d).graph()
    rows = graph_ops.optional_hop(g.nodes["Customer"], "customer_name", g, "BY_CUSTOMER",
                                  reverse=True)
    return rows.groupBy("customer_name").agg(F.count("by_customer_end").alias("sales"))


# ---------------------------------------------------------------------------
# The layout tables themselves
# ---------------------------------------------------------------------------

def _register_star_tables() -> None:
    cols = {
        "dim_date": "date_key, month, month_name, year",
        "dim_product": "product_key, product_name, category_name",
        "dim_customer": "customer_key, customer_name",
        "dim_location": "location_key, state, region",
        "dim_ship_mode": "ship_mode_key, ship_mode_name",
        "fact_sales": ("sales_fact_id, date_key, product_key, customer_key, location_key, "
                       "ship_mode_key, CAST(sales_amount AS DOUBLE) AS sales_amount, quantity, "
                       "CAST(profit_amount AS DOUBLE) AS profit_amount, order_id, line_no"),
    }
    for name, sel in cols.items():
        register(f"star_{name}", oracle.with_ctes(f"SELECT {sel} FROM {name}", "star"))(
            lambda spark, d, name=name: plain(_wh(spark, d).star().tables()[name]))


_register_star_tables()


@register("star_fact_evolved", oracle.with_ctes("""
SELECT sales_fact_id, date_key, product_key, customer_key, location_key, ship_mode_key,
       CAST(sales_amount AS DOUBLE) AS sales_amount, quantity,
       CAST(profit_amount AS DOUBLE) AS profit_amount,
       CAST(NULL AS VARCHAR) AS order_id, CAST(NULL AS BIGINT) AS line_no
FROM fact_sales""", "star"))
def star_fact_evolved(spark: SparkSession, d: str) -> DataFrame:
    """A fact written before the order-line columns existed, read with them."""
    old = _wh(spark, d).star().fact_sales.drop("order_id", "line_no")
    return plain(star_ops.evolve_fact(old))


@register("nested_records_flat", oracle.with_ctes("""
SELECT sales_fact_id, CAST(sales_amount AS DOUBLE) AS sales_amount, quantity,
       CAST(profit_amount AS DOUBLE) AS profit_amount, product_name, category, customer_name,
       day, month, month_name, year, state, region, ship_mode
FROM sales"""))
def nested_records_flat(spark: SparkSession, d: str) -> DataFrame:
    """L8 (flattened): every nested record, struct fields as columns."""
    n = _wh(spark, d).nested()
    return plain(n.select("sales_fact_id", "sales_amount", "quantity", "profit_amount",
                          "product.*", "customer.*", "date.*", "location.*", "ship_mode"))


_GRAPH_NODE_SQL = {
    "Sale": ("SELECT sales_fact_id, CAST(sales_amount AS DOUBLE) AS sales_amount, quantity, "
             "CAST(profit_amount AS DOUBLE) AS profit_amount FROM sale_node"),
    "Product": "SELECT DISTINCT product_name FROM sales",
    "Category": "SELECT DISTINCT category AS category_name FROM sales",
    "Customer": "SELECT DISTINCT customer_name FROM sales",
    "State": "SELECT state_name, region FROM state_node",
    "ShipMode": "SELECT DISTINCT ship_mode AS ship_mode_name FROM sales",
    "Date": "SELECT DISTINCT strftime(order_date, '%Y-%m-%d') AS date FROM sales",
    "Month": "SELECT year, month, month_name FROM month_node",
}
_GRAPH_EDGE_SQL = {
    "OF_PRODUCT": "of_product", "BY_CUSTOMER": "by_customer", "SHIPPED_TO": "shipped_to",
    "ON_DATE": "on_date", "USES_SHIP_MODE": "uses_ship_mode", "IN_CATEGORY": "in_category",
}


def _register_graph_tables() -> None:
    for label, sql in _GRAPH_NODE_SQL.items():
        register(f"graph_nodes_{label.lower()}", oracle.with_ctes(sql, "graph"))(
            lambda spark, d, label=label: plain(_wh(spark, d).graph().nodes[label]))
    for etype, cte in _GRAPH_EDGE_SQL.items():
        dst = "strftime(dst, '%Y-%m-%d') AS dst" if etype == "ON_DATE" else "dst"
        register(f"graph_edges_{etype.lower()}",
                 oracle.with_ctes(f"SELECT src, {dst} FROM {cte}", "graph"))(
            lambda spark, d, etype=etype: plain(_wh(spark, d).graph().edges[etype]))
    register("graph_edges_in_month", oracle.with_ctes(
        "SELECT strftime(src, '%Y-%m-%d') AS src, dst_year, dst_month FROM in_month", "graph"))(
        lambda spark, d: plain(_wh(spark, d).graph().edges["IN_MONTH"]
                               .select("src", F.col("dst.year").alias("dst_year"),
                                       F.col("dst.month").alias("dst_month"))))


_register_graph_tables()


@register("check_star_keys", oracle.with_ctes("""
SELECT t.table_name, t.key_columns, t.row_count, CAST(0 AS BIGINT) AS duplicate_keys,
       CAST(0 AS BIGINT) AS null_key_rows
FROM (
  SELECT 'dim_date' AS table_name, 'date_key' AS key_columns, COUNT(*) AS row_count
    FROM dim_date
  UNION ALL SELECT 'dim_date', 'year,month', COUNT(*) FROM dim_date
  UNION ALL SELECT 'dim_product', 'product_key', COUNT(*) FROM dim_product
  UNION ALL SELECT 'dim_product', 'product_name,category_name', COUNT(*) FROM dim_product
  UNION ALL SELECT 'dim_customer', 'customer_key', COUNT(*) FROM dim_customer
  UNION ALL SELECT 'dim_customer', 'customer_name', COUNT(*) FROM dim_customer
  UNION ALL SELECT 'dim_location', 'location_key', COUNT(*) FROM dim_location
  UNION ALL SELECT 'dim_location', 'state,region', COUNT(*) FROM dim_location
  UNION ALL SELECT 'dim_ship_mode', 'ship_mode_key', COUNT(*) FROM dim_ship_mode
  UNION ALL SELECT 'dim_ship_mode', 'ship_mode_name', COUNT(*) FROM dim_ship_mode
  UNION ALL SELECT 'fact_sales', 'sales_fact_id', COUNT(*) FROM fact_sales) t""", "star"))
def check_star_keys(spark: SparkSession, d: str) -> DataFrame:
    """L12 on the star: every key unique and not null."""
    return checks.star_checks(_wh(spark, d).star())


@register("check_graph_keys", oracle.with_ctes("""
SELECT label AS table_name, key_columns, row_count, CAST(0 AS BIGINT) AS duplicate_keys,
       CAST(0 AS BIGINT) AS null_key_rows
FROM (
  SELECT 'Sale' AS label, 'sales_fact_id' AS key_columns, COUNT(*) AS row_count FROM sale_node
  UNION ALL SELECT 'Product', 'product_name', COUNT(DISTINCT product_name) FROM sales
  UNION ALL SELECT 'Category', 'category_name', COUNT(DISTINCT category) FROM sales
  UNION ALL SELECT 'Customer', 'customer_name', COUNT(DISTINCT customer_name) FROM sales
  UNION ALL SELECT 'State', 'state_name', COUNT(*) FROM state_node
  UNION ALL SELECT 'ShipMode', 'ship_mode_name', COUNT(DISTINCT ship_mode) FROM sales
  UNION ALL SELECT 'Date', 'date', COUNT(DISTINCT order_date) FROM sales
  UNION ALL SELECT 'Month', 'year,month', COUNT(*) FROM month_node) t""", "graph"))
def check_graph_keys(spark: SparkSession, d: str) -> DataFrame:
    """L12 on the graph: node keys unique and not null."""
    return checks.graph_checks(_wh(spark, d).graph())


# ---------------------------------------------------------------------------
# Order lines through the reference's CSV format and back
# ---------------------------------------------------------------------------

def exported_order_lines(wh: Warehouse) -> str:
    """The staging written once as order-line CSV (latin-1, header row)."""
    from ..sources.csv_orders import write_order_lines
    st = wh.storage
    if not st.is_done("exports", "order_lines_csv"):
        write_order_lines(wh.sales(), st.path("exports", "order_lines_csv", "files"))
        st.mark_done("exports", "order_lines_csv")
    return st.path("exports", "order_lines_csv", "files")


@register("csv_roundtrip_category_totals", oracle.with_ctes("""
SELECT category, COUNT(*) AS lines, CAST(SUM(sales_amount) AS DOUBLE) AS total_sales,
       CAST(SUM(profit_amount) AS DOUBLE) AS total_profit, CAST(SUM(quantity) AS BIGINT) AS units
FROM sales GROUP BY category"""))
def csv_roundtrip_category_totals(spark: SparkSession, d: str) -> DataFrame:
    """Export, read back with per-file line numbers, clean, aggregate."""
    from ..functions.cleaning import clean_rows
    from ..sources.csv_orders import read_order_lines_any_encoding
    path = exported_order_lines(_wh(spark, d))
    good, _skipped = clean_rows(read_order_lines_any_encoding(spark, [path], multiline=False))
    return (good.groupBy("category")
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.sum(F.col("sales_amount").cast("decimal(18,2)")).cast("double")
                 .alias("total_sales"),
                 F.sum(F.col("profit_amount").cast("decimal(18,4)")).cast("double")
                 .alias("total_profit"),
                 F.sum("quantity").cast("long").alias("units")))


@register("csv_roundtrip_read_counts", oracle.with_ctes("""
SELECT COUNT(*) AS rows_read, CAST(0 AS BIGINT) AS skipped FROM sales"""))
def csv_roundtrip_read_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows read back from the exported files, and how many the cleaning rejects."""
    from ..functions.cleaning import clean_columns
    from ..sources.csv_orders import read_order_lines_any_encoding
    path = exported_order_lines(_wh(spark, d))
    checked = clean_columns(read_order_lines_any_encoding(spark, [path], multiline=False))
    return checked.agg(F.count(F.lit(1)).alias("rows_read"),
                       F.count("reject_reason").alias("skipped"))
