"""Catalogue entries for incremental ingest.

Scenario (ours): the warehouse was first loaded with the order lines dated
before ``INITIAL_END``; then a feed delivers every line dated from
``FEED_START`` on, in line order. The half year between the two dates is
delivered twice (a replayed window), so the layouts' replay semantics show:
the star appends the replays again, the nested set and the graph replace
them. The two slices together cover the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import plain
from ..functions.joins import partitions_for
from ..operators import graph as graph_ops
from ..operators import ingest
from ..operators import nested as nested_ops
from ..operators import star as star_ops
from .catalog import register
from .oracle import with_ctes
from .warehouse import Warehouse

INITIAL_END = "2000-07-01"
FEED_START = "2000-01-01"


def ingest_layouts(spark: SparkSession, sf_dir: str) -> dict:
    """Base layouts (written once) with the feed applied (lazy)."""
    wh = Warehouse.open(spark, sf_dir)
    if "ingest" not in wh.memo:
        base = wh.slice("initial-load", F.col("order_date") < F.lit(INITIAL_END).cast("date"))
        events = ingest.normalize_events(
            wh.sales().where(F.col("order_date") >= F.lit(FEED_START).cast("date")))
        wh.memo["ingest"] = {
            "base": base,
            "events": events,
            "star": ingest.upsert_star(base.star(), events, base.storage,
                                       partitions_for(spark, wh._staging_bytes())),
            "nested": ingest.upsert_nested(base.nested(), events),
            "graph": ingest.merge_graph(base.graph(), events, on_match=True),
            "graph_batch": ingest.merge_graph(base.graph(), events, on_match=False),
        }
    return wh.memo["ingest"]


# ---------------------------------------------------------------------------
# Oracle: the same scenario in SQL
# ---------------------------------------------------------------------------

_DIMS = {
    # name: (key, match columns, [(dim column, event expression)] for non-match attrs,
    #        base select list)
    "dim_date": ("date_key", ["year", "month"], [("month_name", "month_name")]),
    "dim_product": ("product_key", ["product_name"], [("category_name", "category")]),
    "dim_customer": ("customer_key", ["customer_name"], []),
    "dim_location": ("location_key", ["state", "region"], []),
    "dim_ship_mode": ("ship_mode_key", ["ship_mode_name"], []),
}
_BASE_DIM_SOURCE = {
    "dim_date": ("year, month", "year, month, month_name", "year, month, month_name"),
    "dim_product": ("product_name, category_name", "product_name, category_name",
                    "product_name, category AS category_name"),
    "dim_customer": ("customer_name", "customer_name", "customer_name"),
    "dim_location": ("state, region", "state, region", "state, region"),
    "dim_ship_mode": ("ship_mode_name", "ship_mode_name", "ship_mode AS ship_mode_name"),
}
_EVENT_COL = {"ship_mode_name": "ship_mode"}


def nulls_first(order: str) -> str:
    """Spark's ascending order puts nulls first; say so to the oracle."""
    return ", ".join(f"{c.strip()} NULLS FIRST" for c in order.split(","))


def _ingest_ctes() -> str:
    parts = [f"""
base AS (SELECT * FROM sales WHERE order_date < DATE '{INITIAL_END}'),
feed AS (SELECT * FROM sales WHERE order_date >= DATE '{FEED_START}')"""]
    for name, (key, match, attrs) in _DIMS.items():
        order, cols, src = _BASE_DIM_SOURCE[name]
        parts.append(f"""
b_{name} AS (SELECT row_number() OVER (ORDER BY {nulls_first(order)}) AS {key}, {cols}
  FROM (SELECT DISTINCT {src} FROM base))""")
        ev = [f"{_EVENT_COL.get(m, m)} AS {m}" for m in match]
        ev_attrs = [f"arg_min({e}, line_no) AS {c}" for c, e in attrs]
        not_in = " AND ".join(f"b.{m} = f.{m}" for m in match)
        group = ", ".join(_EVENT_COL.get(m, m) for m in match)
        parts.append(f"""
n_{name} AS (SELECT * FROM (SELECT {', '.join(ev + ev_attrs)}, MIN(line_no) AS first_seq
  FROM feed GROUP BY {group}) f
  WHERE NOT EXISTS (SELECT 1 FROM b_{name} b WHERE {not_in}))""")
        all_cols = cols
        parts.append(f"""
{name} AS (SELECT {key}, {all_cols} FROM b_{name}
  UNION ALL
  SELECT (SELECT COALESCE(MAX({key}), 0) FROM b_{name})
         + row_number() OVER (ORDER BY first_seq, {', '.join(match)}), {all_cols}
  FROM n_{name})""")
    parts.append("""
base_fact AS (
  SELECT s.line_no + 1 AS sales_fact_id, d.date_key, p.product_key, c.customer_key,
         l.location_key, m.ship_mode_key, s.sales_amount, s.quantity, s.profit_amount,
         s.order_id, s.line_no
  FROM base s
  JOIN b_dim_date d ON d.year = s.year AND d.month = s.month
  JOIN b_dim_product p ON p.product_name = s.product_name AND p.category_name = s.category
  JOIN b_dim_customer c ON c.customer_name = s.customer_name
  JOIN b_dim_location l ON l.state = s.state AND l.region = s.region
  JOIN b_dim_ship_mode m ON m.ship_mode_name = s.ship_mode),
new_fact AS (
  SELECT (SELECT MAX(sales_fact_id) FROM base_fact) + row_number() OVER (ORDER BY s.line_no)
           AS sales_fact_id,
         d.date_key, p.product_key, c.customer_key, l.location_key, m.ship_mode_key,
         s.sales_amount, s.quantity, s.profit_amount, s.order_id, s.line_no
  FROM feed s
  JOIN (SELECT year, month, MIN(date_key) AS date_key FROM dim_date GROUP BY year, month) d
    ON d.year = s.year AND d.month = s.month
  JOIN (SELECT product_name, MIN(product_key) AS product_key FROM dim_product
        GROUP BY product_name) p ON p.product_name = s.product_name
  JOIN (SELECT customer_name, MIN(customer_key) AS customer_key FROM dim_customer
        GROUP BY customer_name) c ON c.customer_name = s.customer_name
  JOIN (SELECT state, region, MIN(location_key) AS location_key FROM dim_location
        GROUP BY state, region) l ON l.state = s.state AND l.region = s.region
  JOIN (SELECT ship_mode_name, MIN(ship_mode_key) AS ship_mode_key FROM dim_ship_mode
        GROUP BY ship_mode_name) m ON m.ship_mode_name = s.ship_mode),
fact_sales AS (SELECT * FROM base_fact UNION ALL SELECT * FROM new_fact),
after_sales AS (SELECT * FROM base WHERE sales_fact_id NOT IN (SELECT sales_fact_id FROM feed)
                UNION ALL SELECT * FROM feed)""")
    return ",".join(parts)


def _sql(body: str) -> str:
    text = with_ctes("SELECT 1")
    prelude = text[: text.rindex("\nSELECT 1")]
    return prelude + "," + _ingest_ctes() + "\n" + body.strip()


def _register_dims() -> None:
    for name, (key, _match, _attrs) in _DIMS.items():
        cols = _BASE_DIM_SOURCE[name][1]

        def build(spark, d, name=name):
            return getattr(ingest_layouts(spark, d)["star"], name)
        register(f"ingest_star_{name}", _sql(f"SELECT {key}, {cols} FROM {name}"))(build)


_register_dims()


@register("ingest_star_new_facts", _sql("""
SELECT sales_fact_id, date_key, product_key, customer_key, location_key, ship_mode_key,
       CAST(sales_amount AS DOUBLE) AS sales_amount, quantity,
       CAST(profit_amount AS DOUBLE) AS profit_amount, order_id, line_no
FROM new_fact"""))
def ingest_star_new_facts(spark: SparkSession, d: str) -> DataFrame:
    lay = ingest_layouts(spark, d)
    top = ingest.max_key(lay["base"].star().fact_sales, "sales_fact_id")
    return plain(lay["star"].fact_sales.where(F.col("sales_fact_id") > top))


@register("ingest_star_q4_revenue_by_category", _sql("""
SELECT p.category_name AS category, CAST(SUM(f.sales_amount) AS DOUBLE) AS total_sales
FROM fact_sales f JOIN dim_product p ON f.product_key = p.product_key
GROUP BY p.category_name ORDER BY total_sales DESC"""))
def ingest_star_q4(spark: SparkSession, d: str) -> DataFrame:
    return star_ops.q4_revenue_by_category(ingest_layouts(spark, d)["star"])


@register("ingest_star_q2_monthly_revenue", _sql("""
SELECT d.year, d.month, CAST(SUM(f.sales_amount) AS DOUBLE) AS revenue
FROM fact_sales f JOIN dim_date d ON f.date_key = d.date_key
GROUP BY d.year, d.month ORDER BY d.year, d.month"""))
def ingest_star_q2(spark: SparkSession, d: str) -> DataFrame:
    return star_ops.q2_monthly_revenue(ingest_layouts(spark, d)["star"])


@register("ingest_nested_q5_profit_by_state", _sql("""
SELECT state, CAST(SUM(profit_amount) AS DOUBLE) AS total_profit FROM after_sales
GROUP BY state ORDER BY total_profit DESC"""))
def ingest_nested_q5(spark: SparkSession, d: str) -> DataFrame:
    return nested_ops.q5_profit_by_state(ingest_layouts(spark, d)["nested"])


@register("ingest_nested_q2_monthly_revenue", _sql("""
SELECT CAST(SUM(sales_amount) AS DOUBLE) AS revenue, year, month_name FROM after_sales
GROUP BY year, month, month_name ORDER BY year, month"""))
def ingest_nested_q2(spark: SparkSession, d: str) -> DataFrame:
    return nested_ops.q2_monthly_revenue(ingest_layouts(spark, d)["nested"])


@register("ingest_graph_q4_revenue_by_category", _sql("""
SELECT ic.category AS category, CAST(SUM(s.sales_amount) AS DOUBLE) AS total_sales
FROM after_sales s
JOIN (SELECT DISTINCT product_name, category FROM after_sales) ic
  ON ic.product_name = s.product_name
GROUP BY ic.category ORDER BY total_sales DESC"""))
def ingest_graph_q4(spark: SparkSession, d: str) -> DataFrame:
    return graph_ops.q4_revenue_by_category(ingest_layouts(spark, d)["graph"])


@register("ingest_graph_node_counts", _sql("""
SELECT 'Sale' AS label, COUNT(DISTINCT sales_fact_id) AS nodes FROM after_sales
UNION ALL SELECT 'Product', COUNT(DISTINCT product_name) FROM after_sales
UNION ALL SELECT 'Category', COUNT(DISTINCT category) FROM after_sales
UNION ALL SELECT 'Customer', COUNT(DISTINCT customer_name) FROM after_sales
UNION ALL SELECT 'State', COUNT(DISTINCT state) FROM after_sales
UNION ALL SELECT 'ShipMode', COUNT(DISTINCT ship_mode) FROM after_sales
UNION ALL SELECT 'Date', COUNT(DISTINCT order_date) FROM after_sales
UNION ALL SELECT 'Month', COUNT(*) FROM (SELECT DISTINCT year, month FROM after_sales) t"""))
def ingest_graph_node_counts(spark: SparkSession, d: str) -> DataFrame:
    g = ingest_layouts(spark, d)["graph"]
    parts = [df.agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("nodes"))
             for label, df in g.nodes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("ingest_graph_batch_q5_profit_by_state", _sql("""
SELECT state, CAST(SUM(profit_amount) AS DOUBLE) AS total_profit FROM after_sales
GROUP BY state ORDER BY total_profit DESC"""))
def ingest_graph_batch_q5(spark: SparkSession, d: str) -> DataFrame:
    """The batch merge keeps first measures; replays carry equal ones."""
    return graph_ops.q5_profit_by_state(ingest_layouts(spark, d)["graph_batch"])
