"""Property-graph layout as node and edge tables, and its questions.

Nodes (key first): Sale(sales_fact_id, sales_amount, quantity,
profit_amount), Product(product_name), Category(category_name),
Customer(customer_name), State(state_name, region), ShipMode(ship_mode_name),
Date(date), Month(year, month, month_name). Edges are (src, dst) frames
holding the end keys; IN_MONTH's dst is struct(year, month).

A MERGE on a node key keeps one node per key; attributes set ON CREATE
keep the first value seen (State.region, Month.month_name, and the batch
load's Sale measures), computed as ``min_by(attr, line_no)`` - an ordinary
partial aggregation, so a hot key is combined map-side.

Pattern matches are equi-joins on edge frames. A multi-hop question
aggregates by the first hop's end key before the next hop, so only one row
per product (or date) crosses the second join, whatever the fan-out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money, ratio
from ..functions.joins import broadcast_if_files_small, file_bytes
from ..plans.storage import Storage
from ..session import settings

NODE_KEYS = {
    "Sale": ["sales_fact_id"],
    "Product": ["product_name"],
    "Category": ["category_name"],
    "Customer": ["customer_name"],
    "State": ["state_name"],
    "ShipMode": ["ship_mode_name"],
    "Date": ["date"],
    "Month": ["year", "month"],
}

# edge type: (source label, target label)
EDGE_ENDS = {
    "OF_PRODUCT": ("Sale", "Product"),
    "BY_CUSTOMER": ("Sale", "Customer"),
    "SHIPPED_TO": ("Sale", "State"),
    "ON_DATE": ("Sale", "Date"),
    "USES_SHIP_MODE": ("Sale", "ShipMode"),
    "IN_CATEGORY": ("Product", "Category"),
    "IN_MONTH": ("Date", "Month"),
}

SALE_MEASURES = ["sales_amount", "quantity", "profit_amount"]


@dataclass
class Graph:
    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    # on-disk bytes of the small node tables: their broadcast size bound
    rows: dict[str, int] = field(default_factory=dict)

    def node(self, label: str) -> DataFrame:
        size = self.rows.get(label)
        return self.nodes[label] if size is None else broadcast_if_files_small(
            self.nodes[label], size)


def _first_per_key(sales: DataFrame, keys: list[str], col: str, order: str = "line_no") -> DataFrame:
    """The first value of ``col`` in ``order`` for each key. The values are combined first, by a
    hash aggregation; ``min_by`` of a text sorts its input, which is then only the distinct values."""
    seen = sales.groupBy(*keys, col).agg(F.min(order).alias("_order"))
    return seen.groupBy(*keys).agg(F.min_by(col, "_order").alias(col))


def sale_nodes(sales: DataFrame, unique_sales: bool = False) -> DataFrame:
    """Sale nodes; the first measures per sale id win (MERGE .. ON CREATE).
    ``unique_sales`` skips the dedup when the input has one row per id."""
    if unique_sales:
        return sales.select("sales_fact_id", *SALE_MEASURES)
    first = F.min_by(F.struct(*SALE_MEASURES), F.col("line_no"))
    return (sales.groupBy("sales_fact_id").agg(first.alias("m"))
            .select("sales_fact_id", *[F.col(f"m.{c}").alias(c) for c in SALE_MEASURES]))


# edge type leaving a sale -> the order-line column of its far end
SALE_EDGE_DST = {"OF_PRODUCT": "product_name", "BY_CUSTOMER": "customer_name",
                 "SHIPPED_TO": "state", "ON_DATE": "order_date",
                 "USES_SHIP_MODE": "ship_mode"}


def sale_edges(sales: DataFrame, unique_sales: bool = False) -> dict[str, DataFrame]:
    """The five edge types leaving a sale, as (src, dst), no duplicates."""
    out = {}
    for etype, dst in SALE_EDGE_DST.items():
        e = sales.select(F.col("sales_fact_id").alias("src"), F.col(dst).alias("dst"))
        out[etype] = e if unique_sales else e.distinct()
    return out


def graph_nodes(sales: DataFrame, unique_sales: bool = False) -> dict[str, DataFrame]:
    """One frame per label. ``unique_sales`` skips the Sale dedup when
    the input already has one row per sale id (the numbered staging)."""
    return {
        "Sale": sale_nodes(sales, unique_sales),
        "Product": sales.select("product_name").distinct(),
        "Category": sales.select(F.col("category").alias("category_name")).distinct(),
        "Customer": sales.select("customer_name").distinct(),
        "State": _first_per_key(sales.withColumn("state_name", F.col("state")), ["state_name"], "region"),
        "ShipMode": sales.select(F.col("ship_mode").alias("ship_mode_name")).distinct(),
        "Date": sales.select(F.col("order_date").alias("date")).distinct(),
        "Month": _first_per_key(sales, ["year", "month"], "month_name"),
    }


def graph_edges(sales: DataFrame, unique_sales: bool = False) -> dict[str, DataFrame]:
    """One (src, dst) frame per type, no duplicate edges."""
    return {
        **sale_edges(sales, unique_sales),
        "IN_CATEGORY": sales.select(F.col("product_name").alias("src"),
                                    F.col("category").alias("dst")).distinct(),
        "IN_MONTH": sales.select(F.col("order_date").alias("src"),
                                 F.struct("year", "month").alias("dst")).distinct(),
    }


def sale_buckets(spark) -> int:
    """Bucket count shared by the Sale node table and the five sale edge
    tables: the session's shuffle partition count (a cluster sizes it so a
    bucket fits one task)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucket_key(label_or_type: str) -> str | None:
    if label_or_type == "Sale":
        return "sales_fact_id"
    if EDGE_ENDS.get(label_or_type, ("",))[0] == "Sale":
        return "src"
    return None


def write_graph(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], storage: Storage,
                name: str = "graph", buckets: int | None = None,
                partitioned: bool = False) -> Graph:
    """K6: node and edge parquet, one folder per label / type.

    The Sale nodes and the five edge types leaving a sale are bucketed on
    the sale id with one bucket count, so every hop Sale -> edge is a
    sort-merge join with no exchange on either side. The on-disk size of
    each small node table is kept as its broadcast bound. ``partitioned``:
    the sale-keyed frames already come hash-partitioned on the sale id into
    ``buckets`` partitions (one shared shuffle instead of one per table)."""
    buckets = buckets or sale_buckets(storage.spark)
    out_nodes, out_edges, sizes = {}, {}, {"_buckets": buckets}
    for label, df in nodes.items():
        key = _bucket_key(label)
        if key:
            out_nodes[label] = storage.write_bucketed(df, key, buckets, name, "nodes", label,
                                                      partitioned=partitioned)
        else:
            out_nodes[label] = storage.write(df, name, "nodes", label)
            sizes[label] = file_bytes(storage.spark, storage.path(name, "nodes", label))
    for etype, df in edges.items():
        key = _bucket_key(etype)
        if key:
            out_edges[etype] = storage.write_bucketed(df, key, buckets, name, "edges", etype,
                                                      partitioned=partitioned)
        else:
            out_edges[etype] = storage.write(df, name, "edges", etype)
    return Graph(out_nodes, out_edges, sizes)


def open_graph(storage: Storage, name: str, sizes: dict[str, int]) -> Graph:
    """A graph written by ``write_graph``, read back (bucketed tables included)."""
    buckets = sizes.get("_buckets")
    nodes, edges = {}, {}
    for label in NODE_KEYS:
        key = _bucket_key(label)
        nodes[label] = (storage.open_bucketed(key, buckets, name, "nodes", label)
                        if key and buckets else storage.read(name, "nodes", label))
    for etype in EDGE_ENDS:
        key = _bucket_key(etype)
        edges[etype] = (storage.open_bucketed(key, buckets, name, "edges", etype)
                        if key and buckets else storage.read(name, "edges", etype))
    return Graph(nodes, edges, sizes)


def build_graph(sales: DataFrame, storage: Storage, name: str = "graph",
                unique_sales: bool = False, buckets: int | None = None) -> Graph:
    """Nodes and edges from order lines.

    The small tables (seven labels, two edge types) are separate distinct
    aggregations: each reads only its one or two columns of the columnar
    staging, with map-side partial aggregation. The Sale nodes and the five
    edge types leaving a sale share one hash partitioning on the sale id:
    their columns are shuffled and sorted once, into a bucketed table that is
    dropped in the end, and each of the six tables reads its own columns of
    it bucket by bucket. (Cached rows took three times its size, beside the
    shuffle.) ``buckets``: their bucket count (the caller sizes it from the
    data; default: the session's shuffle partitions)."""
    buckets = buckets or sale_buckets(storage.spark)
    order = [] if unique_sales else ["line_no"]
    staged = (name, "by_sale")
    by_sale = storage.write_bucketed(
        sales.select("sales_fact_id", *SALE_MEASURES, *SALE_EDGE_DST.values(), *order), "sales_fact_id", buckets, *staged)
    nodes = {**graph_nodes(sales, unique_sales), "Sale": sale_nodes(by_sale, unique_sales)}
    edges = {**graph_edges(sales, unique_sales), **sale_edges(by_sale, unique_sales)}
    try:
        # Spark would read the buckets as plain files, since no join asks for them; the writes do.
        with settings(storage.spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):
            return write_graph(nodes, edges, storage, name, buckets=buckets, partitioned=unique_sales)
    finally:
        storage.drop_bucketed(*staged)


# ---------------------------------------------------------------------------
# Path patterns
# ---------------------------------------------------------------------------

def hop(g: Graph, etype: str, measures: list[str] | None = None) -> DataFrame:
    """(s:Sale)-[:etype]->(x): sale measures with the end key as ``dst``.

    A sort-merge join: both tables are bucketed and sorted on the sale id,
    so it needs no exchange and no sort, and it scales with the data;
    broadcasting an edge table that happens to be under the threshold was
    measured twice as slow."""
    sale = g.nodes["Sale"].select("sales_fact_id", *(measures or SALE_MEASURES))
    edges = g.edges[etype].hint("merge")
    return edges.join(sale, edges.src == sale.sales_fact_id).drop("src")


def optional_hop(left: DataFrame, left_key: str, g: Graph, etype: str,
                 reverse: bool = False) -> DataFrame:
    """OPTIONAL MATCH: keep every left row, with null end keys where no edge.

    Two joins instead of one left outer join, whose right side AQE never splits: an inner
    join, where it splits the edges of a hot key, and an anti join with the distinct ends,
    which are combined before their shuffle."""
    e = g.edges[etype]
    near, far = ("dst", "src") if reverse else ("src", "dst")
    end = f"{etype.lower()}_end"
    edges = e.select(F.col(near).alias("_near"), F.col(far).alias(end))
    ends = e.select(F.col(near).alias("_near")).distinct()
    met = left.join(edges, left[left_key] == edges["_near"]).drop("_near")
    unmet = left.join(ends, left[left_key] == ends["_near"], "left_anti")
    return met.unionByName(unmet.withColumn(end, F.lit(None).cast(e.schema[far].dataType)))


def _month_totals(g: Graph, measure: str) -> DataFrame:
    """(s:Sale)-[:ON_DATE]->(:Date)-[:IN_MONTH]->(m:Month), summed per month."""
    per_date = hop(g, "ON_DATE", [measure]).groupBy("dst").agg(F.sum(measure).alias("v"))
    in_month = g.edges["IN_MONTH"]
    per_month = (per_date.join(in_month, per_date.dst == in_month.src)
                 .groupBy(in_month.dst.alias("m")).agg(F.sum("v").alias("v")))
    month = g.node("Month")
    return (per_month.join(month, (per_month.m.year == month.year)
                           & (per_month.m.month == month.month))
            .select("year", "month", "month_name", "v"))


# ---------------------------------------------------------------------------
# The ten questions
# ---------------------------------------------------------------------------

def q1_top_products(g: Graph) -> DataFrame:
    return (hop(g, "OF_PRODUCT", ["sales_amount"])
            .groupBy(F.col("dst").alias("product_name"))
            .agg(money(F.sum("sales_amount")).alias("revenue"))
            .orderBy(F.desc("revenue"), "product_name").limit(10))


def q2_monthly_revenue(g: Graph) -> DataFrame:
    return (_month_totals(g, "sales_amount")
            .orderBy("year", "month")
            .select("year", F.col("month_name").alias("month"),
                    money(F.round("v", 3)).alias("revenue")))


def q3_top_customers(g: Graph) -> DataFrame:
    return (hop(g, "BY_CUSTOMER", ["sales_amount"])
            .groupBy(F.col("dst").alias("customer_name"))
            .agg(money(F.sum("sales_amount")).alias("total_spent"))
            .orderBy(F.desc("total_spent"), "customer_name").limit(10))


def q4_revenue_by_category(g: Graph) -> DataFrame:
    per_product = (hop(g, "OF_PRODUCT", ["sales_amount"])
                   .groupBy("dst").agg(F.sum("sales_amount").alias("v")))
    in_cat = g.edges["IN_CATEGORY"]
    return (per_product.join(in_cat, per_product.dst == in_cat.src)
            .groupBy(in_cat.dst.alias("category"))
            .agg(money(F.sum("v")).alias("total_sales"))
            .orderBy(F.desc("total_sales"), "category"))


def q5_profit_by_state(g: Graph) -> DataFrame:
    return (hop(g, "SHIPPED_TO", ["profit_amount"])
            .groupBy(F.col("dst").alias("state"))
            .agg(money(F.sum("profit_amount")).alias("total_profit"))
            .orderBy(F.desc("total_profit"), "state"))


def _product_sales_profit(g: Graph) -> DataFrame:
    return (hop(g, "OF_PRODUCT", ["sales_amount", "profit_amount"])
            .groupBy(F.col("dst").alias("product_name"))
            .agg(money(F.sum("sales_amount")).alias("total_sales"),
                 money(F.sum("profit_amount")).alias("total_profit")))


def q6_high_sales_low_profit(g: Graph) -> DataFrame:
    return (_product_sales_profit(g)
            .orderBy(F.desc("total_sales"), F.asc("total_profit"), "product_name").limit(10))


def q7_low_sales_high_profit(g: Graph) -> DataFrame:
    return (_product_sales_profit(g)
            .orderBy(F.asc("total_sales"), F.desc("total_profit"), "product_name").limit(10))


def q8_profit_ratio_by_ship_mode(g: Graph) -> DataFrame:
    return (hop(g, "USES_SHIP_MODE", ["sales_amount", "profit_amount"])
            .groupBy(F.col("dst").alias("ship_mode"))
            .agg(ratio(F.sum("profit_amount"), F.sum("sales_amount")).alias("profit_ratio"))
            .orderBy(F.desc_nulls_first("profit_ratio"), "ship_mode"))


def q9_most_frequent_customers(g: Graph) -> DataFrame:
    return (hop(g, "BY_CUSTOMER", [])
            .groupBy(F.col("dst").alias("customer_name"))
            .agg(F.count("sales_fact_id").alias("order_count"))
            .orderBy(F.desc("order_count"), "customer_name").limit(10))


def q10_lowest_profit_months(g: Graph) -> DataFrame:
    return (_month_totals(g, "profit_amount")
            .orderBy("v", "year", "month").limit(10)
            .select("year", F.col("month_name").alias("month"),
                    money("v").alias("total_profit")))


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
