"""The driver's parquet tables, and order lines (``sales``) derived from them.

The reference loads one order-line CSV; the same rows are derived here from
the TPC-H-like tables. Mapping (ours): ship mode is the order priority,
state and region are the customer's nation and region, product and category
are part name and part type, profit is price minus quantity x retail price.
``line_no`` is the row's 0-based position in one global order of lineitem
rows, as the reference numbers every CSV row in file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import joins
from ..functions.joins import PARQUET_EXPANSION, broadcast_if_files_small, file_bytes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# The global order that defines line_no; the trailing columns only break
# ties between lines that share (l_orderkey, l_linenumber).
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
              "l_quantity", "l_extendedprice"]

SALES_COLUMNS = ["order_id", "line_no", "order_date", "ship_mode", "customer_name", "state",
                 "region", "product_name", "category", "sales_amount", "quantity",
                 "profit_amount"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem columns the order lines need (all of them order the lines)."""
    return read_table(spark, sf_dir, "lineitem").select(*LINE_ORDER)


def attach_orders(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, customer, nation, region and part columns for each line.

    Left joins keep every line (numbering offsets count all of them);
    ``_matched`` marks the lines that find all five, i.e. the inner join.
    The lines are always the streamed side; every other input is joined in
    order of size and broadcast only when the bytes of the files it comes
    from bound it under the broadcast limit - otherwise a shuffle join
    that AQE may turn into a broadcast at run time, or split where a key
    is hot. Lines are shuffled with as little as possible: orders bring a
    nation key whose names are looked up last, and parts that have to be
    shuffled too come before the wider orders.
    """
    size = {t: file_bytes(spark, table_path(sf_dir, t))
            for t in ("region", "nation", "customer", "orders", "part")}
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type",
                                                    "p_retailprice")

    geo_bytes = size["nation"] + size["region"]
    geo = (nation.join(broadcast_if_files_small(region, size["region"]),
                       nation.n_regionkey == region.r_regionkey)
           .select("n_nationkey", "n_name", "r_name"))
    small_geo = broadcast_if_files_small(geo, geo_bytes)
    cust = customer.join(small_geo, customer.c_nationkey == geo.n_nationkey, "left_semi")
    cust_bytes = geo_bytes + size["customer"]
    order_rows = orders.join(broadcast_if_files_small(cust, cust_bytes),
                             orders.o_custkey == cust.c_custkey).drop("o_custkey", "c_custkey")
    sides = [(broadcast_if_files_small(order_rows, cust_bytes + size["orders"]), "l_orderkey", "o_orderkey"),
             (broadcast_if_files_small(part, size["part"]), "l_partkey", "p_partkey")]
    if size["part"] * PARQUET_EXPANSION > joins.BROADCAST_MAX_BYTES:
        sides.reverse()
    joined = lines
    for side, left, right in sides:
        joined = joined.join(side, F.col(left) == F.col(right), "left")
    joined = joined.join(small_geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")

    sales_amount = F.col("l_extendedprice").cast("decimal(18,2)")
    profit = (sales_amount - F.col("l_quantity").cast("decimal(9,2)")
              * F.col("p_retailprice").cast("decimal(9,2)")).cast("decimal(18,4)")
    keep = [c for c in lines.columns if c not in LINE_ORDER]
    return joined.select(
        *keep,
        (F.col("o_orderkey").isNotNull() & F.col("p_partkey").isNotNull()).alias("_matched"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("ship_mode"),
        F.col("c_name").alias("customer_name"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("region"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        sales_amount.alias("sales_amount"),
        F.col("l_quantity").cast("int").alias("quantity"),
        profit.alias("profit_amount"),
    )
