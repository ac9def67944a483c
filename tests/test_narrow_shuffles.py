"""Lines are shuffled with little: large sides come last, names of nations are looked up after them."""
from pyspark.sql import functions as F

from shopfloor.functions import joins
from shopfloor.operators import star
from shopfloor.sources.tables import LINE_ORDER, attach_orders


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, folder):
    tables = {
        "region": ([(0, "EAST"), (1, "WEST"), (1, "WEST")], "r_regionkey int, r_name string"),
        "nation": ([(0, "A", 0), (1, "B", 1), (2, "C", 9), (None, "D", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "c1", 0), (2, "c2", 1), (3, "c3", 2), (4, "c4", None), (5, "c5", 0), (5, "c5", 2)],
                     "c_custkey long, c_name string, c_nationkey int"),
        "orders": ([(n, n, "1999-01-01", "HIGH") for n in range(1, 7)] + [(None, 1, "1999-01-01", "LOW"), (8, None, None, None)],
                   "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string"),
        "part": ([(1, "p1", "T", 1.5), (2, "p2", "T", 2.0), (None, "p3", "U", 1.0)],
                 "p_partkey long, p_name string, p_type string, p_retailprice double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    lines = [(o, 1, p, 1, "1999-02-01", 2, 10.0) for o in (1, 2, 3, 4, 5, 6, 7, 8, None) for p in (1, 2, 3, None)]
    return spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, "
                                        "l_shipdate string, l_quantity int, l_extendedprice double").select(*LINE_ORDER)


def test_staging_joins(spark, tmp_path, monkeypatch):
    lines = _tables(spark, str(tmp_path))
    small = attach_orders(lines, spark, str(tmp_path))
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    large = attach_orders(lines, spark, str(tmp_path))
    rows = sorted(map(str, small.collect()))
    assert sorted(map(str, large.collect())) == rows
    # Nation 1 has two regions' rows and so two rows for each line of order 2; the others have one each, matched or not.
    assert len(rows) == 9 * 4 + 4
    assert small.where("_matched").count() == 2 * (1 + 2 + 1)
    assert large.where("_matched AND state IS NULL").isEmpty()
    plan = _plan(large)
    first = {key: plan.index(f"LeftOuter, ({key}") for key in ("l_partkey", "l_orderkey", "c_nationkey")}
    # The plan's last join stands first.
    assert first["c_nationkey"] < first["l_orderkey"] < first["l_partkey"]
    assert _plan(small).index("LeftOuter, (l_partkey") < _plan(small).index("LeftOuter, (l_orderkey")


def test_large_dimension_is_looked_up_last(spark):
    sales = spark.range(1).select(
        F.lit(1).alias("sales_fact_id"), F.lit("1").alias("order_id"), F.lit(1).alias("line_no"),
        F.to_date(F.lit("1999-01-01")).alias("order_date"), F.lit("M").alias("ship_mode"), F.col("id").cast("string").alias("customer_name"),
        F.lit("s").alias("state"), F.lit("r").alias("region"), F.lit("p").alias("product_name"), F.lit("c").alias("category"),
        F.lit(1).alias("sales_amount"), F.lit(1).alias("quantity"), F.lit(1).alias("profit_amount"))
    with_names = sales.withColumns({"year": F.year("order_date"), "month": F.month("order_date"),
                                    "category_name": F.col("category"), "ship_mode_name": F.col("ship_mode")})
    dims = {name: with_names.select(F.lit(1).alias(key), *natural) for name, (key, natural, _) in star.DIMENSIONS.items()}
    order = []

    def looked_up(frame, rows, *_):
        order.append(rows)
        return frame

    old, star.maybe_broadcast = star.maybe_broadcast, looked_up
    try:
        rows = {"dim_customer": 9, **{name: n for n, name in enumerate(n for n in star.DIMENSIONS if n != "dim_customer")}}
        assert star.fact_rows(sales, dims, rows).count() == 1
    finally:
        star.maybe_broadcast = old
    assert order == sorted(order) and order[-1] == 9
