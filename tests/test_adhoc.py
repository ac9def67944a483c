"""A2-A4: find, stage-function aggregation, records of mixed shapes."""
from pyspark.sql import functions as F

from conftest import sales_frame
from shopfloor.operators import adhoc
from shopfloor.operators import nested as nested_ops


def _nested(spark, n=150):
    rows = [(f"O{i}", i, "2017-01-02", "First" if i % 2 else "Second", f"C{i % 5}", "Oslo",
             "North", f"P{i % 3}", "Tech", 10 + i, 1, i % 7 - 3) for i in range(n)]
    return nested_ops.nested_records(sales_frame(spark, rows))


def test_find_default_limit_sorted_and_projected(spark):
    found = adhoc.find(_nested(spark), F.col("quantity") == 1,
                       ["sales_fact_id", "product.product_name"])
    rows = found.collect()
    assert len(rows) == adhoc.FIND_DEFAULT_LIMIT
    assert found.columns == ["sales_fact_id", "product_product_name"]
    ids = [r.sales_fact_id for r in rows]
    assert ids == sorted(ids)


def test_stage_aggregation_equals_the_question(spark):
    nested = _nested(spark)
    staged = adhoc.aggregate(
        nested,
        adhoc.group({"ship_mode": "ship_mode"}, s=F.sum("sales_amount"), n=F.count(F.lit(1))),
        adhoc.match(adhoc.ne_null("ship_mode")),
        adhoc.add_fields(avg=F.col("s") / F.col("n")),
        adhoc.sort(F.desc("s")),
        adhoc.limit(1),
        adhoc.project("ship_mode", "s"))
    top = staged.collect()
    totals = {r.ship_mode: r.s for r in nested.groupBy("ship_mode")
              .agg(F.sum("sales_amount").alias("s")).collect()}
    assert [(r.ship_mode, r.s) for r in top] == [max(totals.items(), key=lambda kv: kv[1])]


def test_union_records_first_seen_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([("y", 2, True)], "name string, id int, extra boolean")
    out = adhoc.union_records(a, b)
    assert out.columns == ["id", "name", "extra"]
    assert sorted(out.collect(), key=lambda r: r.id) == [(1, "x", None), (2, "y", True)]
