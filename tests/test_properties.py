"""Properties: distributed numbering equals row_number() on random data;
every layout conserves the order lines and their totals."""
import tempfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SMALL
from shopfloor.functions.keys import number_rows
from shopfloor.plans.storage import Storage
from shopfloor.plans.warehouse import Warehouse

rows = st.lists(st.tuples(st.sampled_from([1, 1, 1, 2, 3, None]),  # a hot first key
                          st.integers(-5, 5), st.text(max_size=3)), max_size=60)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 6), start=st.integers(0, 3))
def test_number_rows_is_row_number(spark, data, parts, start):
    storage = Storage(spark, tempfile.mkdtemp(prefix="prop-", dir="/tmp"))
    df = spark.createDataFrame(data, "a long, b long, c string")
    got, total = number_rows(df, ["a", "b", "c"], "n", storage, "p", start=start,
                             num_partitions=parts)
    assert total == len(data)
    want = df.withColumn("n", F.row_number().over(Window.orderBy("a", "b", "c")) - 1 + start)
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_layouts_conserve_lines_and_totals(spark):
    wh = Warehouse.open(spark, SMALL)
    sales = wh.sales().agg(F.count(F.lit(1)), F.sum("sales_amount"), F.sum("profit_amount"))
    star = wh.star().fact_sales.agg(F.count(F.lit(1)), F.sum("sales_amount"),
                                    F.sum("profit_amount"))
    nested = wh.nested().agg(F.count(F.lit(1)), F.sum("sales_amount"), F.sum("profit_amount"))
    graph = wh.graph().nodes["Sale"].agg(F.count(F.lit(1)), F.sum("sales_amount"),
                                         F.sum("profit_amount"))
    want = tuple(sales.first())
    assert tuple(star.first()) == want == tuple(nested.first()) == tuple(graph.first())
    for etype in ("OF_PRODUCT", "BY_CUSTOMER", "SHIPPED_TO", "ON_DATE", "USES_SHIP_MODE"):
        assert wh.graph().edges[etype].count() == want[0]


def test_layouts_agree_when_products_have_one_category(spark):
    """R1 on all ten questions: with one category per product and one
    region per state, star, nested and graph give the same answers."""
    from conftest import sales_frame
    from shopfloor.operators import graph as graph_ops
    from shopfloor.operators import nested as nested_ops
    from shopfloor.operators import star as star_ops
    from shopfloor.plans.catalog_access import _key_cols, _MEASURE
    from shopfloor.operators.reconcile import keyed, reconcile

    products = [("Phone", "Tech"), ("Chair", "Furn"), ("Desk", "Furn"), ("Lamp", "Home")]
    states = [("Oslo", "North"), ("Bergen", "West")]
    rows = []
    for i in range(40):
        p, c = products[i % 4]
        st, rg = states[i % 2]
        rows.append((f"O{i // 3}", i, f"2017-{1 + i % 5:02d}-{1 + i % 27:02d}",
                     ["First", "Second", "Third"][i % 3], f"Cust{i % 7}", st, rg, p, c,
                     10 + i * 3.5, 1 + i % 4, (i % 9) - 3.25))
    storage = Storage(spark, tempfile.mkdtemp(prefix="agree-", dir="/tmp"))
    sales = sales_frame(spark, rows)
    star = star_ops.build_star(sales, storage)
    nested = nested_ops.build_nested(sales, storage)
    graph = graph_ops.build_graph(sales, storage)
    for q in star_ops.QUESTIONS:
        keys = _key_cols(q)
        m = _MEASURE[q]
        out = reconcile({
            "star": keyed(star_ops.QUESTIONS[q](star), keys[0], m),
            "nested": keyed(nested_ops.QUESTIONS[q](nested), keys[1], m),
            "graph": keyed(graph_ops.QUESTIONS[q](graph), keys[2], m),
        })
        statuses = {r.status for r in out.collect()}
        assert statuses == {"match"}, (q, out.where("status != 'match'").collect())
