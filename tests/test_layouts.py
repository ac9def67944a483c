"""Layout semantics on tiny frames: the divergences the reference has
(SURVEY 1.3), incremental ingest (FIXTURES F2), deletes, summaries."""
import pytest
from pyspark.sql import functions as F

from conftest import sales_frame
from shopfloor.operators import customers as cust
from shopfloor.operators import graph as graph_ops
from shopfloor.operators import ingest
from shopfloor.operators import nested as nested_ops
from shopfloor.operators import star as star_ops
from shopfloor.operators import summaries as summ

BASE = [
    ("O1", 0, "2017-01-02", "First", "Ann", "Oslo", "North", "Phone", "Tech", 100, 1, 10),
    ("O1", 1, "2017-01-03", "First", "Bob", "Oslo", "North", "Chair", "Furn", 50, 2, 5),
    ("O2", 2, "2017-01-04", "Second", "Ann", "Oslo", "East", "Phone", "Gadgets", 30, 1, 3),
]


@pytest.fixture(scope="module")
def layouts(spark):
    import tempfile
    from shopfloor.plans.storage import Storage
    st = Storage(spark, tempfile.mkdtemp(prefix="layouts-", dir="/tmp"))
    sales = sales_frame(spark, BASE)
    return {"star": star_ops.build_star(sales, st),
            "nested": nested_ops.build_nested(sales, st),
            "graph": graph_ops.build_graph(sales, st)}


def test_product_in_two_categories(layouts):
    star_cat = {r.category: r.total_sales
                for r in star_ops.q4_revenue_by_category(layouts["star"]).collect()}
    graph_cat = {r.category: r.total_sales
                 for r in graph_ops.q4_revenue_by_category(layouts["graph"]).collect()}
    assert star_cat == {"Tech": 100, "Furn": 50, "Gadgets": 30}
    # one Phone node, two IN_CATEGORY edges: every Phone sale counts in both
    assert graph_cat == {"Tech": 130, "Furn": 50, "Gadgets": 130}
    assert layouts["star"].dim_product.count() == 3
    assert layouts["graph"].nodes["Product"].count() == 2


def test_state_in_two_regions(layouts):
    assert layouts["star"].dim_location.count() == 2
    state = layouts["graph"].nodes["State"].collect()
    assert [(r.state_name, r.region) for r in state] == [("Oslo", "North")]  # first wins


def _events(spark):
    rows = [
        ("O1", 0, "2017-01-02", "First", "Ann", "Oslo", "North", "Phone", "Tech", 100, 1, 10),
        ("O1", 1, "2017-01-03", "First", "Bob", "Oslo", "North", "Chair", "Furn", 80, 2, 8),
        ("O3", 3, "2017-02-01", "Third", "Cy", "Bergen", "West", "Desk", "Furn", 70, 1, 7),
        ("O4", 4, "2017-02-02", "First", "Ann", "Oslo", "North", "Phone", "Toys", 20, 1, 2),
    ]
    return ingest.normalize_events(sales_frame(spark, rows))


def test_ingest_star(spark, storage, layouts):
    star = ingest.upsert_star(layouts["star"], _events(spark), storage)
    facts = star.fact_sales
    assert facts.count() == 7  # replays are appended again
    assert sorted(r.sales_fact_id for r in facts.collect()) == [1, 2, 3, 4, 5, 6, 7]
    dims = {n: {tuple(r) for r in getattr(star, n).collect()} for n in star_ops.DIMENSIONS}
    assert (4, "Desk", "Furn") in dims["dim_product"]
    assert not any(r[2] == "Toys" for r in dims["dim_product"])  # known name: category dropped
    assert (3, "Cy") in dims["dim_customer"]
    assert (2, 2017, 2, "February") in dims["dim_date"]
    assert (3, "Third") in dims["dim_ship_mode"]
    toys = facts.where(F.col("line_no") == 4).first()
    phone_keys = {r[0] for r in dims["dim_product"] if r[1] == "Phone"}
    assert toys.product_key == min(phone_keys)


def test_ingest_nested_last_wins(spark, layouts):
    nested = ingest.upsert_nested(layouts["nested"], _events(spark))
    amounts = {r.sales_fact_id: float(r.sales_amount) for r in nested.collect()}
    assert amounts == {"O1-0": 100, "O1-1": 80, "O2-2": 30, "O3-3": 70, "O4-4": 20}


def test_ingest_graph_stream_and_batch(spark, layouts):
    stream = ingest.merge_graph(layouts["graph"], _events(spark), on_match=True)
    batch = ingest.merge_graph(layouts["graph"], _events(spark), on_match=False)
    s = {r.sales_fact_id: float(r.sales_amount) for r in stream.nodes["Sale"].collect()}
    b = {r.sales_fact_id: float(r.sales_amount) for r in batch.nodes["Sale"].collect()}
    assert s["O1-1"] == 80 and b["O1-1"] == 50
    cats = {r.dst for r in stream.edges["IN_CATEGORY"].where("src = 'Phone'").collect()}
    assert cats == {"Tech", "Gadgets", "Toys"}  # edges only ever added
    assert stream.nodes["Customer"].count() == 3


def test_replayed_sale_with_new_customer_keeps_old_edge(spark, layouts):
    ev = ingest.normalize_events(sales_frame(spark, [
        ("O1", 0, "2017-01-02", "First", "Dee", "Oslo", "North", "Phone", "Tech", 100, 1, 10)]))
    g = ingest.merge_graph(layouts["graph"], ev)
    owners = {r.dst for r in g.edges["BY_CUSTOMER"].where("src = 'O1-0'").collect()}
    assert owners == {"Ann", "Dee"}


def test_delete_customer_then_reingest_restores_totals(spark, storage, layouts):
    names = spark.createDataFrame([("Ann",)], "customer_name string")
    before = {r.state: r.total_profit for r in nested_ops.q5_profit_by_state(
        layouts["nested"]).collect()}
    kept, counts = cust.delete_customers_nested(layouts["nested"], names)
    assert counts.first().value == 2
    ann = ingest.normalize_events(sales_frame(spark, [r for r in BASE if r[4] == "Ann"]))
    again = ingest.upsert_nested(kept, ann)
    after = {r.state: r.total_profit for r in nested_ops.q5_profit_by_state(again).collect()}
    assert after == before


def test_delete_customer_star_and_graph(spark, layouts):
    names = spark.createDataFrame([("Ann",), ("Nobody",)], "customer_name string")
    star, counts = cust.delete_customers_star(layouts["star"], names)
    assert {r.metric: r.value for r in counts.collect()} == {
        "deleted_facts": 2, "deleted_customers": 1}
    assert star.fact_sales.count() == 1
    g, gcounts = cust.delete_customers_graph(layouts["graph"], names)
    assert gcounts.first().value == 2
    assert g.nodes["Sale"].count() == 1
    for etype in ("OF_PRODUCT", "BY_CUSTOMER", "SHIPPED_TO", "ON_DATE", "USES_SHIP_MODE"):
        assert g.edges[etype].count() == 1


def test_parse_sale_ids(spark):
    ids = spark.createDataFrame([("a-b-3",), ("x",), ("x-",), ("-3",), ("a-x",), ("7-0",)],
                                "sales_fact_id string")
    got = {r.sales_fact_id: (r.order_id, r.line_no, r.parsed)
           for r in cust.parse_sale_ids(ids).collect()}
    assert got["a-b-3"] == ("a-b", 3, True)
    assert got["7-0"] == ("7", 0, True)
    for bad in ("x", "x-", "-3", "a-x"):
        assert got[bad][2] is False


def test_delete_lines_everywhere(spark, layouts):
    ids = spark.createDataFrame([("O1-1",), ("junk",)], "sales_fact_id string")
    star, counts = cust.delete_lines_star(layouts["star"], ids)
    assert {r.metric: r.value for r in counts.collect()} == {
        "deleted_count": 1, "requested": 1, "unparseable": 1}
    nested, n = cust.delete_lines_nested(layouts["nested"], ids)
    graph, g = cust.delete_lines_graph(layouts["graph"], ids)
    assert n.first().value == 1 and g.first().value == 1
    assert star.fact_sales.count() == nested.count() == graph.nodes["Sale"].count() == 2


def test_summary_refresh_and_merge(spark, storage, layouts):
    first = summ.refresh_star_summaries(layouts["star"], storage)
    v1 = storage.current_version("star_summaries")
    second = summ.refresh_star_summaries(layouts["star"], storage)
    assert storage.current_version("star_summaries") != v1
    assert sorted(first["summary_customer_ranking"].collect()) == \
        sorted(second["summary_customer_ranking"].collect())
    fresh = summ.nested_customer(layouts["nested"])
    once = summ.refresh_merged(storage, "cust", fresh, ["customer_name"])
    twice = summ.refresh_merged(storage, "cust", fresh, ["customer_name"])
    assert sorted(once.collect()) == sorted(twice.collect())  # merge is idempotent
    names = spark.createDataFrame([("Bob",)], "customer_name string")
    kept, _ = cust.delete_customers_nested(layouts["nested"], names)
    merged = summ.refresh_merged(storage, "cust", summ.nested_customer(kept), ["customer_name"])
    assert {r.customer_name for r in merged.collect()} == {"Ann", "Bob"}  # stale group stays
