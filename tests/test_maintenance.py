"""Deletes that persist in the stored layouts."""
import os

import pytest
from conftest import sales_frame
from shopfloor.functions import joins
from shopfloor.operators import graph as graph_ops
from shopfloor.operators import nested as nested_ops
from shopfloor.operators import star as star_ops
from shopfloor.operators import summaries
from shopfloor.plans.maintenance import LINE_TABLES, StoredLayouts
from shopfloor.session import settings

ROWS = [("O1", 0, "2017-01-02", "First", "Ann", "Oslo", "North", "Phone", "Tech", 100, 1, 10),
        ("O1", 1, "2017-01-02", "First", "Ann", "Oslo", "North", "Desk", "Furn", 30, 1, 3),
        ("O2", 2, "2017-01-09", "First", "Bob", "Oslo", "North", "Phone", "Tech", 50, 1, 5),
        ("O3", 3, "2017-02-09", "Second", "Ann", "Bergen", "West", "Phone", "Tech", 70, 2, 7),
        ("O4", 4, "2017-03-05", "Second", "Cy", "Bergen", "West", "Desk", "Furn", 40, 2, 4)]


def _stored(spark, storage, tmp_path):
    sales = sales_frame(spark, ROWS)
    return StoredLayouts.create(spark, str(tmp_path / "stored"), star_ops.build_star(sales, storage, "star"),
                                nested_ops.build_nested(sales, storage, "nested"), graph_ops.build_graph(sales, storage, "graph"))


def _files(stored, name):
    return {f"{d}/{f}" for d, _, names in os.walk(stored.storage.path(name).removeprefix("file:")) for f in names if f.endswith(".parquet")}


def _sale_ids(stored):
    star, graph = stored.star(), stored.graph()
    facts = {f"{r.order_id}-{r.line_no}" for r in star.fact_sales.collect()}
    records = {r.sales_fact_id for r in stored.nested().collect()}
    nodes = {r.sales_fact_id for r in graph.nodes["Sale"].collect()}
    ends = {name: {r.src for r in graph.edges[name].collect()} for name in graph_ops.SALE_EDGE_DST}
    return [facts, records, nodes, *ends.values()]


def test_customer_delete_rewrites_only_touched_months(spark, storage, tmp_path):
    stored = _stored(spark, storage, tmp_path)
    assert all(ids == {"O1-0", "O1-1", "O2-2", "O3-3", "O4-4"} for ids in _sale_ids(stored))
    march = {name: {f for f in _files(stored, name) if "2017-3" in f or "2017-03" in f} for name in ("nested", "Sale")}
    assert all(march.values())
    names = spark.createDataFrame([("Ann",), ("Nobody",), (None,), ("Ann",)], "customer_name string")
    counts = {(r.layout, r.metric): r.value for r in stored.delete_customers(names).collect()}
    assert counts == {("star", "deleted_facts"): 3, ("star", "deleted_customers"): 1, ("nested", "deleted_count"): 3,
                      ("graph", "deleted_sales"): 3, ("graph", "deleted_customers"): 1}
    again = StoredLayouts(spark, stored.root)
    assert all(ids == {"O2-2", "O4-4"} for ids in _sale_ids(again))
    assert {r.customer_name for r in again.star().dim_customer.collect()} == {"Bob", "Cy"}
    assert {r.customer_name for r in again.graph().nodes["Customer"].collect()} == {"Bob", "Cy"}
    for name in ("nested", "Sale"):
        assert march[name] <= _files(again, name)
    # February held only rows that went: its folders are gone.
    assert not [f for f in _files(again, "nested") if "2017-2" in f]
    assert {r.value for r in again.delete_customers(names).collect()} == {0}


def test_line_delete_returns_unparsable_ids(spark, storage, tmp_path):
    stored = _stored(spark, storage, tmp_path)
    ids = spark.createDataFrame([("O1-1",), ("O4-4",), ("O4-4",), ("nodash",), ("O9-9",), (None,)], "sales_fact_id string")
    counts, unparsable = stored.delete_lines(ids)
    assert {(r.layout, r.metric): r.value for r in counts.collect()} == {
        (layout, "deleted_count"): 2 for layout in ("star", "nested", "graph")}
    assert [r.sales_fact_id for r in unparsable.collect()] == ["nodash"]
    assert all(left == {"O1-0", "O2-2", "O3-3"} for left in _sale_ids(StoredLayouts(spark, stored.root)))


def test_everything_can_go(spark, storage, tmp_path):
    stored = _stored(spark, storage, tmp_path)
    stored.delete_lines(spark.createDataFrame([(f"{r[0]}-{r[1]}",) for r in ROWS], "sales_fact_id string"))
    assert all(left == set() for left in _sale_ids(stored)) and stored.months().count() == 0


def _values(tables):
    """Rows with exact numbers: sums of sums are wider decimals of the same value."""
    return {name: sorted(str([v.normalize() if hasattr(v, "normalize") else v for v in row]) for row in table.collect())
            for name, table in tables.items()}


def test_summaries_follow_deletes_by_touched_parts(spark, storage, tmp_path):
    stored = _stored(spark, storage, tmp_path)
    march = {f for f in _files(stored, "sums_summary_customer_ranking") if "2017-3" in f}
    edge_march = {f for f in _files(stored, "sums_BY_CUSTOMER") if "2017-03" in f}
    assert march and edge_march
    for step in ("none", "customer", "line"):
        if step == "customer":
            stored.delete_customers(spark.createDataFrame([("Ann",)], "customer_name string"))
        elif step == "line":
            stored.delete_lines(spark.createDataFrame([("O2-2",)], "sales_fact_id string"))
        again = StoredLayouts(spark, stored.root)
        nested, graph = again.nested(), again.graph()
        assert _values(again.nested_summaries()) == _values(
            {name: build(nested) for name, (build, _) in summaries.NESTED_BUILDERS.items()})
        assert _values(again.graph_summaries()) == _values(
            {name: build(graph) for name, (build, _, _) in summaries.GRAPH_BUILDERS.items()})
    assert march <= _files(again, "sums_summary_customer_ranking") and edge_march <= _files(again, "sums_BY_CUSTOMER")
    assert [(r.src, r.dst) for r in again.summarises()["CustomerRanking"].collect()] == [("Cy", "Cy")]
    again.delete_lines(spark.createDataFrame([("O4-4",)], "sales_fact_id string"))
    assert not any(t.count() for t in (*again.nested_summaries().values(), *again.graph_summaries().values()))


def test_a_delete_that_died_after_the_sums_is_run_again(spark, storage, tmp_path, monkeypatch):
    stored = _stored(spark, storage, tmp_path)
    ids = spark.createDataFrame([("O1-0",)], "sales_fact_id string")
    put = StoredLayouts._replace

    def dies(self, name, rows, touched, then=None):
        if name == "Sale":
            raise RuntimeError("lost")
        put(self, name, rows, touched, then)

    monkeypatch.setattr(StoredLayouts, "_replace", dies)
    with pytest.raises(RuntimeError):
        stored.delete_lines(ids)
    monkeypatch.undo()
    again = StoredLayouts(spark, stored.root)
    again.delete_lines(ids)
    graph = again.graph()
    assert graph.nodes["Sale"].where("sales_fact_id = 'O1-0'").count() == 0
    assert _values(again.graph_summaries()) == _values(
        {name: build(graph) for name, (build, _, _) in summaries.GRAPH_BUILDERS.items()})


def test_graph_delete_finds_parts_once_and_repeated_nodes_multiply_no_edge(spark, storage, tmp_path, monkeypatch):
    sales = sales_frame(spark, ROWS)
    graph = graph_ops.build_graph(sales, storage, "graph")
    twice = graph_ops.Graph({**graph.nodes, "Sale": graph.nodes["Sale"].union(graph.nodes["Sale"])}, graph.edges, {})
    stored = StoredLayouts.create(spark, str(tmp_path / "stored"), star_ops.build_star(sales, storage, "star"),
                                  nested_ops.build_nested(sales, storage, "nested"), twice)
    sought, look = [], StoredLayouts._touched
    monkeypatch.setattr(StoredLayouts, "_touched", lambda self, name, *a: sought.append(name) or look(self, name, *a))
    counts, _ = stored.delete_lines(spark.createDataFrame([("O1-0",)], "sales_fact_id string"))
    assert sought == ["fact_sales", "nested", "Sale"]
    assert {r.layout: r.value for r in counts.collect()} == {"star": 1, "nested": 1, "graph": 2}
    left = stored.graph()
    assert all(left.edges[name].count() == 4 for name in graph_ops.SALE_EDGE_DST) and left.nodes["Sale"].count() == 8
    assert _values(stored.graph_summaries()) == _values(
        {name: build(left) for name, (build, _, _) in summaries.GRAPH_BUILDERS.items()})


def _plans(monkeypatch):
    """Table -> plan of the rows that replace its parts, as it is when they are written."""
    plans, put = {}, StoredLayouts._replace

    def look(self, name, rows, touched, then=None):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        put(self, name, rows, touched, then)

    monkeypatch.setattr(StoredLayouts, "_replace", look)
    return plans


def test_many_keys_meet_the_rows_in_the_shuffle_that_brings_parts_together(spark, storage, tmp_path, monkeypatch):
    stored = _stored(spark, storage, tmp_path)
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    plans = _plans(monkeypatch)
    ids = spark.createDataFrame([("O1-1",), ("O1-0",), ("O1-0",), ("O3-3",), ("O9-9",)], "sales_fact_id string")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        counts, _ = stored.delete_lines(ids)
    assert {r.layout: r.value for r in counts.collect()} == {"star": 3, "nested": 3, "graph": 3}
    again = StoredLayouts(spark, stored.root)
    assert all(left == {"O2-2", "O4-4"} for left in _sale_ids(again))
    for name in LINE_TABLES:
        shuffles = [x for x in plans[name].splitlines() if "Exchange hashpartitioning(" in x]
        # Rows once, and the keys (the sales' state is bucketed for the edges).
        assert len(shuffles) == (1 if name in graph_ops.SALE_EDGE_DST else 2), plans[name]
        assert all("_slot" in x for x in shuffles)
    nested, graph = again.nested(), again.graph()
    assert _values(again.nested_summaries()) == _values({name: build(nested) for name, (build, _) in summaries.NESTED_BUILDERS.items()})
    assert _values(again.graph_summaries()) == _values({name: build(graph) for name, (build, _, _) in summaries.GRAPH_BUILDERS.items()})
    assert all(f.endswith(".zstd.parquet") for name in LINE_TABLES for f in _files(again, name) if "_part=none" not in f)


def test_few_keys_move_no_rows(spark, storage, tmp_path, monkeypatch):
    stored = _stored(spark, storage, tmp_path)
    plans = _plans(monkeypatch)
    counts = stored.delete_customers(spark.createDataFrame([("Ann",)], "customer_name string"))
    assert ("graph", "deleted_sales", 3) in {tuple(r) for r in counts.collect()}
    assert all("Exchange hashpartitioning(" not in plans[name] for name in ("fact_sales", "nested", "Sale"))
