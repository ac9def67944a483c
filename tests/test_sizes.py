"""What grows with the order lines in the graph: aggregations that sort, size of the files."""
import glob
import time

from conftest import sales_frame
from shopfloor.operators import customers
from shopfloor.operators import graph as graph_ops

ROWS = [
    ("O1", 0, "2017-01-02", "First", "Ann", "Oslo", None, "Phone", "Tech", 100, 1, 10),
    ("O1", 1, "2017-01-03", "First", "Bob", "Oslo", "North", "Chair", "Furn", 50, 2, 5),
    ("O2", 2, "2017-01-04", "Second", "Ann", "Bergen", "West", "Phone", "Gadgets", 30, 1, 3),
    ("O2", 3, "2017-02-04", "Second", None, "Bergen", "East", None, "Gadgets", 30, 1, 3),
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_values_need_no_sort_of_the_lines(spark):
    nodes = graph_ops.graph_nodes(sales_frame(spark, ROWS))
    assert sorted(map(tuple, nodes["State"].collect())) == [("Bergen", "West"), ("Oslo", None)]
    for label, column in (("State", "region"), ("Month", "month_name")):
        lines = [x for x in _plan(nodes[label]).splitlines() if "Aggregate(" in x][-1]
        assert "HashAggregate" in lines and column in lines.split("functions=")[0]


def test_sale_tables_are_compressed_small_ones_keep_the_broadcast_bound(spark, storage):
    graph_ops.build_graph(sales_frame(spark, ROWS), storage, "g", unique_sales=True, buckets=2)
    for part in ("nodes/Sale", *(f"edges/{e}" for e in graph_ops.SALE_EDGE_DST)):
        files = glob.glob(storage.path("g", part, "*.parquet"))
        assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert glob.glob(storage.path("g", "nodes", "State", "*.snappy.parquet"))


def _scratch_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size())}


def test_a_graph_build_leaves_no_shuffle_or_cached_files(spark, storage):
    before = _scratch_files(spark)
    graph = graph_ops.build_graph(sales_frame(spark, ROWS), storage, "g", unique_sales=True, buckets=3)
    for _ in range(50):  # files go in the background
        left = _scratch_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert storage.folders("g") == ["edges", "nodes"]
    for etype, column in graph_ops.SALE_EDGE_DST.items():
        files = glob.glob(storage.path("g", "edges", etype, "*.parquet"))
        assert len({f.split("_")[-1] for f in files}) == len(files)  # one file per bucket
        rows = sorted((str(r.src), str(r.dst)) for r in graph.edges[etype].collect())
        assert rows == sorted((str(r[0]), str(r[1])) for r in sales_frame(spark, ROWS).select("sales_fact_id", column).collect())


def test_a_frame_can_be_collected_again_after_its_shuffle_went(spark):
    rows = spark.range(1000).repartition(7).groupBy("id").count().where("id < 5")
    assert len(rows.collect()) == 5
    time.sleep(1)
    assert len(rows.collect()) == 5


def test_a_small_request_does_not_shuffle_the_edges_of_all_customers(spark, storage):
    graph = graph_ops.build_graph(sales_frame(spark, ROWS), storage, "g", unique_sales=True, buckets=3)
    names = spark.createDataFrame([("Ann",), ("Nobody",), (None,), ("Ann",)], "customer_name string").limit(4)
    left, counts = customers.delete_customers_graph(graph, names)
    assert {r.src for r in left.edges["OF_PRODUCT"].collect()} == {"O1-1", "O2-3"} and counts.first().value == 2
    plan = left.edges["OF_PRODUCT"]._jdf.queryExecution().optimizedPlan().toString()
    semi = [x for x in plan.splitlines() if "Join LeftSemi" in x]
    assert len(semi) == 2 and "customer_name" in semi[0] and plan.index("Aggregate") < plan.index("Join LeftSemi")
    assert "GlobalLimit" in plan[plan.index(semi[1]):]  # the request meets the edges first, the nodes what is left of them
