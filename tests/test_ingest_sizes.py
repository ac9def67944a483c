"""What grows with the events of an ingest: the columns that are sorted."""
import glob

from conftest import sales_frame
from shopfloor.operators import ingest
from shopfloor.operators import star as star_ops

ROWS = [
    ("O1", 0, "2017-01-02", "First", "Ann", "Oslo", None, "Phone", "Tech", 100, 1, 10),
    ("O1", 1, "2017-01-03", "First", "Bob", "Oslo", "North", "Chair", "Furn", 50, 2, 5),
    ("O2", 2, "2017-01-04", "Second", "Ann", "Bergen", "West", "Phone", "Gadgets", 30, 1, 3),
    ("O2", 3, "2017-02-04", "Second", None, "Bergen", "East", None, "Gadgets", 30, 1, 3),
]


def test_new_facts_are_sorted_with_the_fact_columns_only(spark, storage):
    star = star_ops.build_star(sales_frame(spark, ROWS[1:3]), storage)
    events = ingest.normalize_events(sales_frame(spark, ROWS))
    new = ingest.upsert_star(star, events, storage, 3)
    staged, = [f for f in glob.glob(storage.path("stage", "append-fact-*")) if not f.endswith("-offsets")]
    assert set(spark.read.parquet(staged).columns) == {*star_ops.FACT_COLUMNS, "seq", "_row_id"} - {"sales_fact_id"}
    assert len(glob.glob(f"{staged}/*.zstd.parquet")) == 3
    got = sorted(new.fact_sales.collect(), key=lambda r: r.sales_fact_id)
    assert [r.line_no for r in got] == [1, 2, 0, 1, 2, 3]
    assert [r.sales_fact_id for r in got] == list(range(2, 8))
    # the first category of a new name, in arrival order; null is a name like any other
    again = ingest.upsert_star(new, events, storage)
    assert sorted((str(r.product_name), r.category_name) for r in again.dim_product.collect()) == [
        ("Chair", "Furn"), ("None", "Gadgets"), ("Phone", "Gadgets")]
