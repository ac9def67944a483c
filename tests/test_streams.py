"""Structured Streaming: golden totals (FIXTURES F3), stream equals batch,
late rows within and beyond the grace period, append sink."""
import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from shopfloor.plans.storage import Storage
from shopfloor.sources.tables import read_table
from shopfloor.streaming import tables as W
from shopfloor.streaming.runner import read_table as read_live, start_append, start_table
from shopfloor.streaming.sources import (query_events_from_table, read_query_events,
                                         read_sales_transactions)

# The reference's sample transactions (cust_id, location, product, sale).
TRANSACTIONS = """\
CUST001,Oslo,Laptop,1200.00
CUST002,Bergen,Phone,800.00
CUST003,Trondheim,Headphones,150.00
CUST001,Oslo,Mouse,45.00
CUST004,Stavanger,Keyboard,90.00
CUST002,Bergen,Laptop,1450.00
CUST005,Oslo,Monitor,310.00
CUST003,Trondheim,Phone,720.00
CUST001,Oslo,Headphones,180.00
CUST006,Kristiansand,Laptop,1100.00
CUST004,Stavanger,Mouse,35.00
CUST007,Bergen,Monitor,290.00
CUST002,Bergen,Keyboard,75.00
CUST005,Oslo,Phone,850.00
CUST008,Oslo,Laptop,1320.00
CUST003,Trondheim,Mouse,40.00
CUST006,Kristiansand,Headphones,160.00
CUST007,Bergen,Phone,790.00
CUST001,Oslo,Keyboard,80.00
CUST008,Oslo,Monitor,330.00
"""

GOLDEN_PRODUCT = {"Headphones": (3, 490), "Keyboard": (3, 245), "Laptop": (4, 5070),
                  "Monitor": (3, 930), "Mouse": (3, 120), "Phone": (4, 3160)}
GOLDEN_CUSTOMER = {"CUST001": (4, 1505), "CUST002": (3, 2325), "CUST003": (3, 910),
                   "CUST004": (2, 125), "CUST005": (2, 1160), "CUST006": (2, 1260),
                   "CUST007": (2, 1080), "CUST008": (2, 1650)}


def _files_in_order(d, chunks, ext):
    """One file per chunk, modification times ascending."""
    os.makedirs(d, exist_ok=True)
    now = time.time() - 1000
    for i, text in enumerate(chunks):
        p = os.path.join(d, f"part-{i:04d}.{ext}")
        with open(p, "w") as fh:
            fh.write(text)
        os.utime(p, (now + i, now + i))


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="stream-", dir="/tmp")


def test_golden_running_totals(spark, tmp):
    lines = TRANSACTIONS.splitlines()
    chunks = ["# header comment\n\n" + "\n".join(lines[:7]) + "\n",
              "\n".join(lines[7:14]) + "\n\n", "\n".join(lines[14:]) + "\n"]
    src = os.path.join(tmp, "in")
    _files_in_order(src, chunks, "txt")
    st = Storage(spark, os.path.join(tmp, "out"))
    tx = read_sales_transactions(spark, src, max_files_per_trigger=1)
    queries = [start_table(W.sales_by_customer(tx), "by_customer", ["cust_id"], st),
               start_table(W.sales_by_product_location(tx), "by_pl", ["product", "location"], st),
               start_table(W.sales_windowed(tx, grace=None), "windowed",
                           W.TABLE_KEYS["sales_windowed"], st)]
    for q in queries:
        q.processAllAvailable()
        q.stop()
    cust = {r.cust_id: (r.order_count, r.total_spent) for r in read_live(st, "by_customer").collect()}
    assert cust == GOLDEN_CUSTOMER
    pl = read_live(st, "by_pl")
    assert pl.count() == 17
    two = {(r["product"], r.location): r.total_sale for r in pl.where("order_count = 2").collect()}
    assert two == {("Laptop", "Oslo"): 2520, ("Monitor", "Oslo"): 640, ("Phone", "Bergen"): 1590}
    per_product = (read_live(st, "windowed").groupBy("product")
                   .agg(F.sum("order_count").alias("n"), F.sum("total_sale").alias("s")))
    assert {r["product"]: (r.n, r.s) for r in per_product.collect()} == GOLDEN_PRODUCT


def _event_json(rows):
    out = []
    for r in rows:
        d = r.asDict()
        d.pop("event_time")
        out.append(json.dumps(d))
    return "\n".join(out) + "\n"


def test_query_metrics_stream_equals_batch(spark, tmp):
    events = query_events_from_table(read_table(spark, SMALL, "events"))
    rows = events.orderBy("event_time").collect()
    quarter = len(rows) // 4
    chunks = [_event_json(rows[i * quarter:(i + 1) * quarter if i < 3 else len(rows)])
              for i in range(4)]
    src = os.path.join(tmp, "events")
    _files_in_order(src, chunks, "json")
    st = Storage(spark, os.path.join(tmp, "out"))
    stream = read_query_events(spark, src, max_files_per_trigger=1)
    q = start_table(W.query_metrics(stream), "metrics", W.TABLE_KEYS["query_metrics"], st)
    failed = start_append(W.failed_queries(stream), "failed", st)
    for query in (q, failed):
        query.processAllAvailable()
        query.stop()
    got = read_live(st, "metrics")
    want = W.query_metrics(read_query_events(spark, src, stream=False))
    cols = sorted(want.columns)
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    assert spark.read.parquet(st.path("failed", "data")).count() == \
        events.where("success = false").count()


def test_late_rows_within_and_beyond_grace(spark, tmp):
    """24 h grace: a row a day behind the newest one still counts; a row
    behind the watermark is dropped. Spark filters late rows with the
    watermark of the previous batch, so the too-late row comes one batch
    after the watermark moved."""
    def ev(i, ts):
        return json.dumps({"event_id": str(i), "db_name": "pg", "query_type": "custom",
                           "query_key": None, "success": True, "row_count": 1,
                           "elapsed_ms": 10.0, "executed_at": ts}) + "\n"
    src = os.path.join(tmp, "late")
    _files_in_order(src, [
        ev(1, "2024-01-02T10:00:00Z") + ev(2, "2024-01-02T10:02:00Z"),
        ev(3, "2024-01-03T12:00:00Z"),  # watermark moves to Jan 2 12:00
        ev(4, "2024-01-02T13:00:00Z"),  # late, but inside the grace: counted
        ev(5, "2024-01-03T12:02:00Z"),
        ev(6, "2024-01-02T10:01:00Z"),  # behind the watermark: dropped
    ], "json")
    st = Storage(spark, os.path.join(tmp, "out"))
    stream = read_query_events(spark, src, max_files_per_trigger=1)
    q = start_table(W.query_metrics(stream), "m", W.TABLE_KEYS["query_metrics"], st)
    q.processAllAvailable()
    q.stop()
    got = {r.window_start.strftime("%d %H:%M"): r.execution_count
           for r in read_live(st, "m").collect()}
    assert got == {"02 10:00": 2, "03 12:00": 2, "02 13:00": 1}
