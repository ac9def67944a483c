"""The three layouts loaded from order-line CSV files (the reference's own
input), with the reference's per-file line numbers and sale ids."""
import csv
import os
import tempfile

from shopfloor.operators import graph as graph_ops
from shopfloor.operators import nested as nested_ops
from shopfloor.operators import star as star_ops
from shopfloor.plans.warehouse import CsvWarehouse

HEADER = ["Order ID", "Order Date", "Ship Mode", "Customer Name", "State", "Region",
          "Category", "Product Name", "Sales", "Quantity", "Profit"]


def _write(path, rows):
    with open(path, "w", newline="", encoding="latin-1") as fh:
        w = csv.writer(fh)
        w.writerow(HEADER)
        w.writerows(rows)


def test_csv_load_into_three_layouts(spark):
    d = tempfile.mkdtemp(prefix="csvwh-", dir="/tmp")
    _write(os.path.join(d, "a.csv"), [
        ["CA-1", "1/2/2017", "First", "Ann", "Oslo", "North", "Tech", "Phone", "100", "1", "10"],
        ["CA-1", "1/3/2017", "First", "Bob", "Oslo", "North", "Furn", "Chair", "50", "2", "5"],
        ["CA-2", "bad", "First", "Bob", "Oslo", "North", "Furn", "Chair", "50", "2", "5"],
    ])
    _write(os.path.join(d, "b.csv"), [
        ["CA-1", "2/3/2017", "Second", "Cy", "Bergen", "West", "Tech", "Phone", "70", "1", "7"],
    ])
    root = tempfile.mkdtemp(prefix="csvroot-", dir="/tmp")
    wh = CsvWarehouse.open_csv(spark, [d], root=root)
    sales = {(r.file.rsplit("/", 1)[-1], r.line_no): (r.sales_fact_id, r.fact_seq)
             for r in wh.sales().collect()}
    assert sales == {("a.csv", 0): ("CA-1-0", 1), ("a.csv", 1): ("CA-1-1", 2),
                     ("b.csv", 0): ("CA-1-0", 3)}
    assert [(r.line, r.reason) for r in wh.skipped().collect()] == [(4, "bad order date")]
    star = wh.star()
    assert sorted(r.sales_fact_id for r in star.fact_sales.collect()) == [1, 2, 3]
    assert wh.nested().count() == 3  # the batch load inserts both CA-1-0 records
    sale = {r.sales_fact_id: float(r.sales_amount) for r in wh.graph().nodes["Sale"].collect()}
    assert sale == {"CA-1-0": 100.0, "CA-1-1": 50.0}  # first file's measures win
    star_q1 = {r.product_name: r.revenue for r in star_ops.q1_top_products(star).collect()}
    nested_q1 = {r.product_name: r.revenue
                 for r in nested_ops.q1_top_products(wh.nested()).collect()}
    graph_q1 = {r.product_name: r.revenue
                for r in graph_ops.q1_top_products(wh.graph()).collect()}
    assert star_q1 == nested_q1 == {"Phone": 170.0, "Chair": 50.0}
    assert graph_q1 == {"Phone": 100.0, "Chair": 50.0}  # the reference's MERGE semantics


def test_columns_go_by_each_files_own_header(spark):
    d = tempfile.mkdtemp(prefix="csvwh-", dir="/tmp")
    line = ["CA-1", "1/2/2017", "First", "Ann", "Oslo", "North", "Tech", "Phone", "957.5775", "1", "-383.03105"]
    other = [*HEADER[:8], "Profit", "Quantity", "Sales", "Discount"]
    _write(os.path.join(d, "a.csv"), [line])
    files = {"b.csv": (other, [[*line[:8], "10.5", "2", "100.25", "0.2"], [*line[:8], "x", "2", "100.25", "0.2"]]),
             "c.csv": (HEADER[:10], [line[:10], line[:10]]), "d.csv": (HEADER, []), "e.csv": ([], [])}
    for name, (header, rows) in files.items():
        with open(os.path.join(d, name), "w", newline="", encoding="utf-8-sig" if name == "b.csv" else "utf-8") as fh:
            csv.writer(fh).writerows([header, *rows] if header else rows)
    wh = CsvWarehouse.open_csv(spark, [d], root=tempfile.mkdtemp(prefix="csvroot-", dir="/tmp"))
    got = sorted((r.file[-5:], str(r.sales_amount.normalize()), r.quantity, str(r.profit_amount.normalize())) for r in wh.sales().collect())
    assert got == [("a.csv", "957.5775", 1, "-383.03105"), ("b.csv", "100.25", 2, "10.5")]
    skipped = sorted((r.file[-5:], r.line, r.reason) for r in wh.skipped().collect())
    assert skipped == [("b.csv", 3, "bad profit"), ("c.csv", 2, "missing column: Profit"), ("c.csv", 3, "missing column: Profit")]
    amounts = {(str(r.sales_amount.normalize()), str(r.profit_amount.normalize()))
               for frame in (wh.star().fact_sales, wh.nested()) for r in frame.collect()}
    assert amounts == {("957.5775", "-383.03105"), ("100.25", "10.5")}


def test_only_files_without_a_required_column(spark):
    d = tempfile.mkdtemp(prefix="csvwh-", dir="/tmp")
    with open(os.path.join(d, "a.csv"), "w", newline="") as fh:
        csv.writer(fh).writerows([HEADER[1:], ["1/2/2017", *"abcdefgh", "1"]])
    wh = CsvWarehouse.open_csv(spark, [d], root=tempfile.mkdtemp(prefix="csvroot-", dir="/tmp"))
    assert wh.sales().count() == 0
    assert [(r.line, r.reason) for r in wh.skipped().collect()] == [(2, "missing column: Order ID")]
