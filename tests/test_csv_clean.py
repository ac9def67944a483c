"""Order-line CSV edge rows (FIXTURES F1) through S1/S2 and C1-C10."""
import csv
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shopfloor.functions.cleaning import clean_rows, event_json, skipped_report, to_event
from shopfloor.sources.csv_orders import (detect_encoding, read_order_lines,
                                          read_order_lines_any_encoding)

HEADER = ["Order ID", "Order Date", "Ship Mode", "Customer Name", "State", "Region",
          "Category", "Product Name", "Sales", "Quantity", "Profit", "Discount"]


def row(oid, date, name="Ann", sales="10", qty="1", profit="1", disc="", product="Phone",
        category="Tech", state="Oslo", region="North", mode="First"):
    return [oid, date, mode, name, state, region, category, product, sales, qty, profit, disc]


# (row, expected: None = accepted, else the reject reason)
CASES = [
    (row("A", "1/2/2017"), None),
    (row("B", "13/01/2017"), None),
    (row("C", "2017-1-5"), None),
    (row("D", "1/2/17"), "bad order date"),
    (row("E", "02/30/2017"), "bad order date"),
    (row("F", "1/2/2017 x"), "bad order date"),
    (row("G", ""), "bad order date"),
    (row("H", "1/2/2017", qty="3.0"), "bad quantity"),
    (row("I", "1/2/2017", qty=" 3 "), None),
    (row("J", "1/2/2017", sales="1,234.5"), "bad sales"),
    (row("K", "1/2/2017", sales="1e3"), None),
    (row("L", "1/2/2017", name="  José  "), None),
    (row("M", "1/2/2017", name="Line\nbreak"), None),
    (row("N", "1/2/2017", profit="-5.5"), None),
    (row("O", "1/2/2017", disc="x"), "bad discount"),
    (row("P", "001/2/2017"), "bad order date"),
    (row("Q", "1/2/2017", name=""), None),
]


@pytest.fixture(scope="module")
def csv_file():
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    path = os.path.join(d, "orders.csv")
    with open(path, "w", newline="", encoding="latin-1") as fh:
        w = csv.writer(fh)
        w.writerow(HEADER)
        for i, (r, _exp) in enumerate(CASES):
            w.writerow(r)
            if i == 3:
                fh.write("\r\n")  # a blank line takes no line number
        fh.write("R,1/2/2017\r\n")  # short row
    return path


def test_accept_reject_and_line_numbers(spark, csv_file):
    raw = read_order_lines(spark, csv_file)
    good, bad = clean_rows(raw)
    accepted = {r.order_id: r for r in good.collect()}
    rejected = {r.line_no: r.reject_reason for r in bad.collect()}
    for i, (r, expected) in enumerate(CASES):
        if expected is None:
            assert r[0] in accepted, r
            assert accepted[r[0]].line_no == i
            assert accepted[r[0]].sales_fact_id == f"{r[0]}-{i}"
        else:
            assert rejected[i] == expected, (r, rejected.get(i))
    assert rejected[len(CASES)] == "short or malformed row"


def test_values(spark, csv_file):
    good, _ = clean_rows(read_order_lines(spark, csv_file))
    by_id = {r.order_id: r for r in good.collect()}
    assert str(by_id["A"].order_date) == "2017-01-02"
    assert str(by_id["B"].order_date) == "2017-01-13"
    assert str(by_id["C"].order_date) == "2017-01-05"
    assert by_id["I"].quantity == 3
    assert by_id["K"].sales_amount == 1000.0
    assert by_id["L"].customer_name == "José"
    assert by_id["M"].customer_name == "Line\nbreak"
    assert by_id["Q"].customer_name == ""
    assert by_id["A"].discount == 0.0 and by_id["A"].month_name == "January"


def test_skipped_report_uses_file_lines(spark, csv_file):
    _, bad = clean_rows(read_order_lines(spark, csv_file))
    lines = {r.line for r in skipped_report(bad).collect()}
    assert 3 + 2 in lines  # row index 3 ('1/2/17') is file line 5


def test_event_shape(spark, csv_file):
    good, _ = clean_rows(read_order_lines(spark, csv_file))
    ev = to_event(good)
    assert len(ev.columns) == 25 and ev.columns[0] == "sales_fact_id"
    msg = event_json(ev).where(F.col("key") == "A-0").first()
    assert '"order_date":"2017-01-02"' in msg.value


def test_encoding_detection_and_union(spark, csv_file):
    d = os.path.dirname(csv_file)
    utf = os.path.join(d, "utf8.csv")
    with open(utf, "w", encoding="utf-8", newline="") as fh:
        csv.writer(fh).writerows([HEADER, row("U", "1/2/2017", name="Zoë")])
    enc = {os.path.basename(r.file): r.encoding
           for r in detect_encoding(spark, [csv_file, utf]).collect()}
    assert enc == {"orders.csv": "ISO-8859-1", "utf8.csv": "UTF-8"}
    good, _ = clean_rows(read_order_lines_any_encoding(spark, [csv_file, utf]))
    names = {r.order_id: r.customer_name for r in good.collect()}
    assert names["U"] == "Zoë" and names["L"] == "José"


def test_line_numbers_when_files_split(spark):
    """Splittable mode: a file cut into several blocks keeps one numbering."""
    d = tempfile.mkdtemp(prefix="csvsplit-", dir="/tmp")
    path = os.path.join(d, "big.csv")
    with open(path, "w", newline="", encoding="latin-1") as fh:
        w = csv.writer(fh)
        w.writerow(HEADER)
        for i in range(3000):
            w.writerow(row(f"X{i}", "1/2/2017", sales=str(i)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = read_order_lines(spark, path, multiline=False)
        assert raw.rdd.getNumPartitions() > 3
        pairs = raw.select("`Order ID`", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r["Order ID"] == f"X{r.line_no}" for r in pairs)
    assert len(pairs) == 3000
