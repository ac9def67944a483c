"""Line numbers of CSV files: the rows stay where they were read."""
from shopfloor.sources.csv_orders import most_blocks, read_order_lines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_csv_lines_shuffles_blocks_only(spark, tmp_path):
    header = "Order ID,Order Date,Ship Mode,Customer Name,State,Region,Category,Product Name,Sales,Quantity,Profit\n"
    for name, n in (("a b.csv", 5), ("c.csv", 3)):
        (tmp_path / name).write_text(header + "".join(f"O{i},1/2/2017,,,,,,,1,1,1\n" for i in range(n)))
    assert most_blocks(spark, [str(tmp_path)]) == most_blocks(spark, [f"{tmp_path}/*.csv"]) == 2
    for path in (str(tmp_path), f"{tmp_path}/*.csv"):
        rows = read_order_lines(spark, path, multiline=False)
        assert "SortMergeJoin" not in _plan(rows) and "BroadcastHashJoin" in _plan(rows)
        assert sorted((r["Order ID"], r.line_no) for r in rows.collect()) == sorted(
            [(f"O{i}", i) for i in range(5)] + [(f"O{i}", i) for i in range(3)])
