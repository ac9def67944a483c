"""Sale events through the fan-out consumer."""
import json
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import sales_frame
from shopfloor.functions.cleaning import to_event
from shopfloor.operators import graph as graph_ops
from shopfloor.operators import ingest
from shopfloor.operators import nested as nested_ops
from shopfloor.operators import star as star_ops
from shopfloor.plans.storage import Storage
from shopfloor.sources.sinks import write_documents, write_events, write_lines
from shopfloor.streaming.fanout import LiveLayouts, fan_out, outcomes, pending_epochs, start_fan_out
from shopfloor.streaming.sources import read_sale_events

BASE = [("O1", 0, "2017-01-02", "First", "Ann", "Oslo", "North", "Phone", "Tech", 100, 1, 10)]
EVENTS = [
    ("O1", 0, "2017-01-02", "First", "Ann", "Oslo", "North", "Phone", "Tech", 90, 1, 9),
    ("O2", 1, "2017-03-05", "Second", "Bob", "Bergen", "West", "Desk", "Furn", 40, 2, 4),
]


def _live(spark):
    st = Storage(spark, tempfile.mkdtemp(prefix="live-", dir="/tmp"))
    base = sales_frame(spark, BASE)
    live = LiveLayouts(spark, st)
    live.seed(star_ops.build_star(base, st, "seed_star"),
              nested_ops.build_nested(base, st, "seed_nested"),
              graph_ops.build_graph(base, st, "seed_graph"))
    return live


def _event_files(spark):
    d = tempfile.mkdtemp(prefix="events-", dir="/tmp")
    ev = to_event(sales_frame(spark, EVENTS).withColumn("customer_id", F.lit(""))
                  .withColumn("segment", F.lit("")).withColumn("country", F.lit(""))
                  .withColumn("city", F.lit("")).withColumn("postal_code", F.lit(""))
                  .withColumn("product_id", F.lit("")).withColumn("sub_category", F.lit(""))
                  .withColumn("discount", F.lit(0.0))
                  .withColumn("sales_amount", F.col("sales_amount").cast("double"))
                  .withColumn("profit_amount", F.col("profit_amount").cast("double")))
    write_events(ev, os.path.join(d, "msgs"))
    values = spark.read.json(os.path.join(d, "msgs")).select("value")
    values.write.text(os.path.join(d, "values"))
    return os.path.join(d, "values")


def test_fan_out_stream(spark):
    live = _live(spark)
    raw = spark.readStream.text(_event_files(spark))
    from shopfloor.streaming.sources import SALE_EVENT_SCHEMA
    events = raw.select(F.from_json("value", SALE_EVENT_SCHEMA).alias("e")).select("e.*")
    q = start_fan_out(events, live)
    q.processAllAvailable()
    q.stop()
    star = live.star()
    assert star.fact_sales.count() == 3  # the replay is appended
    assert {r.customer_name for r in star.dim_customer.collect()} == {"Ann", "Bob"}
    nested = {r.sales_fact_id: float(r.sales_amount) for r in live.nested().collect()}
    assert nested == {"O1-0": 90.0, "O2-1": 40.0}
    sale = {r.sales_fact_id: float(r.sales_amount)
            for r in live.graph().nodes["Sale"].collect()}
    assert sale == {"O1-0": 90.0, "O2-1": 40.0}
    counts = {(r.sink, r.outcome): r.rows
              for r in ingest.outcome_counts(outcomes(live)).collect()}
    assert counts == {("star", "ok"): 2, ("nested", "ok"): 2, ("graph", "ok"): 2}


def test_sink_failure_is_isolated_and_retry_adds_nothing(spark):
    live = _live(spark)
    batch = read_sale_events(spark, _event_files(spark), stream=False)
    run = fan_out(live, fail={"nested": RuntimeError("store down")})
    run(batch, 0)
    res = {r.sink: r.outcome for r in outcomes(live).select("sink", "outcome").distinct().collect()}
    assert res["star"] == "ok" and res["graph"] == "ok"
    assert res["nested"].startswith("ERR: RuntimeError: store down")
    assert live.nested().count() == 1  # nested unchanged
    fan_out(live)(batch, 0)  # the same epoch again, e.g. after a crash
    assert live.star().fact_sales.count() == 3
    assert live.nested().count() == 2


def test_other_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("a,b",), ("",), ("# c",), ("d,e",)], "value string")
    write_lines(lines, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    nested = nested_ops.nested_records(sales_frame(spark, BASE))
    write_documents(nested, str(tmp_path / "docs"), fmt="json")
    back = spark.read.json(str(tmp_path / "docs"))
    assert back.select("customer.customer_name").first()[0] == "Ann"


def test_nested_upsert_rewrites_only_touched_months(spark):
    st = Storage(spark, tempfile.mkdtemp(prefix="live-", dir="/tmp"))
    base = sales_frame(spark, BASE + [
        ("O0", 9, "2017-02-10", "First", "Cy", "Oslo", "North", "Desk", "Furn", 5, 1, 1)])
    live = LiveLayouts(spark, st)
    live.write_nested(nested_ops.build_nested(base, st, "seed_nested"))
    before = live._meta("nested")["months"]
    events = ingest.normalize_events(sales_frame(spark, [
        ("O2", 1, "2017-03-05", "Second", "Bob", "Bergen", "West", "Desk", "Furn", 40, 2, 4),
        ("O0", 9, "2017-01-20", "First", "Cy", "Oslo", "North", "Desk", "Furn", 6, 1, 1)]))
    live.apply_nested(events, 0)
    after = live._meta("nested")["months"]
    # Feb lost its only record (the sale moved to Jan): rewritten and now empty
    assert set(after) == {"2017-1", "2017-3"}
    assert after["2017-1"] != before["2017-1"]
    got = {r.sales_fact_id: (r.date.month, float(r.sales_amount)) for r in live.nested().collect()}
    assert got == {"O1-0": (1, 100.0), "O0-9": (1, 6.0), "O2-1": (3, 40.0)}


def test_untouched_month_is_carried_over(spark):
    st = Storage(spark, tempfile.mkdtemp(prefix="live-", dir="/tmp"))
    base = sales_frame(spark, BASE)
    live = LiveLayouts(spark, st)
    live.write_nested(nested_ops.build_nested(base, st, "seed_nested"))
    before = live._meta("nested")["months"]
    events = ingest.normalize_events(sales_frame(spark, [
        ("O2", 1, "2017-03-05", "Second", "Bob", "Bergen", "West", "Desk", "Furn", 40, 2, 4)]))
    live.apply_nested(events, 0)
    after = live._meta("nested")["months"]
    assert after["2017-1"] == before["2017-1"]  # same folder: not rewritten
    assert live.nested().count() == 2


def test_graph_upsert_rewrites_only_touched_months(spark):
    live = _live(spark)
    before = live._meta("graph")["sale_parts"]
    events = ingest.normalize_events(sales_frame(spark, [
        ("O2", 1, "2017-03-05", "Second", "Bob", "Bergen", "West", "Desk", "Furn", 40, 2, 4),
        ("O1", 0, "2017-01-02", "First", "Dee", "Oslo", "North", "Phone", "Tech", 95, 1, 9)]))
    live.apply_graph(events, 0)
    after = live._meta("graph")["sale_parts"]
    assert set(after["Sale"]) == {"2017-01", "2017-03"}
    g = live.graph()
    assert {r.sales_fact_id: float(r.sales_amount) for r in g.nodes["Sale"].collect()} == \
        {"O1-0": 95.0, "O2-1": 40.0}
    assert {r.dst for r in g.edges["BY_CUSTOMER"].where("src = 'O1-0'").collect()} == \
        {"Ann", "Dee"}  # the old edge stays, the new one is added
    assert g.edges["OF_PRODUCT"].count() == 2
    events2 = ingest.normalize_events(sales_frame(spark, [
        ("O3", 2, "2017-03-09", "Second", "Bob", "Bergen", "West", "Desk", "Furn", 1, 1, 1)]))
    live.apply_graph(events2, 1)
    again = live._meta("graph")["sale_parts"]
    assert again["Sale"]["2017-01"] == after["Sale"]["2017-01"]  # untouched: same folder
    assert again["Sale"]["2017-03"] != after["Sale"]["2017-03"]
    assert live.graph().nodes["Sale"].count() == 3


def test_compact_star_keeps_facts_and_shrinks_the_manifest(spark):
    live = _live(spark)
    batch = read_sale_events(spark, _event_files(spark), stream=False)
    fan_out(live)(batch, 0)
    fan_out(live)(batch, 1)
    before = sorted(tuple(r) for r in live.star().fact_sales.collect())
    assert len(live._meta("star")["fact_parts"]) == 3
    live.compact_star()
    assert live._meta("star")["fact_parts"] == [-2]
    assert sorted(tuple(r) for r in live.star().fact_sales.collect()) == before
    fan_out(live)(batch, 2)  # batches keep appending after a compaction
    assert live.star().fact_sales.count() == len(before) + 2


def _events(spark, rows):
    cols = ("sales_fact_id string, line_no long, order_date string, ship_mode string, customer_name string, "
            "state string, region string, product_name string, category string, sales_amount double, "
            "quantity int, profit_amount double, order_id string, seq long")
    return spark.createDataFrame(rows, cols)


def _event(sale, amount, seq, date="2017-03-05"):
    order, line = sale.split("-")
    return (sale, int(line), date, "First", "Ann", "Oslo", "North", "Phone", "Tech", float(amount), 1, 1.0, order, seq)


def test_failed_sink_takes_its_batches_later_and_in_order(spark, tmp_path):
    live = _live(spark)
    schema = _events(spark, []).schema
    folder = str(tmp_path / "in")

    def step(rows, fail):
        _events(spark, rows).coalesce(1).write.mode("append").json(folder)
        q = start_fan_out(spark.readStream.schema(schema).json(folder), live, fail=fail)
        q.processAllAvailable()
        q.stop()

    down = {"nested": RuntimeError("store down")}
    step([_event("O2-1", 10, 0)], down)
    step([_event("O2-1", 20, 1), _event("O3-1", 5, 2)], down)
    assert pending_epochs(live, "nested") == [0, 1] and live.nested().count() == 1
    step([_event("O4-1", 7, 3)], None)
    assert pending_epochs(live, "nested") == []
    want = {"O1-0": 100.0, "O2-1": 20.0, "O3-1": 5.0, "O4-1": 7.0}
    assert {r.sales_fact_id: float(r.sales_amount) for r in live.nested().collect()} == want
    assert {r.sales_fact_id: float(r.sales_amount) for r in live.graph().nodes["Sale"].collect()} == want
    assert live.star().fact_sales.count() == 5
    assert {r.outcome for r in outcomes(live).collect()} == {"ok"}


def test_bad_event_is_its_own_outcome(spark):
    live = _live(spark)
    fan_out(live)(_events(spark, [_event("O2-1", 1, 0), _event("O3-1", 1, 1, "not a date"), _event("O4-1", 1, 2, None)]), 0)
    assert {r.sales_fact_id for r in live.nested().collect()} == {"O1-0", "O2-1"}
    assert live.star().fact_sales.count() == 2
    got = {(r.sales_fact_id, r.outcome) for r in outcomes(live).collect()}
    assert got == {("O2-1", "ok"), ("O3-1", "ERR: order_date is no date: not a date"),
                   ("O4-1", "ERR: order_date is missing")}


def test_last_of_several_events_wins_however_dealt(spark):
    rows = [_event("O2-1", amount, seq) for seq, amount in enumerate([30, 90, 10])]
    for parts in (1, 2, 5):
        last = ingest.last_per_id(ingest.normalize_events(_events(spark, rows).repartition(parts))).collect()
        assert [float(r.sales_amount) for r in last] == [10.0]


def test_file_events_come_in_order_of_their_places(spark, tmp_path):
    _events(spark, [_event("O2-1", a, 0) for a in (30, 90, 10)]).drop("seq").coalesce(1).write.json(str(tmp_path / "e"))
    last = ingest.last_per_id(ingest.normalize_events(read_sale_events(spark, str(tmp_path / "e"), stream=False)))
    assert [float(r.sales_amount) for r in last.collect()] == [10.0]


def test_nested_layout_with_a_sale_without_date(spark):
    st = Storage(spark, tempfile.mkdtemp(prefix="live-", dir="/tmp"))
    live = LiveLayouts(spark, st)
    undated = (BASE[0][0], 5, None, *BASE[0][3:])
    live.write_nested(nested_ops.nested_records(sales_frame(spark, [*BASE, undated])))
    assert live.nested().count() == 2


def test_long_tails_of_sale_ids_do_not_parse(spark):
    from shopfloor.operators.customers import parse_sale_ids
    ids = spark.createDataFrame([("O1-99999999999999999999",), ("O1-7",), (None,)], "sales_fact_id string")
    got = {r.sales_fact_id: (r.line_no, r.parsed) for r in parse_sale_ids(ids).collect()}
    assert got == {"O1-99999999999999999999": (None, False), "O1-7": (7, True), None: (None, False)}


GOOD_EVENT = {"sales_fact_id": "O7-1", "order_id": "O7", "line_no": 1, "order_date": "2017-03-05", "ship_mode": "Second",
              "customer_name": "Bob", "state": "Bergen", "region": "West", "product_name": "Desk", "category": "Furn",
              "sales_amount": 957.5775, "quantity": 2, "profit_amount": -383.03105}


def test_bad_records_of_a_stream_are_errors_and_add_nothing(spark, tmp_path):
    live = _live(spark)
    before = {name: sorted(map(str, rows)) for name, rows in _state(live).items()}
    folder = tmp_path / "events"
    folder.mkdir()
    bad = [{**GOOD_EVENT, "sales_fact_id": "O8-1", "sales_amount": "abc"}, {**GOOD_EVENT, "sales_fact_id": "O9-1", "customer_name": None},
           {**GOOD_EVENT, "sales_fact_id": "O10-1", "sales_amount": 1e30}]
    lines = [json.dumps(e) for e in bad] + ['{"sales_fact_id": "O11-1", "sales_am', "[1, 2]", "", json.dumps({**GOOD_EVENT, "sales_fact_id": None})]
    (folder / "a.json").write_text("\n".join(lines))
    q = start_fan_out(read_sale_events(spark, str(folder)), live)
    q.processAllAvailable()
    q.stop()
    assert {name: sorted(map(str, rows)) for name, rows in _state(live).items()} == before
    for sink in ("star", "nested", "graph"):
        got = sorted((r.sales_fact_id or "", r.outcome) for r in outcomes(live).where(F.col("sink") == sink).collect())
        assert got == [("", 'ERR: no JSON event: [1, 2]'), ("", 'ERR: no JSON event: {"sales_fact_id": "O11-1", "sales_am'),
                       ("O10-1", "ERR: sales_amount is no decimal: 1.0E30"), ("O8-1", "ERR: sales_amount is no decimal: abc"),
                       ("O9-1", "ERR: customer_name is missing")]


def _state(live):
    star, graph = live.star(), live.graph()
    return {**{d: getattr(star, d).collect() for d in star_ops.DIMENSIONS}, "fact": star.fact_sales.collect(),
            "nested": live.nested().collect(), **{n: df.collect() for n, df in {**graph.nodes, **graph.edges}.items()}}


def test_amounts_of_events_are_exact_in_every_layout(spark, tmp_path):
    live = _live(spark)
    (tmp_path / "a.json").write_text(json.dumps(GOOD_EVENT))
    fan_out(live)(read_sale_events(spark, str(tmp_path), stream=False), 0)
    want = (Decimal("957.5775"), Decimal("-383.03105"))
    facts = live.star().fact_sales.where("order_id = 'O7'").collect()
    records = live.nested().where("sales_fact_id = 'O7-1'").collect()
    nodes = live.graph().nodes["Sale"].where("sales_fact_id = 'O7-1'").collect()
    assert [(r.sales_amount, r.profit_amount) for r in facts + records + nodes] == [want] * 3
    assert {r.outcome for r in outcomes(live).collect()} == {"ok"}


def test_null_keys_are_created_once(spark):
    live = _live(spark)
    rows = [("O2", 1, "2017-03-05", "Second", None, "Bergen", "West", "Desk", "Furn", 40, 2, 4)]
    star = live.star()
    for _ in range(2):
        star = ingest.upsert_star(star, ingest.normalize_events(sales_frame(spark, rows)), live.storage)
    assert star.dim_customer.where("customer_name IS NULL").count() == 1
    assert star.fact_sales.count() == 3


def test_topic_text_is_parsed_like_files(spark):
    from shopfloor.streaming.sources import parse_sale_events
    lines = spark.createDataFrame([(json.dumps(GOOD_EVENT), 5), ("no json", 6)], "value string, seq long")
    rows = ingest.normalize_events(parse_sale_events(lines)).orderBy("seq").collect()
    assert [r.error for r in rows] == [None, "no JSON event: no json"]
    assert (rows[0].sales_amount, rows[0].quantity, rows[0].line_no, rows[0].year) == (Decimal("957.5775"), 2, 1, 2017)
