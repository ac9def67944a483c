"""Incremental ingest of sale events into the three layouts.

The reference applies one event at a time, in arrival order. Here a whole
batch is applied at once with the same outcome, ``seq`` standing for the
arrival order:

* star (I1-I3): each dimension is get-or-create - natural keys not yet
  present get keys ``max(key) + 1, + 2, ...`` in order of first arrival;
  the product is matched by name only (first key found wins, a new
  category for a known name is dropped); every event appends a fact with
  ``sales_fact_id = max + 1 ...``, replays included.
* nested (I4): keyed upsert on the sale id, the last event wins.
* graph (I5/I6): MERGE semantics - nodes by key, first value wins for
  ON CREATE attributes; Sale measures are replaced (stream) or kept
  (batch load); edges are added, never removed.

All steps are joins and aggregations ("last/first per key" is
``max_by``/``min_by`` with partial aggregation, so a hot key is combined
map-side); new keys are numbered with ``number_rows`` (no one-task window).
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import AMOUNT
from ..functions.columns import month_name
from ..functions.joins import maybe_broadcast
from ..functions.keys import number_rows
from ..plans.storage import LARGE_CODEC, Storage
from . import graph as graph_ops
from .nested import nested_records
from .star import DIMENSIONS, FACT_COLUMNS, Star

CORRUPT_EVENT, ARRIVED = "_corrupt", "_arrived"
# What the reference's tables hold as NOT NULL; year, month and month name follow from the date.
REQUIRED_FIELDS = ["order_date", "product_name", "category", "customer_name", "state", "region",
                   "ship_mode", "sales_amount", "quantity", "profit_amount"]


def exact(df: DataFrame) -> DataFrame:
    """Amounts in the one type of the live layouts, whatever layout or event they come from."""
    return df.withColumns({c: F.col(c).cast(AMOUNT) for c in ("sales_amount", "profit_amount")})


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str,
                   rows: int | None = None) -> DataFrame:
    """Join on ``keys`` where null equals null; the keys come from ``left``. ``rows`` bounds the right side."""
    there = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in keys]
    return left.join(maybe_broadcast(there, rows), on, how).drop(*[f"_right_{c}" for c in keys])


def normalize_events(events: DataFrame) -> DataFrame:
    """Typed events: exact amounts, a date, calendar parts, ``seq``.

    Accepts events as JSON gives them (all fields as text) or as the staging has
    them. ``seq`` is the arrival order: of files the modification time (``_arrived``), then the
    place; ``line_no`` when the source gives neither. ``events`` is a batch, not a stream. A
    record that is no event (``_corrupt``), an event whose date or numbers don't
    parse and one that lacks a required field keep their reason in ``error`` (null
    for a good event). An event without a sale id is none (I8); a record that can't
    be read is kept, since what it was can't be told."""
    cols = set(events.columns)
    e = events
    if ARRIVED in cols:
        place = F.monotonically_increasing_id().cast("decimal(38,0)")
        e = e.withColumn("seq", (F.col(ARRIVED).cast("decimal(38,0)") * F.lit(1 << 62) + place).cast("decimal(38,0)"))
        e = e.drop(ARRIVED)
    elif "seq" not in cols:
        e = e.withColumn("seq", F.col("line_no").cast("long"))
    typed = {"order_date": "date", "sales_amount": AMOUNT, "profit_amount": AMOUNT,
             "quantity": "int", "line_no": "long"}
    reasons = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(),
                      F.concat(F.lit(f"{c} is no {t.split('(')[0]}: "), F.col(c).cast("string")))
               for c, t in typed.items()]
    reasons += [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in REQUIRED_FIELDS if c in cols]
    reasons += [F.lit(f"{c} is missing") for c in REQUIRED_FIELDS if c not in cols]
    broken = F.col(CORRUPT_EVENT) if CORRUPT_EVENT in cols else F.lit(None).cast("string")
    e = e.withColumn("error", F.coalesce(F.concat(F.lit("no JSON event: "), broken), *reasons))
    e = e.where(F.col("sales_fact_id").isNotNull() | broken.isNotNull()).drop(CORRUPT_EVENT)
    e = e.withColumns({c: F.col(c).try_cast(t) for c, t in typed.items()})
    e = e.withColumns({c: F.col(c).try_cast("int") for c in ("year", "month", "day") if c in cols})
    derived = {"year": F.year("order_date"), "month": F.month("order_date"),
               "day": F.dayofmonth("order_date"), "month_name": month_name("order_date")}
    for name, expr in derived.items():
        e = e.withColumn(name, F.coalesce(F.col(name), expr) if name in cols else expr)
    return e


def _stage(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex[:10]}"


def max_key(df: DataFrame, key: str) -> int:
    """Largest key in use (0 when empty): one scalar to the driver."""
    value = df.agg(F.max(key)).first()[0]
    return int(value or 0)


# ---------------------------------------------------------------------------
# Star
# ---------------------------------------------------------------------------

# dimension: (event columns used for the lookup, event -> dimension column map)
STAR_LOOKUP = {
    "dim_date": (["year", "month"], {"year": "year", "month": "month",
                                     "month_name": "month_name"}),
    "dim_product": (["product_name"], {"product_name": "product_name",
                                       "category_name": "category"}),
    "dim_customer": (["customer_name"], {"customer_name": "customer_name"}),
    "dim_location": (["state", "region"], {"state": "state", "region": "region"}),
    "dim_ship_mode": (["ship_mode_name"], {"ship_mode_name": "ship_mode"}),
}


def upsert_dim(dim: DataFrame, events: DataFrame, name: str, storage: Storage,
               rows: int | None = None) -> tuple[DataFrame, int]:
    """Get-or-create. Returns the dimension with new rows appended
    (keys continue from the current maximum, in order of first arrival)
    and its new row count."""
    key = DIMENSIONS[name][0]
    match, mapping = STAR_LOOKUP[name]
    attrs = [c for c in mapping if c not in match]
    # Events are combined by a hash aggregation before min_by, which sorts what it is given.
    candidates = (events.groupBy(*[F.col(mapping[c]).alias(c) for c in [*match, *attrs]])
                  .agg(F.min("seq").alias("_first")))
    if attrs:
        candidates = candidates.groupBy(*match).agg(
            F.min("_first").alias("_first"), F.min_by(F.struct(*attrs), F.col("_first")).alias("_attrs"))
    fresh = null_safe_join(candidates, dim.select(*match), match, "left_anti", rows)
    fresh = fresh.select(*match, *[F.col(f"_attrs.{c}").alias(c) for c in attrs], "_first")
    start = max_key(dim, key) + 1
    numbered, n_new = number_rows(fresh, ["_first", *match], key, storage,
                                  _stage(f"upsert-{name}"), start=start)
    new_rows = numbered.select(*dim.columns)
    return dim.unionByName(new_rows), (rows or 0) + n_new


def key_lookup(dim: DataFrame, name: str) -> DataFrame:
    """Key per lookup value; for the name-only product match, the first
    (lowest) key of that name."""
    key = DIMENSIONS[name][0]
    match, _ = STAR_LOOKUP[name]
    return dim.groupBy(*match).agg(F.min(key).alias(key))


MAX_FACT_ID = "max_fact_id"


def append_fact(star: Star, events: DataFrame, storage: Storage,
                partitions: int | None = None) -> tuple[DataFrame, int]:
    """One new fact per event, ids ``max + 1 ...`` in arrival order.
    Returns the facts and the new largest id. The current largest id comes
    from ``star.rows`` when the caller keeps it (no fact scan), else from a
    ``max`` over the fact's id column. ``partitions``: how many tasks sort
    the new facts (default: the session's shuffle partitions); they are
    sorted with the fact's columns only."""
    f = events.withColumn("ship_mode_name", F.col("ship_mode"))
    for name, (match, _m) in STAR_LOOKUP.items():
        f = null_safe_join(f, key_lookup(getattr(star, name), name), match, "inner", star.rows.get(name))
    top = star.rows.get(MAX_FACT_ID)
    top = max_key(star.fact_sales, "sales_fact_id") if top is None else top
    f = f.select(*[c for c in FACT_COLUMNS if c != "sales_fact_id"], "seq")
    numbered, added = number_rows(f, ["seq"], "sales_fact_id", storage, _stage("append-fact"),
                                  start=top + 1, num_partitions=partitions, codec=LARGE_CODEC)
    new_facts = numbered.select(*FACT_COLUMNS)
    return star.fact_sales.unionByName(new_facts), top + added


def upsert_star(star: Star, events: DataFrame, storage: Storage,
                partitions: int | None = None) -> Star:
    """I1-I3 for a batch: five get-or-create dimensions, then the facts."""
    dims, rows = {}, dict(star.rows)
    for name in STAR_LOOKUP:
        dims[name], rows[name] = upsert_dim(getattr(star, name), events, name, storage,
                                            star.rows.get(name))
    with_dims = replace(star, **dims, rows=rows)
    facts, top = append_fact(with_dims, events, storage, partitions)
    return replace(with_dims, fact_sales=facts, rows={**rows, MAX_FACT_ID: top})


# ---------------------------------------------------------------------------
# Nested
# ---------------------------------------------------------------------------

def last_per_id(events: DataFrame) -> DataFrame:
    """The last event of each sale id (``max_by`` on arrival order)."""
    cols = [c for c in events.columns if c != "sales_fact_id"]
    last = F.max_by(F.struct(*cols), F.col("seq"))
    return (events.groupBy("sales_fact_id").agg(last.alias("_e"))
            .select("sales_fact_id", *[F.col(f"_e.{c}").alias(c) for c in cols]))


def upsert_nested(nested: DataFrame, events: DataFrame) -> DataFrame:
    """I4: ``update_one(upsert=True)`` per event; the last one per id wins."""
    latest = nested_records(last_per_id(events))
    kept = nested.join(latest.select("sales_fact_id"), "sales_fact_id", "left_anti")
    return kept.unionByName(latest)


# ---------------------------------------------------------------------------
# Graph
# ---------------------------------------------------------------------------

def _first_wins(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """MERGE .. ON CREATE SET: existing nodes unchanged, new keys added."""
    new = incoming.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def merge_graph(g: graph_ops.Graph, events: DataFrame, on_match: bool = True
                ) -> graph_ops.Graph:
    """I5 (``on_match=True``, the stream consumer: Sale measures replaced by
    the last event) and I6 (``on_match=False``, the batch load: the first
    measures stay)."""
    staged = events.withColumn("line_no", F.col("seq"))
    incoming_nodes = graph_ops.graph_nodes(staged)
    incoming_edges = graph_ops.graph_edges(staged)
    nodes = {}
    for label, keys in graph_ops.NODE_KEYS.items():
        old, new = g.nodes[label], incoming_nodes[label]
        if label == "Sale" and on_match:
            last = last_per_id(events).select("sales_fact_id", *graph_ops.SALE_MEASURES)
            nodes[label] = (old.join(last.select("sales_fact_id"), "sales_fact_id", "left_anti")
                            .unionByName(last))
        else:
            nodes[label] = _first_wins(old, new, keys)
    edges = {e: add_edges(g.edges[e], incoming_edges[e], sale_keyed=e in graph_ops.SALE_EDGE_DST)
             for e in g.edges}
    return graph_ops.Graph(nodes, edges, {})


def add_edges(existing: DataFrame, incoming: DataFrame, sale_keyed: bool) -> DataFrame:
    """MERGE (a)-[:T]->(b) for a batch: edges not yet present are added.

    Only existing edges that start at a sale of the batch can already be
    present, so for sale-keyed edge types those are picked with a semi-join
    on the batch's sale ids (the small side is the build side: the edge
    table is scanned, not shuffled) before the anti-join."""
    fresh = incoming.distinct()
    near = (existing.join(fresh.select("src").distinct(), "src", "left_semi")
            if sale_keyed else existing)
    return existing.unionByName(fresh.join(near, ["src", "dst"], "left_anti"))


# ---------------------------------------------------------------------------
# Fan-out with per-sink outcomes
# ---------------------------------------------------------------------------

def outcome_rows(events: DataFrame, outcomes: dict[str, str]) -> DataFrame:
    """One row per event and sink: (sales_fact_id, sink, outcome). A bad event's own
    error is its outcome, whatever the sink's."""
    own = (F.concat(F.lit("ERR: "), F.col("error")) if "error" in events.columns
           else F.lit(None).cast("string"))
    parts = [events.select("sales_fact_id", F.lit(sink).alias("sink"),
                           F.coalesce(own, F.lit(res)).alias("outcome"))
             for sink, res in outcomes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Rows per sink and outcome class (ok / error)."""
    cls = F.when(F.col("outcome") == "ok", F.lit("ok")).otherwise(F.lit("error"))
    return outcomes.groupBy("sink", cls.alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))
