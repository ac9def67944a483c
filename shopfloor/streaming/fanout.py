"""The ingest consumer - each micro-batch of sale events goes to the
three layouts, with one outcome per event and sink.

A sink that fails does not stop the others (as in the reference) and its
error is recorded; unlike the reference its batch is not lost. It is kept
under ``pending/<sink>`` and applied before any newer one, so a layout gets
its batches in order and each once. Each layout records the last batch id
it published, and a replayed batch skips the layouts that already have it.
A bad event (no date, a number that does not parse) is its own error outcome;
the rest of its batch goes on. Each layout lives as versions under
``live/<layout>`` behind a pointer: a batch reads the current version,
writes the next one and moves the pointer. New facts are written as their
own part (``facts/epoch=<id>``, replaced on retry), so the star's fact
table is never rewritten. The nested set, and the graph's Sale nodes and
sale edges, are kept one folder per order month behind a version manifest;
a batch rewrites only the months it touches. The graph's small node and
edge tables are rewritten whole.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph as graph_ops
from ..operators import ingest
from ..operators.star import DIMENSIONS, Star
from ..plans.storage import Storage

SINKS = ("star", "nested", "graph")


class LiveLayouts:
    """The three layouts as published versions in one folder."""

    def __init__(self, spark: SparkSession, storage: Storage):
        self.spark = spark
        self.storage = storage

    # -- reading the current state -----------------------------------------
    def _meta(self, name: str) -> dict | None:
        version = self.storage.current_version(name)
        if version is None:
            return None
        return json.loads(self.storage.read_text(name, version, "_META"))

    def star(self) -> Star | None:
        meta = self._meta("star")
        if meta is None:
            return None
        v = meta["version"]
        dims = {n: self.storage.read("star", v, n) for n in DIMENSIONS}
        # only the fact parts this version published: a part being rewritten
        # by a retried batch is never read
        base = self.storage.path("star_facts")
        parts = [self.storage.path("star_facts", f"epoch={e}") for e in meta["fact_parts"]]
        facts = self.spark.read.option("basePath", base).parquet(*parts).drop("epoch")
        return Star(**dims, fact_sales=facts, rows=meta["rows"])

    def nested(self) -> DataFrame | None:
        meta = self._meta("nested")
        if meta is None:
            return None
        return self._read_months(meta, list(meta["months"].values()))

    def _read_months(self, meta: dict, dirs: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(meta["schema_json"]))
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*dirs)

    def graph(self) -> graph_ops.Graph | None:
        meta = self._meta("graph")
        if meta is None:
            return None
        nodes, edges = {}, {}
        for name in (*graph_ops.NODE_KEYS, *graph_ops.EDGE_ENDS):
            df = (self._read_sale_table(meta, name) if name in meta["sale_parts"]
                  else self.storage.spark.read.parquet(meta["small"][name]))
            (nodes if name in graph_ops.NODE_KEYS else edges)[name] = df.drop(MONTH)
        return graph_ops.Graph(nodes, edges, meta.get("sizes", {}))

    def _read_sale_table(self, meta: dict, name: str, months=None) -> DataFrame:
        """A sale-keyed graph table (with its ``_month``), all months or some."""
        parts = meta["sale_parts"][name]
        dirs = [d for m, d in parts.items() if months is None or m in months]
        schema = T.StructType.fromJson(json.loads(meta["schemas"][name]))
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*dirs)

    # -- writing the next state -------------------------------------------
    def applied(self, name: str, epoch: int) -> bool:
        """True when ``epoch`` is already in the published version of ``name``."""
        meta = self._meta(name)
        return meta is not None and meta.get("last_epoch", -1) >= epoch >= 0

    def _publish(self, name: str, version: str, meta: dict) -> None:
        meta = {**meta, "version": version}
        self.storage.write_text(json.dumps(meta), name, version, "_META")
        self.storage.publish(name, version)

    def seed(self, star: Star, nested: DataFrame, graph: graph_ops.Graph) -> None:
        """Version 0 from layouts built by the batch load."""
        top = ingest.max_key(star.fact_sales, "sales_fact_id")  # once, at seeding
        self.write_star(replace(star, rows={**star.rows, ingest.MAX_FACT_ID: top}), epoch=-1)
        self.write_nested(nested)
        self.write_graph(graph)

    def write_star(self, star: Star, epoch: int, new_facts: DataFrame | None = None) -> None:
        previous = self._meta("star")
        parts = [p for p in (previous or {}).get("fact_parts", []) if p != epoch]
        version = self.storage.new_version("star")
        for name in DIMENSIONS:
            getattr(star, name).write.mode("overwrite").parquet(
                self.storage.path("star", version, name))
        facts = ingest.exact(star.fact_sales if new_facts is None else new_facts)
        facts.write.mode("overwrite").parquet(self.storage.path("star_facts", f"epoch={epoch}"))
        self._publish("star", version, {"rows": star.rows, "fact_parts": parts + [epoch],
                                        "last_epoch": epoch})

    def write_nested(self, nested: DataFrame, epoch: int = -1,
                     keep: dict[str, str] | None = None) -> None:
        """Write ``nested`` one folder per order month; ``keep`` are months
        (key -> folder) carried over unchanged from the previous version."""
        nested = ingest.exact(nested)
        version = self.storage.new_version("nested")
        root = self.storage.path("nested_months", version)
        (nested.withColumns({"_y": F.col("date.year"), "_m": F.col("date.month")})
         .write.mode("overwrite").partitionBy("_y", "_m").parquet(root))
        written = (self.spark.read.parquet(root).select("_y", "_m").distinct().collect())
        months = dict(keep or {})
        for r in written:
            months[f"{r['_y']}-{r['_m']}"] = f"{root}/_y={_folder(r['_y'])}/_m={_folder(r['_m'])}"
        self._publish("nested", version, {"last_epoch": epoch, "months": months,
                                          "schema_json": nested.schema.json()})

    def write_graph(self, g: graph_ops.Graph, epoch: int = -1,
                    sale_tables: dict[str, DataFrame] | None = None,
                    keep: dict[str, dict[str, str]] | None = None) -> None:
        """Publish a graph version. Small tables are written whole. The Sale
        nodes and sale edges are kept one folder per order month (``_month``
        is the month of the sale's first date): ``sale_tables`` are the rows of
        the months being rewritten, ``keep`` the month folders carried over.
        Without ``sale_tables`` (seeding) every month is written."""
        version = self.storage.new_version("graph")
        if sale_tables is None:
            sale_tables = _with_sale_month(g)
        small, sizes = {}, {}
        for name in (*graph_ops.NODE_KEYS, *graph_ops.EDGE_ENDS):
            if name in SALE_TABLES:
                continue
            df = g.nodes[name] if name in graph_ops.NODE_KEYS else g.edges[name]
            path = self.storage.path("graph_small", version, name)
            df.write.mode("overwrite").parquet(path)
            small[name] = path
            if name in graph_ops.NODE_KEYS:
                sizes[name] = graph_ops.file_bytes(self.spark, path)
        parts, schemas = {}, {}
        for name, df in sale_tables.items():
            df = ingest.exact(df) if name == "Sale" else df
            root = self.storage.path("graph_sales", version, name)
            (df.withColumn("_pm", F.col(MONTH)).write.mode("overwrite")
             .partitionBy("_pm").parquet(root))
            written = {r["_pm"] for r in
                       self.spark.read.parquet(root).select("_pm").distinct().collect()}
            months = dict((keep or {}).get(name, {}))
            months.update({str(m): f"{root}/_pm={_folder(m)}" for m in written})
            parts[name] = months
            schemas[name] = df.schema.json()
        self._publish("graph", version, {"small": small, "sale_parts": parts,
                                         "schemas": schemas, "sizes": sizes,
                                         "last_epoch": epoch})

    def compact_star(self, target_bytes: int | None = None) -> int:
        """Rewrite the published fact parts as one part and publish a version
        that lists only it (readers switch at the pointer move). The old
        parts stay on disk for a retention job. Returns the new part id."""
        from ..functions.joins import TARGET_PARTITION_BYTES, file_bytes
        meta = self._meta("star")
        part = -2 - meta.get("compactions", 0)  # negative ids never meet a batch id
        facts = self.star().fact_sales
        parts = [self.storage.path("star_facts", f"epoch={e}") for e in meta["fact_parts"]]
        size = file_bytes(self.spark, *parts)
        files = max(1, -(-size // (target_bytes or TARGET_PARTITION_BYTES)))
        (facts.repartitionByRange(files, "sales_fact_id").write.mode("overwrite")
         .parquet(self.storage.path("star_facts", f"epoch={part}")))
        self._publish("star", meta["version"],
                      {**{k: v for k, v in meta.items() if k != "version"},
                       "fact_parts": [part], "compactions": meta.get("compactions", 0) + 1})
        return part

    # -- one micro-batch ---------------------------------------------------------
    def apply_star(self, events: DataFrame, epoch: int) -> None:
        star = self.star()
        top = star.rows[ingest.MAX_FACT_ID]
        new = ingest.upsert_star(star, events, self.storage)
        self.write_star(new, epoch, new.fact_sales.where(F.col("sales_fact_id") > top))

    def apply_nested(self, events: DataFrame, epoch: int) -> None:
        """Keyed upsert that rewrites only the order months it touches: the
        months of the incoming records and the months where replaced
        records lived (a replay may move a sale to another month)."""
        meta = self._meta("nested")
        current = self.nested()
        latest = ingest.nested_records(ingest.last_per_id(events))
        month = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("None"))
                                   for c in ("date.year", "date.month")])
        ids = latest.select("sales_fact_id")
        old_months = current.join(ids, "sales_fact_id", "left_semi").select(month.alias("k"))
        touched = {r.k for r in latest.select(month.alias("k")).union(old_months)
                   .distinct().collect()}  # one row per month, bounded
        dirs = [meta["months"][k] for k in touched if k in meta["months"]]
        kept = (self._read_months(meta, dirs).join(ids, "sales_fact_id", "left_anti")
                if dirs else None)
        rewritten = latest if kept is None else kept.unionByName(latest)
        untouched = {k: v for k, v in meta["months"].items() if k not in touched}
        self.write_nested(rewritten, epoch, keep=untouched)

    def apply_graph(self, events: DataFrame, epoch: int) -> None:
        """MERGE a batch into the graph, rewriting only the order months its
        sales are stored in (a new sale goes to the month of its event)."""
        meta = self._meta("graph")
        merged = ingest.merge_graph(self.graph(), events, on_match=True)
        latest = ingest.last_per_id(events)
        stored = (self._read_sale_table(meta, "Sale").select("sales_fact_id", MONTH)
                  .join(latest.select("sales_fact_id"), "sales_fact_id", "left_semi"))
        assign = (latest.select("sales_fact_id",
                                F.date_format("order_date", "yyyy-MM").alias("_new"))
                  .join(stored, "sales_fact_id", "left")
                  .select("sales_fact_id", F.coalesce(MONTH, "_new").alias(MONTH)))
        touched = {str(r[0]) for r in assign.select(MONTH).distinct().collect()}  # bounded
        ids = assign.select("sales_fact_id")
        # every edge of a sale is stored in the sale's month, so the touched
        # months hold all edges a batch can repeat: no whole-table scan
        incoming = graph_ops.sale_edges(events)
        tables = {}
        for name in SALE_TABLES:
            before = self._read_sale_table(meta, name, touched)
            if name == "Sale":
                key = "sales_fact_id"
                kept = before.join(ids, key, "left_anti")
                fresh = latest.select(key, *graph_ops.SALE_MEASURES)
            else:
                key = "src"
                kept = before
                fresh = incoming[name].join(before, ["src", "dst"], "left_anti")
            fresh = fresh.join(assign.withColumnRenamed("sales_fact_id", key), key)
            tables[name] = kept.unionByName(fresh.select(*kept.columns))
        keep = {name: {m: d for m, d in meta["sale_parts"][name].items() if m not in touched}
                for name in SALE_TABLES}
        self.write_graph(merged, epoch, sale_tables=tables, keep=keep)


MONTH = "_month"
SALE_TABLES = ("Sale", *graph_ops.SALE_EDGE_DST)


def _folder(value) -> str:
    """A partition column's value as its folder is named."""
    return "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)


def _with_sale_month(g: graph_ops.Graph) -> dict[str, DataFrame]:
    """Sale nodes and sale edges tagged with the month of the sale's first date."""
    month = (g.edges["ON_DATE"].groupBy("src")
             .agg(F.date_format(F.min("dst"), "yyyy-MM").alias(MONTH)))
    out = {"Sale": g.nodes["Sale"].join(month.withColumnRenamed("src", "sales_fact_id"),
                                        "sales_fact_id")}
    for name in graph_ops.SALE_EDGE_DST:
        out[name] = g.edges[name].join(month, "src")
    return out


def _apply(live: LiveLayouts, sink: str, events: DataFrame, epoch: int, fail) -> str:
    """Apply one batch to one layout unless it has it; the outcome."""
    try:
        if fail and sink in fail:
            raise fail[sink]
        if not live.applied(sink, epoch):  # a replayed batch
            getattr(live, f"apply_{sink}")(events.where("error IS NULL").drop("error"), epoch)
        return "ok"
    except Exception as exc:  # one sink's failure is its own outcome
        return f"ERR: {type(exc).__name__}: {exc}"


def _record(live: LiveLayouts, sink: str, events: DataFrame, epoch: int, outcome: str) -> None:
    (ingest.outcome_rows(events, {sink: outcome}).drop("sink").write.mode("overwrite")
     .parquet(live.storage.path("outcomes", f"epoch={epoch}", f"sink={sink}")))


def pending_epochs(live: LiveLayouts, sink: str) -> list[int]:
    """Batches a sink has yet to take, oldest first."""
    names = live.storage.folders("pending", sink)
    return sorted(int(n.split("=")[1]) for n in names
                  if live.storage.exists("pending", sink, n, "_SUCCESS"))


def fan_out(live: LiveLayouts, fail: dict[str, Exception] | None = None):
    """foreachBatch function: apply a batch to each layout, record outcomes.

    ``fail`` injects an error for a sink (tests of sink isolation)."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        events = ingest.normalize_events(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for sink in SINKS:
                outcome = "ok"
                for epoch in [e for e in pending_epochs(live, sink) if e < epoch_id]:
                    kept = live.storage.read("pending", sink, f"epoch={epoch}")
                    outcome = _apply(live, sink, kept, epoch, fail)
                    if outcome != "ok":
                        break
                    _record(live, sink, kept, epoch, outcome)
                    live.storage.delete("pending", sink, f"epoch={epoch}")
                if outcome == "ok":
                    outcome = _apply(live, sink, events, epoch_id, fail)
                here = ("pending", sink, f"epoch={epoch_id}")
                if outcome != "ok":
                    events.write.mode("overwrite").parquet(live.storage.path(*here))
                _record(live, sink, events, epoch_id, outcome)
                if outcome == "ok" and live.storage.exists(*here):
                    live.storage.delete(*here)
        finally:
            events.unpersist()
    return run


def start_fan_out(events: DataFrame, live: LiveLayouts, trigger: dict | None = None,
                  fail: dict[str, Exception] | None = None):
    """Run the consumer on a stream of sale events (I7); returns the query."""
    writer = (events.writeStream.foreachBatch(fan_out(live, fail))
              .option("checkpointLocation", live.storage.path("_checkpoints", "fan_out")))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.queryName("fan_out").start()


def outcomes(live: LiveLayouts) -> DataFrame:
    """All recorded outcomes; with ``ingest.outcome_counts`` for I9."""
    return live.spark.read.parquet(live.storage.path("outcomes"))
