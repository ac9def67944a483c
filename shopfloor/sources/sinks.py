"""Sinks (K1-K6). Files are the default target everywhere; a broker or a
database is a format option (the Kafka and JDBC connectors are not in this
image, so those paths are written but not exercised by the tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import event_json


def write_events(events: DataFrame, path: str | None = None, topic: str | None = None,
                 servers: str | None = None) -> None:
    """K1: keyed JSON events (key = sale id) - JSON-lines files, or a topic."""
    msgs = event_json(events)
    if topic:
        (msgs.write.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("topic", topic).save())
    else:
        msgs.write.mode("overwrite").json(path)


def stream_events(events: DataFrame, checkpoint: str, path: str | None = None,
                  topic: str | None = None, servers: str | None = None):
    """K1 for a stream of events: exactly-once file sink, or a topic."""
    msgs = event_json(events)
    w = msgs.writeStream.option("checkpointLocation", checkpoint)
    if topic:
        return (w.format("kafka").option("kafka.bootstrap.servers", servers)
                .option("topic", topic).start())
    return w.format("json").option("path", path).start()


def write_lines(lines: DataFrame, path: str | None = None, topic: str | None = None,
                servers: str | None = None, value: str = "value") -> None:
    """K2: raw text lines (blank and ``#`` lines dropped) to files or a topic."""
    v = F.trim(F.col(value))
    kept = lines.where((v != "") & ~v.startswith("#")).select(F.col(value).alias("value"))
    if topic:
        (kept.write.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("topic", topic).save())
    else:
        kept.write.mode("overwrite").text(path)


def write_relational(df: DataFrame, path: str | None = None, url: str | None = None,
                     table: str | None = None, mode: str = "append",
                     properties: dict | None = None) -> None:
    """K4: a table - parquet files, or a JDBC table when ``url`` is given."""
    if url:
        df.write.jdbc(url, table, mode=mode, properties=properties or {})
    else:
        df.write.mode("overwrite" if mode == "overwrite" else "append").parquet(path)


def write_documents(nested: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K5: nested records as parquet with structs, or as JSON documents."""
    writer = nested.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
