"""Running the stream tables and the fan-out consumer.

``update`` output repeats a key whenever its value changes, so the sink
must upsert by key, never append: each micro-batch is merged into the
table's current version and a new version is published (readers never see
a half-written table). A retried micro-batch replays the same rows, and
replacing the same keys with the same values changes nothing, so the
upsert is idempotent without extra bookkeeping. Checkpoints go under the
shared folder, so a restarted query resumes from its last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.summaries import refresh_merged
from ..plans.storage import Storage


def upsert_sink(storage: Storage, name: str, keys: list[str]):
    """foreachBatch function: keyed merge of each batch into table ``name``."""
    def merge(batch: DataFrame, epoch_id: int) -> None:
        refresh_merged(storage, name, batch, keys)
    return merge


def start_table(df: DataFrame, name: str, keys: list[str], storage: Storage,
                trigger: dict | None = None) -> StreamingQuery:
    """Run one stream table in update mode into a keyed table."""
    writer = (df.writeStream.outputMode("update")
              .foreachBatch(upsert_sink(storage, name, keys))
              .option("checkpointLocation", storage.path("_checkpoints", name)))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.queryName(f"table_{name}").start()


def start_append(df: DataFrame, name: str, storage: Storage, fmt: str = "parquet",
                 trigger: dict | None = None) -> StreamingQuery:
    """W2/K3 for a stateless stream: exactly-once file sink in append mode."""
    writer = (df.writeStream.outputMode("append").format(fmt)
              .option("path", storage.path(name, "data"))
              .option("checkpointLocation", storage.path("_checkpoints", name)))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.queryName(f"append_{name}").start()


def read_table(storage: Storage, name: str) -> DataFrame | None:
    """The current version of an upserted table (None before the first batch)."""
    version = storage.current_version(name)
    return storage.read(name, version) if version else None
