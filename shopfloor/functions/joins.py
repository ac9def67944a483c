"""Join and partition sizing helpers: broadcast only behind a size check,
partition counts from input bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count, known exactly from the build
# step, times a generous row width stays under this many bytes. Past it the
# join is left to Catalyst/AQE (sort-merge with skew splitting, or a
# broadcast AQE chooses from runtime sizes).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


# Parquet on disk is compressed; in memory a table can be several times larger.
PARQUET_EXPANSION = 8


def maybe_broadcast(df: DataFrame, rows: int | None, row_bytes: int = 256) -> DataFrame:
    """Broadcast ``df`` when its exact row count bounds it under the limit."""
    if rows is not None and rows * row_bytes <= BROADCAST_MAX_BYTES:
        return F.broadcast(df)
    return df


def file_bytes(spark: SparkSession, *paths: str) -> int:
    """Total size of the files under ``paths`` (Hadoop FS metadata, no scan)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    total = 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        total += p.getFileSystem(conf).getContentSummary(p).getLength()
    return total


def broadcast_if_files_small(df: DataFrame, on_disk_bytes: int) -> DataFrame:
    """Broadcast a side derived from files of ``on_disk_bytes`` (its size
    bound) when the expanded size stays under the limit."""
    if on_disk_bytes * PARQUET_EXPANSION <= BROADCAST_MAX_BYTES:
        return F.broadcast(df)
    return df


# Target on-disk input bytes per task when a job sizes its own partitions. Order lines take
# 8 to 24 bytes each there and ten times that as rows, so a task sorts about 100 MB, which
# fits beside three others in an executor of a few GB; ten times as much is spilled.
TARGET_PARTITION_BYTES = 8 * 1024 * 1024
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _parts(floor: str, on_disk_bytes: int) -> int:
    return max(int(floor), -(-on_disk_bytes // TARGET_PARTITION_BYTES))


def partitions_for(spark: SparkSession, on_disk_bytes: int) -> int:
    """Partition count for data of ``on_disk_bytes``: about 8 MB of input
    per task, never fewer than the session's shuffles start with."""
    return _parts(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"), on_disk_bytes)


def size_shuffles(spark: SparkSession, on_disk_bytes: int) -> None:
    """Let the session's shuffles start with enough partitions for input of ``on_disk_bytes``; AQE
    puts small ones together, but splits none except those of a hot join key."""
    spark.conf.set(INITIAL_PARTITIONS, str(_parts(spark.conf.get("spark.sql.shuffle.partitions"), on_disk_bytes)))
