"""Dense sequence numbers without a one-partition window.

``row_number() OVER (ORDER BY k)`` with no PARTITION BY moves every row to
one task. Here the rows are range-partitioned on the ordering (a hot value
of the first column is split by the later ones), sorted inside each
partition and given ``monotonically_increasing_id`` (partition id in the
upper 31 bits, position in the lower 33). The numbered rows are written to
the shared folder so the ids are fixed. A second written table holds each
partition's first number: the rows are counted by partition and the counts
summed in two levels, inside blocks of ``BLOCK`` partitions and then over
the blocks' totals. The number is first + position + start, by a join of the
rows with that table; the plan's size does not depend on the partition
count, and numbers opened again are not counted again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import Storage
from .joins import maybe_broadcast

_POSITION_BITS = 33
_ROW_ID = "_row_id"
_PARTITION = "_partition"
# Partitions per block of the first level; the second level sums one row per block.
BLOCK = 1024
# In memory: partition and offset, two longs and the row's frame.
_OFFSET_ROW_BYTES = 64
# Rows of a known count that one task sorts.
ROWS_PER_TASK = 1_000_000


def partition_offsets(staged: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_partition, _offset, _rows): rows before each partition that has rows, and its own."""
    counts = (staged.groupBy(F.shiftright(_ROW_ID, _POSITION_BITS).alias(_PARTITION))
              .agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_block", F.expr(f"{_PARTITION} div {block}")))
    before = Window.partitionBy("_block").orderBy(_PARTITION).rowsBetween(
        Window.unboundedPreceding, -1)
    inside = counts.withColumn("_inside", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    # One row per block of partitions is all that meets in one task.
    blocks_before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("_block").agg(F.sum("_rows").alias("_total"))
    totals = totals.select("_block", F.coalesce(F.sum("_total").over(blocks_before), F.lit(0))
                           .alias("_before"))
    return inside.join(totals, "_block").select(
        _PARTITION, (F.col("_inside") + F.col("_before")).alias("_offset"), "_rows")


def _offsets_stage(stage: str) -> str:
    return f"{stage}-offsets"


def number_rows(df: DataFrame, order_cols: list[str | Column], name: str, storage: Storage,
                stage: str, start: int = 0, num_partitions: int | None = None,
                then: Callable[[DataFrame], DataFrame] | None = None,
                codec: str | None = None) -> tuple[DataFrame, int]:
    """Add ``name`` = start + 0-based rank of each row in ``order_cols`` order.

    Equal to ``row_number() OVER (ORDER BY order_cols) - 1 + start`` (nulls
    first, ascending). Rows tied on every ordering column get distinct
    numbers in an unspecified order, as with ``row_number``. Returns the
    numbered frame (read from the staged files) and the row count.

    ``then`` runs on the numbered rows before they are written (e.g. joins
    that add columns); it must keep every row, or the offsets are wrong. ``codec``: of the staged
    files.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn(_ROW_ID, F.monotonically_increasing_id()))
    if then is not None:
        ranged = then(ranged)
    staged = storage.write(ranged, "stage", stage, codec=codec)
    storage.write(partition_offsets(staged), "stage", _offsets_stage(stage))
    return numbered_view(storage, stage, name, start)


def numbered_view(storage: Storage, stage: str, name: str, start: int = 0) -> tuple[DataFrame, int]:
    """The numbers of the rows that ``number_rows`` wrote as ``stage`` (e.g. after a restart)."""
    staged = storage.read("stage", stage)
    offsets = storage.read("stage", _offsets_stage(stage))
    size = offsets.agg(F.count(F.lit(1)).alias("n"),
                       F.coalesce(F.sum("_rows"), F.lit(0)).alias("total")).first()
    offsets = maybe_broadcast(offsets.drop("_rows"), size["n"], _OFFSET_ROW_BYTES)
    position = F.col(_ROW_ID).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    numbered = (staged.withColumn(_PARTITION, F.shiftright(_ROW_ID, _POSITION_BITS))
                .join(offsets, _PARTITION)
                .withColumn(name, F.col("_offset") + position + F.lit(start).cast("long"))
                .select(*[c for c in staged.columns if c not in (_ROW_ID, name)], name))
    return numbered, int(size["total"])


def dense_keys(df: DataFrame, order_cols: list[str], key: str, storage: Storage, stage: str,
               start: int = 1, known_rows: int | None = None) -> tuple[DataFrame, int]:
    """Surrogate keys 1..n for distinct natural keys, in natural-key order.

    ``known_rows``: the exact row count when the caller has it, which gives the
    number of range partitions (``ROWS_PER_TASK`` rows each)."""
    parts = None if known_rows is None else max(1, -(-known_rows // ROWS_PER_TASK))
    numbered, total = number_rows(df, order_cols, key, storage, stage, start=start,
                                  num_partitions=parts)
    return numbered.select(key, *[c for c in numbered.columns if c != key]), total
