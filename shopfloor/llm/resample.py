"""Importance resampling of documents towards a target distribution, ranked by parallel sorting by regular sampling.

**Weights.** A text's features are its runs of 1 to ``ngram`` consecutive words,
hashed to ``buckets`` buckets by crc32. The counts of a bucket in all documents and in
all target texts give its gain; a document's weight is the floored mean gain of its
features, and its score adds a Gumbel draw that depends on the seed and the id alone.
Features are counted and gains looked up as arrays, batch by batch, in the tasks that
read the texts; each task sends one count for each bucket that it met.

**Ranks.** Of the documents with at least ``min_words`` words, the ``percent`` with the
highest scores (ties: the smaller id) get ranks 1, 2, 3...

1. Each partition of the written scores is sorted locally: a run. From every run each
   ``spacing``-th row is a sample, so the samples are regular and say to ``spacing``
   rows where a key stands in each run.
2. The sorted samples give the splitters of as many segments as there are runs. A segment
   holds at most n / segments + runs * spacing rows, however the scores lie.
3. Segments are counted. Those that start after the last rank needn't be sorted at all;
   the others are exchanged (``repartitionById``) and their runs merged locally.
4. The prefix sums of the segments' counts are the ranks at which they begin.

What reaches the driver is bounded: ``SAMPLES`` samples and one more for each run, and
one count for each segment. No row is dropped: undrawn documents come back without a rank.

Null texts and texts without words have no feature, weight 0 and no rank. A null id is
hashed as an empty text and sorts after all others. Repeated rows are ranked each.
Empty tables are allowed on both sides. Texts are read whole, other columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import shared_dir
from .arrow import text_chunks, utf8
from .spelling import CRC_TABLE, LOWER, UPPER, crc32_sql

BUCKETS = 10_000
SAMPLES = 1 << 20
LEAST_SPACING = 16
LOCKSTEP = 48


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def crc32_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span of bytes, all spans a byte at a time; long ones by the library."""
    table = _crc_table()
    length = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(length, kind="stable")
    places = np.searchsorted(length[order], np.arange(1, LOCKSTEP + 2))
    short = order[:places[-1]]
    state, first = out[short], starts[short]
    for i in range(LOCKSTEP):
        begin = places[i]
        if begin >= len(short):
            break
        now = state[begin:]
        state[begin:] = table[(now ^ raw[first[begin:] + i]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out[short] = ~state
    for j in order[places[-1]:].tolist():
        out[j] = zlib.crc32(raw[starts[j]:ends[j]])
    return out


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of every word, and the number of words before each text (one longer)."""
    folded = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    inside = ((folded >= 48) & (folded <= 57)) | ((folded >= 97) & (folded <= 122)) | (folded >= 128)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    return folded, starts, ends, np.searchsorted(starts, offsets)


def text_buckets(raw: np.ndarray, offsets: np.ndarray, ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the number of features before each text (one longer), and each text's words."""
    folded, starts, ends, first = word_spans(raw, offsets)
    found, counts = [], []
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for k in range(1, ngram + 1):
        at = np.arange(max(0, len(starts) - k + 1))
        at = at[text[at] == text[at + k - 1]] if k > 1 else at
        if k == 1:
            hashes = crc32_spans(folded, starts, ends)
        else:
            # The words of a run joined by one space each, laid out anew.
            pieces = [b" ".join(folded[starts[i + j]:ends[i + j]].tobytes() for j in range(k)) for i in at.tolist()]
            hashes = np.fromiter(map(zlib.crc32, pieces), np.uint32, len(pieces))
        found.append((text[at], (hashes % np.uint32(buckets)).astype(np.int64)))
        counts.append(np.bincount(text[at], minlength=len(offsets) - 1))
    owner = np.concatenate([f[0] for f in found])
    bucket = np.concatenate([f[1] for f in found])
    if ngram > 1:
        bucket = bucket[np.argsort(owner, kind="stable")]
    return bucket, np.concatenate([[0], np.cumsum(sum(counts))]), np.diff(first)


def bucket_counts(texts: DataFrame, ngram: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features of each bucket, over all rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_chunks(batch):
                total += np.bincount(text_buckets(*utf8(part.column("text")), ngram, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = (texts.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())
    total = np.zeros(buckets, np.int64)
    total[found.bucket.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + b) / ((s + 1)(T + b)))) of each bucket, b buckets in all."""
    s_all, t_all, b = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, ngram: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                bucket, first, words = text_buckets(*utf8(part.column("text")), ngram, len(gain))
                total = np.concatenate([[0], np.cumsum(gain[bucket])])
                n = np.diff(first)
                weight = (total[first[1:]] - total[first[:-1]]) // np.maximum(1, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (n, words, weight))],
                                                 names=["doc_id", "n_features", "n_words", "weight"])

    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        task, "doc_id long, n_features long, n_words long, weight long")
    print_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(print_, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def _split(samples: list[tuple], segments: int) -> list[tuple]:
    """The splitters: every (samples / segments)-th of the sorted samples."""
    held = sorted(samples)
    return sorted({held[i * len(held) // segments] for i in range(1, segments)}) if held else []


def ranked(rows: DataFrame, limit: int, folder: str) -> DataFrame:
    """The written ``rows`` (any columns; doc_id and score order them) with ``rank`` 1 to ``limit``, else null.

    Highest score first, ties by the smaller id, a null id last.
    """
    spark = rows.sparkSession
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("run")).count().collect()]
    n, runs = sum(sizes), max(1, len(sizes))
    spacing = max(LEAST_SPACING, -(-n // (runs * runs)), -(-n // SAMPLES))
    keyed = rows.withColumn("k1", -F.col("score")).withColumn(
        "k2", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).withColumn("k3", F.col("doc_id").isNull().cast("int"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            first = (spacing // 2 - seen) % spacing
            seen += batch.num_rows
            yield batch.take(pa.array(np.arange(first, batch.num_rows, spacing)))

    key = ["k1", "k2", "k3"]
    samples = keyed.select(*key).sortWithinPartitions(*key).mapInArrow(sample, "k1 long, k2 long, k3 int").collect()
    splitters = _split([tuple(s) for s in samples], runs)

    # A segment's number is how many splitters are not above the row's key.
    edges = F.array(*(F.struct(F.lit(a).cast("long").alias("k1"), F.lit(b).cast("long").alias("k2"),
                               F.lit(c).cast("int").alias("k3")) for a, b, c in splitters)) if len(splitters) < 64 else None
    if edges is not None:
        segmented = keyed.withColumn("segment", F.size(F.filter(edges, lambda e: e <= F.struct(*key))) if splitters else F.lit(0))
    else:
        cuts = np.array(splitters, dtype=[("k1", np.int64), ("k2", np.int64), ("k3", np.int64)])

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = np.empty(batch.num_rows, cuts.dtype)
                for name in key:
                    keys[name] = batch.column(name).to_numpy(zero_copy_only=False)
                place = np.searchsorted(cuts, keys, side="right").astype(np.int32)
                yield batch.append_column("segment", pa.array(place))

        segmented = keyed.mapInArrow(number, StructType([*keyed.schema, StructField("segment", IntegerType())]))
    segmented.write.parquet(f"{folder}/segmented")
    segmented = spark.read.parquet(f"{folder}/segmented")

    before = [0] * (len(splitters) + 2)
    for segment, count in segmented.groupBy("segment").count().collect():
        before[segment + 1] = count
    before = np.cumsum(before).tolist()
    needed = sum(start < limit for start in before[:-1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, done = None, 0
        for batch in batches:
            held = batch.column("segment").to_numpy(zero_copy_only=False)
            out = np.empty(len(held), np.int64)
            for s in np.unique(held).tolist():
                if s != segment:
                    segment, done = s, 0
                here = np.flatnonzero(held == s)
                out[here] = before[s] + done + 1 + np.arange(len(here))
                done += len(here)
            yield batch.append_column("rank", pa.array(out, pa.int64(), mask=out > limit))

    drawn = (segmented.where(F.col("segment") < needed).repartitionById(max(1, needed), F.col("segment"))
             .sortWithinPartitions("segment", *key).mapInArrow(
                 place, StructType([*segmented.schema, StructField("rank", LongType())])))
    rest = segmented.where(F.col("segment") >= needed).withColumn("rank", F.lit(None).cast("long"))
    return drawn.union(rest).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, ngram: int = 1,
             buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of ``docs``."""
    folder = f"{shared_dir(docs.sparkSession)}/resample-{uuid.uuid4().hex}"
    gain = gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets))
    scored(docs, gain, ngram, seed).write.parquet(f"{folder}/scored")
    rows = docs.sparkSession.read.parquet(f"{folder}/scored")
    eligible = rows.where(F.col("n_words") >= min_words)
    drawn = ranked(eligible, percent * eligible.count() // 100, folder)
    short = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.union(short).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = f"""unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"""

RESAMPLE_SQL = f"""
WITH {CRC_TABLE},
rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
doc_words AS (SELECT r, {_WORDS} AS word FROM rows),
target_words AS (SELECT {_WORDS} AS word FROM benchmark),
bucketed AS (
  SELECT word, ({crc32_sql("word")} % 10000) AS bucket
  FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words), crc_table),
corpus AS (SELECT bucket, count(*) AS s FROM doc_words JOIN bucketed USING (word) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM target_words JOIN bucketed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM doc_words) AS s_all, (SELECT count(*) FROM target_words) AS t_all),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all::DOUBLE + 10000)
         / ((s::DOUBLE + 1) * (t_all::DOUBLE + 10000)))) AS BIGINT) AS g
  FROM corpus LEFT JOIN wanted USING (bucket), totals),
weighed AS (
  SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM doc_words JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features,
         coalesce((total - (((total % n) + n) % n)) // n, 0) AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM rows LEFT JOIN weighed USING (r)),
final AS (
  SELECT doc_id, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n FROM final)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM ordered
"""
