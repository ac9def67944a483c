"""All pairs of vectors within a cosine, by an epsilon grid order join.

Vectors of unit length have a cosine of at least ``similarity`` where they are
at most ``epsilon = sqrt(2 - 2 * similarity)`` apart. The vectors are turned to
their principal directions (moments summed over all rows, see ``directions``),
sorted by their grid cells of width epsilon on the leading ones, and cut into
sequence intervals of at most ``ROWS`` vectors, one row each. Two intervals meet
in a task unless the boxes around them on the leading directions are more than
epsilon apart. The task halves the longer of the two sequences again and again,
dropping parts whose boxes are too far apart, until both are short; the rest is
compared by exact cosines in double precision.

What a task returns is bounded by its rows, however many links they have: the
number of links of each vector, and a spanning forest of the links. The forests'
components are those of all links. So a group of copies makes no list of pairs.
Equal cells are dealt by the hash of the row, hence a group of any size is cut
into intervals like the rest.

The driver holds one box per interval (``2 * LEADING`` numbers for ``ROWS``
vectors) and d * d moments, no vectors. The number of interval pairs is the
square of the number of intervals less the distant ones: on data without
structure in the leading directions nothing can be skipped, and work is
quadratic.

Vectors of another length (another model) are of another space, so the join runs
once for each length present. Vectors that are null, zero, or hold null or
non-finite components, and rows without an id, link with nothing.
Repeated rows are vectors of their own that link with each other, an empty table
gives no rows, and other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from .components import components

ROWS, LEAF, LEADING = 8192, 256, 8
MARGIN = 1e-9
INTERVALS = "part int, ids binary, data binary, low array<double>, high array<double>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of all rows; embedding is null where the vector links with nothing."""
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).withColumn("embedding", F.when(
        F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0), F.col("embedding")))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a non-null list column as rows of length one (scaled first, so that squares stay in range)."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def directions(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal directions of all vectors, most spread first, as columns (dim, LEADING)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = unit_rows(batch.column(0), dim)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange((dim + 1) ** 2)), pa.array(total.ravel())],
                                             names=["k", "v"])

    rows = vectors.select("embedding").mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    total = np.zeros((dim + 1) ** 2)
    for r in rows.collect():
        total[r.k] = r.v
    total = total.reshape(dim + 1, dim + 1)
    mean = total[-1, :-1] / total[-1, -1]
    spread = total[:-1, :-1] / total[-1, -1] - np.outer(mean, mean)
    return np.ascontiguousarray(np.linalg.eigh(spread)[1][:, ::-1][:, :LEADING])


def box_gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Squared distance between boxes."""
    return (np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)) ** 2).sum(axis=-1)


def _sequence_intervals(valid: DataFrame, axes: np.ndarray, dim: int, epsilon: float, parts: int) -> DataFrame:
    """One row per sequence interval, with its vectors and the box around them."""
    leading = axes.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit_rows(batch.column(1), dim)
            cells = np.floor((x @ axes) / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()),
                 *(pa.array(cells[:, i]) for i in range(leading))],
                names=["vec_id", "data", *(f"c{i}" for i in range(leading))])

    order = [f"c{i}" for i in range(leading)]
    placed = valid.select("vec_id", "embedding").mapInArrow(
        place, "vec_id long, data binary, " + ", ".join(f"{c} int" for c in order))
    # The hash last, so that one crowded cell can be cut between partitions.
    placed = placed.withColumn("h", F.xxhash64("vec_id", "data"))
    placed = placed.repartitionByRange(parts, *order, "h").sortWithinPartitions(*order, "h").select(
        F.spark_partition_id().alias("part"), "vec_id", "data")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data, part = [], [], None

        def interval() -> pa.RecordBatch:
            x = np.concatenate(data)
            p = x @ axes
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                 pa.array([x.tobytes()], pa.binary()),
                 pa.array([p.min(axis=0).tolist()], pa.list_(pa.float64())),
                 pa.array([p.max(axis=0).tolist()], pa.list_(pa.float64()))],
                names=["part", "ids", "data", "low", "high"])

        held = 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, ROWS - held)
                batch = batch.slice(take.num_rows)
                part = take.column(0)[0].as_py()
                ids.append(take.column(1).to_numpy(zero_copy_only=False))
                data.append(np.frombuffer(b"".join(take.column(2).to_pylist()), np.float64).reshape(-1, dim))
                held += take.num_rows
                if held == ROWS:
                    yield interval()
                    ids, data, held = [], [], 0
        if held:
            yield interval()

    return placed.mapInArrow(gather, INTERVALS)


class _Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def _leaf_forest(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what the links of a leaf connect, at most one per row and column."""
    far = np.iinfo(np.int64).max
    of_col = cols.copy()
    while True:
        of_row = np.minimum(np.where(hit, of_col, far).min(axis=1), rows)
        new = np.minimum(np.where(hit, of_row[:, None], far).min(axis=0), of_col)
        if (new == of_col).all():
            break
        of_col = new
    yield from zip(rows.tolist(), of_row.tolist(), strict=True)
    yield from zip(cols.tolist(), of_col.tolist(), strict=True)


def join_sequences(a: np.ndarray, b: np.ndarray, axes: np.ndarray, similarity: float, same: bool
                   ) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links per row of ``a`` then ``b``, and forest edges between their places (``b`` is ``a`` where ``same``)."""
    limit = 2 - 2 * similarity + MARGIN
    shift = 0 if same else len(a)
    counts = np.zeros(len(a) + (0 if same else len(b)), np.int64)
    forest = _Forest(len(counts))

    def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = x @ axes
        firsts = np.arange(0, len(x), LEAF)
        return np.minimum.reduceat(p, firsts), np.maximum.reduceat(p, firsts)

    (la, ha), (lb, hb) = boxes(a), boxes(b)
    todo = [(0, len(la), 0, len(lb))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        if box_gap(la[a0:a1].min(axis=0), ha[a0:a1].max(axis=0), lb[b0:b1].min(axis=0), hb[b0:b1].max(axis=0)) > limit:
            continue
        if a1 - a0 > 1 or b1 - b0 > 1:
            if a1 - a0 >= b1 - b0:
                m = (a0 + a1) // 2
                todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
            else:
                m = (b0 + b1) // 2
                todo += [(a0, a1, b0, m), (a0, a1, m, b1)]
            continue
        rows = np.arange(a0 * LEAF, min(a1 * LEAF, len(a)))
        cols = np.arange(b0 * LEAF, min(b1 * LEAF, len(b)))
        hit = a[rows[0]:rows[-1] + 1] @ b[cols[0]:cols[-1] + 1].T >= similarity
        if same and a0 == b0:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        counts[rows] += hit.sum(axis=1)
        if not (same and a0 == b0):
            counts[cols + shift] += hit.sum(axis=0)
        touched_rows, touched_cols = hit.any(axis=1), hit.any(axis=0)
        for x, y in _leaf_forest(hit[touched_rows][:, touched_cols], rows[touched_rows], cols[touched_cols] + shift):
            forest.link(x, y)
    return counts, forest.edges


def _alone(rows: DataFrame) -> DataFrame:
    """Rows that link with nothing; one without an id is no class, so it isn't kept."""
    return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                       F.col("vec_id").isNotNull().alias("kept"))


def similarity_classes(vectors: DataFrame, similarity: float = 0.9) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept, one row per vector."""
    spark = vectors.sparkSession
    folder = f"{shared_dir(spark)}/grid-join-{uuid.uuid4().hex}"
    usable(vectors).write.parquet(f"{folder}/vectors")
    rows = spark.read.parquet(f"{folder}/vectors")
    sizes = (rows.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
             .orderBy("dim").collect())
    out = _alone(rows.where("embedding IS NULL"))
    for dim, n in sizes:
        valid = rows.where(F.size("embedding") == dim)
        # A vector alone in its length has no other to link with.
        out = out.union(_alone(valid) if n == 1 else _classes_of_length(valid, dim, n, similarity, f"{folder}/{dim}"))
    return out


def _classes_of_length(valid: DataFrame, dim: int, n: int, similarity: float, folder: str) -> DataFrame:
    """similarity_classes of the ``n`` usable vectors of one length."""
    spark, parts = valid.sparkSession, -(-n // ROWS)
    epsilon = (2 - 2 * similarity) ** 0.5
    axes = directions(valid, dim)
    _sequence_intervals(valid, axes, dim, epsilon, parts).withColumn(
        "seq", F.monotonically_increasing_id()).write.parquet(f"{folder}/intervals")
    intervals = spark.read.parquet(f"{folder}/intervals")
    found = intervals.select("seq", "low", "high").orderBy("seq").collect()
    seqs = np.array([r.seq for r in found], np.int64)
    low, high = np.array([r.low for r in found]), np.array([r.high for r in found])

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each interval once for every interval it has to meet."""
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                me = int(np.searchsorted(seqs, one.column(0)[0].as_py()))
                near = np.flatnonzero(box_gap(low, high, low[me], high[me]) <= 2 - 2 * similarity + MARGIN)
                for other in near.tolist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([min(me, other)], pa.int64()), pa.array([max(me, other)], pa.int64()),
                         pa.array([me], pa.int64()), one.column(1), one.column(2)],
                        names=["first", "second", "me", "ids", "data"])

    def meet(table: pa.Table) -> pa.Table:
        """Links of the one or two intervals of a pair: per row its links, then the forest's edges."""
        table = table.sort_by("me")
        ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        data = [np.frombuffer(x, np.float64).reshape(-1, dim) for x in table.column("data").to_pylist()]
        same = len(data) == 1
        counts, edges = join_sequences(data[0], data[-1], axes, similarity, same)
        all_ids = np.concatenate(ids)
        row = np.concatenate([(np.int64(me) << 20) + np.arange(len(i)) for me, i in
                              zip(table.column("me").to_pylist(), ids, strict=True)])
        keep = np.flatnonzero(counts) if not same else np.arange(len(counts))
        a, b = (np.array(edges, np.int64).reshape(-1, 2)).T
        return pa.table({
            "row": pa.concat_arrays([pa.array(row[keep]), pa.nulls(len(a), pa.int64())]),
            "a": np.concatenate([all_ids[keep], all_ids[a]]),
            "b": pa.concat_arrays([pa.nulls(len(keep), pa.int64()), pa.array(all_ids[b])]),
            "n": np.concatenate([counts[keep], np.zeros(len(a), np.int64)])})

    pairs = intervals.select("seq", "ids", "data").mapInArrow(
        partners, "first long, second long, me long, ids binary, data binary")
    pairs.groupBy("first", "second").applyInArrow(meet, "row long, a long, b long, n long").write.parquet(
        f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    counted = links.where("row IS NOT NULL").groupBy("row").agg(F.first("a").alias("vec_id"), F.sum("n").alias("n_links"))
    classes = components(links.where("row IS NULL").select("a", "b"))
    joined = counted.join(classes, counted.vec_id == classes.id, "left").select(
        "vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id") == F.col("component_id"))
