"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when ``100 * intersection >= percent * union`` of their
sets of distinct k-word shingles. Texts with equal sets form one class; classes
are joined as follows.

1. All shingles follow one order: by how often those of the same hash cell occur
   in all documents (``2 ** CELL_BITS`` cells of 8-bit codes, so the table's size is
   fixed), then by hash. Frequent shingles come last. Any one order gives right results;
   this one keeps shingles out of prefixes that are more frequent than the mean cell.
   Sets of size n that link share t = ceil(percent * n / 100) shingles, so for every l
   their first n - t + l shingles share at least l.
2. Each class picks its own l: a longer prefix meets more shared shingles but
   demands more matches, and the class takes the l with the least expected
   cost (shingle partners met + verifications left). A pair is a candidate when
   it shares at least the smaller of its two l. Shingles that one class alone
   holds only use up places of the prefix; a class with no shared one there has
   no partner and leaves the join.
3. Two classes meet at a shingle only if their places there leave room for a link:
   what they share up to it is at most the lesser of its ranks among the shared
   shingles of each prefix, and after it at most the shorter rest. This is part of the
   join, so classes that a third text made alike, each with changes of its own, don't
   come out of it as pairs.
4. Within a shingle's group no list of all pairs is made. ``ROUNDS`` times, each class is
   compared with one pivot of each of its groups and the links found are contracted to
   components; the first pivot is the class with the fewest shingles of its own, which
   is the original where others are its changed copies. After that only pairs of classes
   that are still in different components are candidates, and groups inside one component
   are gone, and each of those classes brings ``SKETCH`` words of 64 bits, in which every shingle
   of its set turns one bit over. Bits that differ are at most the shingles that only one set has,
   so the join drops pairs with more of them than a link allows (changed copies that don't link
   with each other), and no other. All candidates are verified on the whole texts, and every
   pair that could join two components is among them, so no link is lost: the components are
   those of the full join.

The texts of classes that can be in a pair are written once, in buckets of their class; the
verifying joins move the pairs to them, and only the text of a pair's one side moves.

Null and empty texts, and texts without words, have an empty set and link with
nothing (their own component). Rows are told apart by id and text together, and
classes have numbers of their own, so rows that share an id may differ in text and
lie in different components (which bear the same name where that id is the smallest
of both). Rows with a null doc_id link like others, but aren't in the result of
``jaccard_components``, as nothing could name them there; a component of such rows
alone has no name. ``keep_one`` keeps them. Repeated rows of one id are one document
each in the result; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import INITIAL_PARTITIONS
from ..plans.storage import LARGE_CODEC, Storage
from ..session import shared_dir
from .arrow import text_chunks, utf8
from .components import components
from .shingles import mix, shingle_sets

CELL_BITS, BLOCKS, FAN_IN = 22, 64, 64
MAX_MATCHES = 8
ROW, SET = ["row_id", "row_hash"], ["n", "f1", "f2"]
ROUNDS = 2
# Words of a class's sketch, and bytes of text whose sets a task makes at a time (some thirty times that in numbers).
SKETCH, SET_BYTES = 4, 1 << 19
SKETCHES = [f"s{i}" for i in range(SKETCH)]


def _needed(n, percent: int):
    """Least overlap of a set of size n with a set it links to."""
    return (percent * n + 99) // 100


def _matches(n: int, percent: int) -> int:
    return int(max(1, min(MAX_MATCHES, 1 + n // 20, _needed(n, percent))))


def _row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("row_id")


def _row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_hash")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and what tells a row by them: the id (0 for null) and a hash of both."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       _row_id(), _row_hash())


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """Key and doc_id of every row, n (set size) and a 128-bit fingerprint of the set."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, limit=SET_BYTES):
                sets = shingle_sets(*utf8(part.column("text")), k)
                prints = [np.array([mix(s ^ np.uint64(salt)).sum() for s in sets], np.uint64).view(np.int64)
                          for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, [*ROW, "doc_id"]), pa.array([len(s) for s in sets], pa.int64()),
                     *map(pa.array, prints)], names=[*ROW, "doc_id", "n", "f1", "f2"])

    return _rows(docs).mapInArrow(task, "row_id long, row_hash long, doc_id long, n long, f1 long, f2 long")


def _listed(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()),
                                    pa.array(flat))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


# What each 8-bit code stands for: counts under 16 as they are, larger ones to three bits after the first.
_VALUE = np.array([c if c < 16 else (8 + c % 8) << (c // 8 - 1) for c in range(256)], np.int64)


def _coded(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_VALUE, counts, side="right") - 1).astype(np.uint8)


def _tasks(docs: DataFrame) -> int:
    """How many tasks read ``docs``."""
    return (docs.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] or 0) + 1


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Coded number of shingles of each hash cell, over the sets of all documents.

    Each task sends its whole table in 8-bit codes, cut into blocks; the tables are added up ``FAN_IN`` at a time.
    """
    size = (1 << CELL_BITS) // BLOCKS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int32)
        for batch in batches:
            for part in text_chunks(batch, limit=SET_BYTES):
                for s in shingle_sets(*utf8(part.column("text")), k):
                    np.add.at(total, _cells(s), 1)
        codes = _coded(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BLOCKS)), pa.array(np.full(BLOCKS, TaskContext.get().partitionId())),
             pa.array([codes[i * size:(i + 1) * size].tobytes() for i in range(BLOCKS)], pa.binary())],
            names=["block", "part", "codes"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(_VALUE[np.frombuffer(c, np.uint8)] for c in table.column("codes").to_pylist())
        return pa.table({"block": [key[0].as_py()], "part": [key[1].as_py()], "codes": pa.array([_coded(total).tobytes()], pa.binary())})

    schema = "block long, part long, codes binary"
    parts = _tasks(docs)
    tables = _rows(docs).select("text").mapInArrow(task, schema)
    while parts:
        parts = 0 if parts <= FAN_IN else -(-parts // FAN_IN)
        tables = (tables.select("block", F.floor(F.col("part") / FAN_IN).alias("part"), "codes")
                  .groupBy("block", "part").applyInArrow(added, schema))
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for row in tables.collect():
        out[row.block * size:(row.block + 1) * size] = np.frombuffer(row.codes, np.uint8)
    return out


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """``SKETCH`` words of 64 bits; each shingle turns over the one that its lowest bits name."""
    turned = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view("<i8")


def _heads(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Key, n, sketch and the longest prefix that a document may choose, of every row."""
    often = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, k))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, limit=SET_BYTES):
                sets = shingle_sets(*utf8(part.column("text")), k)
                heads = [s[np.argsort(often.value[_cells(s)], kind="stable")[
                    :len(s) - _needed(len(s), percent) + _matches(len(s), percent)]] for s in sets]
                sketches = np.array([_sketch(s) for s in sets], np.int64).reshape(-1, SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, ROW), pa.array([len(s) for s in sets], pa.int64()),
                     *map(pa.array, np.ascontiguousarray(sketches.T)), _listed(heads)], names=[*ROW, "n", *SKETCHES, "head"])

    return _rows(docs).mapInArrow(
        task, f"row_id long, row_hash long, n long, {', '.join(f'{s} long' for s in SKETCHES)}, head array<long>")


def _adaptive(percent: int):
    """Chooses l for each class and returns the shared shingles of its prefix."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, shared = (batch.column(c) for c in ("cls", "n", "shared"))
            ends = shared.offsets.to_numpy().astype(np.int64)
            tokens, places, counts = (shared.values.field(c).to_numpy() for c in ("token", "pos", "classes"))
            chosen, kept = [np.empty(0, np.int64)], []
            for row, n in enumerate(sizes.to_pylist()):
                order = ends[row] + np.argsort(places[ends[row]:ends[row + 1]], kind="stable")
                place, met_before = places[order], np.concatenate([[0], np.cumsum(counts[order] - 1)])
                best = None
                for matches in range(1, _matches(n, percent) + 1):
                    length = int(np.searchsorted(place, n - _needed(n, percent) + matches))
                    met = int(met_before[length])
                    cost = met + n * met / matches ** 2
                    if best is None or cost < best[0]:
                        best = (cost, matches, length)
                    if not met:
                        best = (0, matches, 0)
                        break
                chosen.append(order[:best[2]])
                kept.append(best[1:])
            at, matches, length = np.concatenate(chosen), *np.array(kept, np.int64).reshape(-1, 2).T
            rank = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(length) - length, length)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.repeat(x, length)) for x in (classes.to_numpy(), sizes.to_numpy(), matches)),
                 pa.array(tokens[at]), pa.array(places[at].astype(np.int64)), pa.array(rank.astype(np.int64))],
                names=["cls", "n", "matches", "token", "pos", "rank"])

    return task


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The written pairs (a, b) that link, by the whole texts of both.

    The text of ``a`` travels with the pair to that of ``b``, and sets are made of both there.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "ta", SET_BYTES):
                for piece in text_chunks(part, "tb", SET_BYTES):
                    left, right = (shingle_sets(*utf8(piece.column(c)), k) for c in ("ta", "tb"))
                    common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
                    size = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("a"), piece.column("b"), pa.array(100 * common >= percent * (size - common))],
                        names=["a", "b", "links"])

    first = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")).join(pairs, "a")
    both = first.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long, links boolean").where("links").select("a", "b")


def _joined_classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their set's size and fingerprint, and the classes with their first row and component (a class)."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/jaccard-join-{uuid.uuid4().hex}"

    def written(frame: DataFrame, name: str) -> DataFrame:
        # A written table cuts lineage, and Spark knows its size.
        frame.write.option("compression", LARGE_CODEC).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # As many buckets as shuffles have partitions at least, or joins would move the texts and not the pairs.
    least = spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")
    store, buckets = Storage(spark, folder), max(int(least), _tasks(docs))

    signed = written(_signatures(docs, k), "signed")
    # Rows with an id come before those without.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *ROW)).alias("first")
    classes = written(signed.where("n > 0").groupBy(*SET).agg(first).select(*SET, "first.*")
                      .withColumn("cls", F.monotonically_increasing_id()), "classes")

    heads = (_heads(docs, k, percent).where("n > 0").join(classes.select(*ROW, "cls"), ROW).dropDuplicates(ROW))
    heads = written(heads.select("cls", "n", *SKETCHES, "head"), "heads")
    rows = heads.select("cls", "n", F.posexplode("head").alias("pos", "token"))
    # Counts are summed before the shuffle, and the join back may be split where one shingle is in very many classes.
    often = rows.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1")
    shared = rows.join(often, "token").groupBy("cls", "n").agg(
        F.collect_list(F.struct("token", "pos", "classes")).alias("shared"))
    prefix = written(shared.mapInArrow(
        _adaptive(percent), "cls long, n long, matches long, token long, pos long, rank long"), "prefix")

    # At a token that both hold, at most the lesser rank of it is common so far, and at most the shorter rest after it.
    reach = (f"(least(rank, prank) + least(n - pos, pn - ppos) - 1) * {100 + percent} >= {percent} * (n + pn)")
    partner = ["cls", "n", "matches", "pos", "rank", "comp"]
    # What only one of two linked sets has: both sizes less twice the least overlap.
    differ = f"{' + '.join(f'bit_count({s} ^ p{s})' for s in SKETCHES)} <= n + pn - 2 * (({percent} * (n + pn) + {99 + percent}) div {100 + percent})"
    state, links, texts = prefix.withColumn("comp", F.col("cls")), None, None
    comps = spark.createDataFrame([], "cls long, root long")
    for step in range(ROUNDS + 1):
        if step < ROUNDS:
            # A pivot is first the class with the fewest shingles of its own, then any.
            order = [F.col("pos") - F.col("rank"), F.col("cls")] if step == 0 else [F.xxhash64("cls", F.lit(step)), F.col("cls")]
            pivots = state.groupBy("token").agg(
                F.min_by(F.struct(*partner), F.struct(*order)).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
            ).where("lo < hi").select("token", *(F.col(f"p.{c}").alias(f"p{c}") for c in partner))
            met = state.join(pivots, "token").where("comp <> pcomp")
        else:
            mixed = state.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
            open_rows = state.join(mixed.select("token"), "token", "left_semi").join(heads.select("cls", *SKETCHES), "cls")
            open_rows = written(open_rows.select("token", *partner, *SKETCHES), "open")
            others = open_rows.select("token", *(F.col(c).alias(f"p{c}") for c in [*partner, *SKETCHES]))
            met = open_rows.join(others, "token").where("cls < pcls AND comp <> pcomp").where(differ)
        pairs = (met.where(reach).groupBy(F.col("pcls").alias("a"), F.col("cls").alias("b"), F.least("matches", "pmatches").alias("least"))
                 .agg(F.count("*").alias("met")).where("met >= least"))
        if step < ROUNDS:
            # One pivot for each class: the one it shares most with.
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("met", -F.col("a"))).alias("a"))
        pairs = written(pairs.select("a", "b"), f"pairs-{step}")
        if pairs.isEmpty():
            continue
        if texts is None:
            able = prefix.select("cls").distinct().join(classes.select("cls", *ROW), "cls")
            moved = _rows(docs).join(able, ROW).select("cls", "text").repartition(buckets, "cls")
            texts = store.write_bucketed(moved.dropDuplicates(["cls"]), "cls", buckets, "texts", partitioned=True)
        found = written(_verified(pairs, texts, k, percent), f"links-{step}")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        comps = components(links).select(F.col("id").alias("cls"), F.col("component").alias("root"))
        if step < ROUNDS:
            state = written(prefix.join(comps, "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root"),
                            f"state-{step}")
    return signed, classes.join(comps, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row with an id."""
    signed, classes = _joined_classes(docs, k, percent)
    names = classes.groupBy("root").agg(F.min("doc_id").alias("name"))
    named = classes.join(names, "root").select(*SET, "name")
    return signed.where("doc_id IS NOT NULL").join(named, SET, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, the one of the smallest id (null ids last); all without words."""
    _, classes = _joined_classes(docs, k, percent)
    kept = classes.groupBy("root").agg(F.min(F.struct("unnamed", "doc_id", *ROW)).alias("first")).select("first.*")
    has_words = F.coalesce(F.col("text").cast("string").rlike(r"[^\t\n\x0B\f\r ]"), F.lit(False))
    # The row travels as one column, so that its own names can't clash with the key's.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.where(has_words).select(row, _row_id(), _row_hash())
    first = keyed.join(kept.select(*ROW), ROW, "left_semi").dropDuplicates(ROW)
    return first.select("row.*").union(docs.where(~has_words))
