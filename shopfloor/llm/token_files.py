"""Token ids in seekable zstandard files.

A file holds one zstandard frame for each document (more where a document has
over ``MAX_FRAME`` bytes of ids), then a skippable frame with the documents'
ids and frame counts, then the seek table of the public seekable format: for
each frame its compressed and decompressed size and a checksum, with the
number of frames and a magic number at the very end. A reader takes the last
bytes first, then only the frames it is asked for; each frame is checked
against its checksum.

Rows are dealt by ranges of doc_id and sorted, one file a partition, so the
files in order hold the documents in order; equal ids follow the hash of their
text. A task writes under a name of its own and renames when it is done, so a
task that is run again, or twice at once, leaves one whole file. Null texts
count as empty, a null id sorts first and is kept, an empty table leaves no
file, and other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .arrow import text_chunks
from .tokens import encoder

MAX_FRAME = 64 << 20
# Fixed values of the seekable format.
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
NULL_ID = -(1 << 63)
MANIFEST = "part long, file string, n_docs long, n_tokens long"


def open_store(folder: str):
    """The file system and path of a folder that all executors share."""
    from pyarrow import fs
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


class FrameWriter:
    def __init__(self, out, level: int = 3):
        import zstandard
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.table, self.docs, self.n_tokens = bytearray(), [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash
        frames = 0
        for at in range(0, max(1, len(ids)), MAX_FRAME):
            raw = ids[at:at + MAX_FRAME]
            frame = self.packer.compress(raw)
            self.out.write(frame)
            self.table += struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
            frames += 1
        self.docs.append((NULL_ID if doc_id is None else doc_id, frames))
        self.n_tokens += len(ids) // 4

    def close(self) -> None:
        index = np.array(self.docs, "<i8").tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        footer = struct.pack("<IBI", len(self.table) // 12, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(self.table) + len(footer)) + bytes(self.table) + footer)


class FrameReader:
    """Reads documents of one open file; ``wanted`` limits the frames that are read."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        frames, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a token file")
        table = size - 9 - 12 * frames
        self.table = np.frombuffer(self._at(table, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        head, length = struct.unpack("<II", self._at(int(self.offsets[-1]), 8))
        if head != INDEX_MAGIC or self.offsets[-1] + 8 + length + 8 != table:
            raise ValueError("damaged index")
        self.docs = np.frombuffer(self._at(int(self.offsets[-1]) + 8, length), "<i8").reshape(-1, 2)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, number of ids before it in the file, ids."""
        import xxhash
        import zstandard
        unpack, frame, before = zstandard.ZstdDecompressor().decompress, 0, 0
        for doc_id, frames in self.docs.tolist():
            sizes = self.table[frame:frame + frames]
            if wanted is None or doc_id in wanted:
                parts = []
                for i in range(frames):
                    packed = self._at(int(self.offsets[frame + i]), int(sizes[i, 0]))
                    raw = unpack(packed, max_output_size=max(1, int(sizes[i, 1])))
                    if len(raw) != sizes[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != sizes[i, 2]:
                        raise ValueError(f"checksum of frame {frame + i} differs")
                    parts.append(raw)
                yield None if doc_id == NULL_ID else doc_id, before // 4, b"".join(parts)
            frame, before = frame + frames, before + int(sizes[:, 1].sum())


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> None:
    """Write every row of ``docs`` (doc_id, text) under ``folder``, with a manifest of the files."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = open_store(folder)
        name = f"part-{part:06d}.zst"
        own = str(PurePosixPath(root) / f".{name}.{uuid.uuid4().hex}")
        writer = None
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for chunk in text_chunks(batch):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    writer = FrameWriter(store.open_output_stream(own))
                ids = encoder(tokenizer).encode_array(chunk.column("text"))
                for doc_id, body in zip(chunk.column("doc_id").to_pylist(), ids, strict=True):
                    writer.add(doc_id, body + end)
        if writer is not None:
            writer.close()
            writer.out.close()
            store.move(own, str(PurePosixPath(root) / name))
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(writer.docs)],
                                              "n_tokens": [writer.n_tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = ["doc_id", F.xxhash64("text")]
    (rows.repartitionByRange(*key).sortWithinPartitions(*key)
     .mapInArrow(task, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest"))


def read(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and input_ids of all documents, or of the few ``wanted`` ones."""
    only = None if wanted is None else set(wanted)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(str(PurePosixPath(root) / row["file"])) as file:
                    rows, size = [], 0
                    for doc_id, before, ids in FrameReader(file).documents(only):
                        rows.append((doc_id, row["before"] + before, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    # One row a file: the running sum over them is short.
    files = spark.read.parquet(f"{folder}/_manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.withColumn("before", F.coalesce(before, F.lit(0)))
    # A stated number of partitions: the listing is small, and would else be read by one task.
    return (listed.repartitionByRange(max(1, files.count()), "part").mapInArrow(
        task, "doc_id long, start long, n_tokens long, input_ids binary"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                      names=["doc_id", "start", "n_tokens", "input_ids"])


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("input_ids").alias("ids_crc32"))
