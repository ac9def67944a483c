"""Vector bin packing of tokenized examples into training sequences.

Every example is a vector (tokens, one segment, loss-bearing tokens) and every
sequence has a limit for each component. A task fills one sequence at a time
from a window of open examples: of those that fit, the one with the greatest
dot product between its demand and the room left, both as shares of the limits,
goes in; when none fits, the one with the greatest product is cut so that it
fills the room. Full-length pieces of long examples are cut off on arrival.
A sequence that cannot be filled (the last of a task, or one that holds the
largest number of segments) is split at powers of two, which need no padding.

Each partition packs its own rows, so nothing is shuffled and a lost task can
be run again alone. A task holds ``window`` open examples of less than one
sequence each and one batch of texts.

Null texts count as empty; an empty text is one piece that holds the end id
alone. Repeated rows are packed as often as they occur, ties go to the earlier
row, an empty table gives no rows, and other columns are not read. A null id is
kept as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrow import text_chunks
from .tokens import encoder

SCHEMA = ("doc_id long, start long, length long, input_ids binary, doc_tokens long, "
          "sequence_id long, offset long, loss_tokens long")
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("input_ids", pa.binary()), ("doc_tokens", pa.int64()),
                   ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())])


class Example:
    __slots__ = ("doc_id", "ids", "start", "end", "prompt")

    def __init__(self, doc_id: int | None, ids: bytes, prompt: int):
        self.doc_id, self.ids, self.start, self.end, self.prompt = doc_id, ids, 0, len(ids) // 4, prompt

    def loss(self, start: int, end: int) -> int:
        return end - max(start, min(self.prompt, end))

    def take(self, room: int, loss_room: int) -> int:
        """How many of the open ids fit into the room."""
        masked = min(max(0, self.prompt - self.start), room, self.end - self.start)
        return masked + min(self.end - self.start - masked, room - masked, loss_room)


class Packer:
    """Packs the examples of one task; ``rows`` collects finished pieces."""

    def __init__(self, first_id: int, capacity: int, max_segments: int, max_loss: int, window: int):
        self.limits = np.array([capacity, max_segments, max_loss], float)
        self.capacity, self.max_segments, self.max_loss, self.window = capacity, max_segments, max_loss, window
        self.next_id = first_id
        self.open: list[Example] = []
        self.demand = np.zeros((window + 1, 3))
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple[Example, int, int]]) -> None:
        """One finished sequence."""
        offset = 0
        for example, start, end in pieces:
            self.rows.append((example.doc_id, start, end - start, example.ids[4 * start:4 * end],
                              len(example.ids) // 4, self.next_id, offset, example.loss(start, end)))
            offset += end - start
        self.next_id += 1

    def _close(self, pieces: list[tuple[Example, int, int]], filled: int) -> None:
        if filled == self.capacity:
            return self._emit(pieces)
        pieces, part, room = list(reversed(pieces)), [], 0
        while filled:
            room = room or 1 << (filled.bit_length() - 1)
            example, start, end = pieces.pop()
            cut = min(end, start + room)
            part.append((example, start, cut))
            room, filled = room - (cut - start), filled - (cut - start)
            if cut < end:
                pieces.append((example, cut, end))
            if not room:
                self._emit(part)
                part = []

    def add(self, example: Example) -> None:
        while (n := example.take(self.capacity, self.max_loss)) and (
                n == self.capacity or example.start + n < example.end):
            pieces = [(example, example.start, example.start + n)]
            example.start += n
            self._close(pieces, n)
        if example.start < example.end:
            at = len(self.open)
            self.open.append(example)
            self.demand[at] = (example.end - example.start, 1, example.loss(example.start, example.end))
            if len(self.open) > self.window:
                self.fill()

    def _remove(self, at: int) -> None:
        del self.open[at]
        n = len(self.open)
        self.demand[at:n] = self.demand[at + 1:n + 1]

    def fill(self) -> None:
        """One sequence from the open examples."""
        room = self.limits.copy()
        pieces: list[tuple[Example, int, int]] = []
        while self.open and room.min() > 0:
            demand = self.demand[:len(self.open)]
            product = demand @ (room / self.limits**2)
            fits = (demand <= room).all(axis=1)
            at = int(np.argmax(np.where(fits, product, -1.0) if fits.any() else product))
            example = self.open[at]
            n = example.take(int(room[0]), int(room[2]))
            pieces.append((example, example.start, example.start + n))
            room -= (n, 1, example.loss(example.start, example.start + n))
            example.start += n
            if example.start == example.end:
                self._remove(at)
            else:
                self.demand[at] = (example.end - example.start, 1, example.loss(example.start, example.end))
        self._close(pieces, int(self.capacity - room[0]))

    def flush(self) -> None:
        while self.open:
            self.fill()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)],
                                          schema=ARROW)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, max_segments: int = 64,
         max_loss: int | None = None, window: int = 2048, prompt: str | None = None) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) with their place in a sequence.

    ``prompt`` names a text column put before ``text`` whose ids bear no loss.
    ``input_ids`` holds little-endian unsigned 32-bit ids. A piece is
    ``length`` ids from ``start`` of its document's ``doc_tokens``.
    """
    if min(capacity, max_segments, window, 1 if max_loss is None else max_loss) < 1:
        raise ValueError("limits must be positive")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_array
        end = int(end_id).to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, max_segments,
                        capacity if max_loss is None else max_loss, window)
        for batch in batches:
            for part in text_chunks(batch):
                ids = encode(part.column("text"))
                heads = encode(pc.fill_null(part.column("prompt").cast(pa.large_string()), ""))
                for doc_id, head, body in zip(part.column("doc_id").to_pylist(), heads, ids, strict=True):
                    packer.add(Example(doc_id, head + body + end, len(head) // 4))
                if packer.rows:
                    yield packer.batch()
        packer.flush()
        yield packer.batch()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         (F.col(prompt) if prompt else F.lit(None)).cast("string").alias("prompt"))
    return chosen.mapInArrow(task, SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum instead of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "loss_tokens")
