"""Quality score of whole texts by a byte-level convolutional network.

A text is cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - HOP`` and
cover it from end to end (the last one ends with the text). Each byte has a
learned vector, and learned filters ``2 * STEP`` bytes wide move over a chunk in
steps of ``STEP`` bytes; the largest answer of each filter is the chunk's
description. Its maximum, mean and minimum over all chunks go through one hidden
layer into one probability.

The network is trained in numpy from a bounded sample of labelled rows: at most
``per_class`` rows of each label, taken by the hash of their id whatever their length,
until they hold ``class_bytes`` bytes (the last one may pass that); the bias is then
set back to the labels' own ratio.
Scoring reads whole texts, batch by batch, in tasks without a shuffle.

Null texts count as empty, and an empty text is one chunk of padding, so it has
a score too. Rows without a usable label are not trained on. With labels of one
class only the score is 1 or 0 for all rows, and 0.5 when there are none. Where the
labels have both classes and the labelled documents one or none, the labels' more
frequent class is the score of all rows, with a warning.
Repeated rows are scored each, an empty table gives no rows, other columns are
not read, and a null id is kept.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import text_chunks, utf8

CHUNK, HOP, STEP = 256, 192, 4
BYTE_DIM, FILTERS, HIDDEN = 8, 32, 16
BLOCK = 512


def chunk_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every chunk, and the number of chunks before each text (one longer)."""
    length = np.diff(offsets)
    count = np.maximum(1, -(-np.maximum(0, length - CHUNK) // HOP) + 1)
    first = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(length)), count)
    start = offsets[text] + np.minimum(HOP * (np.arange(first[-1]) - first[text]), np.maximum(0, length - CHUNK)[text])
    return np.stack([start, np.minimum(start + CHUNK, offsets[text + 1])], axis=1), first


class Network:
    NAMES = ("bytes", "filters", "filter_bias", "hidden", "hidden_bias", "out", "out_bias")

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        width = 2 * STEP * BYTE_DIM
        self.w = weights or {
            "bytes": rng.normal(0, 0.5, (256, BYTE_DIM)), "filters": rng.normal(0, width ** -0.5, (width, FILTERS)),
            "filter_bias": np.zeros(FILTERS), "hidden": rng.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN), "out": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "out_bias": np.zeros(1)}
        self.w = {k: np.asarray(v, np.float32) for k, v in self.w.items()}

    def _block(self, raw: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Chunks as rows of bytes, padded with zeros."""
        at = spans[:, :1] + np.arange(CHUNK)
        inside = at < spans[:, 1:]
        return np.where(inside, raw[np.minimum(at, max(0, len(raw) - 1))] if len(raw) else 0, 0).astype(np.uint8)

    def chunks(self, raw: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest answer of each filter in each chunk, where it was, and the chunks' bytes."""
        half = STEP * BYTE_DIM
        both = np.concatenate([self.w["filters"][:half], self.w["filters"][half:]], axis=1)
        best, where, kept = [], [], []
        for i in range(0, len(spans), BLOCK):
            data = self._block(raw, spans[i:i + BLOCK])
            answers = self.w["bytes"][data].reshape(-1, half) @ both
            answers = answers.reshape(len(data), CHUNK // STEP, 2 * FILTERS)
            answers = answers[:, :-1, :FILTERS] + answers[:, 1:, FILTERS:]
            at = answers.argmax(axis=1) if self.training else np.zeros((len(data), 0), np.int64)
            best.append(np.maximum(answers.max(axis=1) + self.w["filter_bias"], 0))
            where.append(at)
            kept.append(data if self.training else data[:, :0])
        return np.concatenate(best), np.concatenate(where), np.concatenate(kept)

    training = False

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        spans, first = chunk_rows(raw, offsets)
        described = self.chunks(raw, spans)[0]
        return self._combine(described, first)[0]

    def _combine(self, described: np.ndarray, first: np.ndarray):
        top = np.maximum.reduceat(described, first[:-1])
        mean = np.add.reduceat(described, first[:-1]) / np.diff(first)[:, None]
        low = np.minimum.reduceat(described, first[:-1])
        features = np.concatenate([top, mean, low], axis=1).astype(np.float32)
        hidden = np.tanh(features @ self.w["hidden"] + self.w["hidden_bias"])
        return hidden @ self.w["out"] + self.w["out_bias"][0], hidden, features

    def gradients(self, raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        spans, first = chunk_rows(raw, offsets)
        described, where, data = self.chunks(raw, spans)
        logit, hidden, features = self._combine(described, first)
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)).astype(np.float32)
        g = {"out": hidden.T @ error, "out_bias": error.sum(keepdims=True)}
        at_hidden = error[:, None] * self.w["out"] * (1 - hidden ** 2)
        g["hidden"], g["hidden_bias"] = features.T @ at_hidden, at_hidden.sum(axis=0)
        at_features = at_hidden @ self.w["hidden"].T
        counts = np.diff(first)
        text = np.repeat(np.arange(len(counts)), counts)
        at_chunk = (at_features[:, FILTERS:2 * FILTERS] / counts[:, None])[text]
        for part in (slice(0, FILTERS), slice(2 * FILTERS, None)):
            is_best = described == features[:, part][text]
            shared = np.add.reduceat(is_best, first[:-1], dtype=np.int64)
            at_chunk = at_chunk + (at_features[:, part] / np.maximum(1, shared))[text] * is_best
        at_chunk = (at_chunk * (described > 0)).astype(np.float32)
        g["filter_bias"] = at_chunk.sum(axis=0)
        window = data[np.arange(len(data))[:, None, None], where[:, :, None] * STEP + np.arange(2 * STEP)]
        vectors = self.w["bytes"][window].reshape(len(data), FILTERS, -1)
        g["filters"] = np.einsum("cfw,cf->wf", vectors, at_chunk)
        at_vectors = at_chunk[:, :, None] * self.w["filters"].T
        g["bytes"] = np.zeros_like(self.w["bytes"])
        np.add.at(g["bytes"], window.reshape(-1), at_vectors.reshape(-1, BYTE_DIM))
        return g


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fit(texts: list[bytes], labels: list[int], rates: tuple[int, int], epochs: int = 8, batch: int = 16,
        speed: float = 0.004, seed: int = 3) -> Network:
    """Adam on whole texts; ``rates`` are the numbers of rows of label 0 and 1 that the sample stands for."""
    net = Network(seed=seed)
    net.training = True
    rng = np.random.default_rng(seed)
    labels_ = np.array(labels, np.float32)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            part = order[i:i + batch]
            step += 1
            rate = speed * (1 - step / (total + 1)) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
            for k, g in net.gradients(*_joined([texts[j] for j in part]), labels_[part]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.w[k] = (net.w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    ones = labels_.sum()
    net.w["out_bias"] = net.w["out_bias"] + np.float32(
        np.log(rates[1] / rates[0]) - np.log(ones / (len(labels_) - ones)))
    net.training = False
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, class_bytes: int = 1 << 26) -> Network | float:
    """A network for ``labels.quality``, or the one score of all rows where the labels have no two classes.

    Only rows whose crc32(doc_id as text) mod 3 is not 1 are looked at.
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND crc32(cast(doc_id AS string)) % 3 <> 1").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rates = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(rates) < 2:
        return float(next(iter(rates), 0.5))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.struct(F.octet_length("text").cast("long").alias("bytes"),
                                            F.xxhash64("text").alias("print")).alias("pick"))
    chosen = []
    for label, n in sorted(rates.items()):
        # The hash threshold leaves about twice the rows needed, the limit bounds them; all labels are looked at
        # where too few of those are of documents here.
        for share in dict.fromkeys((min(1.0, 2 * per_class / n), 1.0)):
            part = usable.where(f"quality = {label} AND pmod(xxhash64(doc_id), 1000000) < {share * 1e6}").distinct()
            found = (sizes.join(part, "doc_id").groupBy("quality", "doc_id").agg(F.min("pick").alias("pick"))
                     .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
                     .select("quality", "doc_id", "pick.*").collect())
            if len(found) == per_class:
                break
        total = 0
        for row in found:
            if total < class_bytes:
                chosen.append(tuple(row))
                total += row.bytes
    classes = {c[0] for c in chosen}
    if len(classes) < 2:
        # No cut of the sample leads here: each class with a document has a row at least.
        warnings.warn(f"both labels are given, but the documents that are trained on have {len(classes)} of them: "
                      "all get the score of the more frequent label", stacklevel=2)
        return float(rates.get(1, 0) >= rates.get(0, 0))
    wanted = docs.sparkSession.createDataFrame(chosen, "quality int, doc_id long, bytes long, print long")
    sample = (texts.withColumn("bytes", F.octet_length("text").cast("long")).withColumn("print", F.xxhash64("text"))
              .join(F.broadcast(wanted), ["doc_id", "bytes", "print"]).groupBy("quality", "doc_id")
              .agg(F.min("text").alias("text")).orderBy("quality", F.xxhash64("doc_id"), "doc_id")
              .select("quality", F.encode("text", "utf-8").alias("raw")).collect())
    return fit([bytes(r.raw) for r in sample], [r.quality for r in sample], (rates[0], rates[1]))


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id and the probability of label 1 of every row."""
    weights = model.w if isinstance(model, Network) else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights) if weights else None
        for batch in batches:
            for part in text_chunks(batch, limit=1 << 20):
                raw, offsets = utf8(part.column("text"))
                logit = net.logits(raw, offsets) if net else np.zeros(len(offsets) - 1)
                value = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))) if net else np.full(len(logit), model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value, pa.float64())],
                                                 names=["doc_id", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(task, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Network | float, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    weights = model.w if isinstance(model, Network) else None
    if weights is None:
        return docs.where(F.lit(model >= threshold))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        limit = np.log(threshold / (1 - threshold))
        for batch in batches:
            good = [net.logits(*utf8(part.column("text"))) >= limit for part in text_chunks(batch, limit=1 << 20)]
            yield batch.filter(pa.array(np.concatenate([np.empty(0, bool), *good])))

    return docs.mapInArrow(task, docs.schema)
