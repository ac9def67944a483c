"""Language of whole texts by a bidirectional gated recurrent network over bytes.

A text is cut into pieces of ``PIECE`` bytes that cover it from end to end. In each
piece one gated recurrent layer reads the bytes forwards and another backwards; at every
position both states together give a probability for each language. A text's
probability is the mean over all its positions, and the language with the highest one
is its label (ties: the first in code-point order).

Gates are (1 + squash) / 2. The network is trained in numpy by backpropagation through time, with a loss at
every position, from a bounded sample of the rows whose crc32(doc_id as text) mod 3 is
not 1 and whose lang isn't null: at most ``per_lang`` documents of each language, taken
by a hash of their id, and of each one stretch of at most ``stretch`` bytes at a place
that the hash names. The languages themselves are collected: a label set is a small
thing, and the network has an output for each.
Only text and lang are learned from; lang, source and doc_id are never read in scoring,
which happens batch by batch in the tasks that read the texts, without a shuffle.

Null texts and texts without any letter are ``und`` with score 0. Where no labelled
document has a letter, all rows are ``und``; with one language only, all others get that
language with score 1. Repeated rows are labelled each, a null id is kept, an empty
table gives no rows, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .arrow import text_chunks, utf8

PIECE, STATE, BLOCK = 96, 12, 1024
LETTER = r"\p{L}"


def pieces(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every piece of every text, and the number of pieces before each text (one longer)."""
    length = np.diff(offsets)
    count = np.maximum(1, -(-length // PIECE))
    first = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(length)), count)
    start = offsets[:-1][text] + PIECE * (np.arange(first[-1]) - first[text])
    return start, np.minimum(PIECE, offsets[1:][text] - start), first


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place of the hyperbolic tangent: as smooth a step to -1 and 1, at a sixth of its time."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of ``squash`` where it is ``y``."""
    return (1 - np.abs(y)) ** 2


class Reader:
    """Two gated recurrent layers over bytes and one output layer; index 0 reads forwards, 1 backwards.

    ``inputs`` (2, 3 STATE, 256) is what a byte adds to the gates update, reset and candidate, ``states`` (2, 3 STATE,
    STATE) what the last state adds, ``out`` (languages, 2, STATE).
    """

    def __init__(self, languages: int, weights: dict[str, np.ndarray] | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = weights or {
            "inputs": rng.normal(0, 0.4, (2, 3 * STATE, 256)), "states": rng.normal(0, STATE ** -0.5, (2, 3 * STATE, STATE)),
            "bias": np.zeros((2, STATE, 1)), "out": rng.normal(0, STATE ** -0.5, (languages, 2, STATE)),
            "out_bias": np.zeros((languages, 1))}
        self.w = {k: np.asarray(v, np.float32) for k, v in self.w.items()}

    def read(self, data: np.ndarray, inside: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, 2, STATE, pieces) at each position of ``data`` (steps, pieces); 0 where not ``inside``."""
        steps, n = data.shape
        out = np.empty((steps, 2, STATE, n), np.float32)
        table, state_w, bias = self.w["inputs"], self.w["states"], self.w["bias"]
        data = data.astype(np.intp)
        state = np.zeros((2, STATE, n), np.float32)
        added = np.empty((2, 3 * STATE, n), np.float32)
        whole = bool(inside.all())
        for t in range(steps):
            back = steps - 1 - t
            np.take(table[0], data[t], axis=1, out=added[0], mode="clip")
            np.take(table[1], data[back], axis=1, out=added[1], mode="clip")
            held = state_w @ state
            gates = squash(added[:, :2 * STATE] + held[:, :2 * STATE])
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:, :STATE], gates[:, STATE:]
            pre = held[:, 2 * STATE:] + bias
            new = reset * pre
            new += added[:, 2 * STATE:]
            new = squash(new)
            nxt = state - new
            nxt *= update
            nxt += new
            if not whole:
                nxt[0] *= inside[t]
                nxt[1] *= inside[back]
            if keep is not None:
                keep.append((state, update, reset, pre, new))
            state = nxt
            out[t, 0], out[back, 1] = state[0], state[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(steps, languages, pieces) from the states at each position."""
        steps, _, _, n = states.shape
        logit = np.matmul(self.w["out"].reshape(-1, 2 * STATE), states.reshape(steps, 2 * STATE, n)) + self.w["out_bias"]
        logit -= logit.max(axis=1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=1, keepdims=True)
        return logit

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): mean probability over all positions of each text; 0 for an empty one."""
        start, length, first = pieces(offsets)
        total = np.zeros((len(start), len(self.w["out"])), np.float64)
        # Pieces of like length stand together, so that short ones take few steps.
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), BLOCK):
            part = order[i:i + BLOCK]
            steps = int(length[part[-1]])
            if steps:
                data, inside = grid(raw, start[part], length[part], steps)
                p = self.probabilities(self.read(data, inside))
                total[part] = (p * inside[:, None]).sum(axis=0, dtype=np.float64).T
        return np.add.reduceat(total, first[:-1]) / np.maximum(1, np.diff(offsets))[:, None]

    def gradients(self, data: np.ndarray, inside: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        steps, n = data.shape
        kept: list[tuple] = []
        states = self.read(data, inside, kept)
        error = self.probabilities(states)
        error[:, label, np.arange(n)] -= 1
        error *= (inside / inside.sum())[:, None]
        flat = states.reshape(steps, 2 * STATE, n)
        languages = len(self.w["out"])
        g = {"out": np.einsum("tkn,tsn->ks", error, flat).reshape(languages, 2, STATE),
             "out_bias": error.sum(axis=(0, 2))[:, None]}
        at_states = np.matmul(self.w["out"].reshape(languages, -1).T, error).reshape(steps, 2, STATE, n)
        at_inputs = np.empty((2, 3 * STATE, steps, n), np.float32)
        g["states"], g["bias"] = np.zeros_like(self.w["states"]), np.zeros_like(self.w["bias"])
        carried = np.zeros((2, STATE, n), np.float32)
        back_w = self.w["states"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            state, update, reset, pre, new = kept[t]
            at = carried + np.stack([at_states[t, 0], at_states[back, 1]])
            at[0] *= inside[t]
            at[1] *= inside[back]
            at_new = at * (1 - update) * slope(new)
            at_held = np.concatenate([at * (state - new) * 0.5 * slope(2 * update - 1),
                                      at_new * pre * 0.5 * slope(2 * reset - 1), at_new * reset], axis=1)
            g["bias"] += at_held[:, 2 * STATE:].sum(axis=2, keepdims=True)
            g["states"] += at_held @ state.transpose(0, 2, 1)
            at_inputs[0, :, t], at_inputs[1, :, back] = at_held[0], at_held[1]
            at_inputs[0, 2 * STATE:, t], at_inputs[1, 2 * STATE:, back] = at_new[0], at_new[1]
            carried = at * update + back_w @ at_held
        chosen = np.zeros((steps * n, 256), np.float32)
        chosen[np.arange(steps * n), data.reshape(-1)] = 1
        g["inputs"] = at_inputs.reshape(2, 3 * STATE, -1) @ chosen
        return g


def grid(raw: np.ndarray, start: np.ndarray, length: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' bytes as (steps, pieces), 0 beyond their ends, and where they are inside."""
    at = np.arange(steps)[:, None]
    inside = at < length
    data = np.where(inside, raw[np.minimum(start + at, len(raw) - 1)], 0)
    return data.astype(np.uint8), inside.astype(np.float32)


def fit(texts: list[bytes], labels: list[int], languages: int, rounds: int = 240, batch: int = 160, steps: int = 64,
        speed: float = 0.02, seed: int = 5) -> Reader:
    """Adam over stretches of 4 to ``steps`` bytes, each language equally often."""
    net, rng = Reader(languages, seed=seed), np.random.default_rng(seed)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    held = np.array(labels)
    of = [np.flatnonzero((held == k) & (ends > starts)) for k in range(languages)]
    weight = [np.cumsum(ends[x] - starts[x]) for x in of]
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, rounds + 1):
        label = rng.permutation(batch) % languages
        # Texts are drawn by their length, and every fourth stretch is a short one.
        text = np.array([of[k][np.searchsorted(weight[k], rng.integers(weight[k][-1]), side="right")] for k in label])
        size = ends[text] - starts[text]
        length = np.minimum(size, np.where(rng.random(batch) < 0.25, rng.integers(4, steps + 1, batch), steps))
        at = starts[text] + (rng.random(batch) * (size - length + 1)).astype(np.int64)
        rate = speed * (1 - step / (rounds + 1)) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
        for k, g in net.gradients(*grid(raw, at, length, int(length.max())), label).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.w[k] = (net.w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, per_lang: int = 400, stretch: int = 2048) -> tuple[list[str], Reader | None]:
    """The languages, in code-point order, and a network for them (None where there are less than two)."""
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    shares = [(r.lang, min(1.0, 2 * per_lang / r.n))
              for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not shares:
        return [], None
    found = []
    # The thresholds leave about twice the rows needed; all rows are looked at where those have no letters.
    for wanted in (shares, [(lang, 1.0) for lang, _ in shares]):
        wanted = [w for w in wanted if w[0] not in {f.lang for f in found}]
        if not wanted:
            break
        drawn = (usable.join(F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, share double")), "lang")
                 .where(F.expr("pmod(xxhash64(doc_id), 1000000) < share * 1e6"))
                 .where(F.col("text").cast("string").rlike(LETTER)))
        raw = F.encode(F.col("text").cast("string"), "utf-8")
        place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length(raw) - stretch + 1)).cast("int")
        # One row of each id, and per_lang of each language, are kept before and after the shuffle.
        one = drawn.groupBy("lang", "doc_id").agg(F.min(F.substring(raw, place + 1, F.lit(stretch))).alias("raw"))
        order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
        found += (one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_lang)
                  .select("lang", "doc_id", "raw").collect())
    found.sort(key=lambda r: (r.lang, r.doc_id))
    languages = sorted({r.lang for r in found})
    if len(languages) < 2:
        return languages, None
    return languages, fit([bytes(r.raw) for r in found], [languages.index(r.lang) for r in found], len(languages))


def predict(docs: DataFrame, model: tuple[list[str], Reader | None]) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``."""
    languages, net = model
    weights = net.w if net else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(len(languages), weights) if weights else None
        for batch in batches:
            for part in text_chunks(batch, limit=1 << 20):
                p = (reader.pooled(*utf8(part.column("text"))) if reader
                     else np.ones((part.num_rows, 1)))
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lettered"), pa.array([languages[i] for i in best.tolist()], pa.string()),
                     pa.array(p[np.arange(len(p)), best], pa.float64())], names=["doc_id", "lettered", "lang", "score"])

    text = F.col("text").cast("string")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("lettered"),
                         text.alias("text"))
    if not languages:
        return chosen.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return chosen.mapInArrow(task, "doc_id long, lettered boolean, lang string, score double").select(
        "doc_id", F.when(F.col("lettered"), F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.least(F.col("score"), F.lit(1.0))).otherwise(0.0).alias("score"))
