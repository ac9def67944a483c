"""Token counts by rank-synchronous merging over ragged arrays.

The symbols of many pre-tokens lie in one flat array. In every round each
pre-token finds the lowest-ranked pair of neighbours it holds and all
pre-tokens merge theirs at once; those without a pair left are done, and the
symbols that remain are their tokens. Each task keeps the counts of pre-tokens
it has met (about ``max_cached`` words, then it starts afresh) and merges the
new ones of a batch together.

Null and empty texts have no tokens. Repeated rows are counted each, an empty
table gives no rows, other columns are not read, and a null id is kept.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .arrow import text_chunks
from .tokens import LETTERS, NUMBERS, OTHER_SCRIPTS, load_tokenizer

NO_RANK = np.int64(1 << 40)
# Fixed value: the split pattern of the word-end vocabulary.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class MergeTable:
    """Pair ranks of a BPE file with word ends, sorted for array look-ups."""

    def __init__(self, spec: dict):
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.rank[at], NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left in each of the non-empty ``words`` when no pair can be merged."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        done, active = np.zeros(len(words), np.int64), np.arange(len(words))
        while len(active):
            starts = np.cumsum(lengths) - lengths
            rank = np.full(len(symbols), NO_RANK)
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[starts[1:] - 1] = NO_RANK
            lowest = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(lowest, lengths)) & (rank < NO_RANK)
            # Of touching hits (a a a) the first, third, ... are merged.
            at = np.flatnonzero(hit)
            fresh = np.ones(len(at), bool)
            fresh[1:] = np.diff(at) > 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            lengths = np.add.reduceat(keep.astype(np.int64), starts)
            over = lowest == NO_RANK
            done[active[over]] = lengths[over]
            keep &= ~np.repeat(over, np.diff(np.append(starts, len(symbols))))
            symbols, active, lengths = symbols[keep], active[~over], lengths[~over]
        return done


class UnitCache:
    """Values of units (words with their marks), computed in batches for those not met before."""

    def __init__(self, compute, max_cached: int):
        self.compute, self.max_cached = compute, max_cached
        self.known: dict = {}

    def values(self, texts: list[list[str]]) -> list[list]:
        if len(self.known) > self.max_cached:
            self.known.clear()
        known = self.known.get
        out = [list(map(known, units)) for units in texts]
        missing = []
        for units, values in zip(texts, out, strict=True):
            at = -1
            for _ in range(values.count(None)):
                at = values.index(None, at + 1)
                missing.append((values, at, units[at]))
        new = list({unit for _, _, unit in missing})
        if new:
            self.known.update(zip(new, self.compute(new), strict=True))
        for values, at, unit in missing:
            values[at] = self.known[unit]
        return out


class Counter:
    def __init__(self, path: str, max_cached: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or not spec["model"]["end_of_word_suffix"]:
            raise ValueError("a BPE file with word ends is needed")
        self.table = MergeTable(spec)
        self.library = load_tokenizer(path)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.bytes_of = {s: b for b, s in enumerate(byte_symbols())}
        self.words = UnitCache(self._merged, max_cached)
        self.cache = UnitCache(self._units, max_cached)

    def _units(self, units: list[str | tuple[str]]) -> list[int]:
        """Tokens of blank-separated units, and of the library's pieces; the new pre-tokens of all are merged together."""
        words = [u if isinstance(u, tuple) else WORDS.findall(u) for u in units]
        return [sum(counts) for counts in self.words.values(words)]

    def _merged(self, words: list[str]) -> list[int]:
        return self.table.count([w.encode("utf-8", "surrogateescape") for w in words]).tolist()

    def _split(self, text: str) -> list[str | tuple[str]]:
        """The units of a text, or its pre-tokens as tuples of one."""
        lower = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        # Lower case may leave the range of the classes written out here, or enter it.
        if OTHER_SCRIPTS.search(lower) or (not text.isascii() and OTHER_SCRIPTS.search(text)):
            # The library's own rules for scripts whose classes are not written out here.
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [(bytes(self.bytes_of[c] for c in piece).decode("utf-8", "surrogateescape"),) for piece, _ in split]
        return lower.split()

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.special.split(t) for t in texts]
        units = [[w for p in part for w in self._split(p)] if len(part) > 1 else self._split(part[0]) for part in parts]
        return [len(part) - 1 + sum(tokens) for part, tokens in zip(parts, self.cache.values(units), strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row's whole text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            for part in text_chunks(batch):
                texts = part.column("text")
                n = np.array(count(texts.to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n),
                     pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
