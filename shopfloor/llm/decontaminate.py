"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document holds a benchmark item when the item's words lie within a word edit
distance of ``floor((1 - similarity) * words)`` of some stretch of the
document's words (lower case, punctuation and spacing aside; in scripts written
without blanks each letter is a word). Items of fewer than ``least`` words, which
ordinary texts hold by chance, are not searched.

Candidate search: windows as long as an item (in words) are embedded by CGK
random walks. A walk emits the symbol under its pointer and moves on or not by
a random bit of (step, symbol), so that strings a few edits apart stay in step
and differ in few places. Each walk is sampled at ``SAMPLES`` sets of ``BITS``
places; a window whose key at one set equals that of an item of its length is a
candidate, and semi-global edit distance then decides. Walks stay in step over
short stretches only, so an item of more than ``PART`` words is cut into even
parts: one part has no more than its share of the item's edits and is searched
in windows of its own length, and the whole item is compared around it. For each
length and number of edits there are as many walks (up to ``MOST_WALKS``) as find
``TARGET`` of trial windows with that many random edits. Windows are embedded only
where they can match at all: m words with at most e edits have, cut into e + 1
blocks, one block unharmed, so a match has the first words of a block at that
block's place, up to e words off.

The items are small beside the corpus, but no size is taken for granted: they
are dealt into blocks of about ``ITEMS`` items and ``ITEM_BYTES`` bytes at most, each
collected and searched by itself (a large benchmark makes a pass over the
documents for each block). Documents are read in place without a shuffle.

Null and empty texts and items without words match nothing; items without an id
are left out. Repeated documents are each reported, an empty table on either
side gives no rows, and other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import text_chunks

# Thai to Khmer, kana and Han are written without blanks.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
HIGH = re.compile("[\u0e00-\U0010ffff]")
WORD, PLAIN_WORD = re.compile(f"[{UNSPACED}]|[^\\W{UNSPACED}]+"), re.compile(r"\w+")
SAMPLES, BITS = 16, 3
PART = 64
TARGET, MOST_WALKS, TRIALS = 0.99, 16, 400
LEAST = 5
ITEMS, ITEM_BYTES = 20_000, 32 << 20
SCHEMA = "doc_id long, item_id long, start long, edits long"


def words(text: str) -> list[str]:
    text = text.lower()
    return (WORD if HIGH.search(text) else PLAIN_WORD).findall(text)


def allowed_edits(m: int, similarity: float) -> int:
    return int(np.floor((1 - similarity) * m + 1e-9))


def edit_distance(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Least edits between ``item`` and any part of ``stretch``, and the end of that part."""
    row = np.zeros(len(stretch) + 1, np.int64)
    place = np.arange(len(row))
    for i, symbol in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (stretch != symbol))
        # A run of insertions: the least of new[j] + (k - j) for j <= k.
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def _draws(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the walks, and the sampled places as shares of the walk's length."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, MOST_WALKS).astype(np.uint64), rng.random((MOST_WALKS, SAMPLES, BITS))


WALK_SEEDS, PLACES = _draws(11)


def walk_keys(flat: np.ndarray, starts: np.ndarray, m: int, first: int, last: int) -> np.ndarray:
    """LSH keys (one column for each sample of the walks from ``first``) of the windows of ``m`` symbols at ``starts``.

    All walks take a step together, so that short lists of windows don't pay for numpy's calls walk by walk."""
    out = np.zeros(((last - first) * SAMPLES, len(starts)), np.uint64)
    place = np.floor(PLACES[first:last] * (2 * m)).astype(np.int64)
    seeds = np.array([int(s) for s in WALK_SEEDS[first:last]], np.uint64)[:, None]
    pointer = np.zeros((last - first, len(starts)), np.int64)
    for step in range(int(place.max(initial=-1)) + 1):
        inside = pointer < m
        symbol = np.where(inside, flat[starts + np.minimum(pointer, m - 1)], -1).astype(np.uint64)
        walk, sample, bit = np.nonzero(place == step)
        if len(walk):
            drawn = _scatter(symbol[walk] + np.uint64(1), (977 * bit + 13)[:, None])
            for row, key in zip((walk * SAMPLES + sample).tolist(), drawn, strict=True):
                out[row] += key
        draw = _scatter(symbol + np.uint64(step << 32), seeds)
        pointer += (inside & ((draw >> np.uint64(60)) & np.uint64(1)).astype(bool))
    return out.T


def _trial(rng: np.random.Generator, item: np.ndarray, edits: int, mixed: bool) -> np.ndarray:
    """The item with ``edits`` words replaced, or replaced, dropped or put in; a new word may be unknown."""
    out = item.tolist()
    if not mixed:
        at = rng.permutation(len(out))[:edits]
        return np.where(np.isin(np.arange(len(out)), at), rng.integers(0, 2, len(out)) << 21, item)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        new = int(rng.integers(1, 1 << 20)) * int(rng.integers(2))
        out[at:at + (kind != 0)] = [] if kind == 1 and len(out) > 1 else [new]
    return np.array(out, np.int64)


@lru_cache(maxsize=None)
def walks_needed(m: int, edits: int, target: float = TARGET) -> int:
    """Fewest walks, doubled from four up to ``MOST_WALKS``, that find ``target`` of trial windows of either kind."""
    rng = np.random.default_rng([m, edits])
    items = rng.integers(1, 1 << 20, (TRIALS, m))
    pad = np.zeros(2 * edits + m, np.int64)
    texts = [np.concatenate([pad, _trial(rng, item, edits, n % 2 == 1), pad])
             for n, item in enumerate(items)]
    begin = np.cumsum([0, *[len(t) for t in texts[:-1]]]) + len(pad)
    starts = (begin[:, None] + np.arange(-edits, edits + 1)).ravel()
    flat, own = np.concatenate(texts), items.ravel()
    found, walks = np.zeros(TRIALS, bool), 0
    while walks < MOST_WALKS and min(found[0::2].mean(), found[1::2].mean()) < target:
        walks_next = max(4, 2 * walks)
        keys = walk_keys(own, np.arange(TRIALS) * m, m, walks, walks_next)
        got = walk_keys(flat, starts, m, walks, walks_next).reshape(TRIALS, -1, keys.shape[1])
        found |= (got == keys[:, None, :]).any(axis=(1, 2))
        walks = walks_next
    return walks


def cut(m: int) -> list[tuple[int, int]]:
    """First word and length of each part of an item of ``m`` words."""
    edges = np.linspace(0, m, -(-m // PART) + 1).astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def probe_sizes(m: int, similarity: float) -> list[tuple[int, int, int]]:
    """First word, length and most edits of each part: by their mean, one part has no more than its share."""
    edits = allowed_edits(m, similarity)
    return [(at, size, edits * size // m) for at, size in cut(m)]


class Items:
    """One block of benchmark items, ready for a task's search. ``walks`` are those of each (words, edits) of a part."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, walks: dict[tuple[int, int], int],
                 least: int = LEAST):
        split = [(i, words(t)) for i, t in rows]
        self.rows = [(i, w) for i, w in split if len(w) >= max(1, least)]
        vocabulary = sorted({x for _, w in self.rows for x in w})
        self.code = {x: n + 1 for n, x in enumerate(vocabulary)}
        self.ids = np.array([i for i, _ in self.rows], np.int64)
        self.words = [np.array([self.code[x] for x in w], np.int64) for _, w in self.rows]
        self.edits = [allowed_edits(len(w), similarity) for w in self.words]
        parts = [(n, *p) for n, w in enumerate(self.words) for p in probe_sizes(len(w), similarity)]
        self.item, self.first, self.sizes, self.most = (np.array([p[i] for p in parts], np.int64) for i in range(4))
        self.walks = {}
        for m, e in zip(self.sizes.tolist(), self.most.tolist(), strict=True):
            self.walks[m] = max(self.walks.get(m, 1), walks[m, e])
        self._seeds()
        self._tables()

    def _part(self, n: int) -> np.ndarray:
        return self.words[self.item[n]][self.first[n]:self.first[n] + self.sizes[n]]

    def _seeds(self) -> None:
        """By width: the key of the first words of each block of each part, the part and the block's place in it."""
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n in range(len(self.sizes)):
            w = self._part(n)
            blocks = int(self.most[n]) + 1
            width = min(3, len(w) // blocks)
            at = np.arange(blocks) * (len(w) // blocks)
            found.setdefault(width, []).append((_seed_keys(w, at, width), np.full(blocks, n), at))
        self.seeds = {}
        for width, rows in found.items():
            key, part, at = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.lexsort((at, part, key))
            self.seeds[width] = key[order], part[order], at[order]

    def _tables(self) -> None:
        self.tables = {}
        for m in np.unique(self.sizes).tolist():
            chosen = np.flatnonzero(self.sizes == m)
            flat = np.concatenate([self._part(i) for i in chosen])
            keys = walk_keys(flat, np.arange(len(chosen)) * m, m, 0, self.walks[m])
            order = np.argsort(keys, axis=0, kind="stable")
            self.tables[m] = (chosen, np.take_along_axis(keys, order, 0), order)

    def windows(self, flat: np.ndarray) -> dict[int, np.ndarray]:
        """By length: the starts of the windows that hold a block of a part near its place."""
        known = flat > 0
        out: dict[int, list[np.ndarray]] = {}
        for width, (key, part, at) in self.seeds.items():
            here = known.copy()
            for i in range(1, width):
                here[:-i] &= known[i:]
                here[-i:] = False
            pos = np.flatnonzero(here)
            got = _seed_keys(flat, pos, width)
            low, high = np.searchsorted(key, got), np.searchsorted(key, got, side="right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            entry = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(pos[hit], count) - at[entry]
            sizes = self.sizes[part[entry]]
            for m in np.unique(sizes).tolist():
                out.setdefault(m, []).append(start[sizes == m])
        return {m: np.unique(np.concatenate(s)) for m, s in out.items()}

    def candidates(self, flat: np.ndarray) -> Iterator[tuple[int, int]]:
        """(part, window start) where an LSH key of the window equals one of a part of its length."""
        longest = int(self.sizes.max())
        padded = np.concatenate([np.zeros(longest, np.int64), flat, np.zeros(longest, np.int64)])
        for m, starts in self.windows(flat).items():
            starts = starts[(starts > -m) & (starts < len(flat))]
            chosen, table, order = self.tables[m]
            step = (1 << 22) // table.shape[1]
            for i in range(0, len(starts), step):
                part = starts[i:i + step]
                keys = walk_keys(padded, part + longest, m, 0, self.walks[m])
                pairs = []
                for column in range(keys.shape[1]):
                    low = np.searchsorted(table[:, column], keys[:, column])
                    high = np.searchsorted(table[:, column], keys[:, column], side="right")
                    hit = np.flatnonzero(high > low)
                    count = (high - low)[hit]
                    entry = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    pairs.append(np.repeat(hit, count) * len(chosen) + order[entry, column])
                for pair in np.unique(np.concatenate(pairs)).tolist():
                    yield int(chosen[pair % len(chosen)]), int(part[pair // len(chosen)])

    def search(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) to (edits, start) of the best match of every item in every text."""
        if not texts or not len(self.sizes):
            return {}
        # Texts are set apart by more unknown words than a window has.
        gap = int((self.sizes + self.most).max()) + 1
        code, parts, first, ends = self.code.get, [], [], []
        at = gap
        for text in texts:
            got = words(text)
            parts += [np.zeros(gap, np.int64), np.fromiter(map(code, got, repeat(0)), np.int64, len(got))]
            first.append(at)
            ends.append(at + len(got))
            at += len(got) + gap
        flat = np.concatenate([*parts, np.zeros(gap, np.int64)])
        first_ = np.array(first)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for part, window in self.candidates(flat):
            item = int(self.item[part])
            text = int(np.searchsorted(first_, window + int(self.sizes[part]) - 1, side="right")) - 1
            m, e = len(self.words[item]), self.edits[item]
            # Places near one another share one stretch, wide enough for any of them.
            cell = (window - int(self.first[part])) // (e + 1)
            if text < 0 or (item, text, cell) in seen:
                continue
            seen.add((item, text, cell))
            low = max(first[text], cell * (e + 1) - 2 * e)
            stretch = flat[low:max(low, min(ends[text], cell * (e + 1) + m + 4 * e + 1))]
            edits, end = edit_distance(self.words[item], stretch)
            if edits <= e:
                back, length = edit_distance(self.words[item][::-1], stretch[:end][::-1])
                best = (edits, int(low + end - length - first[text]))
                found[text, item] = min(found.get((text, item), best), best)
        return found


def _seed_keys(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    key = np.zeros(len(at), np.uint64)
    for i in range(width):
        key = _scatter(key + flat[at + i].astype(np.uint64), 31 * i + 7)
    return key


def _scatter(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _prepared(rows: tuple[tuple[int, str], ...], similarity: float, walks: tuple, least: int) -> Items:
    return Items(list(rows), similarity, dict(walks), least)


def _walks(rows: tuple[tuple[int, str], ...], similarity: float) -> tuple:
    """Walks of every length and number of edits that the parts of these items have."""
    kinds = {(size, e) for m in {len(words(t)) for _, t in rows} if m for _, size, e in probe_sizes(m, similarity)}
    return tuple((k, walks_needed(*k)) for k in sorted(kinds))


def _blocks(items: DataFrame, per_block: int) -> Iterator[tuple[tuple[int, str], ...]]:
    usable = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n, blocks = size["n"], 1
    if n > per_block or size["b"] > ITEM_BYTES:
        blocks = max(-(-n // max(1, per_block // 2)), -(-size["b"] // (ITEM_BYTES // 2)))
    for b in range(blocks if n else 0):
        rows = usable.where(f"pmod(xxhash64(item_id, text), {blocks}) = {b}").orderBy("item_id", "text").collect()
        yield tuple((r.item_id, r.text) for r in rows)


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, per_block: int = ITEMS,
                 least: int = LEAST) -> DataFrame:
    """doc_id, item_id, start (word) and edits of the best match of each item found in each row of ``docs``."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(items, per_block):
        walks = _walks(block, similarity)

        def task(batches: Iterator[pa.RecordBatch], block=block, walks=walks) -> Iterator[pa.RecordBatch]:
            searched = _prepared(block, similarity, walks, least)
            for batch in batches:
                for part in text_chunks(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[t], int(searched.ids[i]), at, edits) for (t, i), (edits, at)
                            in sorted(searched.search(part.column("text").to_pylist()).items())]
                    columns = list(zip(*rows, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                     names=["doc_id", "item_id", "start", "edits"])

        part = chosen.mapInArrow(task, SCHEMA)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def keep_clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8, per_block: int = ITEMS,
               least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    for block in _blocks(items, per_block):
        walks = _walks(block, similarity)

        def task(batches: Iterator[pa.RecordBatch], block=block, walks=walks) -> Iterator[pa.RecordBatch]:
            searched = _prepared(block, similarity, walks, least)
            for batch in batches:
                clean: list[bool] = []
                for part in text_chunks(batch):
                    dirty = {t for t, _ in searched.search(part.column("text").to_pylist())}
                    clean += [i not in dirty for i in range(part.num_rows)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
