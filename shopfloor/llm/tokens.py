"""Token ids of whole texts, as the tokenizers library gives them.

A byte-level BPE encodes each pre-token by itself, so the ids of a text are
those of its pre-tokens in order. Each task keeps the ids of the pre-tokens it
has met, under a 64-bit hash in a numpy table, and asks the library only for
new ones; pre-tokens are cut, hashed and looked up as arrays. Texts outside
plain Latin script with single blanks and line breaks (other scripts, other
white space, contractions, what may be a special string) go to the library
whole; the ids are the same either way.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .arrow import utf8
from .shingles import mix, span_hashes

# Letters and numbers of U+0000 to U+024F.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
# Everything else; U+0130 has a lower case of two characters.
OTHER_SCRIPTS = re.compile("[^\t\n\r\x20-\x7e\xa0-\u012f\u0131-\u024f]")
LETTER, NUMBER, MARK, BLANK, BREAK, ODD = range(6)


def _classes() -> np.ndarray:
    """Class of each byte; lead bytes 0xC3 to 0xC9 and what follows them are letters."""
    kind = np.full(256, ODD, np.uint8)
    kind[0x21:0x7F] = MARK
    kind[0x30:0x3A] = NUMBER
    kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0x80:0xC0] = kind[0xC3:0xCA] = LETTER
    kind[0x20], kind[0x0A] = BLANK, BREAK
    return kind


KINDS = _classes()


def tokenizer_path(name: str) -> str:
    """Place of an installed public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class HashTable:
    """Open addressing over 64-bit hashes; the values are 0, 1, ... in order of insertion."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.full(int(self.mask) + 1, -1, np.int32)
        self.size = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Values, -1 where a hash is not held."""
        out = np.full(len(hashes), -1, np.int32)
        todo, slot = np.arange(len(hashes)), hashes & self.mask
        while len(todo):
            value = self.values[slot]
            same = self.keys[slot] == hashes[todo]
            out[todo[same]] = value[same]
            on = (value >= 0) & ~same
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def insert(self, hashes: np.ndarray) -> None:
        """Distinct hashes that are not held yet."""
        value = np.arange(self.size, self.size + len(hashes), dtype=np.int32)
        todo, slot = np.arange(len(hashes)), hashes & self.mask
        while len(todo):
            free = self.values[slot] < 0
            self.keys[slot[free]] = hashes[todo[free]]
            self.values[slot[free]] = value[todo[free]]
            put = free & (self.values[slot] == value[todo])
            todo, slot = todo[~put], (slot[~put] + np.uint64(1)) & self.mask
        self.size += len(hashes)


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, without added special tokens."""

    def __init__(self, path: str, bits: int = 22):
        self.library = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space") and spec["normalizer"] is None
                         and spec["post_processor"] is None and spec["model"]["type"] == "BPE"
                         and all(t["content"].startswith("<|") for t in spec["added_tokens"]))
        self.table = HashTable(bits)
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the arrays can cut: no odd byte, no white space beside another or at the end."""
        odd = kind == ODD
        space = (kind == BLANK) | (kind == BREAK)
        odd[:-1] |= space[:-1] & space[1:]
        odd[:-1] |= (raw[:-1] == 0x27) & (kind[1:] == LETTER)  # don't
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)  # <|
        odd[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # the signs × and ÷
        filled = np.flatnonzero(np.diff(offsets))
        plain = np.ones(len(offsets) - 1, bool)
        if len(filled):
            plain[filled] = ~np.logical_or.reduceat(odd, offsets[filled]) & ~space[offsets[filled + 1] - 1]
        return plain & self.by_piece

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids = self._whole(pieces)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        first, n = self.table.size, len(ids)
        while first + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        length = np.array([len(x) // 4 for x in ids], np.int64)
        self.lengths[first:first + n] = length
        self.starts[first:first + n] = self.used + np.cumsum(length) - length
        self.pool[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.table.insert(hashes)

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """Ids of a non-null large_string array."""
        raw, offsets = utf8(texts)
        if not len(raw):
            return [b""] * len(texts)
        kind = KINDS[raw]
        plain = self._plain(raw, kind, offsets)
        first = np.zeros(len(raw), bool)
        first[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK)
        first |= (kind == BLANK) | (kind == BREAK)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        text = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.append(starts[1:], len(raw))
        keep = plain[text]
        starts, ends, text = starts[keep], ends[keep], text[keep]
        hashes = mix(span_hashes(raw, starts, ends))
        value = self.table.find(hashes)
        missing = np.flatnonzero(value < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            if self.table.size + len(new) > int(self.table.mask) // 3:
                self._clear()
                new, at = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            data = raw.tobytes()
            self._learn(new, [data[a:b].decode() for a, b in zip(
                starts[missing[at]].tolist(), ends[missing[at]].tolist(), strict=True)])
            value[missing] = self.table.find(hashes[missing])
        length = self.lengths[value]
        before = np.cumsum(length) - length
        ids = self.pool[np.repeat(self.starts[value] - before, length) + np.arange(length.sum())]
        bounds = np.concatenate([before, [len(ids)]])[np.searchsorted(text, np.arange(len(texts) + 1))].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        rest = np.flatnonzero(~plain & (np.diff(offsets) > 0)).tolist()
        for i, whole in zip(rest, self._whole([texts[i].as_py() for i in rest]), strict=True):
            out[i] = whole
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.large_string()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
