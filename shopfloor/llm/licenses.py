"""Licence notices in whole texts: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of a text; one of more than ``SPAN`` words is also read in
stretches of ``SPAN`` words every ``SPAN // 2``, so the whole text is covered
and a notice inside running text isn't diluted. A paragraph's features are its
hashed word 1-, 2- and 3-grams (letters only, A-Z folded), each divided by the square
root of the number of words. A multinomial logistic regression gives each
licence family and the unknown class a probability.

The classifier is trained from notices made of ``NOTICES`` by dropping,
doubling and replacing words and putting them among words of the corpus, and for the unknown
class from at most ``sample`` of the paragraphs and stretches that are scanned, those
of lowest hash (of id, text and place), however long their lines are. Part
of these examples is kept back to calibrate: one temperature for all classes, and for each
family the lowest probability that lets at most ``false_rate`` of the unknown ones
through (never below one half).

A paragraph taken for a family is compared with the family's notices: the share
of the notice's word pairs that the paragraph holds. From ``confirm`` on the prediction is
confirmed; others are reported as they are.

Null and empty texts have no paragraphs. Documents without a notice are not
in ``scan``'s result, a document has a row per family found, and repeated rows
give repeated rows. Null ids are kept, an empty table gives no rows (the classifier
is then trained on the notices alone), and other columns are not read.
Documents are read in place; nothing is shuffled but the training sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import text_chunks, utf8
from .shingles import mix, word_hashes

SPAN, BITS = 48, 16
FACTORS = np.random.default_rng(6).integers(1, 1 << 63, 3, np.uint64) * np.uint64(2) + np.uint64(1)

# Customary short notices of public licences, by family.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at",
               "SPDX-License-Identifier: Apache"],
    "mit": ["Released under the MIT License", "This project is licensed under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files", "SPDX-License-Identifier: MIT"],
    "bsd": ["Released under the BSD License", "Licensed under the BSD 3-Clause License",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", "SPDX-License-Identifier: BSD Clause"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL"],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 3",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: LGPL"],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3",
             "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: AGPL"],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0",
            "This Source Code Form is subject to the terms of the Mozilla Public License", "SPDX-License-Identifier: MPL"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0",
                 "This work is licensed under a Creative Commons Attribution ShareAlike International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0",
                 "This work is licensed under a Creative Commons Attribution NonCommercial International License"],
    "cc0": ["Released under CC0 Public Domain Dedication",
            "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "unlicense": ["This is free and unencumbered software released into the public domain",
                  "Released under the Unlicense"],
    "reserved": ["Copyright. All rights reserved", "No part of this publication may be reproduced or distributed in "
                 "any form without the prior written permission of the publisher"],
}
FAMILIES = sorted(NOTICES)
UNKNOWN = len(FAMILIES)


def _letters() -> np.ndarray:
    """Bytes as they count for words: ASCII other than letters, digits and line breaks is a space, digits too."""
    table = np.arange(256, dtype=np.uint8)
    keep = np.zeros(256, bool)
    keep[128:] = keep[65:91] = keep[97:123] = keep[10] = True
    # CC0's digit belongs to its name.
    keep[48] = True
    table[~keep] = 32
    return table


LETTERS = _letters()


def paragraphs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, then first and last word and text of every paragraph and stretch."""
    breaks = np.flatnonzero(raw == 10) + 1
    edges = np.union1d(offsets, breaks).astype(np.int64)
    words, first = word_hashes(LETTERS[raw], edges)
    text = np.searchsorted(offsets, edges[:-1], side="right") - 1
    start, stop = first[:-1], first[1:]
    some = stop > start
    start, stop, text = start[some], stop[some], text[some]
    extra = np.maximum(0, -(-(stop - start - SPAN) // (SPAN // 2)) + 1) * (stop - start > SPAN)
    line = np.repeat(np.arange(len(start)), extra)
    turn = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
    begin = start[line] + turn * (SPAN // 2)
    return (words, np.concatenate([start, begin]),
            np.concatenate([stop, np.minimum(begin + SPAN, stop[line])]), np.concatenate([text, text[line]]))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (one after it) of each word that ``paragraphs`` counts."""
    inside = ~np.isin(LETTERS[raw], [9, 10, 11, 12, 13, 32])
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def gram_places(words: np.ndarray) -> list[np.ndarray]:
    """Feature number of the 1-, 2- and 3-gram that begins at each word."""
    out, total = [], np.zeros(len(words), np.uint64)
    for n in range(3):
        size = max(0, len(words) - n)
        total = total[:size] + words[n:] * FACTORS[n]
        out.append((mix(total) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return np.unique(mix(words[:-1] * FACTORS[0] + words[1:] * FACTORS[1])) if len(words) > 1 else np.empty(0, np.uint64)


def _words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.replace("\n", " ").encode(), np.uint8)
    return word_hashes(LETTERS[raw], np.array([0, len(raw)], np.int64))[0]


class LicenceModel:
    """Weights, temperature and the families' thresholds."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, limits: np.ndarray | None = None):
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.limits = np.full(UNKNOWN, 0.5) if limits is None else limits
        self.pairs = [[pair_hashes(_words_of(n)) for n in NOTICES[f]] for f in FAMILIES]

    def logits(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Sums of the weights of each paragraph's grams, as differences of running sums."""
        total = np.zeros((len(start), UNKNOWN + 1))
        for n, places in enumerate(gram_places(words)):
            running = np.zeros((len(places) + 1, UNKNOWN + 1))
            np.cumsum(self.weights[places], axis=0, out=running[1:])
            end = np.maximum(start, stop - n)
            has = end > start
            total[has] += running[end[has]] - running[start[has]]
        return total / np.sqrt(np.maximum(1, stop - start))[:, None] + self.bias

    def probabilities(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return softmax(self.logits(words, start, stop) / self.temperature)

    def confirmation(self, words: np.ndarray, family: int) -> float:
        """Largest share of a notice's word pairs that is in the paragraph."""
        held = pair_hashes(words)
        return max(float(np.isin(p, held).mean()) for p in self.pairs[family])


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def examples(unknown: list[str], per_family: int = 150, seed: int = 6) -> tuple[list[str], list[int]]:
    """Training paragraphs: changed notices with their family, and the unknown ones."""
    rng = np.random.default_rng(seed)
    filler = " ".join(unknown[:200]).split() or "the of and in to".split()
    texts, labels = [], []
    for label, family in enumerate(FAMILIES):
        for i in range(per_family):
            words = NOTICES[family][i % len(NOTICES[family])].split()
            if len(words) > 6:
                words = [w for w in words if rng.random() > 0.08]
                words = [filler[rng.integers(len(filler))] if rng.random() < 0.03 else w for w in words]
            around = [filler[j] for j in rng.integers(len(filler), size=rng.integers(0, 12) * (i % 2))]
            cut = rng.integers(len(around) + 1)
            texts.append(" ".join([*around[:cut], *words, *around[cut:]]))
            labels.append(label)
    return texts + unknown, labels + [UNKNOWN] * len(unknown)


def fit(unknown: list[str], false_rate: float = 0.001, epochs: int = 12, speed: float = 0.5, seed: int = 6) -> LicenceModel:
    """Adagrad on the examples, then temperature and thresholds on the quarter kept back."""
    texts, labels = examples(unknown, seed=seed)
    label = np.array(labels)
    hashes = [_words_of(t) for t in texts]
    size = np.array([len(h) for h in hashes])
    words = np.concatenate(hashes)
    start = np.cumsum(size) - size
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 4], order[len(order) // 4:]
    weights, bias = np.zeros((1 << BITS, UNKNOWN + 1)), np.zeros(UNKNOWN + 1)
    seen = np.full(weights.shape, 1e-2)
    places = [np.concatenate([g for g in gram_places(h)]) for h in hashes]
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), 32):
            part = train[i:i + 32]
            at = np.concatenate([places[j] for j in part])
            row = np.repeat(np.arange(len(part)), [len(places[j]) for j in part])
            scale = 1 / np.sqrt(np.maximum(1, size[part]))
            logit = np.zeros((len(part), UNKNOWN + 1))
            np.add.at(logit, row, weights[at] * scale[row][:, None])
            error = softmax(logit + bias)
            error[np.arange(len(part)), label[part]] -= 1
            step = error[row] * scale[row][:, None] / len(part)
            touched, where = np.unique(at, return_inverse=True)
            g = np.zeros((len(touched), UNKNOWN + 1))
            np.add.at(g, where, step)
            seen[touched] += g * g
            weights[touched] -= speed * g / np.sqrt(seen[touched])
            bias -= 0.1 * error.mean(axis=0)
    model = LicenceModel(weights.astype(np.float32), bias)
    logits = model.logits(words, start[held], start[held] + size[held])
    heats = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), label[held]] + 1e-12).mean() for t in heats]
    model.temperature = float(heats[int(np.argmin(loss))])
    other = softmax(logits / model.temperature)[label[held] == UNKNOWN]
    if len(other):
        model.limits = np.maximum(0.5, np.quantile(other[:, :UNKNOWN], 1 - false_rate, axis=0))
    return model


def scanned_sample(docs: DataFrame, sample: int) -> list[str]:
    """The ``sample`` paragraphs and stretches of lowest hash; a task keeps no more than twice as many."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        limit = np.iinfo(np.int64).max
        for batch in batches:
            for part in text_chunks(batch, limit=1 << 20):
                raw, offsets = utf8(part.column("text"))
                words, start, stop, text = paragraphs(raw, offsets)
                first = np.full(part.num_rows, len(words), np.int64)
                np.minimum.at(first, text, start)
                row = part.column("row").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                place = ((start - first[text]) * (1 << 31) + stop - start).astype(np.uint64)
                key = (mix(row[text] + mix(place)) >> np.uint64(1)).astype(np.int64)
                low = np.flatnonzero(key < limit)
                if len(low) > sample:
                    low = low[np.argpartition(key[low], sample - 1)[:sample]]
                begin, end = word_spans(raw, offsets)
                held += [(int(key[i]), raw[begin[start[i]]:end[stop[i] - 1]].tobytes()) for i in low]
                if len(held) > sample:
                    held = sorted(held)[:sample]
                    limit = held[-1][0]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()),
                                          pa.array([t for _, t in held], pa.binary())], names=["key", "raw"])

    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64("doc_id", text).alias("row"), text.alias("text"))
    found = rows.mapInArrow(task, "key long, raw binary").orderBy("key", "raw").limit(sample).select("raw").collect()
    return [bytes(r.raw).decode("utf-8", "replace") for r in found]


def train(docs: DataFrame, sample: int = 4000) -> LicenceModel:
    """A classifier whose unknown class comes from at most ``sample`` paragraphs and stretches of the documents."""
    notices = [set(pair_hashes(_words_of(n)).tolist()) for f in FAMILIES for n in NOTICES[f]]
    unknown = []
    for paragraph in scanned_sample(docs, sample):
        held = set(pair_hashes(_words_of(paragraph)).tolist())
        # What holds a good part of a notice is not an example of the unknown.
        if not any(n and 2 * len(n & held) >= len(n) for n in notices):
            unknown.append(paragraph)
    return fit(unknown)


def scan(docs: DataFrame, model: LicenceModel, confirm: float = 0.6) -> DataFrame:
    """doc_id, family, its number of paragraphs, the surest one's probability, similarity to a notice, confirmed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, limit=1 << 20):
                words, start, stop, text = paragraphs(*utf8(part.column("text")))
                chance = model.probabilities(words, start, stop)
                best = chance[:, :UNKNOWN].argmax(axis=1) if len(chance) else np.empty(0, np.int64)
                sure = chance[np.arange(len(best)), best]
                hits = np.flatnonzero((chance.argmax(axis=1) != UNKNOWN) & (sure >= model.limits[best])) if len(chance) else []
                found: dict[tuple[int, int], list] = {}
                for i in hits:
                    like = model.confirmation(words[start[i]:stop[i]], int(best[i]))
                    row = found.setdefault((int(text[i]), int(best[i])), [0, 0.0, 0.0])
                    row[0] += 1
                    row[1], row[2] = max(row[1], float(sure[i])), max(row[2], like)
                keys = sorted(found)
                values = [found[k] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())),
                     pa.array([FAMILIES[k[1]] for k in keys], pa.string()),
                     pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.float64()),
                     pa.array([v[2] for v in values], pa.float64()),
                     pa.array([v[2] >= confirm for v in values], pa.bool_())],
                    names=["doc_id", "family", "n_paragraphs", "probability", "similarity", "confirmed"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(
        task, "doc_id long, family string, n_paragraphs long, probability double, similarity double, confirmed boolean")
