"""Recall of the decontamination search by length and kind of edit, and items of odd kinds."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from shopfloor.llm import decontaminate


def changed(rng, item, n, mixed):
    item = list(item)
    if not mixed:
        for at in rng.choice(len(item), n, replace=False):
            item[at] = f"new{rng.integers(10 ** 6)}"
        return item
    for _ in range(n):
        at, kind = int(rng.integers(len(item))), rng.integers(3)
        item[at:at + (kind != 1)] = [] if kind == 0 and len(item) > 1 else [f"v{rng.integers(0, 3000)}"]
    return item


def search(items, docs, similarity=0.8):
    walks = decontaminate._walks(tuple(items), similarity)
    return decontaminate.Items(items, similarity, dict(walks)).search(docs)


@pytest.mark.parametrize("mixed", [False, True])
@pytest.mark.parametrize("length", [5, 8, 15, 30, 59, 64, 65, 150, 300, 500])
def test_recall_by_length(length, mixed):
    rng = np.random.default_rng([length, mixed])
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 3000, length))) for i in range(60)]
    edits = decontaminate.allowed_edits(length, 0.8)
    around = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 50)) for _ in items]
    docs = [f"{a} {' '.join(changed(rng, t.split(), edits, mixed))} {a}" for a, (_, t) in zip(around, items, strict=True)]
    found = search(items, docs)
    assert sum((i, i) in found for i in range(60)) >= 0.95 * 60
    assert all(e <= edits for e, _ in found.values())


def test_unspaced_scripts_and_short_items(spark):
    items = spark.createDataFrame([(1, "昨天晚上城里的居民聚集在广场上"), (2, "yes"), (3, "no way at all"),
                                   (4, "the quick brown fox jumps")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "他们说昨天晚上城里的居民聚集在广场上，一起迎接第一场雪。"), (2, "yes yes, no way at all"),
                                  (3, "See The quick, brown fox JUMPS over"), (3, "See The quick, brown fox JUMPS over"),
                                  (None, "the quick brown fox jumps")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(0, 4), (1, 1), (3, 4), (3, 4)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, least=1).collect()}
    assert got >= {(2, 2), (2, 3)}
    kept = decontaminate.keep_clean(docs.withColumn("item_id", F.lit("x")), items).collect()
    assert [(r.doc_id, r.item_id) for r in kept] == [(2, "x")]


def test_items_of_more_distinct_words_than_a_key_had_bits():
    n = 1500
    items = [(i, " ".join(f"u{i}x{j}" for j in range(n))) for i in range(1500)]
    found = search(items[:1500], ["a b c " + items[7][1] + " d", items[1499][1][: len(items[1499][1]) // 2]])
    assert set(found) == {(0, 7)} and found[0, 7] == (0, 3)


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, " ".join(f"b{i}w{j}" for j in range(20))) for i in range(200)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 12_000)
    blocks = list(decontaminate._blocks(items, decontaminate.ITEMS))
    assert len(blocks) > 2 and sorted(r for b in blocks for r in b) == sorted(rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(i, i) for i in range(200)}
