"""Packing, token counts, token files, quality, decontamination and the pipeline against plain versions."""
import os
import re
import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shopfloor.llm import decontaminate, jaccard_join, packing, quality, queries, token_counts, token_files
from shopfloor.llm.tokens import Encoder, tokenizer_path

SMALL = "/root/testdata/sf0.001"
BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
ENCODER, COUNTER = Encoder(BYTES), token_counts.Counter(WORDS)
ODD = ["", " ", "  two  blanks ", "don't we'll I'D", "tabs\tand\r\nbreaks\n\n\nend\n", "naïve Ärger 3² ×÷ ½", "中文 текст हिन्दी 🙂🙂",
       "<|endoftext|> inside <|x|> <s>", "a" * 3000, "á  x y​", "İstanbul ſ K", "12345 6,789.01 a_b-c"]
SCHEMA = "doc_id long, text string, n_tokens string, start string"
ROWS = [(i, t, "x", None) for i, t in enumerate(ODD)] + [
    (50, None, "x", "y"), (None, "no id", None, "y"), (3, ODD[3], "x", None), (60, "long words here " * 20000, "x", "y")]


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def order(value):
    return (value is not None, value or 0)


texts = st.text(st.one_of(st.sampled_from("ab '<|>sS\n\téİ"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_and_counts_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids(BYTES, text)
    assert COUNTER.count([text]) == [len(ids(WORDS, text))]


def test_counts_of_capitals_whose_lower_case_is_of_another_range():
    capitals = [chr(c) for c in range(0x131, 0x250) if chr(c) != chr(c).lower() and not "\u0131" <= chr(c).lower() <= "\u024f"]
    assert {"\u018f", "\u0181", "\u0190", "\u023a"} <= set(capitals)
    texts = [t for c in capitals for t in (f"{c}WORD,and 12", f"a{c}LI'S,{c}!3", f"{c}, {c.lower()},x don't {c}")]
    # Each by itself, and all with one store of units, met after the library's pieces and before them.
    for order_ in (texts, texts[::-1]):
        assert token_counts.Counter(WORDS).count(order_) == [len(ids(WORDS, t)) for t in order_]
    assert [token_counts.Counter.count(COUNTER, [t])[0] for t in texts] == [len(ids(WORDS, t)) for t in texts]


def test_token_counts(spark):
    got = token_counts.token_counts(spark.createDataFrame(ROWS, SCHEMA), WORDS).collect()
    want = [(d, len((t or "").encode()), n := len(ids(WORDS, t)), n > 2048) for d, t, *_ in ROWS]
    assert sorted(map(tuple, got), key=lambda r: (order(r[0]), r)) == sorted(want, key=lambda r: (order(r[0]), r))
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), WORDS).collect() == []


def check_packed(rows, want, capacity=2048):
    """Every id lies in one piece; sequences are gapless and full or a power of two long."""
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        filled = 0
        for offset, length in sorted(parts):
            assert offset == filled and length > 0
            filled += length
        assert filled == capacity or (filled < capacity and filled & (filled - 1) == 0)
    expected = {}
    for doc_id, numbers in want:
        expected.setdefault((doc_id, len(numbers)), []).append(numbers)
    assert set(pieces) == set(expected)
    for key, found in pieces.items():
        copies, at = len(expected[key]), 0
        assert sum(length for _, length, _ in found) == copies * key[1]
        if copies == 1:
            for start, length, check in sorted(found):
                assert start == at and check == crc(expected[key][0][start:start + length])
                at += length


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3, F.xxhash64("text"))
    want = [(d, [*ids(BYTES, t), 1]) for d, t, *_ in ROWS]
    check_packed(packing.digest(packing.pack(docs, BYTES)).collect(), want)
    check_packed(packing.digest(packing.pack(docs, BYTES, window=2)).collect(), want)
    assert packing.pack(docs.limit(0), BYTES).collect() == []


def test_packing_limits_of_all_three_components(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 90), "some prompt " * (i % 40)) for i in range(300)],
                                 "doc_id long, text string, ask string").coalesce(1)
    rows = packing.pack(docs, BYTES, capacity=256, max_segments=4, max_loss=120, prompt="ask").collect()
    for name, limit in (("length", 256), ("loss_tokens", 120)):
        total = {}
        for r in rows:
            total[r.sequence_id] = total.get(r.sequence_id, 0) + r[name]
        assert max(total.values()) <= limit
    assert max(np.unique([r.sequence_id for r in rows], return_counts=True)[1]) <= 4
    heads = {i: len(ids(BYTES, "some prompt " * (i % 40))) for i in range(300)}
    loss = {}
    for r in rows:
        loss[r.doc_id] = loss.get(r.doc_id, 0) + r.loss_tokens
    assert loss == {i: len(ids(BYTES, "word " * (5 + i % 90))) + 1 for i in heads}


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    folder = tempfile.mkdtemp(prefix="run-tokens-", dir="/tmp")
    token_files.write(docs, folder, BYTES, end_id=2)
    got = sorted(map(tuple, token_files.digest(token_files.read(spark, folder)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in ROWS), key=order)
    before = 0
    want = {d: [*ids(BYTES, t), 2] for d, t, *_ in ROWS}
    for doc_id, start, n, check in got:
        assert (start, n, check) == (before, len(want[doc_id]), crc(want[doc_id]))
        before += n
    few = {r.doc_id: list(np.frombuffer(r.input_ids, "<u4")) for r in token_files.read(spark, folder, [5, 60]).collect()}
    assert few == {5: want[5], 60: want[60]}
    name = next(f for f in sorted(os.listdir(folder)) if f.endswith(".zst"))
    with open(f"{folder}/{name}", "r+b") as file:
        raw = bytearray(file.read())
        # The first frame's checksum is the third number of the seek table's first row.
        table = len(raw) - 9 - 12 * int.from_bytes(raw[-9:-5], "little")
        raw[table + 8] ^= 1
        file.seek(0)
        file.write(raw)
    with pytest.raises(Exception, match="checksum"):
        token_files.read(spark, folder).collect()


def test_token_files_of_an_empty_table(spark):
    folder = tempfile.mkdtemp(prefix="run-tokens-", dir="/tmp")
    token_files.write(spark.createDataFrame([], SCHEMA), folder, BYTES)
    assert token_files.read(spark, folder).collect() == []


def plain_score(net, text):
    """The network over one text, chunk by chunk and place by place."""
    raw, best = (text or "").encode(), []
    starts = range(0, max(1, len(raw) - quality.CHUNK + quality.HOP), quality.HOP)
    for s in starts:
        s = min(s, max(0, len(raw) - quality.CHUNK))
        part = raw[s:s + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        vectors = net.w["bytes"][list(part)]
        answers = [vectors[p:p + 2 * quality.STEP].reshape(-1) @ net.w["filters"]
                   for p in range(0, quality.CHUNK - quality.STEP, quality.STEP)]
        best.append(np.maximum(np.max(answers, axis=0) + net.w["filter_bias"], 0))
    features = np.concatenate([np.max(best, axis=0), np.mean(best, axis=0), np.min(best, axis=0)])
    logit = np.tanh(features @ net.w["hidden"] + net.w["hidden_bias"]) @ net.w["out"] + net.w["out_bias"][0]
    return 1 / (1 + np.exp(-logit))


def test_quality_scores_and_kept_rows(spark):
    net = quality.Network(seed=5)
    rows = [*ROWS, (70, "x" * quality.CHUNK, "x", None), (71, "xy" * quality.CHUNK, "x", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.score) for r in quality.score(docs, net).collect()), key=lambda r: (order(r[0]), r[1]))
    want = sorted(((d, plain_score(net, t)) for d, t, *_ in rows), key=lambda r: (order(r[0]), r[1]))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-5)
    middle = float(np.median([s for _, s in want])) + 1e-4
    kept = quality.keep_good(docs, net, middle)
    assert kept.schema == docs.schema
    good = [r for r in rows if plain_score(net, r[1]) >= middle]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(good, key=str)
    assert quality.score(docs.limit(0), net).collect() == []


def test_quality_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for labels, want in (([], 0.5), ([(i, 1) for i in range(20)], 1.0), ([(None, 1), (1, None), (2, 7)], 0.5)):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert model == want
        assert {r.score for r in quality.score(docs, model).collect()} == {want}


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op2_quality_classifier(spark, folder).where("held_out")
    both = scored.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id")
    rows = both.where("quality IN (0, 1)").select("quality", "predicted").collect()
    assert len(rows) > 200
    assert np.mean([r.quality == r.predicted for r in rows]) >= 0.85


def test_quality_learns_from_long_texts_only(spark):
    good, bad = "the plain words of a good text ", "zq#7 xx@@ 11!! qz~ "
    rows = [(i, (good if i % 2 else bad) * (800 + i), "x", None) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert min(len(r[1]) for r in rows[::2]) > 15000 and len(rows[1][1]) > 16384
    longer = docs.withColumn("text", F.concat("text", "text"))
    model = quality.train(longer, labels)
    assert {r.doc_id: r.score >= 0.5 for r in quality.score(longer, model).collect()} == {i: i % 2 == 1 for i in range(40)}
    # A byte limit below one text still leaves one of each class.
    assert isinstance(quality.train(longer, labels, class_bytes=1), quality.Network)
    with pytest.warns(UserWarning, match="have 1 of them"):
        assert quality.train(longer.where("doc_id % 2 = 1"), labels) in (0.0, 1.0)


def test_quality_auc_and_recall_of_rejected_on_held_out_labels(spark):
    """A constant answer has an AUC of 0.5 and a recall of 0 for one of the labels."""
    folder = "/root/testdata/sf0.1"
    scored = queries.op2_quality_classifier(spark, folder).where("held_out")
    rows = (scored.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id")
            .join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.octet_length("text").alias("size")),
                  "doc_id").where("quality IN (0, 1)").select("quality", "predicted", "score", "size").collect())
    for least in (0, 4096, 16385):
        good, bad = ([r for r in rows if r.quality == q and r.size >= least] for q in (1, 0))
        higher = np.subtract.outer([r.score for r in good], [r.score for r in bad])
        assert ((higher > 0) + (higher == 0) / 2).mean() >= 0.97
        assert np.mean([r.predicted == 0 for r in bad]) >= 0.9
        assert np.mean([r.predicted == 1 for r in good]) >= 0.95


def brute_edits(item, doc):
    """Least word edits between an item and any stretch of a document."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(doc):
            new.append(min(row[j] + (w != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute_contaminated(docs, items, similarity=0.8):
    cut = [(i, decontaminate.words(t)) for i, t in items if i is not None and t]
    found = set()
    for doc_id, text in docs:
        doc = decontaminate.words(text or "")
        seen = set(doc)
        for i, item in cut:
            allowed = decontaminate.allowed_edits(len(item), similarity)
            # Every word of the item that the document lacks costs an edit.
            if item and sum(w not in seen for w in item) <= allowed and brute_edits(item, doc) <= allowed:
                found.add((doc_id, i))
    return found


def edited(rng, item, n):
    item = list(item)
    for k in range(n):
        at = int(rng.integers(0, len(item)))
        kind = k % 3
        item[at:at + (kind != 1)] = [] if kind == 0 else [f"new{k}"]
    return item


def test_decontamination_recall_and_exactness(spark):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 300, int(rng.integers(8, 60))))) for i in range(60)]
    docs = []
    for n in range(300):
        item = items[n % 60][1].split()
        allowed = decontaminate.allowed_edits(len(item), 0.8)
        body = [f"v{x}" for x in rng.integers(0, 300, 80)]
        docs.append((n, " ".join(body + (edited(rng, item, n % (allowed + 2)) if n % 3 else []) + body[::-1])))
    docs += [(900, None), (901, ""), (902, "  ,. "), (903, items[7][1].upper().replace(" ", ",  ")), (904, items[0][1])]
    extra = [(None, "v1 v2"), (70, None), (71, ""), (72, "...")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    want = brute_contaminated(docs, items)
    for block in (20, decontaminate.ITEMS):
        found = decontaminate.contaminated(frame, spark.createDataFrame(items + extra, "item_id long, text string"),
                                           per_block=block).collect()
        got = {(r.doc_id, r.item_id) for r in found}
        assert len(got) == len(found) and got <= want
        print("recall", len(got) / len(want), len(want))
        assert len(got) >= 0.97 * len(want)
    for r in found:
        assert r.edits == brute_edits(decontaminate.words(dict(items)[r.item_id]), decontaminate.words(dict(docs)[r.doc_id]))
    none = spark.createDataFrame(extra, "item_id long, text string")
    assert decontaminate.contaminated(frame, none).collect() == []
    assert decontaminate.keep_clean(frame, none).count() == len(docs)
    clean = decontaminate.keep_clean(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    dirty = {d for d, _ in got}
    assert {(r.doc_id, r.text, r.item_id) for r in clean} == {(d, t, "clash") for d, t in docs if d not in dirty}
    assert len(clean) == len(docs) - len(dirty)


def near_groups(rows):
    sets, root = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        root[i] = i
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[b] < root[a] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a], changed = root[b], True
    return root


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if plain_score(net, r[1]) >= 0.5]
    root = near_groups(rows)
    rows = [r for r in rows if root[r[0]] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = {d for d, _ in brute_contaminated(rows, items)}
    want = [(d, [*ids(BYTES, t), 1]) for d, t in rows if d not in dirty]
    assert want and len(dirty) + len(want) < docs.count()
    check_packed(corpus_pipeline.run(spark, SMALL).collect(), want)


def test_pipeline_stages_on_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "x", 0), (2, "", "en", "x", 0),
                                 (3, "plain words here", None, None, 1)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, table, SMALL)
            if name != "packing":
                assert after.columns == table.columns
                assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in table.collect()}
            elif table is odd:
                assert sorted((r.doc_id, r.doc_tokens) for r in after.collect()) == [(1, 1), (2, 1), (2, 1), (3, 4)]
            else:
                assert after.count() == 0
