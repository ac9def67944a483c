import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from shopfloor.llm import jaccard_join
from shopfloor.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, comp string"


def brute(rows, k, percent):
    sets = {}
    for i, text, *_ in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
            sets[i] = frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= percent * len(x | y) and root[b] < root[a]:
                    root[a], changed = root[b], True
    return sorted((r[0], len(sets[r[0]]), root[r[0]]) for r in rows if r[0] is not None)


def got(spark, rows, k, percent):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, jaccard_join.jaccard_components(docs, k, percent).collect()))


BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [(5, BASE, "en", "x"), (3, BASE.upper(), "en", None), (9, BASE + " tail", None, "y"), (1, None, None, None),
        (2, "", "en", "x"), (4, "  \t\n ", "en", "x"), (7, "one two", "en", "x"), (8, "One  two", "en", "x"),
        (10, "two one", "en", "x"), (11, " ".join(f"z{i % 7}" for i in range(30000)), "en", "x"),
        (12, BASE.replace("w30", "other"), "en", "x"), (None, BASE, "en", "x"), (6, "Ärger one two three", "en", "x"),
        (13, "ärger one two three", "en", "x"), (5, BASE, "en", "x")]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_edge_rows_match_brute_force(spark, k, percent):
    assert got(spark, ROWS, k, percent) == brute(ROWS, k, percent)


def test_empty_table(spark):
    assert got(spark, [], 3, 90) == []


def test_chain_and_hot_shingles(spark):
    words = [f"h{i}" for i in range(40)]
    rows = [(i, " ".join(words[:40 - i % 3] + [f"u{i}"] * (i % 4 == 0)), "en", "x") for i in range(40)]
    rows += [(100 + i, "very common line here " + " ".join(f"q{i}x{j}" for j in range(30)), "en", "x") for i in range(30)]
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), min_size=1, max_size=14))
def test_random_small_vocabulary(spark, texts):
    rows = [(i, " ".join(t), "en", "x") for i, t in enumerate(texts)]
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_keep_one_keeps_the_smallest_of_each_group(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    smallest = {r[2] for r in brute(ROWS, 5, 80)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(smallest)


MIXED = [(5, BASE, "en", "x"), (5, "other text under the same id", "en", "x"), (3, BASE + " tail", "en", "x"),
         (7, "other text under the same id", "en", "y"), (None, "a text of its own without an id", "en", "x"),
         (None, "A text of its own  without an id", "en", "x"), (None, BASE, "en", "x"), (None, "", "en", "x"),
         (None, None, "en", "x"), (8, "first text of eight here", "en", "x"), (8, "second text of eight is not it", "en", "x"),
         (0, "zero has an id", "en", "x"), (None, "zero has no id", "en", "x"), (9, "", "en", "x"), (9, "", "en", "x"),
         (2, BASE.replace("w3 ", "v3 "), "en", "x"), (2, "unlike the first of two", "en", "x")]


@pytest.mark.parametrize("percent", [80, 95])
def test_rows_that_share_an_id_or_have_none(spark, percent):
    named = [(n, text) for n, (_, text, *_) in enumerate(MIXED)]
    comp = {n: c for n, _, c in brute(named, 5, percent)}
    size = {n: s for n, s, _ in brute(named, 5, percent)}
    groups = {}
    for n, c in comp.items():
        groups.setdefault(c, []).append(n)
    name = {c: min((MIXED[n][0] for n in g if MIXED[n][0] is not None), default=None) for c, g in groups.items()}
    want = sorted((MIXED[n][0], size[n], name[c]) for n, c in comp.items() if MIXED[n][0] is not None)
    assert got(spark, MIXED, 5, percent) == want
    kept = [tuple(r)[:2] for r in jaccard_join.keep_one(spark.createDataFrame(MIXED, SCHEMA), 5, percent).collect()]
    assert len(kept) == len(groups)
    for g in groups.values():
        first = min((MIXED[n][0] is None, MIXED[n][0] or 0) for n in g)
        assert any(MIXED[n][:2] in kept and first == (MIXED[n][0] is None, MIXED[n][0] or 0) for n in g)


def test_keep_one_leaves_clashing_columns_alone(spark):
    schema = "row_id string, doc_id long, text string, row_hash string, cls int, row string"
    rows = [("mine-1", 1, BASE, "h1", 5, "r"), ("mine-2", 2, BASE, "h2", 6, "s"), ("mine-3", 3, None, "h3", 7, None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, schema), 5, 80)
    assert kept.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_coded_counts_keep_order_and_size():
    counts = np.array([0, 1, 15, 16, 17, 18, 100, 1000, 10 ** 6, 2 ** 33])
    codes = jaccard_join._coded(counts)
    value = jaccard_join._VALUE[codes]
    assert (np.diff(jaccard_join._VALUE) > 0).all() and (value <= counts).all() and (value >= counts * 0.88).all()


def test_frequencies_are_those_of_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FAN_IN", 3)  # eleven tasks, so three rounds of adding up
    texts = [f"a b c d e{i % 5} f g h{i % 7}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(11)
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    want = np.zeros(1 << jaccard_join.CELL_BITS, np.int64)
    for s in shingle_sets(np.frombuffer(raw, np.uint8), offsets, 3):
        np.add.at(want, jaccard_join._cells(s), 1)
    got = jaccard_join._VALUE[jaccard_join._frequencies(docs, 3)]
    assert ((got == 0) == (want == 0)).all() and (got <= want).all() and (got >= 0.6 * want).all()


def test_copies_that_do_not_link_are_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join.uuid, "uuid4", lambda: type("Id", (), {"hex": "copies-apart"}))
    rng = np.random.default_rng(4)
    rows = []
    for i in range(80):
        words = [f"c{j}" for j in range(150)]
        for j in rng.choice(np.arange(5, 145, 5), 4, replace=False):
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words), "en", "x"))
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90) == [(i, 148, i) for i in range(80)]
    folder = f"{jaccard_join.shared_dir(spark)}/jaccard-join-copies-apart"
    # Each copy has a pivot it does not link to, which is all that is left of the 3,160 pairs.
    assert spark.read.parquet(f"{folder}/pairs-{jaccard_join.ROUNDS}").count() < 160


def test_sketches_differ_by_no_more_bits_than_the_sets_do():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in rng.integers(1, 400, 3)]
        x, y = np.concatenate(sets[:2]), np.concatenate(sets[1:])
        bits = sum(int(b).bit_count() for b in (jaccard_join._sketch(x) ^ jaccard_join._sketch(y)).view(np.uint64))
        assert bits <= len(sets[0]) + len(sets[2])
    assert not (jaccard_join._sketch(x) ^ jaccard_join._sketch(x[::-1])).any()


def test_texts_stay_where_they_are_when_pairs_are_verified(spark, tmp_path):
    texts = spark.createDataFrame([(i, BASE + f" t{i // 2}") for i in range(20)], "cls long, text string")
    store = jaccard_join.Storage(spark, str(tmp_path))
    kept = store.write_bucketed(texts.repartition(8, "cls"), "cls", 8, "texts", partitioned=True)
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(10)], "a long, b long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jaccard_join._verified(pairs, kept, 3, 90)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == [(2 * i, 2 * i + 1) for i in range(10)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # The pairs move to each side's texts, with the first side's text the second time.
    assert plan.count("Exchange") == 2 and plan.count("Bucketed: true") == 2
