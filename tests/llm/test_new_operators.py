import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from shopfloor.llm import language, resample, spelling

SCHEMA = "doc_id long, text string, word string, n long, score string, lang string"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def frame(spark, rows, parts=3):
    """Rows (doc_id, text, lang) with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "w", 7, "s", lang) for i, t, lang in rows], SCHEMA).repartition(parts)


# Spelling variants

def brute_spelling(rows):
    count = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    forms, out = {}, []
    for w, n in words.items():
        close = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(close, default=None)
        forms[w] = best[1] if best and -best[0] >= 2 * n else None
        out.append((w, forms[w], n, len(close), words[forms[w]] if forms[w] else None))

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, f, root(w), n, c, m) for w, f, n, c, m in out)


def got_spelling(spark, rows):
    found = spelling.spelling_variants(frame(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, found.collect()))


LONG = "x" * 3000 + "yz"
SPELLING_ROWS = [
    (1, "colour " * 20 + "color " * 9 + "colro colro colro colors colors colors", "en"), (2, "COLOUR Color cólor cólor cólor", "en"),
    (2, "COLOUR Color cólor cólor cólor", "en"), (3, None, "en"), (4, "", "en"), (5, " \t12 34", None), (None, "colour " * 3, "en"),
    (6, "nation ration station stations nations " * 6 + "notion " * 3, "en"), (7, f"{LONG} " * 4 + f"{LONG}a " * 2 + f"a{LONG} " * 8, "en"),
    (8, "ÉÉÉÉÉ ÉÉÉÉé éÉÉÉÉ " * 3 + "aaaaa aaaaaa aaaaaaa " * 4 + "aaaab " * 8, "fr"), (9, "abcde abcdf abcdg " * 5, "en"),
    (10, "ab×cde÷fghij " * 3, "en")]


def test_spelling_edge_rows(spark):
    assert got_spelling(spark, SPELLING_ROWS) == brute_spelling(SPELLING_ROWS)
    assert got_spelling(spark, []) == []


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("abé", min_size=4, max_size=8), st.integers(1, 12)), min_size=1, max_size=80))
def test_spelling_random_words(spark, words):
    rows = [(k, " ".join([w] * n), "en") for k, (w, n) in enumerate(words)]
    assert got_spelling(spark, rows) == brute_spelling(rows)


def test_near_pairs_meet_once(spark):
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abcdefg"), rng.integers(5, 8))) for _ in range(1500)})
    vocab = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = {tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1:]
            if abs(len(a) - len(b)) < 2 and spelling_distance_is_one(a, b)}
    for parts in (2, 5):
        found = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(vocab, parts).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def spelling_distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


# Importance resampling

def brute_resample(rows, target, percent, min_words, ngram, buckets, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets
                            for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]

    docs = [(i, *features(t)) for i, t, _ in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for _, x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, n_words, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), n_words))
    fit = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(fit[:percent * len(fit) // 100])]
    return drawn + [(*r[:4], None) for r in fit[len(drawn):] + [r for r in out if r[4] < min_words]]


def by_text(rows):
    return sorted(rows, key=repr)


TARGET = [(1, "the solar wind drives 7 moons", ), (2, None), (3, ""), (None, "Wind über wind")]
WORDS = "the solar wind drives moons über x1 Ärger stone TREE 東京 river".split()


def resample_rows(n):
    rng = np.random.default_rng(n)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 40))), "en") for i in range(n)]
    return rows + [(n, None, "en"), (n + 1, "", None), (n + 2, "!? \n", "en"), (None, "wind " * 30, "en"), (5, *rows[5][1:]),
                   (n + 3, "東" * 400 + " stone" * 25, "en"), (n + 4, "river\u0000stone " * 30000, "en"), (3, rows[4][1], "en")]


@pytest.mark.parametrize("percent,ngram,buckets", [(10, 1, 10_000), (60, 2, 50), (100, 3, 997)])
def test_resample_matches_brute_force(spark, percent, ngram, buckets):
    rows = resample_rows(300)
    found = resample.resample(frame(spark, rows, 7), spark.createDataFrame(TARGET, "item_id long, text string"),
                              percent, 20, ngram, buckets, 11)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert by_text(map(tuple, found.collect())) == by_text(brute_resample(rows, TARGET, percent, 20, ngram, buckets, 11))


def test_resample_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(frame(spark, []), none).collect() == []
    rows = resample_rows(40)
    assert by_text(map(tuple, resample.resample(frame(spark, rows), none).collect())) == by_text(
        brute_resample(rows, [], 10, 20, 1, 10_000, 2024))


@pytest.mark.parametrize("runs", [5, 90])
def test_ranked_over_many_runs_with_ties(spark, runs, tmp_path, monkeypatch):
    monkeypatch.setattr(resample, "LEAST_SPACING", 2)
    rng = np.random.default_rng(runs)
    rows = [(int(i), int(s)) for i, s in zip(rng.permutation(6000), rng.integers(0, 300, 6000), strict=True)] + [(None, 299)] * 3
    spark.createDataFrame(rows, "doc_id long, score long").repartition(runs).write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        table = spark.read.parquet(str(tmp_path / "rows"))
        found = resample.ranked(table, 2500, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:2500]
    assert [(r.doc_id, r.score) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 2501)) and len(found) == len(rows)


# Language

def test_language_gradients_are_exact(monkeypatch):
    monkeypatch.setattr(language, "STATE", 3)
    net = language.Reader(3)
    raw = np.random.default_rng(1).integers(0, 256, 60).astype(np.uint8)
    data, inside = language.grid(raw, np.array([0, 9, 30, 44]), np.array([9, 4, 9, 1]), 9)
    label = np.array([0, 1, 2, 1])

    def loss():
        p = net.probabilities(net.read(data, inside)).astype(np.float64)
        return -(np.log(p[:, label, np.arange(4)]) * inside).sum() / inside.sum()

    for name, g in net.gradients(data, inside, label).items():
        flat = net.w[name].reshape(-1)
        for k in np.argsort(-np.abs(g.reshape(-1)))[:3]:
            held = flat[k]
            flat[k] = held + 1e-2
            up = loss()
            flat[k] = held - 1e-2
            slope = (up - loss()) / 2e-2
            flat[k] = held
            assert slope == pytest.approx(g.reshape(-1)[k], abs=2e-3)


def plain_pooled(net, raw):
    """Mean probability over positions, one position and one direction after another."""
    total = np.zeros(len(net.w["out"]))
    size = language.STATE
    for at in range(0, len(raw), language.PIECE):
        piece = raw[at:at + language.PIECE]
        states = []
        for d, order in ((0, range(len(piece))), (1, range(len(piece) - 1, -1, -1))):
            h, seen = np.zeros(size), {}
            for i in order:
                x, u = net.w["inputs"][d][:, piece[i]].astype(float), net.w["states"][d].astype(float) @ h
                squash = lambda v: v / (1 + np.abs(v))
                z = (1 + squash(x[:size] + u[:size])) / 2
                r = (1 + squash(x[size:2 * size] + u[size:2 * size])) / 2
                c = squash(x[2 * size:] + r * (u[2 * size:] + net.w["bias"][d][:, 0]))
                h = z * h + (1 - z) * c
                seen[i] = h
            states.append(seen)
        for i in range(len(piece)):
            logit = net.w["out_bias"][:, 0] + sum(net.w["out"][:, d] @ states[d][i] for d in (0, 1))
            e = np.exp(logit - logit.max())
            total += e / e.sum()
    return total / max(1, len(raw))


def test_language_pooling_covers_whole_texts():
    net = language.Reader(4, seed=9)
    texts = [b"", b"a", "Été à la plage".encode(), bytes(range(256)) * 3, b"ab" * 96, b"x" * 97]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = net.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for row, text in zip(got, texts, strict=True):
        assert row == pytest.approx(plain_pooled(net, text), abs=1e-4)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = language.predict(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    for lang in ("de", "en", "es", "fr"):
        own = [r for r in held if r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.98 * len(own)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "fr"), (3, "12 + 3 = ?", "en"), (None, "the moon and the sun", "en"), (4, "le soleil et la lune " * 400, "fr"),
            (5, "the moon", None), (4, "le soleil et la lune " * 400, "fr"), (6, "the sun and the moon " * 30, "en"),
            (7, "東京", "en"), (8, "the sun", "en"), (9, "la lune", "fr"), (10, "la lune et le soleil", "fr"), (11, "the the", "en")]
    docs = frame(spark, rows)
    model = language.train(docs)
    assert model[0] == sorted({lang for i, t, lang in rows if i is not None and lang and zlib.crc32(str(i).encode()) % 3 != 1
                               and re.search(r"[^\W\d_]", t or "")})
    found = [tuple(r) for r in language.predict(docs, model).collect()]
    assert sorted(str(f[0]) for f in found) == sorted(str(r[0]) for r in rows)
    assert all((f[1] == "und") == (f[0] in (1, 2, 3)) and 0 <= f[2] <= 1 for f in found)
    assert all(f[2] == 0 for f in found if f[1] == "und")
    empty = docs.where("false")
    assert language.train(empty) == ([], None)
    assert language.predict(empty, model).collect() == []
    assert {r.lang_pred for r in language.predict(docs, ([], None)).collect()} == {"und"}
    one = language.predict(docs, language.train(docs.where("lang = 'fr'"))).collect()
    assert {(r.lang_pred, r.score) for r in one if r.doc_id not in (1, 2, 3)} == {("fr", 1.0)}
