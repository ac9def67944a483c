import re

import duckdb
import numpy as np

from shopfloor.llm import grid_join, html_blocks, licenses, preferences, queries

SMALL = "/root/testdata/sf0.001"


def test_pages_edge_cases(spark):
    rows = [(1, None, None, "x"), (2, "u", "", None), (None, "u", "<article><p>A&amp;B<br> c</article>", "x"),
            (3, "u", "<script>var a", "x"), (3, "u", "<!-- open <p>hidden", "x"),
            (4, "u", "<div>" * 5000 + "the cat is on the mat and it was there with us", "x"),
            (5, "u", "<nav><a href=a>Home</a></nav><article><h1>T</h1><p>Hi<div class='ad'>Buy</div><p>Yo</article>"
                     "<footer>end</footer>", "x")]
    got = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    texts = [(r.page_id, r.text, r.n_chars) for r in got.collect()]
    assert texts == [(1, "", 0), (2, "", 0), (None, "A&B c", 5), (3, "", 0), (3, "", 0),
                     (4, "the cat is on the mat and it was there with us", 46), (5, "T\nHi\nYo", 7)]


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 12))
    rows = [(i, (base[i % 60] * (1 + i) + rng.normal(size=12) * 0.1 * (1 + i)).tolist(), 1) for i in range(200)]
    odd = [(900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] * 12, 1), (903, [1.0, None] * 6, 1), (904, [], 1),
           (905, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows + odd + [rows[0]], "vec_id long, embedding array<double>, label int")
    for size in (8192, 32):
        grid_join.ROWS, old = size, grid_join.ROWS
        try:
            got = sorted(map(tuple, grid_join.similarity_classes(frame).collect()))
        finally:
            grid_join.ROWS = old
        ids = [r[0] for r in rows + [rows[0]]]
        v = np.array([r[1] for r in rows + [rows[0]]])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        hit = v @ v.T >= 0.9
        label = np.array(ids)
        for _ in ids:
            label = np.minimum(label, np.where(hit, label[None, :], 10 ** 9).min(axis=1))
        want = [(i, int(h.sum()) - 1, int(c), i == c) for i, h, c in zip(ids, hit, label, strict=True)]
        assert got == sorted(want + [(r[0], 0, r[0], True) for r in odd])
    assert grid_join.similarity_classes(frame.limit(0)).collect() == []


def test_preferences_match_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
        want = sorted(db.sql(preferences.ECHO_SQL).fetchall())
    assert sorted(map(tuple, queries.op3_preference_pairs(spark, SMALL).collect())) == want


def test_preferences_edge_cases(spark):
    schema = "pair_id long, turn long, role string, text string, prompt string"
    chosen = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"), (2, 0, None, None, "x"),
                                    (None, 0, "user", "a", "x")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 1, "assistant", "cc", "x"), (3, 0, "user", "q", "x")],
                                     schema)
    got = {r.pair_id: r for r in preferences.format_pairs(chosen, rejected).collect()}
    assert sorted(got) == [1, 2, 3]
    r = got[1]
    assert r.prompt_turns == 1 and r.prompt == "<|im_start|>user\na<|im_end|>\n"
    for text, mask, part in ((r.chosen, r.chosen_mask, "b"), (r.rejected, r.rejected_mask, "cc")):
        assert [text[m.start:m.start + m.length] for m in mask] == [part + "<|im_end|>"]
    assert (got[2].prompt, got[2].rejected, got[3].chosen) == ("", "", "")


def test_licences_found_and_clean_texts_left_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = licenses.train(docs)
    planted = [(1, "Released under the MIT License.", "x"), (2, None, "x"), (3, "", "x"),
               (4, "word " * 30000 + "Licensed under the Apache License, Version 2.0", "x"), (None, "nothing here", "x")]
    got = licenses.scan(spark.createDataFrame(planted, "doc_id long, text string, family string"), model).collect()
    assert {(r.doc_id, r.family) for r in got if r.confirmed} == {(1, "mit"), (4, "apache")}
    assert licenses.scan(docs.limit(0), model).collect() == []
    found = {r.doc_id for r in licenses.scan(docs, model).where("confirmed AND family = 'mit'").collect()}
    assert found >= {r.doc_id for r in docs.collect() if re.search("under the MIT License", r.text or "")}


def test_pages_without_article_in_other_languages_and_of_short_blocks():
    page = "<nav><a href=a>Home</a> <a href=b>News</a></nav>{}<footer>About this site and all of the people in it</footer>"
    russian = ("Вчера вечером жители города собрались на главной площади, чтобы вместе встретить первый снег и "
               "послушать музыку.")
    bodies = [
        ["Первый снег", russian, "Конец", russian], ["Titolo", "Ieri sera molti cittadini hanno visto cadere neve fresca "
         "sopra tetti, strade, giardini, ponti antichi, barche."], ["初雪", "昨天晚上，城里的居民聚集在广场上，一起迎接第一场雪。"],
        ["Roses", "Roses bloom red", "Violets glow", "Honey"], ["milk and eggs", "bread", "tea"], ["x = f(y)", "return x + z"]]
    for body in bodies:
        inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{t}</p>" for t in body[1:])
        for whole in (f"<div>{inner}</div>", f"<section>{inner}</section>", inner,
                      f"<div><a href=c>Start page</a></div><div>{inner}</div><div>© 2024 us</div>"):
            assert html_blocks.main_text(page.format(whole)) == "\n".join(body)
    english = "It was the first snow of the year and all of us went out to see it."
    assert html_blocks.main_text(page.format(f"<section><h2>Snow</h2><p>Brief.</p></section><section><p>{english}</p>"
                                             "</section>")) == f"Snow\nBrief.\n{english}"
    assert html_blocks.main_text(page.format("")) == ""


def test_pages_whose_names_only_hold_a_bad_part_and_pages_in_a_form():
    text = "It was the first snow of the year and all of us went out to see it."
    more = "We were on the hill for an hour and then it was time to go to the village."
    body = f"<h1>Snow</h1><p>{text}</p><p>{more}</p>"
    want = f"Snow\n{text}\n{more}"
    page = "<nav><a href=a>Home</a></nav>{}<footer>About us and all of the people who are in this</footer>"
    for start in ("<div class='content has-sidebar'>", "<div class='layout with-navbar'>", "<section id='related-work'>",
                  "<section id=copyright-notice>", "<div data-id='nav' data-class=\"footer\">", "<form action='/a'>",
                  "<div title='class=ad'>", "<form class=page><div class='widget'>", "<div class='page sidebar'>"):
        for whole in (page, page.format("<article><p>One of the parts is in here and it is on top.</p>{}</article>")):
            got = html_blocks.main_text(whole.format(start + body + "</div>" * ("<div class='w" in start)))
            if whole is page or "form" not in start and "page" not in start:
                assert got.endswith(want), start
    long = " ".join([text] * 4)
    for start in ("<section id='sharing'>", "<form>"):
        assert html_blocks.main_text(f"<article><p>{more}</p>{start}<p>{long}</p></article>") == f"{more}\n{long}"
    assert html_blocks.main_text(f"<article><h2 id='comments-on-method'>On it</h2><p>{text}</p><h2 id='notice'>N</h2>"
                                 f"</article>") == f"On it\n{text}\nN"
    assert html_blocks.main_text("<form><h1>Roses bloom red</h1><p>Violets glow at night</p><p>Honey so very sweet</p></form>"
                                 ) == "Roses bloom red\nViolets glow at night\nHoney so very sweet"
    for part in ("<div class='site-footer'>", "<div id='cookie-banner'>", "<div class='comments-area'>", "<div role=alert>",
                 "<div class='sidebar left'>", "<form>", "<div class=ad>", "<nav>"):
        for whole in ("<div>{}</div>", "<article>{}</article>"):
            inner = f"{body}<p>{more}</p>{part}This is all of the text that we have in here for you.</div></form></nav>"
            assert html_blocks.main_text(whole.format(inner)) == f"{want}\n{more}", part


def test_vectors_of_two_lengths(spark):
    rows = [(i, [1.0, 0.1 * (i % 2), 0.0], 1) for i in range(6)] + [(10 + i, [0.0, 1.0 + i, 0.0, 0.1], 1) for i in range(4)]
    rows += [(20, [1.0, 0.0, 0.0, 0.0], 1), (30, [1.0], 1), (31, None, 1), (32, [0.0, 0.0], 1)]
    got = grid_join.similarity_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = [(i, 5, 0, i == 0) for i in range(6)] + [(10 + i, 3, 10, i == 0) for i in range(4)]
    assert sorted(map(tuple, got.collect())) == want + [(i, 0, i, True) for i in (20, 30, 31, 32)]


def test_licence_sample_of_one_line_texts(spark):
    text = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}" for i in range(3000))
    docs = spark.createDataFrame([(i, f"{i} {text} end", "x") for i in range(40)] + [(None, None, "x"), (90, "", "x")],
                                 "doc_id long, text string, family string")
    found = licenses.scanned_sample(docs, 500)
    assert len(found) == 500 and found == licenses.scanned_sample(docs.repartition(7), 500)
    raw = np.frombuffer(text.encode(), np.uint8)
    words, start, stop, _ = licenses.paragraphs(raw, np.array([0, len(raw)]))
    assert {len(f.split()) for f in found} <= {int(n) for n in stop - start} | {len(text.split()) + 1} | set(range(1, 49))
    assert all(" ".join(f.split()) in f"{text} end" for f in found)
    model = licenses.train(docs)
    assert licenses.scan(docs, model).collect() == []
    assert (model.probabilities(words, start, stop).argmax(axis=1) == licenses.UNKNOWN).all()
