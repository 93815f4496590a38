"""Results of the queries against what their contracts say, worked out row by row."""

import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import op4_simhash, op5_sharding, op8_language, op10_html
from sluice.llm.op10_html import blocks_of, declared
from sluice.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_fingerprints_are_those_of_xxhash(spark, texts):
    def plain(text):
        w = words(text)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))

    got = {r.doc_id: r.fingerprint for r in queries()["op4_simhash"](spark, SF).collect()}
    assert got == {d: f"{plain(t):016x}" for d, t in texts.items()}
    two = spark.createDataFrame([(1, "a b c d e"), (2, "é É"), (3, None), (4, " \n")], "doc_id long, text string")
    assert {r.doc_id: f"{r.fp & (2**64 - 1):016x}" for r in op4_simhash.fingerprints(two).collect()} == {d: f"{plain(t):016x}" for d, t in ((1, "a b c d e"), (2, "é É"), (3, None), (4, " \n"))}


def test_base_score_and_counts_of_the_language_model(spark, texts):
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    got = queries()["op9_pitman_yor"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-5)
        assert r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_inline_adverts_and_undeclared_articles(spark):
    leak = '<article><p>good <span class="ad">buy <span>now</span> cheap</span> text</p></article>'
    assert declared(blocks_of(leak)) == ["good text"]
    menu = '<ul class="topmenu"><li>this menu has the eight words that repeat on every page</li></ul>'
    pages = [(k, "http://h.example/x", f"<!-- <article> -->{menu}<p>alpha{k} beta{k}</p>", k) for k in (1, 2)]
    pages += [(3, "http://h.example/y", leak, 3), (4, "http://h.example/y", leak, 4), (None, None, "<p>no id</p>", None), (5, "http://h.example/z", "<article></article><p>open</p>", 5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, _page long").withColumn("_places", F.lit("clash"))
    got = {(r.page_id, r.text, r.n_chars, r._page, r._places) for r in op10_html.main_text(df).collect()}
    assert got == {(1, "alpha1 beta1", 12, 1, "clash"), (2, "alpha2 beta2", 12, 2, "clash"), (3, "good text", 9, 3, "clash"), (4, "good text", 9, 4, "clash"), (None, "no id", 5, None, "clash"), (5, "open", 4, 5, "clash")}
    assert op10_html.main_text(df.limit(0)).count() == 0


def test_repeated_substrings_equal_brute_force(spark):
    rows = [(k, f"http://{'ab'[k % 2]}.example/", "<p>" + " ".join(f"w{(k // 2 * 7 + j * j) % 23}" for j in range(60)) + "</p>") for k in range(12)]
    rows += [(20, "http://a.example/", rows[0][2] + "<p>tail</p>"), (21, "http://a.example/", None)]
    got = {r.page_id: r.text for r in op10_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    tokens = {k: [t for _, x in blocks_of(h) for t in x.split(" ")] for k, _, h in rows}
    host = {k: u for k, u, _ in rows}
    for k, own in tokens.items():
        others = {tuple(t[i : i + 8]) for j, t in tokens.items() if j != k and host[j] == host[k] for i in range(len(t) - 7)}
        gone = {p for i in range(len(own) - 7) if tuple(own[i : i + 8]) in others for p in range(i, i + 8)}
        assert got[k].replace("\n\n", " ") == " ".join(t for p, t in enumerate(own) if p not in gone)


def test_pages_with_declared_articles_are_in_the_streams_of_their_host(spark):
    notice, news = ("<div>one line of eight words that this host repeats</div>", "<p>the news of the day in ten words or so here</p>")
    rows = [(1, "http://h/a", f"{notice}<article>{news}</article>"), (2, "http://h/b", f"{notice}<p>own text</p>"), (3, "http://h/c", f"<div>{news}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = "the news of the day in ten words or so here"
    assert {r.page_id: r.text for r in op10_html.main_text(pages).collect()} == {1: plain, 2: "own text", 3: plain}
    assert {r["_page"] for r in op10_html.covered_places(pages).collect()} == {1, 2, 3}


@pytest.mark.parametrize("most", [0, 2000, 1 << 30])
def test_hosts_in_one_task_and_in_many_give_the_same_text(spark, monkeypatch, most):
    monkeypatch.setattr(op10_html, "HOST_BYTES", most)
    monkeypatch.setattr(op10_html, "CHUNK_BYTES", 100)
    line = "one line of eight words that this host repeats"
    rows = [(k, f"http://h{k % 3 if k < 20 else 3}/", f"<p>{line} w{k}</p><article>a{k}</article>" if k % 5 == 0 else f"<p>{line} w{k}</p>") for k in range(60)]
    rows += [(60, "http://alone/", f"<p>{line}</p>"), (61, "http://twin/", f"<p>{line} x</p>"), (61, "http://twin/", f"<p>{line} y</p>"), (None, "http://h0/", f"<p>{line}</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = sorted(((r.page_id or 0) if r.page_id is not None else -1, r.text) for r in op10_html.main_text(df).collect())
    want = [(k, f"a{k}" if k % 5 == 0 else f"w{k}") for k in range(60)] + [(60, line), (61, f"{line} x"), (61, f"{line} y"), (-1, line)]
    assert got == sorted(want)
    if most > 2000:  # only the pages are dealt, not their suffixes
        plan = op10_html.main_text(df)._jdf.queryExecution().executedPlan().toString()
        assert "_keys" not in plan and "counts" not in plan


def test_repeated_substrings_come_back_by_bucket(spark):
    text = "<p>one line of eight words that this host repeats and as many words again after it</p>"
    pages = spark.createDataFrame([(k, "http://h/", text) for k in range(50)], "page_id long, url string, html string")
    back = op10_html.covered_places(pages).collect()
    assert sorted(r["_page"] for r in back) == list(range(50))


def test_shards_hold_every_row_once(spark, tmp_path):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (None, None, None), (7, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string").withColumn("shard", F.lit("old"))
    op5_sharding.write_shards(df, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((repr((r.doc_id, r.text, r["size"])) for r in back.collect())) == sorted(map(repr, rows))
    assert sorted((r.shard, r.slot) for r in back.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_languages_beyond_those_learnt(spark):
    assert op8_language.presence([chr(0x30000), "1 2"])[1].tolist() == [True, False]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = " ".join(f"{chr(0x430 + k % 32)}{chr(0x430 + k * 7 % 32)}{chr(0x430 + k * k % 32)}{chr(0x430 + k * 5 % 31)}" for k in range(600))
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**9, odd, None), (10**9 + 1, "12 34", None)], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in op8_language.accepted(more.withColumns({"score": F.lit("x"), "_known": F.lit(1)})).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_ties_of_languages_go_to_the_first_name(spark):
    model = op8_language.Model(["aa", "bb"], op8_language.np.ones((1 << op8_language.BITS, 2), op8_language.np.float32), -1.0)
    langs, scores, known = op8_language.predict(["same for both", "", "12"], model)
    assert langs == ["aa", "und", "und"] and scores.tolist() == [0.5, 0.0, 0.0] and known.tolist() == [True, False, False]
