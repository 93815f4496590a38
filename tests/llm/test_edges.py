"""Values of odd rows, very long texts, ties, layouts, clashing names and empty tables, operator by operator and through the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import _spark, op1_quality, op2_sentencepiece, op3_lines, op4_simhash, op5_sharding, op6_decontamination, op7_passages, op8_language, op9_pitman_yor, op10_html
from sluice.llm.op6_decontamination import EDIT_RATE, Matcher, normal

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(4000)]


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_values_of_odd_rows(spark):
    a = prose(1)
    df = docs(spark, [(1, a), (1, a), (2, a), (3, None), (4, ""), (None, a), (5, " \n\t")]).withColumns({"_doc": F.lit("d"), "_digest": F.lit(1), "n_lines": F.lit("old")})
    lines = {(r.doc_id, r.text, r.n_removed, r.emptied) for r in op3_lines.dedup_lines(df).collect()}
    assert lines == {(1, a, 0, False), (2, "", 1, True), (3, None, 0, False), (4, "", 0, False), (None, a, 0, False), (5, " \n\t", 0, False)}
    groups = {(r.doc_id, r.component_id) for r in op4_simhash.simhash_groups(df).collect()}
    assert groups == {(1, 1), (2, 1), (3, 3), (4, 3), (None, 1), (5, 3)}
    kept = sorted((r.doc_id is None, r.doc_id) for r in op4_simhash.near_dedup(df).collect())
    assert kept == [(False, 1), (False, 1), (False, 3), (True, None)]
    plan = {(r.doc_id, r["size"], r.text_crc32) for r in op5_sharding.shard_plan(df).collect()}
    assert {(3, 16, 0), (4, 16, 0), (5, 19, __import__("zlib").crc32(b" \n\t"))} <= plan
    scored = {r.doc_id: r for r in op9_pitman_yor.score_texts(df).collect()}
    assert scored[3].n_tokens == scored[4].n_tokens == scored[5].n_tokens == 1 and scored[2].n_tokens == 121
    quality = {r.doc_id: r for r in op1_quality.quality_rules(df.withColumn("lang", F.lit("en"))).collect()}
    assert quality[3].n_words == 0 and quality[3].base_failed and not quality[3].kept and quality[2].n_words == 120 and quality[2].n_dup_lines == 0
    trip = {r.doc_id: (None if r.ids is None else len(r.ids), r.decoded) for r in op2_sentencepiece.round_trip(df).collect()}
    assert trip[3] == (None, None) and trip[4] == (0, "") and trip[5][1] == " \n\t"
    assert op7_passages.near_duplicate_passages(df).collect()[0].source_doc_id == 1


def test_fingerprint_bits_at_exactly_half_are_zero(spark):
    import xxhash

    one, two = "a b c d", "a b c d e"
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ("a b c d", "b c d e")]
    got = {r.doc_id: r.fp & (2**64 - 1) for r in op4_simhash.fingerprints(docs(spark, [(1, one), (2, two)])).collect()}
    assert got == {1: h[0], 2: h[0] & h[1]}  # of two shingles a bit is set in over half only if in both


def test_passages_do_not_depend_on_the_layout(spark):
    shared = [prose(100 + k, 60) for k in range(5)]
    rows = [(k, " ".join([prose(k, 40), shared[k % 5], prose(900 + k, 30), shared[(k * 3) % 5]])) for k in range(60)]
    seen = []
    for n, order in ((1, "doc_id"), (7, "text"), (3, None)):
        df = docs(spark, rows).repartition(n)
        df = df.sortWithinPartitions(F.desc(order)) if order else df
        seen.append(sorted(map(tuple, op7_passages.near_duplicate_passages(df).collect())))
    assert seen[0] == seen[1] == seen[2] and len({r[0] for r in seen[0]}) > 50


def test_hot_passages_are_stars_of_stars(spark, monkeypatch):
    monkeypatch.setattr(op7_passages, "SAMPLE", 1)
    monkeypatch.setattr(op7_passages, "HOT_ROWS", 10)
    shared = prose(7, 80)
    rows = [(k, f"{prose(k, 30)} {shared} {prose(500 + k, 30)}") for k in range(40)]
    df = docs(spark, rows)
    assert len(op7_passages.hot_pairs(df)) > 0
    assert {r.doc_id for r in op7_passages.near_duplicate_passages(df).collect()} == set(range(1, 40))


def test_very_long_texts(spark):
    long = "\n".join(prose(k, 200) for k in range(4200))  # over a chunk of hashes
    assert len(long) > 4 << 20
    df = docs(spark, [(1, long), (2, long), (3, prose(1, 60))])
    assert {(r.doc_id, r.n_removed) for r in op3_lines.dedup_lines(df).collect()} == {(1, 0), (2, 4200), (3, 0)}
    assert len({r.component_id for r in op4_simhash.simhash_groups(df).where("doc_id < 3").collect()}) == 1
    found = [r for r in op7_passages.near_duplicate_passages(df).collect() if r.doc_id == 2]
    assert [(r.start_word, r.end_word) for r in found] == [(0, 840_000)]
    assert {r.n_tokens for r in op9_pitman_yor.score_texts(df).collect()} == {840_001, 61}
    assert op2_sentencepiece.round_trip(df).where("decoded <> text").count() == 0
    page = spark.createDataFrame([(1, "http://h/", f"<article><p>{long}</p></article>")], "page_id long, url string, html string")
    assert op10_html.main_text(page).first().n_chars == len(" ".join(long.split()))


def edits(text, n, rng):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + 1] = rng.choice([[], ["q"], [t[k], "z"]])
    return "".join(t)


def test_decontamination_against_dynamic_programming(spark):
    rng = random.Random(2)
    items = [(k, prose(200 + k, 30)) for k in range(6)] + [(90, None), (91, "")]
    texts = [(k, f"{prose(k, 40)} {edits(items[k % 6][1], k // 6 * 2, rng)} {prose(50 + k, 40)}") for k in range(48)] + [(100, None), (101, ""), (None, items[0][1])]

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    matcher = Matcher([i for i in items])
    for k, t in texts[:48:5]:
        want = {i for i, x in items[:6] if least(normal(x), normal(t)) <= int(EDIT_RATE * len(normal(x)))}
        assert {m[0] for m in matcher.matches(t)} == want, k
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = op6_decontamination.benchmark_matches(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(k, k % 6) for k in range(6)} and (None, 0) in {(r.doc_id, r.item_id) for r in found}
    assert op6_decontamination.benchmark_matches(docs(spark, []), bench).count() == 0
    assert op6_decontamination.benchmark_matches(docs(spark, texts), bench.limit(0)).count() == 0
    assert op6_decontamination.decontaminated(docs(spark, texts), bench.limit(0)).count() == len(texts)


def test_intermediate_tables_need_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        _spark.shared_dir(Session())


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    some = base.orderBy("doc_id").limit(40)
    more = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34", "en", "s", 5), (None, base.where("doc_id = 1").first().text, "en", "s", 9)], base.schema)
    copy = base.where("doc_id = 1").withColumn("doc_id", F.lit(5).cast("long"))
    for name, df in (("odd", some.unionByName(more).unionByName(base.where("doc_id = 1")).unionByName(copy)), ("empty", base.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "tokenize"]
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    got = out.collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got) and out.columns[: len(base.columns)] == base.columns
    ids = [r.doc_id for r in got]
    assert not {10**6, 10**6 + 1, 10**6 + 2} & set(ids) and None in ids
    empty = corpus_pipeline.run(spark, str(tmp_path / "empty"))
    assert empty.count() == 0 and empty.columns == out.columns
