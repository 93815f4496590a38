"""Nulls, empty and repeated rows, empty tables and clashing columns, and brute force on the smallest tables."""

import zlib

import pytest
from pyspark.sql import functions as F

from sluice.llm import op1_quality, op2_sentencepiece, op3_lines, op4_simhash, op5_sharding, op6_decontamination, op7_passages, op8_language, op9_pitman_yor, op10_html
from sluice.llm.queries import queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k}" for k in range(300))


def odd(spark, empty=False):
    rows = [(1, LONG, "en", "s", "x"), (1, LONG, "en", "s", "x"), (2, None, None, None, None), (3, "", "de", None, "y"), (None, "one line\nof text", "en", "s", "z"), (4, LONG + "\n" + LONG, "en", "s", None)]
    return spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, ids string").withColumns({"n_lines": F.lit(0), "score": F.lit("s"), "key": F.lit(1)})


OPERATORS = {
    "quality": lambda s, d: op1_quality.quality_rules(d),
    "sentencepiece": lambda s, d: op2_sentencepiece.decode(op2_sentencepiece.encode(d)),
    "sentencepiece_round_trip": lambda s, d: op2_sentencepiece.round_trip(d),
    "lines": lambda s, d: op3_lines.dedup_lines(d),
    "simhash": lambda s, d: op4_simhash.simhash_groups(d),
    "sharding": lambda s, d: op5_sharding.shard_plan(d),
    "decontaminated": lambda s, d: op6_decontamination.decontaminated(d, s.createDataFrame([(1, None), (2, "")], "item_id long, text string")),
    "language": lambda s, d: op8_language.identify(d, op8_language.train(d)),
    "pitman_yor": lambda s, d: op9_pitman_yor.score_texts(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    assert OPERATORS[name](spark, odd(spark)).count() == 6
    assert OPERATORS[name](spark, odd(spark, empty=True)).count() == 0


def test_passages_of_odd_rows(spark):
    assert {(r.source_doc_id, r.doc_id) for r in op7_passages.near_duplicate_passages(odd(spark)).collect()} == {(1, 4)}
    assert op7_passages.near_duplicate_passages(odd(spark, empty=True)).count() == 0


def test_pages_of_odd_rows(spark):
    boiler = "<div>words that every page of this one host repeats again and again</div>"
    rows = [(1, "http://h/a", boiler + "<p>first own</p>", "t"), (2, "http://h/b", boiler + "<p>second own</p>", "t"), (3, None, None, None), (3, "", "", "t")]
    out = op10_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(r.text for r in out.collect()) == ["", "", "first own", "second own"]


def test_simhash_equals_brute_force(spark):
    got = queries()["op4_simhash"](spark, SF).collect()
    fp, up = [int(r.fingerprint, 16) for r in got], list(range(len(got)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(got):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    assert all(r.component_id == least[find(i)] for i, r in enumerate(got))


def test_shards_are_exact(spark):
    got = queries()["op5_sharding"](spark, SF).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16 for r in got)


def test_sentencepiece_parity(spark):
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=op2_sentencepiece.MODEL)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    c = op2_sentencepiece.codec()
    ids = c.encode(texts)
    assert [x.tolist() for x in ids] == known.encode(texts) and [c.decode(x) for x in ids] == texts


def test_languages_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in queries()["op8_language"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)


def test_exact_benchmark_passages_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries()["op6_decontamination"](spark, SF).collect()}
    assert {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text} <= got


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.where("not round_trip").count() == 0 and out.select("doc_id").distinct().count() == out.count() > 100
