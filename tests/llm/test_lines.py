"""Line dedup against brute force over all earlier documents, and the hashes of texts longer than a chunk."""

import numpy as np
import pyarrow as pa

from sluice.llm import _text, op3_lines
from sluice.llm.op3_lines import MIN_WEIGHT, aligned_places, line_hashes, run_hashes

SF = "/root/testdata/sf0.001"


def sequence(text):
    data, offsets = _text.buffer_of(pa.array([text], pa.string()))
    h, weight, _ = line_hashes(data, offsets)
    at = np.flatnonzero(h)
    return h[at].tolist(), weight[at].tolist(), at.tolist()


def common(a, b, weight):
    """Places of b in maximal equal runs of a and b that have the weight."""
    held, out = {}, set()
    for i, x in enumerate(a):
        held.setdefault(x, []).append(i)
    for j, x in enumerate(b):
        for i in held.get(x, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(weight[j : j + n]) >= MIN_WEIGHT:
                out |= set(range(j, j + n))
    return out


def expected(texts):
    """Kept text of each (doc_id, text), all earlier documents compared."""
    seqs = {d: sequence(t) for d, t in texts.items()}
    out = {}
    for d, t in texts.items():
        h, weight, at = seqs[d]
        gone = set()
        for e in texts:
            if e < d:
                gone |= set(range(len(h))) if seqs[e][0] == h else common(seqs[e][0], h, weight)
        drop = {at[k] for k in gone}
        out[d] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
    return out


def kept(spark, texts):
    return {r.doc_id: r.text for r in op3_lines.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def test_all_lines_that_any_earlier_document_holds_go(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}
    assert kept(spark, texts) == expected(texts)


def test_moved_blocks_short_lines_and_other_holders(spark):
    p, q, r = "one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen fifteen sixteen"
    texts = {
        1: f"{p}\n{q}\nfirst",
        2: f"{q}\n{p}\nsecond",  # moved: both go
        3: f"roses are red\nviolets blue\n{r}",
        4: f"fourth own line of words\nroses are red\n\nviolets blue",  # short lines, together heavy enough
        5: f"roses are red\nfifth own line of words\n{r}\n{p}",
        6: "这是一个没有空格的很长的句子它应该被当作一整行来比较因为它有很多字\nx",
        7: "y\n这是一个没有空格的很长的句子它应该被当作一整行来比较因为它有很多字",
        8: f"{p}\n{q}\nfirst",
        9: "",
    }
    got = kept(spark, texts)
    assert got == expected(texts)
    assert got[2] == "second" and got[4] == "fourth own line of words\n" and got[5] == "roses are red\nfifth own line of words" and got[7] == "y" and got[8] == ""


def test_two_documents_fare_alike_in_a_larger_corpus(spark):
    block = "\n".join(["short", "a line of more than five words", "end"])
    two = {1: f"{block}\none", 2: f"two\n{block}"}
    more = two | {k: f"{block}\nown {k}" for k in range(3, 120)}
    got = kept(spark, more)
    assert {k: got[k] for k in two} == kept(spark, two) == {1: two[1], 2: "two"}
    assert all(got[k] == f"own {k}" for k in range(3, 120))


def test_run_hashes_tell_runs():
    h, w = np.array([3, 0, 5, 7], np.int64), np.array([2, 0, 3, 9], np.int32)
    assert len(run_hashes(h, w)) == 3  # 3-5, 5-7 and 7
    assert set(run_hashes(np.array([9, 3, 5], np.int64), np.array([9, 2, 3], np.int32))) & set(run_hashes(h, w))
    assert aligned_places(h, np.array([7, 3, 5]), np.array([9, 2, 3])) == [0, 1, 2]


def test_spans_over_chunks_hash_alike():
    rng = np.random.default_rng(1)
    size = 2 * _text.CHUNK_BYTES + 500_000
    data = rng.integers(0, 256, size).astype(np.uint8)
    starts = np.array([0, 10, _text.CHUNK_BYTES - 5, _text.CHUNK_BYTES + 40_000, 2 * _text.CHUNK_BYTES + 100_000])
    ends = np.array([5, 4000, _text.CHUNK_BYTES + 39_000, 2 * _text.CHUNK_BYTES + 90_000, size])
    got = _text.span_hashes(data, starts, ends)
    for s, e, h in zip(starts, ends, got, strict=True):
        if e - s < _text.CHUNK_BYTES:
            assert _text.span_hashes(data[s:e].copy(), np.array([0]), np.array([e - s]))[0] == h
    assert _text.span_hashes(data[starts[3] :].copy(), np.array([0]), np.array([ends[3] - starts[3]]))[0] == got[3]
