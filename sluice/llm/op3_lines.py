"""Line dedup by pairwise alignment.

Documents whose lines are all the same are one class: the first keeps its lines, the others lose theirs. Among the firsts,
runs of lines that together have ``MIN_WEIGHT`` are hashed: from each line on, and up to each line, as few as will do. A
line weighs its words, or a word for each six characters where it has fewer blanks. Each holder of a run is paired
with the run's first holder (a star, so that rows grow with the lines and not with pairs of holders), and pairs are aligned by
patience diff over all their lines. What the rising order of the alignment leaves out, because it stands in another order, is
aligned block by block after it. Blocks of ``MIN_WEIGHT`` or more are deleted from the later document, so every
line that an earlier document holds in such a block goes, whichever and however many documents hold it.

Defined cases: blank lines are kept and never compared, a null text stays null; a document is later if its doc_id is greater;
of rows with one doc_id but other texts only those equal to the least-hashed text are changed, equal rows are changed alike;
a null doc_id passes unchanged; other columns stay as they are; a very long text is hashed in chunks of bounded memory.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark, _text

MIN_WEIGHT = 5
CHARACTERS = 6  # of a word of a line without blanks
PAIRS_IN_TASK = 1000


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all \\n-split lines of all texts: hash (0: no word), weight, and the text each is of."""
    n, docs = len(data), len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    of = np.repeat(np.arange(docs), np.diff(np.searchsorted(breaks, offsets)) + 1)
    ends = np.append(starts[1:], n)
    ends = np.where(np.isin(ends - 1, breaks, assume_unique=False) & (ends > starts), ends - 1, ends)
    words = _text.Words(data, offsets, lower=False)
    count = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, starts)
    h = _text.span_hashes(data, starts, ends)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    weight = np.where(count > 0, np.maximum(count, (chars[ends] - chars[starts]) // CHARACTERS), 0)
    return np.where(count > 0, h | np.uint64(1), np.uint64(0)), weight, of


def run_hashes(hashes: np.ndarray, weight: np.ndarray, least: int = MIN_WEIGHT) -> np.ndarray:
    """Distinct hashes of the shortest runs of ``least`` weight from each line on and up to each line; blank lines are passed over."""
    at = np.flatnonzero(hashes)
    h, n = hashes[at].view(np.uint64), len(at)
    upto = np.concatenate(([0], np.cumsum(weight[at], dtype=np.int64)))
    up, down = _text._powers_to(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_text.mix(h) * up[:n])))
    start = np.arange(n)
    stop = np.searchsorted(upto, upto[:-1] + least)
    low = np.searchsorted(upto, upto[1:] - least, "right") - 1
    i = np.concatenate((start[stop <= n], low[low >= 0]))
    j = np.concatenate((stop[stop <= n], start[low >= 0] + 1))
    return np.unique(_text.mix((total[j] - total[i]) * down[i] + (j - i).astype(np.uint64)))


def digest_of(hashes: np.ndarray) -> int:
    """One number for a text's lines in their order."""
    out = np.uint64(len(hashes))
    at = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    return int((_text.mix(hashes ^ _text.mix(at)).sum(dtype=np.uint64) + out).astype(np.int64)) if len(hashes) else 0


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, digest, hashes (bytes of 64-bit numbers), words (bytes of 32-bit numbers) of documents with a line of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            data, offsets = _text.buffer_of(b.column(1))
            rows = []
            for i, j in _text.chunks(offsets):
                h, count, of = line_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = np.searchsorted(of, np.arange(j - i + 1))
                for k in range(j - i):
                    own = h[cut[k] : cut[k + 1]]
                    if own.any():
                        rows.append((ids[i + k], digest_of(own), own.tobytes(), count[cut[k] : cut[k + 1]].astype(np.int32).tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "digest", "hashes", "words"])

    found = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest long, hashes binary, words binary")
    return found.groupBy("doc_id").agg(F.min(F.struct("digest", "hashes", "words")).alias("s")).select("doc_id", "s.*")


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), ascending. Lines unique in both anchor, ends of the gaps extend, gaps are done alike."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1}
        pairs = [(at[x], j) for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and x in at]
        chain = _longest_rise(pairs)
        if not chain:
            continue
        for (i, j), (p, q) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            todo.append((i + 1, p, j + 1, q))
        out += chain
    return sorted(out)


def _longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tails, i)
        back.append(ends[p - 1] if p else -1)
        tails[p : p + 1], ends[p : p + 1] = [i], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned_places(a: np.ndarray, b: np.ndarray, weight: np.ndarray, least: int = MIN_WEIGHT) -> list[int]:
    """Places in b of the lines of common blocks of ``least`` weight; blank lines (hash 0) are passed over.

    Aligned lines are extended to the whole block of equal lines that they are in. Of the lines in no block yet, those that a
    holds in another order are aligned after, each by itself, at a place whose neighbour is the same, if there is one.
    """
    in_b = np.flatnonzero(b)
    x, y, upto = a[np.flatnonzero(a)].tolist(), b[in_b].tolist(), np.concatenate(([0], np.cumsum(weight[in_b])))
    gone = np.zeros(len(y), bool)

    def block(i: int, j: int) -> tuple[int, int]:
        first, last = j, j + 1
        k = i
        while k and first and x[k - 1] == y[first - 1]:
            k, first = k - 1, first - 1
        k = i + 1
        while k < len(x) and last < len(y) and x[k] == y[last]:
            k, last = k + 1, last + 1
        if upto[last] - upto[first] >= least:
            gone[first:last] = True
        return i - j, last

    known = (None, 0)
    for i, j in patience(x, y):
        if i - j != known[0] or j >= known[1]:
            known = block(i, j)
    place: dict[int, int] = {}
    ahead: dict[tuple[int, int], int] = {}
    for i, v in enumerate(x):
        place.setdefault(v, i)
        if i + 1 < len(x):
            ahead.setdefault((v, x[i + 1]), i)
    for j, v in enumerate(y):
        if gone[j] or v not in place:
            continue
        behind = ahead.get((y[j - 1], v)) if j else None
        tries = (ahead.get((v, y[j + 1])) if j + 1 < len(y) else None, None if behind is None else behind + 1, place[v])
        for i in dict.fromkeys(t for t in tries if t is not None):
            block(i, j)
    return in_b[gone].tolist()


def line_deletions(docs: DataFrame) -> DataFrame:
    """doc_id, digest, places: of each document that loses lines, which (0 is the first; null: all)."""
    seqs = _spark.materialise(sequences(docs), "lines")
    copies = _spark.first_holders(seqs.select("doc_id", "digest"), "digest").select("doc_id", "digest", F.lit(None).cast("array<int>").alias("places"))
    copies = _spark.materialise(copies, "copies")
    firsts = _spark.materialise(seqs.join(copies.select("doc_id"), "doc_id", "left_anti"), "lines")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [run_hashes(np.frombuffer(h, np.int64), np.frombuffer(w, np.int32)).view(np.int64) for h, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            ids = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["doc_id", "run"])

    runs = firsts.select("doc_id", "hashes", "words").mapInArrow(explode, "doc_id long, run long")
    pairs = _spark.materialise(_spark.first_holders(runs, "run").select("first_id", "doc_id").distinct(), "linked")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, places = [], []
            for d, a, own, w in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                found = aligned_places(np.frombuffer(a, np.int64), np.frombuffer(own, np.int64), np.frombuffer(w, np.int32))
                ids += [d] * len(found)
                places += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32())], ["doc_id", "place"])

    later = firsts.select("doc_id", F.col("hashes").alias("own"), "words")
    dealt = _dealt(pairs, firsts.select(F.col("doc_id").alias("first_id"), "hashes"))
    aligned = dealt.join(later, "doc_id").select("doc_id", "hashes", "own", "words").mapInArrow(align, "doc_id long, place int")
    places = aligned.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    return places.join(firsts.select("doc_id", "digest"), "doc_id").select("doc_id", "digest", "places").unionByName(copies)


def _dealt(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs with the lines of their first document; those of a document in many pairs are dealt to a task for each ``PAIRS_IN_TASK``."""
    held = _spark.materialise(pairs.groupBy("first_id").agg(F.count("*").alias("n")), "heads")
    limit = max((held.agg(F.sum("n")).first()[0] or 0) // _spark.HOT_KEYS + 1, PAIRS_IN_TASK)  # at most HOT_KEYS are over it
    parts = F.ceil(F.col("n") / PAIRS_IN_TASK).cast("int")
    hot = held.where(F.col("n") >= limit).select("first_id", parts.alias("parts"))
    own = pairs.join(F.broadcast(hot), "first_id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    heads = held.select("first_id", F.explode(F.when(F.col("n") >= limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))).alias("part"))
    return own.join(firsts.join(heads, "first_id"), ["first_id", "part"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with text less the deleted lines, and n_lines, n_removed, emptied (no line of words is left of some)."""
    kept = docs.drop("n_lines", "n_removed", "emptied")
    doc_name, digest_name, places_name = _spark.fresh(kept.columns, "_doc", "_digest", "_places")
    gone = line_deletions(docs).select(F.col("doc_id").alias(doc_name), F.col("digest").alias(digest_name), F.col("places").alias(places_name))
    schema = kept.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit(True).alias("emptied")).schema
    at = kept.columns.index("text")
    width = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, removed, emptied = [], [], [], []
            for t, doc, digest, places in zip(*(b.column(i).to_pylist() for i in (at, width, width + 1, width + 2)), strict=True):
                n = 0
                parts = t.split("\n") if t is not None else []
                if doc is not None and t is not None:
                    raw = np.frombuffer(t.encode(), np.uint8)
                    h = line_hashes(raw, np.array([0, len(raw)]))[0]
                    if digest_of(h) == digest:
                        drop = set(np.flatnonzero(h).tolist() if places is None else places)
                        n = len(drop)
                        t = "\n".join(x for k, x in enumerate(parts) if k not in drop)
                texts.append(t)
                lines.append(len(parts))
                removed.append(n)
                emptied.append(n > 0 and not t.strip(" \t\n\x0b\x0c\r"))
            cols = [*b.columns[:width], pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(emptied, pa.bool_())]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    named = kept.where(F.col("doc_id").isNotNull())
    joined = named.join(gone.hint("shuffle_hash"), named["doc_id"].cast("long") == gone[doc_name], "left")
    nameless = kept.where(F.col("doc_id").isNull()).select("*", *(F.lit(None).cast(gone.schema[c].dataType).alias(c) for c in (doc_name, digest_name, places_name)))
    return joined.unionByName(nameless).mapInArrow(run, schema)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_spark.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))
