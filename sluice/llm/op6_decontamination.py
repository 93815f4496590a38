"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased, and everything but letters, digits and non-ASCII becomes one blank between words. An
item of m bytes may be found with up to k = floor(``EDIT_RATE`` m) edits: it is split into k + 1 pieces, one of which
must then occur unchanged. One Aho-Corasick automaton finds all pieces of all items in one reading of a text; around the
hits Myers' bit-parallel matching gives the least edit distance of the item to a substring, and up to k is a match.

The items are a stated query set: they are taken in blocks of at most ``BLOCK_BYTES`` and every block sees all texts.
Texts are read whole, no row is exchanged, and rows are independent, so a group of copies costs as much as its rows.

Defined cases: null or wordless texts match nothing, nor do null or wordless items; an item too short for an edit must
occur exactly, at word boundaries; equal items are matched each; repeated rows are matched one by one; other columns
stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark

EDIT_RATE = 0.05
BLOCK_BYTES = 16 << 20

_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def normal(text: str | None) -> str:
    """The normalised bytes, one character each."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()).decode("latin-1")


def pieces(item: str, rate: float = EDIT_RATE) -> list[tuple[int, str]]:
    """(offset, piece): one more than the item's error budget, of even length."""
    n = int(rate * len(item)) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to a substring of ``text``, and where the first such substring ends."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Pieces of a block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        self.items = [(key, normal(text)) for key, text in items]
        self.budget = [int(rate * len(t)) for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, rate) if text else ():
                where.setdefault(piece, []).append((k, offset))
        self.find = ahocorasick.Automaton()
        for piece, places in where.items():
            self.find.add_word(piece, (len(piece), places))
        self.any = bool(where)
        if self.any:
            self.find.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, budget, end in the normalised text), the best match of each item."""
        plain = normal(text)
        if not self.any or not plain:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.find.iter(plain):
            for k, offset in places:
                start, budget = last + 1 - size - offset, self.budget[k]
                windows.setdefault(k, []).append((max(0, start - budget), start + len(self.items[k][1]) + budget))
        out = []
        for k, spans in windows.items():
            (key, item), budget = self.items[k], self.budget[k]
            if not budget:
                end = f" {plain} ".find(f" {item} ")
                if end >= 0:
                    out.append((key, 0, 0, end + len(item)))
                continue
            best = (budget + 1, 0)
            spans.sort()
            first, stop = spans[0]
            for a, b in [*spans[1:], (len(plain) + len(item) * 3, 0)]:
                if a <= stop:
                    stop = max(stop, b)
                    continue
                distance, end = myers(item, plain[first:stop])
                best = min(best, (distance, first + end))
                first, stop = a, b
            if best[0] <= budget:
                out.append((key, best[0], budget, best[1]))
        return sorted(out)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The test items, in blocks of about ``block_bytes`` that the driver holds one at a time."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r[0], r[1]) for r in part.collect()]


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, item_id, distance, budget, end_at: each document and test item found in it."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, distance int, budget int, end_at long"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in matcher.matches(t)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "budget", "end_at"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The documents in which no test item is found; all columns stay as they are."""
    at = docs.columns.index("text")
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.matches(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_spark.table(spark, sf_dir, "documents"), _spark.table(spark, sf_dir, "benchmark"))
