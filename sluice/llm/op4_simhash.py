"""SimHash near-duplicates through pivot distance tables.

Fingerprints within ``radius`` bits of each other are linked. Distances to reference fingerprints (pivots) alone bound
nothing sharply enough to partition uniform 64-bit fingerprints, so they are compared within buckets: the 64 bits are cut
into ``BLOCKS`` blocks, and two fingerprints that differ in at most ``radius`` bits agree on some ``BLOCKS - radius`` of
them, so each choice of that many blocks is a table whose equal keys hold every link. Within a bucket each fingerprint
has its row of Hamming distances to all pivots; a pair whose rows differ anywhere by more than ``radius`` cannot be within
``radius`` (triangle inequality) and is discarded; survivors are verified by the distance itself.

Only distinct fingerprints are compared (copies meet in a map-side aggregate first). A bucket returns the links of a
spanning forest, so that a large group of near copies gives as many rows as it has members. A bucket over
``BUCKET_ROWS`` is cut further by the blocks that its key leaves open, never capped.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle give
one shingle of all words; repeated rows with one doc_id are one document if their texts agree and a row each otherwise;
a null doc_id keeps its row and is no component's name unless nothing else is in it; other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _components, _spark, _text

SHINGLE = 4  # of the query; near_dedup takes five words
NEAR_SHINGLE, NEAR_RADIUS, NEAR_BLOCKS = 5, 6, 8
RADIUS = 4
BLOCKS = 7
PIVOTS = 16
BUCKET_ROWS = 2048
CHUNK_BYTES = 1 << 20  # of texts hashed at once: their shingles are spans in memory


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text."""
    words = _text.Words(data, offsets, squeeze=True)
    docs, n = len(offsets) - 1, len(words.starts)
    out = np.zeros(docs, np.uint64)
    if not n:
        return out
    first, count = words.first, words.count
    stop = np.repeat(first[1:], count)
    at = np.arange(n)
    own = at == np.repeat(first[:-1], count)  # a text's first word always starts a shingle
    lead = np.flatnonzero((at + shingle <= stop) | own)
    tail = np.minimum(lead + shingle, stop[lead]) - 1
    raw, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    spans = zip(words.starts[lead].tolist(), words.ends[tail].tolist(), strict=True)
    h = np.fromiter((digest(raw[s:e], 42) for s, e in spans), np.uint64, len(lead))
    docs_with = np.flatnonzero(count)
    begin = np.searchsorted(lead, first[docs_with])
    total = np.diff(np.append(begin, len(lead)))
    step = 1 << 17
    ones = np.zeros((len(docs_with), 64), np.int64)
    of = np.repeat(np.arange(len(docs_with)), total)
    for k in range(0, len(h), step):
        bits = np.unpackbits(h[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = of[k : k + step]
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ones[part[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    votes = (2 * ones > total[:, None]).astype(np.uint8)
    out[docs_with] = np.packbits(votes, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _text.buffer_of(b.column(1))
            fps = [fingerprints_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle) for i, j in _text.chunks(offsets, CHUNK_BYTES)]
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    return _text.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _blocks(n: int) -> list[int]:
    """Masks of n blocks of the 64 bits."""
    cuts = [round(64 * k / n) for k in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def bucket_links(fp: np.ndarray, radius: int = RADIUS, open_bits: int = (1 << 64) - 1, bucket_rows: int = BUCKET_ROWS) -> list[tuple[int, int]]:
    """Spanning links among the distinct fingerprints of one bucket; ``open_bits`` are those that its key leaves open."""
    forest, out = _Forest(len(fp)), []
    for i, j in _close_pairs(fp, np.arange(len(fp)), radius, open_bits, bucket_rows):
        if forest.join(i, j):
            out.append((i, j))
    return out


def _close_pairs(fp: np.ndarray, rows: np.ndarray, radius: int, open_bits: int, bucket_rows: int) -> Iterator[tuple[int, int]]:
    if len(rows) > bucket_rows and open_bits.bit_count() > radius:
        places = [k for k in range(64) if open_bits >> k & 1]
        for part in np.array_split(np.array(places), radius + 1):  # at least one part has no differing bit
            mask = sum(1 << int(k) for k in part)
            key = fp[rows] & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            for group in np.split(rows[order], np.flatnonzero(np.diff(key[order])) + 1):
                if len(group) > 1:
                    yield from _close_pairs(fp, group, radius, open_bits & ~mask, bucket_rows)
        return
    table = np.bitwise_count(fp[rows][:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    rows, table = rows[order], table[order]
    for i in range(len(rows) - 1):
        stop = np.searchsorted(table[:, 0], table[i, 0] + radius, "right")
        near = np.arange(i + 1, stop)
        if len(near):
            near = near[np.abs(table[near] - table[i]).max(axis=1) <= radius]  # the greatest difference of any coordinate
            near = near[np.bitwise_count(fp[rows[near]] ^ fp[rows[i]]) <= radius]
            yield from ((int(rows[i]), int(rows[k])) for k in near)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    spark = fps.sparkSession
    masks = _blocks(blocks)
    tables = [sum(c) for c in combinations(masks, blocks - radius)]
    lookup = np.array(tables, np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask in enumerate(lookup):
                key = _text.mix((fp & mask) ^ _text.mix(np.array([k + 1], np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), k, np.int8))], ["key", "fp", "t"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for b in batches:
            new = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            held = np.concatenate([held, new], axis=1)
            cut = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if cut:
                yield links_of(held[:, :cut])
                held = held[:, cut:]
        if held.shape[1]:
            yield links_of(held)

    def links_of(rows: np.ndarray) -> pa.RecordBatch:
        """Of whole buckets, sorted by key. Equal hashes of different tables or blocks only mix buckets; links are verified."""
        edge = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        size = np.diff(np.append(edge, rows.shape[1]))
        a, b = [], []
        for at, n in zip(edge[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            fp = rows[1, at : at + n].view(np.uint64)
            for i, j in bucket_links(fp, radius, ((1 << 64) - 1) & ~tables[int(rows[2, at])]):
                a.append(int(rows[1, at + i]))
                b.append(int(rows[1, at + j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keyed = fps.select("fp").mapInArrow(spread, "key long, fp long, t byte")
    keyed = keyed.repartition(_spark.partitions(spark), "key").sortWithinPartitions("key")
    return keyed.mapInArrow(buckets, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that a document reaches through linked fingerprints."""
    prints = _spark.materialise(fingerprints(docs, shingle), "simhash")
    distinct = _spark.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = _components.components(fingerprint_links(distinct, radius, blocks)).select(F.col("node").alias("fp"), F.col("root").alias("fp_root"))
    group = distinct.join(roots, "fp", "left").withColumn("fp_root", F.coalesce("fp_root", "fp"))
    least = group.groupBy("fp_root").agg(F.min("first_id").alias("component_id"))
    of_fp = group.join(least, "fp_root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, shingle: int = NEAR_SHINGLE, radius: int = NEAR_RADIUS, blocks: int = NEAR_BLOCKS) -> DataFrame:
    """The documents that are the first of their group; all columns and rows of these stay as they are.

    Six of 64 bits are what texts of a Jaccard similarity of 0.8 to 0.9 of their five-word shingles differ by most often; 0.8 itself is a mean of
    ten bits, which no fingerprint of 64 tells from chance at this cost (README has the share that is found).
    """
    groups = simhash_groups(docs, shingle, radius, blocks).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    null_id = docs.where(F.col("doc_id").isNull())
    return docs.join(groups, "doc_id", "left_semi").unionByName(null_id)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(_spark.table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
