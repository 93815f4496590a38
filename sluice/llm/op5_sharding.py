"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

Rows are dealt to source partitions by a hash of doc_id. How many rows of each partition go to each shard is drawn
exactly, as a uniform permutation of all rows would spread them (multivariate hypergeometric, row by row of the
partition-to-shard matrix). A partition then permutes its rows, deals them out by its row of the matrix, and each shard
permutes what it got. The permutations are keyed Feistel networks walked within their range, so neither needs memory,
and a lost task repeats itself exactly: places within a partition follow a sort by (hash, doc_id, size, crc), not arrival.

Law ``rows``: shard sizes are at most one apart; sizes, matrix and permutations follow from the seed alone.

Defined cases: a null text has size 16 and the crc of no bytes (0); a null doc_id hashes like a value of its own; repeated rows are
rows; an empty table gives no rows; other columns are not read by the plan and pass through ``sharded``, as do very long texts.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark, _text

SHARDS = 40
SEED = 20240607
PARTITION_ROWS = 4_000_000
MIN_PARTITIONS = 64


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` without replacement; exact rejection for log-concave laws, at any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    lg = math.lgamma
    weight = lambda k: -(lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    peak = weight(mode)
    norm = lg(good + 1) + lg(bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1) - lg(good + bad + 1)
    p = math.exp(peak + norm)
    w = 1 + p / 2
    while True:
        u, v = rng.random(), rng.random()
        y = v * w / p if u <= w / (1 + w) else (w - math.log(1 - v)) / p
        k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if low <= k <= high and (1 - rng.random()) * min(1.0, math.exp(w - p * y)) <= math.exp(weight(k) - peak):
            return k


def matrix(sources: list[int], targets: list[int], seed: int = SEED) -> np.ndarray:
    """Rows of each source that go to each target, as a uniform permutation of all rows would spread them."""
    rng, left = random.Random(seed), list(targets)
    out = np.zeros((len(sources), len(targets)), np.int64)
    for i, n in enumerate(sources):
        rest = sum(left)
        for j, room in enumerate(left):
            k = hypergeometric(rng, room, rest - room, n)
            out[i, j], left[j] = k, room - k
            n, rest = n - k, rest - room
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1 at ``index``: four Feistel rounds on the next even number of bits, walked into range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 1)).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    top = size.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (_text.mix(right ^ _text.mix(k + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= top[todo]]
    return out.astype(np.int64)


def _source(n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(n)).cast("int")


def _deal(docs: DataFrame, carried: list[str], shards: int, seed: int) -> DataFrame:
    """doc_id, size, text_crc32, the ``carried`` columns of ``docs``, shard and slot of every row."""
    spark = docs.sparkSession
    rows = docs.count()
    parts = max(MIN_PARTITIONS, -(-rows // PARTITION_ROWS))
    text = F.coalesce("text", F.lit(""))
    facts = {"doc": F.col("doc_id").cast("long"), "size": (F.octet_length(text) + 16).cast("long"), "crc": F.crc32(text.cast("binary")), "part": _source(parts)}
    names = dict(zip(facts, _spark.fresh([*carried, "shard", "slot"], *facts), strict=True))
    wide = docs.select(*(c.alias(names[k]) for k, c in facts.items()), *carried)
    held = {r["part"]: r["count"] for r in docs.select(_source(parts).alias("part")).groupBy("part").count().collect()}  # one short row for each partition
    sources = [held.get(k, 0) for k in range(parts)]
    targets = [rows // shards + (k < rows % shards) for k in range(shards)]
    sent = matrix(sources, targets, seed)
    upto, before = np.cumsum(sent, axis=1), np.cumsum(sent, axis=0) - sent
    shared = spark.sparkContext.broadcast((np.array(sources), upto, before, np.array(targets)))
    kept = [k for k, c in enumerate(wide.columns) if c != names["part"]]
    schema = wide.drop(names["part"]).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, upto, before, targets = shared.value
        seen: dict[int, int] = {}
        for b in batches:
            part = b.column(3).to_numpy()
            edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            place = np.arange(len(part)) - np.repeat(edge, np.diff(np.append(edge, len(part))))
            place += np.repeat([seen.get(int(part[k]), 0) for k in edge], np.diff(np.append(edge, len(part)))).astype(np.int64)
            for p, n in zip(*np.unique(part, return_counts=True), strict=True):
                seen[int(p)] = seen.get(int(p), 0) + int(n)
            rank = permute(place, sources[part], _text.mix(part.astype(np.uint64) + np.uint64(seed)))
            shard = (rank[:, None] >= upto[part]).sum(axis=1)
            start = np.where(shard > 0, upto[part, np.maximum(shard - 1, 0)], 0)
            slot = permute(before[part, shard] + rank - start, targets[shard], _text.mix(shard.astype(np.uint64) + np.uint64(seed ^ 0x5A5A5A)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(shard.astype(np.int32)), pa.array(slot)], schema.names)

    order = [names["part"], F.xxhash64(names["doc"], names["crc"]), names["doc"], names["size"], names["crc"]]
    dealt = wide.repartition(_spark.partitions(spark), names["part"]).sortWithinPartitions(*order)
    return dealt.mapInArrow(deal, schema)


def shard_plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row. Only these narrow rows are exchanged, never the texts."""
    return _deal(docs, [], shards, seed).select(F.col("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with shard and slot (which replace columns of these names); rows need no key."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return _deal(docs, kept, shards, seed).select(*kept, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All columns of ``docs`` in folders ``shard=k``, each row with its slot and in its order."""
    rows = sharded(docs, shards)
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shard_plan(_spark.table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
