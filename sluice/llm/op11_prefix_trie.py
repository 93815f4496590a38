"""The prefix trie of conversations, by preorder intervals.

A node is a distinct sequence of first turns. Its key is its depth and 128 bits: the exclusive or, over its turns, of a hash
of the turn and its place, a running total over the sorted turns, so that a conversation of any length is many tasks'.
Grouped by key (combined before the exchange) nodes get their members' count and smallest member.

The smallest member parts the trie into chains: conversation c owns the nodes from some depth down to its end, and its chain
hangs from a node that a smaller conversation owns. A node is ranked by the word of the steps that lead to its chain
(depth left at, deepest first; conversation) and its depth within it; words are put together by pointer doubling over
chains, and compared as bytes. That lexicographic order is a preorder: a chain's own nodes come first, then what hangs from it,
deepest first, so each subtree is an interval. Every node gives two rows to the sorted table, where its subtree begins and
where it ends; leaves and saved bytes of a subtree are the difference of two running totals there.

Defined cases: rows with a null conv_id belong to no conversation and go; a null turn comes first, and equal turns of a
conversation follow the hashes of role and text; null role or text is empty; repeated rows are turns each; an empty table has no
node, not even a root; texts are only hashed and measured, whatever their length; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark
from sluice.llm._running import running

GROUP, MOST_SHARED = 5, 8  # of the query: conversations of a group share up to so many first turns
PIECE_IDS = 1024
_FAR = 1 << 62


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), ta, tb (hash of role and text), bytes: every turn at its place."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("ta"), F.xxhash64(F.lit(2), role, text).alias("tb"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("at")
    )
    return running(rows, "conv_id", [F.col("turn").asc_nulls_first(), "ta", "tb"], sums=("at",)).select("conv_id", F.col("run_at").alias("at"), "ta", "tb", "bytes")


def rebuilt(placed: DataFrame, group: int = GROUP, most: int = MOST_SHARED) -> DataFrame:
    """conv_id, depth, ta, tb, bytes, size (turns of the conversation): the first h turns of c - c % group, then c's own after its first h.

    h is crc32(c) % (most + 1), and nought for the first conversation of a group. One row of depth nought each stands for the root.
    """
    of = placed.groupBy("conv_id").agg(F.max("at").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    h = F.when(F.col("conv_id") == F.col("base"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("long")
    first = of.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("_nb"))
    spans = of.withColumn("h", h).join(first, "base", "left").withColumn("take", F.least("h", F.coalesce("_nb", F.lit(0))))
    spans = _spark.materialise(spans.select("conv_id", "base", "h", "take", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "spans")
    shared = placed.where((F.col("at") <= most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    heads = spans.where("take > 0").join(shared, "base").where("at <= take").select("conv_id", F.col("at").alias("depth"), "ta", "tb", "bytes", "size")
    own = placed.join(spans, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("take")).alias("depth"), "ta", "tb", "bytes", "size")
    zero = F.lit(0).cast("long")
    return heads.unionByName(own).unionByName(spans.select("conv_id", zero.alias("depth"), zero.alias("ta"), zero.alias("tb"), zero.alias("bytes"), "size"))


def prefixes(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, ka, kb (the node), pa, pb (its parent), bytes, last: one row a conversation and node on its way."""
    mixed = sequences.select("conv_id", "depth", *(F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "ta", "tb", "depth")).otherwise(F.lit(0)).alias(x) for seed, x in ((3, "xa"), (4, "xb"))), "bytes", (F.col("depth") == F.col("size")).alias("last"))
    out = running(mixed, "conv_id", ["depth"], xors=("xa", "xb"))
    return out.select("conv_id", "depth", F.col("run_xa").alias("ka"), F.col("run_xb").alias("kb"), F.col("run_xa").bitwiseXOR(F.col("xa")).alias("pa"), F.col("run_xb").bitwiseXOR(F.col("xb")).alias("pb"), "bytes", "last")


def member_hashes(ends: DataFrame) -> DataFrame:
    """depth, ka, kb, ends_sha256 of (depth, ka, kb, conv_id): SHA-256 of the ids of each node, ascending and comma-joined.

    Ids are sorted over all tasks and joined to pieces there; what comes to the task of a node is a piece for each thousand ids, hashed as it streams.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            node, ids = None, []
            for *to, c in [*zip(*(x.to_pylist() for x in b.columns), strict=True), (None, None, None, None)]:
                if to != node or len(ids) == PIECE_IDS:
                    if ids:
                        for column, v in zip(out, [*node, ids[0], ",".join(map(str, ids))], strict=True):
                            column.append(v)
                    node, ids = to, []
                ids.append(c)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string())], ["depth", "ka", "kb", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def packed(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())], ["depth", "ka", "kb", "ends_sha256"])

        for b in batches:
            out = []
            for *to, _, piece in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if to != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = to, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield packed(out)
        if node is not None:
            yield packed([(*node, sha.hexdigest())])

    n, key = _spark.partitions(ends.sparkSession), ["depth", "ka", "kb"]
    joined = ends.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(pieces, "depth long, ka long, kb long, first long, piece string")
    return joined.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "depth long, ka long, kb long, ends_sha256 string")


def _bytes(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def chain_paths(tops: DataFrame) -> DataFrame:
    """conv_id, path: the steps from the root to each chain of (conv_id, up, left): it hangs from chain ``up`` at depth ``left``. Doubles at each round."""
    step = F.concat(_bytes(F.lit(_FAR) - F.col("left")), _bytes(F.col("conv_id").bitwiseXOR(F.lit(-(1 << 63)))))
    chains = _spark.materialise(tops.select("conv_id", "up", F.when(F.col("up").isNull(), F.unhex(F.lit(""))).otherwise(step).alias("path")), "chains")
    while not chains.where("up is not null").isEmpty():
        on = chains.select(F.col("conv_id").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        longer = _spark.materialise(chains.join(on, "up", "left").select("conv_id", F.col("_up").alias("up"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")), "chains")
        _spark.discard(chains)
        chains = longer
    return chains.select("conv_id", "path")


def subtree_totals(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens of nodes (conv_id, depth, leaf, saved) whose chains have ``paths``."""
    zero = F.lit(0).cast("long")
    begin = F.struct(F.concat("path", _bytes(F.col("depth"))).alias("key"), F.lit(False).alias("end"), F.col("leaf").alias("leaf"), F.col("saved").alias("saved"))
    end = F.struct(F.concat("path", _bytes(F.lit(_FAR) - F.col("depth") + 1)).alias("key"), F.lit(True).alias("end"), zero.alias("leaf"), zero.alias("saved"))
    marks = nodes.join(paths, "conv_id").select("conv_id", "depth", F.explode(F.array(begin, end)).alias("m")).select("conv_id", "depth", "m.*")
    total = running(marks, None, ["key"], sums=("leaf", "saved"))
    return total.groupBy("conv_id", "depth").agg(*((F.max(F.when(F.col("end"), F.col(f"run_{v}"))) - F.max(F.when(~F.col("end"), F.col(f"run_{v}") - F.col(v)))).alias(name) for v, name in (("leaf", "n_leaves"), ("saved", "saved_tokens"))))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row a node of (conv_id, depth, ta, tb, bytes, size) rows, as ``rebuilt`` makes them; saved_tokens counts bytes as tokens."""
    on_way = prefixes(sequences)
    key = ["depth", "ka", "kb"]
    nodes = on_way.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    nodes = _spark.materialise(nodes, "nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")]
    children = nodes.where("depth > 0").select(*above).groupBy(*key).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    ends = member_hashes(on_way.where("last").select(*key, "conv_id"))
    full = nodes.join(children, key, "left").join(ends, key, "left").join(parents, ["depth", "pa", "pb"], "left")
    full = full.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    full = _spark.materialise(full, "trie")
    tops = full.where("parent_conv_id is null or parent_conv_id <> conv_id").select("conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("left"))
    totals = subtree_totals(full.select("conv_id", "depth", "leaf", "saved"), chain_paths(tops))
    return full.join(totals, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turns(_spark.table(spark, sf_dir, "conversations"))))
