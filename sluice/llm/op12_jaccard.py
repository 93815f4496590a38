"""Exact Jaccard join of documents by their distinct word shingles, in a metric space with pivots.

Jaccard distance is a metric, but unrelated texts are all at distance one, where no pivot tells anything. So pivots must be near:
each document meets the pivots with which it shares a rare shingle, and that loses no link. Of n shingles a linked document has
``ceil(n / 10)`` at least in common with its partner among the ``n - ceil(0.8 n) + ceil(n / 10)`` of least hash; of these it keeps
those held by fewest documents, as many as must contain a common one. The first holder of a kept shingle is its pivot, and all
its holders are the pivot's Voronoi region.

1. Distances to pivots are computed; those within 0.2 are links. A region whose documents are all linked together is done.
2. In other regions two documents can be linked only if their distances to the pivot differ by 0.2 at most. Regions up to
   ``REGION_ROWS`` documents are joined in a task, recursively: new pivots, the nearest of which is a document's home, and copies of it in
   the cells of all pivots at most 0.4 farther than that (for x at home with p and y with q within 0.2 of x, d(y, p) <= d(y, q) + 0.4).
3. Larger regions are cut by the same rule over many tasks, with about ``PIVOTS`` new pivots each, until they fit; a region that pivots
   do not cut goes by pairs of blocks. Nothing is capped.

Links are those of spanning forests: enough for the classes, and as many as there are documents.

Defined cases: a text with fewer words than a shingle is one shingle of them all; a null or wordless text has no shingle, is linked
with nothing and its own component; repeated rows are documents each, and copies of each other; a null doc_id keeps its row and names no
component unless nothing else is in it; a shingle is known by 64 bits of hash; a text is held whole by the task that hashes it, some
tens of bytes a word; an empty table gives no row; other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm import _components, _spark, _text

WIDTH = 5
RADIUS = 0.2  # as a Jaccard distance; linked() has the exact test
PIVOTS = 16
REGION_ROWS, REGION_BYTES = 4096, 32 << 20
SALT_ROWS = 512
LEAF, DENSE = 512, 16
SAMPLE, SALTS = 64, 256
FILTER_BITS = 1 << 26  # 8 MB, whatever the size of the tables


def linked(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | bool:
    return 100 * common >= 80 * (n + m - common)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, ascending within each, and where each text's begin."""
    words = _text.Words(data, offsets)
    h, first, docs = words.hashes(), words.first, len(offsets) - 1
    s, at = _text.shingles(h, first, width)
    of = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, d in enumerate(short):
            x = int(words.count[d])
            for v in h[first[d] : first[d + 1]]:
                x = (x * 0x9E3779B97F4A7C15 + int(v)) & (2**64 - 1)
            whole[k] = x
        s, of = np.concatenate([s, _text.mix(whole)]), np.concatenate([of, short])
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[new], of[new]
    return s, np.searchsorted(of, np.arange(docs + 1))


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, th (hash of the text), node, n, bytes, keys: the least hashes of each shingle set, as many as the join needs.

    A task names each row by its own number and place; rows whose set it has had before take the node of the first and no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, seen = TaskContext.get().partitionId() << 40, {}
        for b in batches:
            data, offsets = _text.buffer_of(b.column(2))
            for i, j in _text.chunks(offsets):
                s, start = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                n = np.diff(start)
                mixed = _text.mix(s ^ np.uint64(0x5851F42D4C957F2D))
                total = np.concatenate((np.zeros((2, 1), np.uint64), np.cumsum([s, mixed], axis=1, dtype=np.uint64)), axis=1)
                total = total[:, start[1:]] - total[:, start[:-1]]
                least = (8 * n + 9) // 10
                size = n - least + (n + 9) // 10
                nodes, use = np.arange(at, at + len(n)), np.zeros(len(n), bool)
                for k, sign in enumerate(zip(n.tolist(), *total.tolist(), strict=True)):
                    if sign[0]:
                        nodes[k] = seen.setdefault(sign, at + k)
                        use[k] = nodes[k] == at + k
                at += len(n)
                size = np.where(use, size, 0)
                ends = np.concatenate(([0], np.cumsum(size)))
                keys = s[np.arange(ends[-1]) - np.repeat(ends[:-1] - start[:-1], size)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(nodes), pa.array(n), pa.array(np.diff(offsets[i : j + 1])), lists], ["doc_id", "th", "node", "n", "bytes", "keys"])

    return _hashed(docs).mapInArrow(run, "doc_id long, th long, node long, n long, bytes long, keys array<long>")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.length("text"), "text").alias("th"), F.col("text").alias("text"))


def _tenth(x: Column) -> Column:
    return F.floor((x + 9) / 10)


def shared_keys(entries: DataFrame, total: int) -> DataFrame:
    """node, key, df of the keys that several nodes have, df being how many.

    One exchange by key, in which a window counts. Keys that would fill a task are told by a hash sample of one node in ``SAMPLE``: at most
    some 2 * 10**5, so they are broadcast, counted before an exchange, and dealt to many tasks.
    """
    least = max(total // (2 * SAMPLE * _spark.HOT_KEYS), 16)
    sample = entries.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)
    hot = _spark.materialise(sample.groupBy("key").count().where(F.col("count") >= least).select("key", F.lit(True).alias("_hot")), "hot")
    counts = entries.join(F.broadcast(hot), "key", "left").groupBy(F.when(F.col("_hot"), F.col("key")).alias("key")).agg(F.count("*").alias("_df"))
    told = entries.join(F.broadcast(_spark.materialise(counts, "hot")), "key", "left")  # the count of all others has a null key and meets none
    salt = F.when(F.col("_df").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    own = F.count("*").over(Window.partitionBy("key", "_salt"))
    return told.withColumn("_salt", salt).withColumn("df", F.coalesce("_df", own)).where("df > 1").select("node", "key", "df")


def holders(prints: DataFrame) -> DataFrame:
    """node, pivot: each document with the first holder of each of its kept shingles."""
    own = prints.where(F.size("keys") > 0)
    total = own.agg(F.sum(F.size("keys"))).first()[0] or 0
    shared = shared_keys(own.select("node", F.explode("keys").alias("key")), total)
    mine = Window.partitionBy("node")  # no longer than the document
    ranked = shared.withColumns({"at": F.row_number().over(mine.orderBy("df", "key")), "held": F.count("*").over(mine)}).join(own.select("node", "n"), "node")
    least = F.floor((8 * F.col("n") + 9) / 10)
    size = F.col("n") - least + _tenth(F.col("n"))
    keep = size - _tenth(least) + 1
    kept = ranked.where(F.col("at") + size - F.col("held") <= keep).select(F.col("node").alias("doc_id"), "key")
    kept = _spark.materialise(kept, "kept")
    star = _spark.first_holders(kept, "key")
    star = _spark.materialise(star.select(F.col("doc_id").alias("node"), F.col("first_id").alias("pivot")).distinct(), "star")
    _spark.discard(kept)
    return star


def with_texts(docs: DataFrame, prints: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with node) and the text of each node.

    A text travels once to meet its node, and once for each row from there. A bitmap of fixed size keeps most other texts out of the
    exchange; a false hit only joins with nothing. Repeated rows of one id and text meet before it.
    """
    to = [c for c in rows.columns if c != "node"]
    ends = rows.groupBy("node").agg(F.collect_list(F.struct(*to)).alias("_to"))
    same = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    wanted = _spark.materialise(prints.where(F.size("keys") > 0).select("node", "th", *same).join(ends, "node"), "wanted")
    bit = F.pmod(F.col("th"), F.lit(FILTER_BITS))
    place = F.bitmap_bit_position(bit)
    bitmap = wanted.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_there = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    held = _hashed(docs).withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "_bucket").where(set_there)
    held = held.select("th", *same, "text").groupBy("th", "_id", "_none").agg(F.first("text").alias("text"))
    return wanted.join(held, ["th", "_id", "_none"]).select("node", F.explode("_to").alias("_to"), "text").select("node", "_to.*", "text")


def distances(members: DataFrame, pivots: DataFrame, docs: DataFrame, prints: DataFrame, width: int = WIDTH) -> DataFrame:
    """region, node, pivot, common, n, m: of each (region, node) to each (region, pivot) of its region.

    A region is dealt to tasks by ``SALT_ROWS`` documents; the texts of its pivots, some ``PIVOTS``, go to each of them and come first.
    """
    salts = members.groupBy("region").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    rows = members.join(salts, "region").select("region", F.pmod(F.xxhash64("node"), "salts").alias("salt"), F.lit(1).alias("kind"), "node")
    heads = pivots.join(salts, "region").select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("pivot").alias("node"))
    dealt = with_texts(docs, prints, rows.unionByName(heads)).select("region", "salt", "kind", "node", "text")
    dealt = dealt.repartition(_spark.partitions(members.sparkSession), "region", "salt").sortWithinPartitions("region", "salt", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, []
        for b in batches:
            region, salt, kind, node = (b.column(k).to_pylist() for k in range(4))
            data, offsets = _text.buffer_of(b.column(4))
            out: list[list] = [[], [], [], [], [], []]
            for i, j in _text.chunks(offsets):
                s, start = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                for k in range(i, j):
                    own = s[start[k - i] : start[k - i + 1]]
                    if at != (region[k], salt[k]):
                        at, known = (region[k], salt[k]), []
                    if not kind[k]:
                        known.append((node[k], own.copy()))
                    else:
                        for p, other in known:
                            if p != node[k]:
                                for column, v in zip(out, (region[k], node[k], p, common(own, other), len(own), len(other)), strict=True):
                                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["region", "node", "pivot", "common", "n", "m"])

    return dealt.mapInArrow(run, "region long, node long, pivot long, common long, n long, m long")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


class Forest:
    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(v, i) for i, v in enumerate(labels)]

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def region_links(sets: list[np.ndarray], labels: list[int], leaf: int = LEAF) -> list[tuple[int, int]]:
    """Links between the sets whose forest, with ``labels``, has the classes of all linked pairs."""
    forest, out = Forest(labels), []
    n = np.array([len(s) for s in sets])

    def add(i: int, j: int) -> None:
        if forest.join(i, j):
            out.append((i, j))

    def join(rows: np.ndarray) -> None:
        if len({forest.find(i) for i in rows.tolist()}) < 2:
            return
        if len(rows) > leaf:
            picked = rows[np.linspace(0, len(rows) - 1, PIVOTS).astype(int)]
            shared = np.array([[common(sets[i], sets[p]) for p in picked] for i in rows])
            far = 1 - shared / (n[rows][:, None] + n[picked][None, :] - shared)
            for i, k in zip(*np.nonzero(linked(shared, n[rows][:, None], n[picked][None, :])), strict=True):
                add(int(rows[i]), int(picked[k]))
            near = far.min(axis=1)
            home = far.argmin(axis=1)
            cells = [np.flatnonzero(far[:, k] <= near + 2 * RADIUS + 1e-9) for k in range(len(picked)) if (home == k).any()]
            if max(map(len, cells)) <= 0.8 * len(rows):
                for cell in cells:
                    join(rows[cell])
                return
        for i, j in block_pairs([sets[i] for i in rows.tolist()], n[rows]):
            add(int(rows[i]), int(rows[j]))

    join(np.argsort(n, kind="stable"))
    return out


def block_pairs(sets: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[int, int]]:
    """All linked pairs. Shingles that few sets hold add to the counts of their pairs, those that many hold by matrix products, some columns at a time."""
    size = len(sets)
    of = np.repeat(np.arange(size), n)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = held[column] > 1
    of, column, held = of[use], column[use], held[column[use]]
    order = np.lexsort((of, column, held))
    of, column, held = of[order], column[order], held[order]
    total = np.zeros((size, size), np.float32)
    for k in range(2, DENSE):
        rows = of[np.searchsorted(held, k) : np.searchsorted(held, k, "right")].reshape(-1, k)
        for i in range(k - 1):
            for j in range(i + 1, k):
                np.add.at(total, (rows[:, i], rows[:, j]), 1)
    many = np.searchsorted(held, DENSE)
    of, column = of[many:], np.unique(column[many:], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, [at, at + 2048])
        block = np.zeros((size, 2048), np.float32)
        block[of[i:j], column[i:j] - at] = 1
        total += block @ block.T
    for at in range(0, size, 256):
        a, b = np.nonzero(linked(total[at : at + 256].astype(np.int64), n[at : at + 256, None], n[None, :]))
        yield from ((i, j) for i, j in zip((a + at).tolist(), b.tolist(), strict=True) if i < j)


def links_in_regions(rows: DataFrame, docs: DataFrame, prints: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links (a, b) of regions (region, node, label) that fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, labels, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = region_links(sets, labels) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            region, node, label = (b.column(k).to_pylist() for k in range(3))
            data, offsets = _text.buffer_of(b.column(3))
            for i, j in _text.chunks(offsets):
                s, start = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                for k in range(i, j):
                    if region[k] != at:
                        yield links()
                        at, nodes, labels, sets = region[k], [], [], []
                    nodes.append(node[k])
                    labels.append(label[k])
                    sets.append(s[start[k - i] : start[k - i + 1]].copy())
        yield links()

    dealt = with_texts(docs, prints, rows.select("region", "node", "label")).select("region", "node", "label", "text")
    return dealt.repartition(_spark.partitions(rows.sparkSession), "region").sortWithinPartitions("region", "node").mapInArrow(run, "a long, b long")


def _linked(rows: DataFrame) -> DataFrame:
    return rows.where(100 * F.col("common") >= 80 * (F.col("n") + F.col("m") - F.col("common")))


def jaccard_links(docs: DataFrame, prints: DataFrame, width: int = WIDTH, region_rows: int = REGION_ROWS, region_bytes: int = REGION_BYTES) -> DataFrame:
    """Links (a, b) between nodes of ``prints`` whose components are those of all linked pairs."""
    star = holders(prints)
    pivots = star.select(F.col("pivot").alias("region"), "pivot").distinct()
    members = star.select(F.col("pivot").alias("region"), "node")
    known = _spark.materialise(_linked(distances(members, pivots, docs, prints, width)).select(F.col("node").alias("a"), F.col("pivot").alias("b")), "links")
    sizes = prints.where(F.size("keys") > 0).select("node", "bytes")
    cut = 0
    while True:
        roots = _components.components(known)
        rows = members.join(roots, "node", "left").select("region", "node", F.coalesce("root", "node").alias("label"))
        rows = rows.join(sizes, "node")
        state = rows.groupBy("region").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_rows"), F.sum("bytes").alias("_bytes")).where("_low <> _high")
        rows = _spark.materialise(rows.join(state.select("region", "_rows", "_bytes"), "region"), "regions")
        fits = (F.col("_rows") <= region_rows) & (F.col("_bytes") <= region_bytes) | (F.col("_rows") <= 2)
        known = _spark.materialise(known.unionByName(links_in_regions(rows.where(fits), docs, prints, width)), "links")
        large = rows.where(~fits)
        _spark.discard(roots)
        if large.isEmpty():
            for done in (star, rows):
                _spark.discard(done)
            return known
        cut += 1
        # about PIVOTS of each region, told by a hash that differs from round to round
        picked = large.where(F.pmod(F.xxhash64("node", F.lit(cut)), F.greatest(F.floor(F.col("_rows") / PIVOTS), F.lit(1))) == 0).select("region", F.col("node").alias("pivot"))
        far = _spark.materialise(distances(large.select("region", "node"), picked, docs, prints, width), "distances")
        known = _spark.materialise(known.unionByName(_linked(far).select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "links")
        d = F.col("n") + F.col("m") - F.col("common")
        to = far.select("region", "node", "pivot", (1 - F.col("common") / d).alias("d")).unionByName(picked.select("region", F.col("pivot").alias("node"), "pivot", F.lit(0.0).alias("d")))
        near = to.groupBy("region", "node").agg(F.min("d").alias("_near"))
        cells = to.join(near, ["region", "node"]).where(F.col("d") <= F.col("_near") + 2 * RADIUS + 1e-9).select("region", "node", F.xxhash64("region", "pivot", F.lit(cut)).alias("cell"))
        cells = _spark.materialise(cells, "cells")
        shapes = cells.groupBy("region", "cell").count().groupBy("region").agg(F.max("count").alias("_most"), F.sum("count").alias("_sum"))
        shapes = large.select("region", "_rows", "_bytes").distinct().join(shapes, "region", "left").withColumn("_cut", F.coalesce((F.col("_most") <= 0.8 * F.col("_rows")) & (F.col("_sum") <= PIVOTS / 2 * F.col("_rows")), F.lit(False)))
        by_pivot = cells.join(shapes.where("_cut").select("region"), "region", "left_semi").select(F.col("cell").alias("region"), "node")
        blocks = large.select("region", "node").join(shapes.where("not _cut"), "region").withColumn("_b", 2 * F.greatest(F.ceil(F.col("_rows") / region_rows), F.ceil(F.col("_bytes") / region_bytes)).cast("int"))
        mine = F.pmod(F.xxhash64(F.lit(cut), "node"), "_b").cast("int")
        pairs = blocks.withColumn("_i", mine).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).select("node", F.xxhash64("region", F.least("_i", "_j"), F.greatest("_i", "_j"), F.lit(cut)).alias("region"))
        members = _spark.materialise(by_pivot.unionByName(pairs.select("region", "node")).distinct(), "members")


def jaccard_groups(docs: DataFrame, width: int = WIDTH, **limits: int) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that a document reaches by links."""
    prints = _spark.materialise(sketches(docs, width), "sketches")
    roots = _components.components(jaccard_links(docs, prints, width, **limits))
    of = prints.select("doc_id", "n", "node").join(roots, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))
    of = _spark.materialise(of, "classes")
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return of.join(least, "root").select("doc_id", "n_shingles", "component_id")


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_spark.table(spark, sf_dir, "documents"))
