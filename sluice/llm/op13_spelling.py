"""Spelling variants: a self-join of the vocabulary's trie with active-node sets.

Words at one edit from each other share all but one place: with ``L`` the longer length, their common prefix and suffix
together have ``L - 1`` code points or more, so either the prefix or the suffix has ``L // 2``. The trie of the vocabulary is
therefore parted by prefix (and the trie of the reversed words by suffix): each word goes to the part of its own length and
to that of the next length, in both directions, four rows a word. Within a part the trie is walked from its root; every
node gets the set of nodes at distance 0 or 1 (its active nodes) from its parent's set, and terminal pairs at distance one
are emitted. A pair belongs to one part only, told by the length of its common prefix, so no pair is found twice.

A part over ``PART_WORDS`` words is split again, on the free places between its fixed prefix and suffix, until its words
differ in one place at most; such a part has no more words than there are letters. Parts return a row a word (how many
near words, the best of them), never pairs, so rows grow with the vocabulary.

Defined cases: a null text has no words; a null doc_id counts as the empty string in the hash that plants errors; repeated
rows count each; ties of forms go to the smallest word in code-point order; an empty table gives no row; very long texts
are cut into words by the JVM, one array of words a text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark

LETTERS = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLANT_EVERY = 97
MIN_CHARS, MIN_COUNT = 5, 3
PART_WORDS = 4096


def vocabulary(docs: DataFrame, plant_every: int = PLANT_EVERY, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the letter runs of all texts, lower-cased, one in ``plant_every`` with a letter deleted, counted before the exchange."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS))).alias("_run"))
    h, at = F.crc32(F.concat_ws(":", "_id", "_run")), (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    words = runs.withColumn("_h", h).select(F.when(F.col("_h") % plant_every == 0, cut).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _half() -> Column:
    return F.floor((F.col("long") - F.col("a") - F.col("b")) / 2).cast("int")


def _children(parts: DataFrame) -> DataFrame:
    """Both halves of each part: a longer fixed prefix, or a longer fixed suffix; ``top`` bounds the common prefix of its pairs."""
    f = _half()
    left = F.struct((F.col("a") + f).alias("a"), F.col("b").alias("b"), F.col("top").alias("top"))
    right = F.struct(F.col("a").alias("a"), (F.col("b") + f).alias("b"), F.least("top", F.col("a") + f).alias("top"))
    out = parts.select("word", "n", "long", F.explode(F.array(left, right)).alias("_p")).select("word", "n", "long", "_p.*")
    ends = (F.substr("word", F.lit(1), F.col("a")), F.substr("word", F.length("word") - F.col("b") + 1))
    return out.withColumn("key", F.xxhash64("long", "a", "b", "top", *ends))


def parts(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, long, a, b, top, key: words of length ``long`` and one less that share the first a and last b code points.

    Equal hashes of different parts only put their words together; a pair is emitted by its own part alone.
    """
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("long")
    zero = F.lit(0)
    new = _children(words.select("word", "n", longer).withColumns({"a": zero, "b": zero, "top": F.col("long")}))
    done = None
    while True:
        new = _spark.materialise(new, "parts")
        large = _spark.materialise(new.groupBy("key").count().where(F.col("count") > part_words).select("key"), "large")
        fits = new.join(large, "key", "left_anti")
        rest = new.join(large, "key", "left_semi")
        narrow = rest.where(_half() == 0)
        done = fits.unionByName(narrow) if done is None else done.unionByName(fits).unionByName(narrow)
        if large.isEmpty():
            return done
        new = _children(rest.where(_half() > 0))


class Trie:
    """Nodes are numbers; ``end`` has the word that ends at a node."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        for i, w in enumerate(words):
            at = 0
            for c in w:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(-1)
                at = to
            self.end[at] = i

    def pairs(self) -> Iterator[tuple[int, int]]:
        """(i, j) for all words at edit distance one, in both directions, by active nodes at distance 0 or 1."""
        follow, end = self.next, self.end
        todo = [(0, {0: 0} | dict.fromkeys(follow[0].values(), 1))]
        while todo:
            node, active = todo.pop()
            if end[node] >= 0:
                yield from ((end[node], end[v]) for v, d in active.items() if d and end[v] >= 0)
            for c, child in follow[node].items():
                own: dict[int, int] = {child: 0}
                for v, d in active.items():
                    if d:  # no edit is left: the same letter must follow
                        to = follow[v].get(c)
                        if to is not None:
                            own.setdefault(to, 1)
                    else:  # v is the node itself: delete the letter, or replace it
                        own.setdefault(v, 1)
                        for to in follow[v].values():
                            own.setdefault(to, 1)
                for to in follow[child].values():  # or insert one
                    own.setdefault(to, 1)
                todo.append((child, own))


def common_prefix(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def part_rows(rows: list[tuple[str, int, int, int, int, int]]) -> list[tuple[str, int, int, str]]:
    """(word, near, best n, best word) of one part's rows (word, n, long, a, b, top)."""
    n = dict((r[0], r[1]) for r in rows)
    if len(n) < 2:
        return []
    words = list(n)
    shapes = {r[2:] for r in rows}
    backward = all(s[1] < s[2] for s in shapes)
    trie = Trie([w[::-1] for w in words] if backward else words)
    has = {r[0:1] + r[2:] for r in rows} if len(shapes) > 1 else None
    near: dict[str, list] = {}
    for i, j in trie.pairs():
        u, v = words[i], words[j]
        k, size = common_prefix(u, v), max(len(u), len(v))
        if any(s[0] == size and s[1] <= k < s[3] and (has is None or ((u, *s) in has and (v, *s) in has)) for s in shapes):
            mine = near.setdefault(u, [0, 0, ""])
            mine[0] += 1
            if (-n[v], v) < (-mine[1], mine[2]):
                mine[1:] = n[v], v
    return [(u, *m) for u, m in near.items()]


NEAR = "word string, near long, best_n long, best string"


def near_words(parted: DataFrame) -> DataFrame:
    """word, near, best_n, best of each part in which the word has near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def packed(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "best_n", "best"])

        for b in batches:
            out = []
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    out += part_rows(held)
                    key, held = k, []
                held.append(tuple(row))
            yield packed(out)
        yield packed(part_rows(held))

    rows = parted.select("key", "word", "n", "long", "a", "b", "top")
    rows = rows.repartition(_spark.partitions(parted.sparkSession), "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of each word's chain of forms. A form occurs twice as often at least, so chains are short and end."""
    at = _spark.materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        step = _spark.materialise(at.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), "roots")
        _spark.discard(at)
        at = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return at


def variants(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n)."""
    words = _spark.materialise(words, "vocabulary")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    near = near_words(parts(words, part_words)).groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_b"))
    common = -F.col("_b.m") >= 2 * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("_b.w")).alias("form"), F.when(common, -F.col("_b.m")).alias("form_n"))
    out = _spark.materialise(out, "forms")
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(_spark.table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
