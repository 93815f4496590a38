"""Language-model scoring with a hierarchical Pitman-Yor model.

A token's probability is that of its class after the word before it, times that of the word in its class after that word.
Words of a five-hundredth of all training tokens or more (at most ``HOT_WORDS``) are classes of their own; all others are
dealt by hash to classes whose number grows with the corpus, so that a class stays of a size. Both parts are hierarchical
Pitman-Yor models. In a class, the restaurant of each preceding word has the restaurant of that word's group for a parent,
which has the restaurant of no context, which has the uniform law over the known words and one that stands for all
others. The classes themselves have the last three of these levels. As classes do not share words, one task samples a
class with all its true parents, without exchanging anything; the model of the classes is a table of bounded size.

Seating is sampled by Gibbs sweeps. A sweep goes up the levels, and in each takes the parties (customers of a dish in a
restaurant) of a restaurant in turn, those of different restaurants together: a party gets up and its customers are seated
again one after another, given all other tables and the parent as they are then. A restaurant with many parties takes
several at a turn, and a large party is seated in growing groups by a binomial draw. Discounts follow from how many parties have one and two
customers. After ``BURN`` sweeps, predictive probabilities are averaged over ``KEEP``.

All counts come from all training documents. A batch of texts sends one packed row to each class, never a row for a token,
and nothing for words that are classes of their own.

Defined cases: a null text is empty and has one token, the end; repeated rows, and rows with one doc_id, are scored and learnt
from one by one; a null doc_id is learnt from; without training documents the uniform law remains; a very long text is a batch
of its own; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark, _text

CLASSES, MOST_CLASSES, CLASS_TOKENS = 64, 4096, 1 << 20
GROUPS = 256  # of preceding words; those of their own class are groups of their own
HOT_WORDS = 500
BURN, KEEP = 2, 3
TURNS = 16
STRENGTH = 1.0
FOLDS, FOLD = 7, 2
ROWS = 60_000

_END = np.uint64(0x51ED270B9F3A4C6D)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and preceding word (32 bits of its hash, 0 at the beginning) of each token; each text closes with the end token."""
    w = _text.Words(data, offsets)
    h = np.insert(w.hashes(), w.first[1:], _END)
    doc = np.insert(w.doc, w.first[1:], np.arange(len(offsets) - 1))
    before = np.zeros(len(h), np.uint32)
    before[1:] = word32(h[:-1])
    before[np.append(True, doc[1:] != doc[:-1])] = 0
    return h, doc, before


def word32(h: np.ndarray) -> np.ndarray:
    return np.maximum((h >> np.uint64(16)).astype(np.uint32), 1)


class Lexicon(NamedTuple):
    """How words are dealt to classes (0 to classes-1, then the words of their own) and preceding words to groups."""

    classes: int
    hot: np.ndarray

    def class_of(self, h: np.ndarray) -> np.ndarray:
        own = ((h >> np.uint64(32)) % np.uint64(self.classes)).astype(np.int64)
        return np.where((at := _place(self.hot, h)) >= 0, self.classes + at, own)

    def group_of(self, before: np.ndarray) -> np.ndarray:
        hot = word32(self.hot)
        order = np.argsort(hot, kind="stable")
        at = _place(hot[order], before)
        own = np.where(before == 0, 0, 1 + before.astype(np.int64) % (GROUPS - 1))
        return np.where(at >= 0, GROUPS + order[np.maximum(at, 0)], own) if len(hot) else own

    @property
    def shape(self) -> tuple[int, int]:
        return GROUPS + len(self.hot), self.classes + len(self.hot)


def _place(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x among ascending ``known``, or -1."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def seat(count: np.ndarray, others: np.ndarray, prior: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of parties of ``count`` customers, who are seated anew; ``others``: the restaurant's tables of other dishes."""
    tables = np.ones(len(count), np.int64)
    todo = np.flatnonzero(count > 1)
    seated = 1
    while len(todo):
        group = max(1, seated // 16) if seated >= 64 else 1
        t = tables[todo]
        fresh = (strength + discount * (others[todo] + t)) * prior[todo]
        p = fresh / (fresh + np.maximum(seated - discount * t, 1e-12))
        step = np.minimum(group, count[todo] - seated)
        tables[todo] = np.minimum(t + (rng.binomial(step, p) if group > 1 else (rng.random(len(todo)) < p)), seated + step)
        seated += group
        todo = todo[count[todo] > seated]
    return tables


class _Level:
    """Parties of the restaurants of one level: restaurant and party of the parent level of each; the parent of the last is a dish."""

    def __init__(self, room: np.ndarray, parent: np.ndarray, count: np.ndarray):
        self.room, self.parent, self.count = room, parent, count.astype(np.int64)
        self.rooms = int(room.max()) + 1 if len(room) else 1
        self.tables = np.minimum(self.count, 1)
        ones, twos = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
        self.discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))

    def back(self) -> np.ndarray:
        """Of each restaurant, what its parent's law counts for."""
        tables, count = (np.bincount(self.room, x, self.rooms) for x in (self.tables, self.count))
        return (STRENGTH + self.discount * tables) / (STRENGTH + count)

    def seen(self) -> np.ndarray:
        return np.maximum(self.count - self.discount * self.tables, 0) / (STRENGTH + np.bincount(self.room, self.count, self.rooms))[self.room]


class Restaurants:
    """Samples of a model of the dishes 0..dishes-1 and one that stands for all others.

    ``dish`` and ``count`` are of distinct parties; ``rooms`` gives each party's restaurant at every level with contexts, nearest first.
    """

    def __init__(self, dish: np.ndarray, rooms: list[np.ndarray], count: np.ndarray, dishes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.dishes, self.keys, self.levels, self.samples = dishes, [], [], []
        size = count
        for room in rooms:
            key = room.astype(np.int64) * (dishes + 1) + dish
            self.keys.append(known := np.unique(key))
            at = np.searchsorted(known, key)
            held = np.bincount(at, size, len(known))
            room, dish = np.divmod(known, dishes + 1)
            size = np.ones(len(known), np.int64)
            self.levels.append(_Level(room, dish, held))
            if len(self.levels) > 1:
                self.levels[-2].parent = at
        self.levels.append(_Level(np.zeros(dishes, np.int64), np.arange(dishes), np.bincount(dish, size, dishes)))
        for sweep in range(BURN + KEEP):
            for k in range(len(self.levels)):
                self._reseat(k, rng)
            if sweep >= BURN:
                self.samples.append([(x.seen(), x.back()) for x in self.levels])

    def _law(self, k: int) -> np.ndarray:
        """Probability of each party's dish at level k; of dishes at the level above the last."""
        if k == len(self.levels):
            return np.full(self.dishes, 1.0 / (self.dishes + 1))
        x = self.levels[k]
        return x.seen() + x.back()[x.room] * self._law(k + 1)[x.parent]

    def _reseat(self, k: int, rng: np.random.Generator) -> None:
        x = self.levels[k]
        upper = self.levels[k + 1] if k + 1 < len(self.levels) else None
        x.tables = np.clip(x.tables, np.minimum(x.count, 1), x.count)
        many = np.flatnonzero(x.count > 1)
        many = many[np.argsort(x.room[many], kind="stable")]
        first = np.searchsorted(x.room[many], x.room[many])
        n = np.searchsorted(x.room[many], x.room[many], "right") - first
        nth = np.arange(len(many)) - first
        turn = np.where(n > TURNS, nth * TURNS // np.maximum(n, 1), nth)
        for t in range(int(turn.max()) + 1 if len(many) else 0):
            own = many[turn == t]
            if upper is not None:
                upper.count = np.bincount(x.parent, x.tables, len(upper.count)).astype(np.int64)
            open_tables = np.bincount(x.room, x.tables, x.rooms)[x.room[own]] - x.tables[own]
            x.tables[own] = seat(x.count[own], open_tables, self._law(k + 1)[x.parent[own]], x.discount, STRENGTH, rng)
        if upper is not None:
            upper.count = np.bincount(x.parent, x.tables, len(upper.count)).astype(np.int64)

    def predict(self, dish: np.ndarray, rooms: list[np.ndarray]) -> np.ndarray:
        """Averaged predictive probability; dish ``dishes`` is an unknown word, a restaurant not of the model has no customers."""
        places = [_place(known, room.astype(np.int64) * (self.dishes + 1) + dish) for known, room in zip(self.keys, rooms, strict=True)]
        out = np.zeros(len(dish))
        for sample in self.samples:
            seen, back = sample[-1]
            law = (np.append(seen, 0.0) + back[0] / (self.dishes + 1))[dish]
            for (seen, back), at, room in zip(sample[-2::-1], places[::-1], rooms[::-1], strict=True):
                share = np.where((room >= 0) & (room < len(back)), back[np.clip(room, 0, len(back) - 1)], 1.0)
                law = np.append(seen, 0.0)[at] + share * law
            out += law
        return out / max(len(self.samples), 1)


def _held() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def frequent(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Training tokens, and a bounded superset of the words that are a 1/HOT_WORDS of them.

    A batch names the words that are half that share of it, so a word of the whole share is named with half its count or more.
    """
    bound = 2 * HOT_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _text.buffer_of(b.column(0))
            for i, j in _text.chunks(offsets):
                h, _, _ = tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                word, n = np.unique(h, return_counts=True)
                many = n * bound >= len(h)
                names = pa.array(np.append(word[many].view(np.int64), 0), mask=np.append(np.zeros(many.sum(), bool), True))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.append(n[many], len(h)).astype(np.int64))], ["word", "n"])

    named = _spark.materialise(docs.where(~_held()).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = named.where("word is null").agg(F.sum("n")).first()[0] or 0
    rows = named.where(F.col("word").isNotNull() & (F.col("n") * bound >= total)).select("word").collect()  # at most 2 * HOT_WORDS
    return total, np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def class_counts(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Training tokens by group and class; the driver gets one number for each of a bounded number of cells."""
    groups, classes = lexicon.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(groups * classes, np.int64)
        for b in batches:
            data, offsets = _text.buffer_of(b.column(0))
            for i, j in _text.chunks(offsets):
                h, _, before = tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                table += np.bincount(lexicon.group_of(before) * classes + lexicon.class_of(h), minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["cell", "n"])

    got = docs.where(~_held()).select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(groups * classes, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(groups, classes)


def lexicon_of(docs: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and the training tokens by group and class."""
    total, names = frequent(docs)
    classes = CLASSES
    while classes < MOST_CLASSES and total > classes * CLASS_TOKENS:
        classes *= 2
    wide = Lexicon(classes, names)
    counts = class_counts(docs, wide)
    good = counts[:, classes:].sum(axis=0) * HOT_WORDS >= max(total, 1)
    slim = Lexicon(classes, names[good])
    # Words that prove not frequent enough go to the classes and groups that all words have by their hash.
    group, cls = np.arange(len(counts)), np.arange(counts.shape[1])
    group[GROUPS:] = slim.group_of(word32(names)) if len(names) else group[GROUPS:]
    cls[classes:] = slim.class_of(names) if len(names) else cls[classes:]
    out = np.zeros(slim.shape, np.int64)
    np.add.at(out, (group[:, None], cls[None, :]), counts)
    return slim, out


def class_law(counts: np.ndarray, seed: int = 0) -> np.ndarray:
    """log10 probability of each class in each group."""
    group, cls = np.nonzero(counts)
    model = Restaurants(cls, [group], counts[group, cls], counts.shape[1], seed)
    g, k = np.divmod(np.arange(counts.size), counts.shape[1])
    p = model.predict(k, [g]).reshape(counts.shape)
    return np.log10(p / p.sum(axis=1, keepdims=True)).astype(np.float32)  # every class is known, so the share of others is dealt out


_PACKED = "cls int, chunk long, head binary, held binary, words binary, runs binary, docs binary, before binary"
_SUMS = "chunk long, types long, head binary, docs binary, known binary, base binary, score binary"


def pack(docs: DataFrame, shared) -> DataFrame:
    """A row for each batch of texts and class: its words, and for each occurrence text and preceding word; and a head for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for b in batches:
            ids, held = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            data, offsets = _text.buffer_of(b.column(1))
            for i0, j0 in _text.chunks(offsets):
                for i in range(i0, j0, ROWS):
                    j = min(j0, i + ROWS)
                    yield _packed(chunk, ids[i:j], held[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], *shared.value)
                    chunk += 1

    rows = docs.select(F.col("doc_id").cast("long"), "text", _held().alias("held"))
    return rows.mapInArrow(run, _PACKED)


def _packed(chunk: int, ids: pa.Array, held: np.ndarray, data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, by_class: np.ndarray, law: np.ndarray) -> pa.RecordBatch:
    h, doc, before = tokens_of(data, offsets)
    cls, n = lexicon.class_of(h), len(held)
    hot = cls >= lexicon.classes
    of, own = doc[hot], cls[hot]
    logp = law[lexicon.group_of(before[hot]), own].astype(np.float64)
    sums = np.stack([np.bincount(doc, minlength=n), np.bincount(of, by_class[own] > 0, n), np.bincount(of, np.log10(by_class[own] + 1.0), n), np.bincount(of, logp, n)]).astype(np.float64)
    head = zlib.compress(ids.is_null().to_numpy(zero_copy_only=False).tobytes() + held.astype(bool).tobytes() + ids.fill_null(0).to_numpy().tobytes() + sums.tobytes(), 1)
    rows = [(-1 - chunk % MOST_CLASSES, chunk, head, b"", b"", b"", b"", b"")]
    h, doc, before, cls = h[~hot], doc[~hot], before[~hot], cls[~hot]
    order = np.lexsort((h, cls))
    h, doc, before, cls = h[order], doc[order].astype(np.uint16), before[order], cls[order]
    flags = n.to_bytes(4, "little") + np.packbits(held.astype(bool)).tobytes()
    edge = np.flatnonzero(np.append(True, cls[1:] != cls[:-1])) if len(cls) else np.zeros(0, np.int64)
    for i, j in zip(edge.tolist(), np.append(edge[1:], len(cls)).tolist()[: len(edge)], strict=True):
        own = h[i:j]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        runs = np.diff(np.append(start, len(own))).astype(np.uint32)
        rows.append((int(cls[i]), chunk, None, flags, own[start].tobytes(), runs.tobytes(), doc[i:j].tobytes(), before[i:j].tobytes()))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["cls", "chunk", "head", "held", "words", "runs", "docs", "before"])


class _Blob:
    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.n = int.from_bytes(row["held"][:4], "little")
        self.held = np.unpackbits(np.frombuffer(row["held"], np.uint8)[4:], count=self.n).astype(bool)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.runs = np.frombuffer(row["runs"], np.uint32)
        self.docs = np.frombuffer(row["docs"], np.uint16)
        self.before = np.frombuffer(row["before"], np.uint32)


def score_class(blobs: list[_Blob], law: np.ndarray, cls: int, lexicon: Lexicon) -> tuple[int, list[tuple[np.ndarray, ...]]]:
    """Known words of a class, and of each blob (texts, known, sum of log10(c + 1), log10 probability) by text."""
    every, inverse = np.unique(np.concatenate([b.words for b in blobs]), return_inverse=True)
    word = np.repeat(inverse, np.concatenate([b.runs for b in blobs]))
    before = np.concatenate([b.before for b in blobs])
    learnt = ~np.concatenate([b.held[b.docs] for b in blobs])
    by_word = np.bincount(word[learnt], minlength=len(every))
    known = np.flatnonzero(by_word)
    dish = np.full(len(every), len(known))
    dish[known] = np.arange(len(known))
    group = lexicon.group_of(before)
    contexts = np.unique(before[learnt])
    code, count = np.unique(dish[word[learnt]].astype(np.uint64) << np.uint64(32) | before[learnt], return_counts=True)
    party, owner = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    model = Restaurants(party, [np.searchsorted(contexts, owner), lexicon.group_of(owner)], count, len(known), cls)
    logp = np.log10(model.predict(dish[word], [_place(contexts, before), group])) + law[group, cls]
    base, was = np.log10(by_word + 1.0)[word], by_word[word] > 0
    out, at = [], 0
    for b in blobs:
        own = slice(at, at + len(b.docs))
        texts, inverse = np.unique(b.docs, return_inverse=True)
        out.append((texts, *(np.bincount(inverse, x[own], len(texts)) for x in (was, base, logp))))
        at += len(b.docs)
    return len(known), out


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    lexicon, counts = lexicon_of(docs)
    by_class = counts.sum(axis=0)
    shared = spark.sparkContext.broadcast((lexicon, by_class, class_law(counts)))
    train_tokens, own_types = int(counts.sum()), int(np.count_nonzero(by_class[lexicon.classes :]))
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    names = ["chunk", "types", "head", "docs", "known", "base", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Blob] = []
        cls = None
        lexicon, _, law = shared.value

        def done() -> pa.RecordBatch:
            types, sums = score_class(held, law, cls, lexicon)
            rows = [(b.chunk, types if k == 0 else 0, None, texts.tobytes(), known.astype(np.uint32).tobytes(), base.astype(np.float32).tobytes(), logp.astype(np.float32).tobytes()) for k, (b, (texts, known, base, logp)) in enumerate(zip(held, sums, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for row in b.to_pylist():
                if row["cls"] < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row["chunk"], 0, row["head"], b"", b"", b"", b""), kinds, strict=True)], names)
                    continue
                if cls is not None and row["cls"] != cls:
                    yield done()
                    held.clear()
                cls = row["cls"]
                held.append(_Blob(row))
        if held:
            yield done()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, types, rows = None, 0, []
        out = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "types"]

        def done() -> pa.RecordBatch:
            raw = zlib.decompress(next(r["head"] for r in rows if r["head"] is not None))
            n = len(raw) // 42  # a byte for null, one for held out, the id, four sums
            null, flags, ids = np.frombuffer(raw, bool, n), np.frombuffer(raw, bool, n, n), np.frombuffer(raw, np.int64, n, 2 * n)
            sums = np.frombuffer(raw, np.float64, 4 * n, 10 * n).reshape(4, n).copy()
            for r in rows:
                at = np.frombuffer(r["docs"], np.uint16)
                for k, (name, kind) in enumerate((("known", np.uint32), ("base", np.float32), ("score", np.float32)), 1):
                    sums[k][at] += np.frombuffer(r[name], kind)
            cols = [pa.array(ids, mask=null), pa.array(flags), *(pa.array(np.rint(s).astype(np.int64)) for s in sums[:2]), pa.array(sums[2]), pa.array(sums[3]), pa.nulls(n, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, out)

        for b in batches:
            for row in b.to_pylist():
                if row["chunk"] != chunk and rows:
                    yield done()
                    rows.clear()
                chunk = row["chunk"]
                rows.append(row)
                types += row["types"]
        if rows:
            yield done()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array([types], pa.int64())], out)

    n = _spark.partitions(spark)
    scored = pack(docs, shared).repartition(n, "cls").sortWithinPartitions("cls", "chunk").mapInArrow(score, _SUMS)
    summed = scored.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, types long")
    summed = _spark.materialise(summed, "scores")
    types = own_types + (summed.agg(F.sum("types")).first()[0] or 0)
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(train_tokens + types + 1)))
    return summed.where("types is null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_spark.table(spark, sf_dir, "documents"))
