"""Language identification with string kernels.

The kernel is the normalised blended-spectrum presence kernel: of two texts, the n-grams of 1 to ``NGRAM`` characters
that both have, over the root of the product of how many each has. N-grams are of lower-cased letters with one blank for
anything between; they are hashed to ``2**BITS`` places. ``LANDMARKS`` texts of the bounded training sample give the
Nyström map; one-versus-rest kernel ridge regression is solved on it. As the kernel is linear in the presence vectors,
landmarks, map and weights multiply out to one matrix of places by languages, and a batch of texts is scored by a product
of its presence matrix with that. The score is the logistic of the margin between the best two languages.

Training reads at most ``SAMPLE_ROWS`` labelled rows, those of the least hashes, language by language; all else reads all rows whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null ``lang`` is never learnt from; with
one language only, that is predicted with score 1, with none all rows are ``und``; ties go to the first language by name;
repeated rows are predicted one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark

NGRAM = 4
BITS = 15
LANDMARKS = 256
SAMPLE_ROWS = 4000
RIDGE = 1e-2
SHARPNESS = 6.0
SURE_PLACES, SURE_SHARE = 400, 0.25
BLOCK_CHARS = 1 << 20
BLOCK_ROWS = 256


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


_LETTER = np.zeros(0x110000, bool)
_LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 0/1 by place, and whether the text has a letter."""
    size = 1 << BITS
    out = np.zeros((len(texts), size), np.uint8)
    lettered = np.zeros(len(texts), bool)
    flat = out.reshape(-1)
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    pad = np.zeros(1, np.uint32)
    raw = np.concatenate([x for c in codes for x in (pad, c, pad)]) if codes else pad
    row = np.repeat(np.arange(len(texts)), [len(c) + 2 for c in codes])
    letter = _LETTER[raw]
    raw = np.where(letter, raw, 32).astype(np.uint64)
    keep = np.append(True, letter[1:] | letter[:-1] | (row[1:] != row[:-1])) if len(raw) else letter
    raw, row, letter = raw[keep], row[keep], letter[keep]
    lettered[row[letter]] = True
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, NGRAM + 1):
        h = (h[:-1] if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + raw[n - 1 :] + np.uint64(n)
        same = row[n - 1 :] == row[: len(row) - n + 1]
        place = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)
        flat[(row[: len(place)] * size + place)[same]] = 1
    return out, lettered


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, chars = 0, 0
    for k, t in enumerate(texts):
        if k > first and (chars + len(t) > BLOCK_CHARS or k - first >= BLOCK_ROWS):
            yield first, k
            first, chars = k, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def _unit_rows(packed: np.ndarray) -> Iterator[np.ndarray]:
    """Presence rows of length one, a block of packed ones at a time."""
    for i in range(0, len(packed), BLOCK_ROWS):
        x = np.unpackbits(packed[i : i + BLOCK_ROWS], axis=1).astype(np.float32)
        yield x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def packed(texts: list[str]) -> np.ndarray:
    """Presence rows as bits, 2**BITS / 8 bytes each."""
    return np.concatenate([np.packbits(presence(texts[i:j])[0], axis=1) for i, j in blocks(texts)] or [np.zeros((0, (1 << BITS) // 8), np.uint8)])


class Model(NamedTuple):
    """Languages by name, the matrix of places by languages, and the value that a long text of a known language has at least."""

    names: list[str]
    matrix: np.ndarray
    bound: float


def fit(rows: np.ndarray, langs: list[str]) -> Model:
    """The model of packed presence rows and their languages."""
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names, np.zeros((1 << BITS, len(names)), np.float32), -np.inf)
    label = np.array([names.index(v) for v in langs])
    order = np.argsort(label, kind="stable")
    nth = np.empty(len(label), np.int64)
    nth[order] = np.arange(len(label)) - np.searchsorted(label[order], label[order])
    marks = np.concatenate(list(_unit_rows(rows[np.argsort(nth, kind="stable")[:LANDMARKS]])))  # of each language in turn
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    nystrom = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([(x @ marks.T).astype(np.float64) @ nystrom for x in _unit_rows(rows)])
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = len(label) / (len(names) * np.bincount(label, minlength=len(names)))[label]
    solved = np.linalg.solve((z * weight[:, None]).T @ z + RIDGE * len(label) * np.eye(z.shape[1]) / z.shape[1], (z * weight[:, None]).T @ y)
    long = np.bitwise_count(rows).sum(axis=1, dtype=np.int64) >= SURE_PLACES
    least = float((z @ solved).max(axis=1)[long].min()) if long.any() else 0.0
    bound = least * SURE_SHARE if least > 0 else -np.inf
    return Model(names, (marks.T.astype(np.float64) @ (nystrom @ solved)).astype(np.float32), bound)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, list[str]]:
    """Presence rows and languages of at most about ``rows`` labelled texts, as many of each language as there are, up to its share; least hash first.

    The rows are made on the executors; the driver gets 4 KB of bits for each and never a text.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one short row for each language
    share = max(1, rows // max(1, len(counts)))
    below = F.lit(False)
    for lang, n in sorted(counts.items()):
        below |= (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 40)) < int(min(1.0, share / n) * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = pa.array([x.tobytes() for x in packed(b.column(2).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bits], ["h", "lang", "bits"])

    chosen = labelled.where(below).select(F.xxhash64("doc_id", F.lit(8)).alias("h"), "lang", "text").mapInArrow(run, "h long, lang string, bits binary")
    got = chosen.orderBy("h", "lang", "bits").limit(2 * rows).collect()
    return np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), (1 << BITS) // 8), [r["lang"] for r in got]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    return fit(*sample(docs, rows))


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, and whether the text is in a language that the model knows, of each text."""
    names, matrix, bound = model
    langs: list[str] = []
    scores, known = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for i, j in blocks(texts):
        x, lettered = presence(texts[i:j])
        places = x.sum(axis=1, dtype=np.float32)
        if len(names) < 2:
            best, score, sure = np.zeros(j - i, int), np.ones(j - i), np.ones(j - i, bool)
        else:
            value = (x.astype(np.float32) @ matrix) / np.sqrt(np.maximum(places, 1))[:, None]
            best = value.argmax(axis=1)
            top = np.sort(value, axis=1)
            score = 1 / (1 + np.exp(-SHARPNESS * (top[:, -1] - top[:, -2]).astype(np.float64)))
            sure = (top[:, -1] >= bound) | (places < SURE_PLACES)
        lettered &= bool(names)
        langs += [names[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        scores[i:j] = np.where(lettered, score, 0.0)
        known[i:j] = lettered & sure
    return langs, scores, known


def identify(docs: DataFrame, model: Model, name_known: str | None = None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (which replace columns of these names), and ``name_known``: whether the model knows the language."""
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index("text")
    added = {"lang_pred": F.lit(""), "score": F.lit(0.0)} | ({name_known: F.lit(True)} if name_known else {})
    schema = kept.select("*", *(c.alias(n) for n, c in added.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, known = predict([t or "" for t in b.column(at).to_pylist()], shared.value)
            own = [pa.array(langs, pa.string()), pa.array(scores), *([pa.array(known)] if name_known else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], schema.names)

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents in a language that the model knows; the columns stay as they are.

    Those without a letter go, and those of ``SURE_PLACES`` distinct n-grams or more whose best value is under ``SURE_SHARE`` of
    the least that a training text as long has. A shorter text tells too little and stays.
    """
    model = train(docs)
    (name,) = _spark.fresh(docs.columns, "_known")
    clash = _spark.fresh(docs.columns, *(c for c in ("lang_pred", "score") if c in docs.columns))
    renamed = dict(zip((c for c in ("lang_pred", "score") if c in docs.columns), clash, strict=True))
    found = identify(docs.withColumnsRenamed(renamed), model, name).where(name)
    return found.select(*(F.col(renamed.get(c, c)).alias(c) for c in docs.columns))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
