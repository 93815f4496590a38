"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file's protobuf is parsed here; the normaliser (character map, extra white space, dummy prefix, metaspace marker), the
unigram scores or merge ranks and the byte fallback are rebuilt as a tokenizers pipeline, and probes at load time must give the ids
of the sentencepiece library. Where no piece crosses a metaspace boundary no merge or best path can, so a text is cut there,
each distinct segment of a batch is encoded once, in multithreaded batches, and texts are put together from that.

Sentencepiece adds unigram scores up in single precision from the text's beginning, tokenizers in double precision. Where two
paths of a segment are as near as single precision may turn them, which the distance of the best two tells, the text's path is
taken again in single precision as sentencepiece takes it, so that ties fall alike.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; ids outside the vocabulary or null
decode to nothing; control pieces decode to nothing; repeated rows are encoded one by one; other columns pass unchanged.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_SEGMENTS = 200_000  # of a worker, about 50 MB
THREADS = 2
PROBES = ("", " ", "The quick  brown fox.", "naïve café — 東京 🙂", "line\nbreak\ttab", "a" * 40, "  lead and trail  ", "x=1;y[2]+=3", "­​zero", "Ⅷ ﬁ ½")

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as numbers, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield tag >> 3, raw[at : at + size]
        at += size


def parse_model(raw: bytes) -> Model:
    out = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            out.kind = spec.get(3, UNIGRAM)
            out.byte_fallback, out.suffix_marker = bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            out.charsmap = spec.get(2, b"")
            out.dummy_prefix, out.squeeze, out.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    if out.kind not in (UNIGRAM, BPE) or out.suffix_marker or any(k == USER for *_, k in out.pieces):
        raise ValueError("only unigram and BPE models with a prefix marker and without user-defined pieces can be rebuilt")
    return out


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs that merge, best piece first."""
    ids = {p: k for k, (p, _, t) in enumerate(pieces) if t == NORMAL}
    rows = []
    for piece, score, kind in pieces:
        if kind == NORMAL and len(piece) > 1:
            rows += [(-score, ids[piece], k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
    return [(a, b) for *_, a, b in sorted(rows)]


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str = MODEL, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Regex, Tokenizer, models, normalizers

        with open(path, "rb") as f:
            self.model = m = parse_model(f.read())
        unk = next(k for k, p in enumerate(m.pieces) if p[2] == UNKNOWN)
        if m.kind == BPE:
            vocab = {p: k for k, (p, *_) in enumerate(m.pieces)}
            core = models.BPE(vocab, _merges(m.pieces), unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
        else:
            low = min((s for _, s, t in m.pieces if t == NORMAL), default=0.0) - 1e6
            core = models.Unigram([(p, s if t in (NORMAL, UNKNOWN) else low) for p, s, t in m.pieces], unk_id=unk, byte_fallback=m.byte_fallback)
        self.core = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        self.steps = normalizers.Sequence(steps) if steps else None
        self.split = None
        if m.escape and not any(MARK in p.lstrip(MARK) for p, _, t in m.pieces if t == NORMAL):
            self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache: dict[str, bytes] = {}
        self.margins: dict[str, tuple[float, float]] = {}
        self.scores = {p: (k, np.float32(v)) for k, (p, v, t) in enumerate(m.pieces) if t == NORMAL} if m.kind == UNIGRAM else {}
        self.longest = max(map(len, self.scores), default=0)
        self.unk, self.unk_score = unk, np.float32(min((v for _, v in self.scores.values()), default=np.float32(0)) - np.float32(10))
        self.bytes_ = [next((k for k, (p, _, t) in enumerate(m.pieces) if t == BYTE and p == f"<0x{b:02X}>"), unk) for b in range(256)] if m.byte_fallback else []
        self.marked = np.array([p.startswith(MARK) for p, *_ in m.pieces])
        blank = MARK if m.escape else " "
        out = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(blank, " ").encode() for p, _, t in m.pieces]
        self.size = np.array([len(b) for b in out])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(out), np.uint8)

    def normalise(self, text: str) -> str:
        if self.steps is not None:
            text = self.steps.normalize_str(text)
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def _segments(self, text: str) -> list[str]:
        if self.split is None:
            text = self.normalise(text)
            return [text] if text else []
        if self.steps is None and self.model.dummy_prefix and text and "  " not in text and text[-1] != " " and text[0] != " " and MARK not in text:
            return [MARK + w for w in text.split(" ")]
        return self.split.findall(self.normalise(text))

    def _learn(self, new: list[str]) -> None:
        """Encode segments that the cache lacks. Those of one marker, at the front, are encoded in runs; a piece with a marker starts a segment there."""
        plain, odd = [], []
        for s in new:
            (plain if self.split and s[0] == MARK and len(s) > 1 and MARK not in s[1:] else odd).append(s)
        runs = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for own, e in zip(runs, self.core.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False) if runs else [], strict=True):
            ids = np.array(e.ids, np.int32)
            at = (4 * np.append(np.flatnonzero(self.marked[ids]), len(ids))).tolist()
            raw = ids.tobytes()
            self.cache.update(zip(own, [raw[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))
        for s, e in zip(odd, self.core.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.cache[s] = np.array(e.ids, np.int32).tobytes()

    def _paths(self, text: str, kind: type) -> tuple[list[int], float, float]:
        """Piece ids of the best path in the precision of ``kind``, its score, and the least distance of the best two at any place."""
        n = len(text)
        score, back, near = [kind(0)] + [None] * n, [None] * (n + 1), np.inf

        def offer(at: int, value: float, start: int, piece: int) -> None:
            nonlocal near
            if back[at] is None or value > score[at]:
                near = min(near, float(value - score[at])) if back[at] is not None else near
                score[at], back[at] = value, (start, piece)
            else:
                near = min(near, float(score[at] - value))

        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                found = self.scores.get(text[i:j])
                if found:
                    offer(j, kind(found[1]) + score[i], i, found[0])
                    single |= j == i + 1
            if not single:
                offer(i + 1, kind(self.unk_score) + score[i], i, self.unk)
        ids: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece != self.unk:
                ids.append(piece)
            elif self.bytes_:
                ids += [self.bytes_[b] for b in reversed(text[start:at].encode())]
            elif not (ids and ids[-1] == self.unk and start + 1 == at and at < n and back_unk):
                ids.append(self.unk)
            back_unk = piece == self.unk
            at = start
        return ids[::-1], float(score[n]), near

    def _near_tie(self, segments: list[str]) -> bool:
        total, near = 0.0, np.inf
        for s in segments:
            known = self.margins.get(s)
            if known is None:
                _, value, margin = self._paths(s, float)
                known = self.margins[s] = (value, margin)
            total += known[0]
            near = min(near, known[1])
        return near <= 1e-6 + 8 * float(np.finfo(np.float32).eps) * abs(total)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        parts = [None if t is None else self._segments(t) for t in texts]
        if len(self.cache) > CACHE_SEGMENTS:
            self.cache.clear()
            self.margins.clear()
        get = self.cache.get
        found = [None if p is None else [get(s) for s in p] for p in parts]
        holes = [k for k, f in enumerate(found) if f is not None and None in f]
        if holes:
            self._learn(list({s for k in holes for s, v in zip(parts[k], found[k], strict=True) if v is None}))
            for k in holes:
                found[k] = [get(s) if v is None else v for s, v in zip(parts[k], found[k], strict=True)]
        out = [None if f is None else np.frombuffer(b"".join(f), np.int32) for f in found]
        if self.model.kind == UNIGRAM:
            for k, p in enumerate(parts):
                if p and self._near_tie(p):
                    out[k] = np.array(self._paths("".join(p), np.float32)[0], np.int32)
        return out

    def decode(self, ids: list[int] | np.ndarray | None) -> str | None:
        if ids is None:
            return None
        ids = np.array([-1 if i is None else i for i in ids] if isinstance(ids, list) else ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.size))]
        size = self.size[ids]
        at = np.cumsum(size)
        raw = self.flat[np.arange(at[-1] if len(at) else 0) + np.repeat(self.start[ids] - at + size, size)].tobytes()
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def verify(self, path: str = MODEL, probes: tuple[str, ...] = PROBES) -> None:
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_file=path)
        for text, ids in zip(probes, self.encode(list(probes)), strict=True):
            want = known.encode(text)
            if ids.tolist() != want or self.decode(ids) != known.decode(want):
                raise ValueError(f"the rebuilt model differs from sentencepiece on {text!r}")


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str = MODEL, threads: int = THREADS) -> Codec:
    """The worker's codec of a model file, built and verified once."""
    if (path, threads) not in _codecs:
        _codecs[path, threads] = c = Codec(path, threads)
        c.verify(path)
    return _codecs[path, threads]


def _lists(ids: list[np.ndarray | None]) -> pa.ListArray:
    size = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
    flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]), pa.int32())
    return pa.ListArray.from_arrays(pa.array(size, pa.int32(), mask=np.array([*(x is None for x in ids), False])), flat)


def encode(docs: DataFrame, path: str = MODEL, threads: int = THREADS, rows: int = 512) -> DataFrame:
    """All columns of ``docs`` and ``ids`` (which replaces a column of that name)."""
    return _encode(docs.drop("ids"), path, threads, rows, False)


def round_trip(docs: DataFrame, path: str = MODEL, threads: int = THREADS, rows: int = 512) -> DataFrame:
    """``decode(encode(docs))`` in one pass: one worker for a task, and texts and ids cross to Python once."""
    return _encode(docs.drop("ids", "decoded"), path, threads, rows, True)


def _encode(kept: DataFrame, path: str, threads: int, rows: int, back: bool) -> DataFrame:
    at = kept.columns.index("text")
    wide = kept.withColumn("ids", F.lit(None).cast("array<int>"))
    schema = (wide.withColumn("decoded", F.lit(None).cast("string")) if back else wide).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, threads)
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                ids = c.encode(b.column(at).to_pylist())
                decoded = [pa.array([c.decode(x) for x in ids], pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(ids), *decoded], schema.names)

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """All columns of ``encoded`` and ``decoded`` (which replaces a column of that name), the text of ``ids``."""
    kept = encoded.drop("decoded")
    at = kept.columns.index("ids")
    schema = kept.withColumn("decoded", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, threads)
        for b in batches:
            column = b.column(at)
            texts = [c.decode(_ids(column[k])) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema.names)

    return kept.mapInArrow(run, schema)


def _ids(cell: pa.ListScalar) -> np.ndarray | None:
    return pc.fill_null(cell.values, -1).to_numpy(zero_copy_only=False) if cell.is_valid else None


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = round_trip(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.length("decoded").cast("long").alias("decoded_chars"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
