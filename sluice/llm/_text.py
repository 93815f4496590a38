"""Vectorised text primitives over the UTF-8 buffers of Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+``. All of it is bytes: the separators are ASCII, so UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C17
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and the offsets of each (null counts as empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of some texts: ``starts``/``ends`` into ``data``; ``doc`` is each word's text, ``first`` each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, squeeze: bool = False):
        data = _LOWER[data] if lower else data
        n, docs = len(data), len(offsets) - 1
        sep = _SEP[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, sep[:-1]
            after[-1], after[:-1] = True, sep[1:]
            edges = offsets[(offsets > 0) & (offsets < n)]
            before[edges] = True
            after[edges - 1] = True
        word = ~sep
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(docs), self.count)
        if squeeze:  # words of a text are then one blank apart
            size = self.ends - self.starts
            at = np.concatenate(([0], np.cumsum(size + 1)))
            out = np.full(int(at[-1]), 0x20, np.uint8)
            fill = np.ones(len(out), bool)
            fill[at[1:] - 1] = False
            out[fill] = data[word]
            data, self.starts, self.ends = out, at[:-1], at[:-1] + size
        self.data = data

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; starts and ends ascend. Works on ``CHUNK_BYTES`` at a time, however long a text is."""
    sums = np.zeros(len(starts), np.uint64)
    step = CHUNK_BYTES + (1 << 15)
    up, down = _powers_to(min(len(data), step) + 1)
    for at in range(0, len(data), step):
        part = data[at : at + step]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        i, j = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, at + len(part)))
        s, e = np.maximum(starts[i:j], at) - at, np.minimum(ends[i:j], at + len(part)) - at
        own = (total[e] - total[s]) * down[s]
        for k in np.flatnonzero(starts[i:j] < at):  # spans that an earlier chunk began
            own[k : k + 1] *= np.uint64(pow(_BASE, at - int(starts[i + k]), 1 << 64))  # wraps, as sums of numbers of 64 bits do
        sums[i:j] += own
    return mix(sums + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay in one text, and the word at which each starts."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k]
    last = np.repeat(first[1:], np.diff(first))[: n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= last)
    return mix(out[at]), at
