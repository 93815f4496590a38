"""A unigram model made by hand (not trained), with scores that tie, against the sentencepiece library."""

import random
import struct

import pytest
import sentencepiece

from sluice.llm.op2_sentencepiece import Codec


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, wire, value):
    return varint(number << 3 | wire) + (varint(len(value)) + value if wire == 2 else varint(value) if wire == 0 else value)


def model(pieces, byte_fallback):
    out = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, t)) for p, s, t in pieces)
    out += field(2, 2, field(3, 0, 1) + field(35, 0, int(byte_fallback)))
    return out + field(3, 2, field(1, 2, b"identity"))


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_ties_fall_as_in_sentencepiece(tmp_path, byte_fallback):
    rng = random.Random(5)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    words = {"▁", "#", "##", "a", "b", "ab", "ba", "aa", "aba", "▁a", "▁ab", "▁#", "c", "abc", "bc", "▁b"}
    pieces += [(w, -round(rng.choice([1.1, 2.2, 3.3]) * len(w) + rng.choice([0, 0.1, 0.7]), 4), 1) for w in sorted(words)]
    path = tmp_path / "m.model"
    path.write_bytes(model(pieces, byte_fallback))
    known, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), Codec(str(path))
    texts = ["", "###", "#" * 101, "ab " * 50, "zz é 東", "é z"] + ["".join(rng.choice("aabbc## z") for _ in range(rng.randint(1, 400))) for _ in range(400)]
    got = own.encode(texts)
    assert [x.tolist() for x in got] == known.encode(texts)
    assert [own.decode(x) for x in got] == [known.decode(x.tolist()) for x in got]
