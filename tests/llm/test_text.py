import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import _text
from sluice.llm.op3_lines import aligned_places, line_hashes, patience
from sluice.llm.op4_simhash import bucket_links
from sluice.llm.op5_sharding import hypergeometric, matrix, permute
from sluice.llm.op6_decontamination import Matcher, myers, normal
from sluice.llm.op7_passages import compact_windows, passages
from sluice.llm.op9_pitman_yor import CLASSES, GROUPS, Restaurants, class_law, seat
from sluice.llm.op10_html import blocks_of, declared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabÄß🙂\x0b.", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = _text.buffer_of(pa.array(texts, pa.string()))
    w = _text.Words(data, offsets, lower=False, squeeze=True)
    raw = w.data.tobytes()
    got = [[raw[w.starts[k] : w.ends[k]].decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]


@settings(deadline=None)
@given(st.lists(st.text(alphabet="ab\n ", max_size=20), max_size=5))
def test_lines_are_those_of_split(texts):
    data, offsets = _text.buffer_of(pa.array(texts, pa.string()))
    h, count, of = line_hashes(data, offsets)
    assert [int(c) for c in count] == [max(len(WORD.findall(x)), len(x) // 6) if WORD.search(x) else 0 for t in texts for x in t.split("\n")]
    seen = {}
    for x, k in zip([x for t in texts for x in t.split("\n") if WORD.search(x)], h[h != 0].tolist(), strict=True):
        assert seen.setdefault(x, k) == k
    assert len(set(seen.values())) == len(seen)


def test_patience_aligns_in_order():
    assert patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert aligned_places(np.array([5, 6, 7]), np.array([6, 0, 7, 1]), np.array([9, 0, 1, 9])) == [0, 2]


@settings(deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=8), st.text(alphabet="abc", max_size=20))
def test_myers_equals_dynamic_programming(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    assert myers(item, text)[0] == min(row)


def test_matcher_finds_edited_items():
    item = "the quick brown fox jumps over the lazy dog and then runs far away"
    m = Matcher([(7, item), (8, "short"), (9, None)])
    assert m.matches("x " * 50 + item.replace("quick", "quikc").upper() + " y")[0][:2] == (7, 2)
    assert m.matches("shortly") == [] and m.matches("so Short.")[0][0] == 8 and m.matches(None) == [] and normal(None) == ""


def test_bucket_links_have_the_components_of_all_pairs():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fp = list({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for b in base for _ in range(8)})

    def roots(pairs):
        up = list(range(len(fp)))
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in pairs:
            up[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(fp))]

    brute = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    for size in (4, 10_000):
        assert roots(bucket_links(np.array(fp, np.uint64), bucket_rows=size)) == roots(brute)


def test_matrix_has_exact_margins_and_the_law():
    m = matrix([5, 0, 7, 3], [4, 4, 4, 3])
    assert m.sum(axis=1).tolist() == [5, 0, 7, 3] and m.sum(axis=0).tolist() == [4, 4, 4, 3]
    rng = random.Random(1)
    draws = [hypergeometric(rng, 300, 700, 100) for _ in range(4000)]
    assert abs(np.mean(draws) - 30) < 0.4 and abs(np.var(draws) - 100 * 0.3 * 0.7 * 900 / 999) < 1.5


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permute_is_a_permutation(n):
    assert sorted(permute(np.arange(n), np.full(n, n), np.full(n, 5, np.uint64)).tolist()) == list(range(n))


def test_compact_windows_hold_every_long_subsequence_once():
    h = np.random.default_rng(0).integers(0, 1 << 63, 60).astype(np.uint64)
    doc = np.repeat([0, 1], 30)
    first, stop = np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
    _, l, c, r = compact_windows(h, doc, first, stop, 7, 0)
    for lo, hi in ((0, 30), (30, 60)):
        for a in range(lo, hi):
            for b in range(a + 6, hi):
                assert sum((l <= a) & (a <= c) & (c <= b) & (b <= r)) == 1


def test_passages_near_and_exact():
    a = np.arange(200, dtype=np.uint32)
    b = np.concatenate([np.arange(900, 930), np.arange(50, 120), np.arange(800, 830)]).astype(np.uint32)
    assert passages(a, b) == [(30, 100, 50, 120, 1.0)] and passages(a, np.arange(500, 600, dtype=np.uint32)) == []


def test_restaurants_sum_to_one():
    dish, word, group, count = np.array([0, 1, 2, 0]), np.array([0, 0, 1, 2]), np.array([0, 0, 0, 1]), np.array([5, 1, 300, 1])
    m = Restaurants(dish, [word, group], count, 3, 0)
    for u, g in ((0, 0), (1, 0), (2, 1), (-1, 0), (-1, 7)):
        total = m.predict(np.arange(4), [np.full(4, u), np.full(4, g)]).sum()
        assert abs(total - 1) < 1e-9
    for level in m.levels:
        assert ((level.tables <= level.count) & (level.tables >= np.minimum(level.count, 1))).all()
    for lower, upper in zip(m.levels, m.levels[1:], strict=False):
        assert (np.bincount(lower.parent, lower.tables, len(upper.count)) == upper.count).all()
    assert np.allclose((10 ** class_law(np.zeros((GROUPS, CLASSES), int))).sum(axis=1), 1, atol=1e-5)


def test_seats_of_a_party_follow_the_restaurant_process():
    """Tables of a party of three, one customer after another, against the probabilities worked out by hand."""
    rng, d, strength, prior = np.random.default_rng(1), 0.5, 1.0, 0.25
    got = np.bincount(seat(np.full(40_000, 3), np.full(40_000, 2), np.full(40_000, prior), d, strength, rng), minlength=4)[1:] / 40_000
    fresh = lambda t: (strength + d * (2 + t)) * prior
    second = fresh(1) / (fresh(1) + 1 - d)
    one = (1 - second) * (2 - d) / (fresh(1) + 2 - d)
    three = second * fresh(2) / (fresh(2) + 2 - 2 * d)
    assert np.allclose(got, [one, 1 - one - three, three], atol=0.01)


def test_blocks_leave_out_what_the_markup_names():
    page = '<body><nav>menu</nav><article><header><h1>Head</h1></header><p>One &amp; <b>two<br>three<p>Four<div class="ad-box">buy</div><form>x</form><aside>s</aside></article><footer>f</footer>'
    assert declared(blocks_of(page)) == ["Head", "One & two three", "Four"]
    assert blocks_of(None) == [] and blocks_of("<p>cut <a href") == [("open", "cut")]
