"""The prefix trie of conversations and the spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import op11_prefix_trie as trie
from sluice.llm import op13_spelling as spelling
from sluice.llm._running import running
from sluice.llm.queries import queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows without equal turns, as a set of tuples."""
    own = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        b = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns if b == c else own.get(b, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    out = set()
    for s, of in members.items():
        under = [x for x in members if x[: len(s)] == s]
        kids = [x for x in under if len(x) == len(s) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under) for x in under)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
        out.add((min(of), len(s), min(members[s[:-1]]) if s else None, len(of), len(kids), leaves, saved, sha))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def got_trie(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = got_trie(queries()["op11_prefix_trie"](spark, SF))
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_deep_and_shared_conversations(spark, seed):
    rng, rows = random.Random(seed), []
    for c in [*range(-6, 40), 101, 204]:
        base = rng.randrange(3)
        n = rng.choice([1, 2, 5, 9, 14, 40])
        rows += [(c, t if t else None, rng.choice(["user", None]) if t > n - 2 else "user", None if rng.random() < 0.1 else f"é{base}.{t}" if rng.random() < 0.9 else rng.choice("ab")) for t in range(n)]
    rows.append((None, 3, "user", "nobody's"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("clash"), "ka": F.lit(1)}).repartition(7)
    got = got_trie(trie.prefix_trie(trie.rebuilt(trie.turns(df))))
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_copies_ties_and_turnless_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rows = [(5 * c, t, "u", f"t{t}") for c in range(40) for t in range(3)]
    short = [c for c in range(1000, 1300) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:5]
    rows += [(c, 0, "u", "gone") for c in short]  # no base, fewer own turns than h: a member of the root alone
    got = got_trie(trie.prefix_trie(trie.rebuilt(trie.turns(spark.createDataFrame(rows, SCHEMA).repartition(5)))))
    assert set(got) == plain_trie(rows) and len(got) == 4
    tied = spark.createDataFrame([(0, 1, "u", "x"), (0, 1, "u", "x"), (0, 1, "u", "y")], SCHEMA)
    one, two = (sorted(got_trie(trie.prefix_trie(trie.rebuilt(trie.turns(d))))) for d in (tied, tied.orderBy(F.desc("text")).coalesce(1)))
    assert one == two and len(one) == 4
    assert trie.prefix_trie(trie.rebuilt(trie.turns(tied.limit(0)))).count() == 0


def test_running_totals_of_a_group_in_many_tasks(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.randrange(-50, 50), rng.getrandbits(63)) for g, n in ((-3, 1), (0, 900), (4, 2), (9, 300)) for k in range(n)]
    df = spark.createDataFrame(rows, "g long, k long, s long, x long").repartition(6)
    for group in ("g", None):
        order = ["k"] if group else ["g", "k"]
        got = {(r.g, r.k): (r.run_s, r.run_x) for r in running(df, group, order, sums=("s",), xors=("x",)).collect()}
        last, want, s, x = None, {}, 0, 0
        for g, k, a, b in sorted(rows):
            s, x = (s + a, x ^ b) if not group or g == last else (a, b)
            last = g
            want[g, k] = s, x
        assert got == want


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    near_to = {w: [v for v in n if near(v, w)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) if vs else None for w, vs in near_to.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near_to[w]), n[form[w]] if form[w] else None) for w in n}


def plain_vocabulary(rows):
    words = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            words[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def got_variants(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_variants_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = got_variants(queries()["op13_spelling"](spark, SF))
    n = plain_vocabulary([(r.doc_id, r.text) for r in docs.collect()])
    few = {w: {v for v in n if near(v, w)} for w in random.Random(0).sample(sorted(n), 200)}
    assert len(got) == len(set(got)) == len(n) and {g[0]: g[3] for g in got} == n
    assert {g[0]: g[4] for g in got if g[0] in few} == {w: len(v) for w, v in few.items()}


@pytest.mark.parametrize("part_words", [2, 6, 4096])
def test_variants_of_made_words_in_parts_of_any_size(spark, part_words):
    rng = random.Random(part_words)
    n = {"".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7]))): rng.randrange(3, 50) for _ in range(250)}
    n |= {"prefix" * 4 + "".join(rng.choice("abé") for _ in range(5)): rng.randrange(3, 50) for _ in range(150)}
    n |= {"x" * 5: 3, "x" * 6: 6, "x" * 7: 12, "x" * 8: 24, "y" * 3000: 3, "y" * 2999: 9}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    got = got_variants(spelling.variants(df, part_words))
    assert len(got) == len(set(got)) and set(got) == plain_variants(n)


def test_odd_rows_of_the_vocabulary(spark):
    rows = [(1, "Étage étage ÉTAGE x×y÷zz don't"), (1, "Étage étage ÉTAGE x×y÷zz don't"), (None, "Étage " * 400), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1)})
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == plain_vocabulary(rows)
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0
    long = spark.createDataFrame([(7, "letters " * 200_000 + "a" * 300_000)], "doc_id long, text string")
    assert [(r.word, r.n) for r in spelling.vocabulary(long).collect()] == [("letters", 200_000)] or zlib.crc32(b"7:letters") % 97 == 0
