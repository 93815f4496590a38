"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import op12_jaccard as jaccard
from sluice.llm.queries import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """(doc_id, n_shingles, component_id) by comparing each row with each."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_classes_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries()["op12_jaccard"](spark, SF)) == plain(rows)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
    return out


def made(seed, groups=8, each=25):
    """Groups of edited copies about the threshold, a passage that many texts share, and copies of one text."""
    rng, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(30)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.choice([12, 40, 120, 200]))]
        rows += [" ".join(edited(rng, base, rng.randrange(1 + len(base) // 20))) for _ in range(each)]
        rows.append(" ".join(base))
    rows += [" ".join([*(f"u{k}x{j}" for j in range(rng.randrange(60))), *passage]) for k in range(40)]
    rows += ["one text with many copies in many tasks of the job"] * 30 + ["a b", "A  b", "a b c", None, "", " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize(("seed", "groups", "limits"), [(0, 8, {}), (1, 8, {"region_rows": 12}), (2, 3, {"region_rows": 12, "region_bytes": 4000})])
def test_made_groups_in_regions_of_any_size(spark, seed, groups, limits):
    rows = made(seed, groups)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("clash"), "key": F.lit(1), "n": F.lit("x")}).repartition(6)
    assert got(jaccard.jaccard_groups(df, **limits)) == plain(rows)


def test_odd_rows(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (1, "other text of the same id"), (None, " ".join(words)), (None, "alone with no id at all"), (5, None), (6, "Ä b C d É"), (7, "Ä B c d É"), (8, " ".join(words[:90]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jaccard.jaccard_groups(df)) == plain(rows)
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0
    long = [(1, " ".join(f"v{k % 9973} {k}" for k in range(600_000))), (2, " ".join(f"v{k % 9973} {k}" for k in range(500_000)))]
    assert got(jaccard.jaccard_groups(spark.createDataFrame(long, "doc_id long, text string"))) == [("1", 1_199_996, "1"), ("2", 999_996, "1")]


@pytest.mark.parametrize("leaf", [4, 64])
def test_regions_joined_in_a_task_have_the_classes_of_all_pairs(leaf):
    rng = random.Random(leaf)
    texts = [t for _, t in made(3, groups=5, each=20) if t and t.strip()]
    sets = [np.unique(np.array([hash(x) & (2**63 - 1) for x in shingles(t)], np.uint64)) for t in texts]
    labels = list(range(len(sets)))
    rng.shuffle(labels)
    forest = jaccard.Forest(labels)
    for i, j in jaccard.region_links(sets, labels, leaf):
        assert jaccard.linked(jaccard.common(sets[i], sets[j]), len(sets[i]), len(sets[j]))
        forest.join(i, j)
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.linked(jaccard.common(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                assert forest.find(i) == forest.find(j)
