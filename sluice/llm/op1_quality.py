"""Quality rules by distribution divergence, in DataFrame functions only.

``quality_features`` counts, in one narrow pass, what the rules need of each text; ``language_references`` adds the
counts up into one character-class and one common-word histogram for each language; ``judge`` keeps a document whose
histograms are near those of some language in Jensen-Shannon distance.

Defined cases: a null or empty text has no words and fails the base rules; a null ``lang`` adds to no reference; without
any reference the base rules alone decide; repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark

WORD = r"[^\x20\x09-\x0D]+"
CLASSES = ("space", "upper", "digit", "symbol", "punct", "wide", "lower")
# Frequent function words of four languages.
COMMON = (
    "the of and to in a is that it for on was be as with by this are at from or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "de la le et les des en un du une que est pour qui dans "
    "el y los del se las por con no para su al lo como"
).split()

POSITION_BITS = 24  # texts of more windows sort pairs of hash and place instead of packed numbers
MIN_WORDS = 50
MIN_CLASS_CHARS = 200  # below, the character histogram is too thin to judge
MIN_COMMON_WORDS = 150  # likewise for the common words
MIN_REFERENCE_WORDS = 1000  # a language with fewer words gives no reference
MAX_CLASS_DISTANCE = 0.28
MAX_COMMON_DISTANCE = 0.325


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimiser merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return _let(windows, of_windows)

    def of_windows(w: Column) -> Column:
        low = (1 << POSITION_BITS) - 1
        packed = F.sort_array(F.transform(w, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(w) <= low, _let(packed, lambda s: _let(of_packed(s), lambda c: of_candidates(w, c, low)))).otherwise(_let(pairs, of_pairs))

    lead = lambda x: F.shiftright(x, POSITION_BITS)

    def of_packed(s: Column) -> Column:
        """Windows whose leading bits are those of a neighbour."""
        return F.filter(s, lambda x, i: F.coalesce(lead(x) == lead(F.get(s, i - 1)), F.lit(False)) | F.coalesce(lead(x) == lead(F.get(s, i + 1)), F.lit(False)))

    def of_candidates(w: Column, s: Column, low: int) -> Column:
        """Equal windows lie side by side, but for others with the same leading bits: so two places each way are compared in full."""
        at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
        same = lambda x, i, d: F.coalesce(F.get(w, at(x)) == F.get(w, at(F.get(s, i + d))), F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1) | same(x, i, -2) | same(x, i, 2))
        return _let(F.sort_array(F.transform(twice, at)), covered)

    def of_pairs(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True))
        return _let(F.sort_array(F.transform(twice, lambda x: x["at"])), covered)

    def covered(at: Column) -> Column:
        return _sum(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("long")))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _runs(words: Column) -> Column:
    """(word, count) of each common word in the text."""

    def of_sorted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return _let(starts, lambda at: F.transform(at, lambda p, i: F.struct(F.get(s, p).alias("word"), (F.coalesce(F.get(at, i + 1), F.size(s)) - p).cast("long").alias("n"))))

    short = F.filter(words, lambda w: F.octet_length(w) <= max(len(w.encode()) for w in COMMON))
    known = F.filter(F.transform(short, F.lower), lambda w: w.isin(*sorted(set(COMMON))))
    return _let(F.sort_array(known), of_sorted)


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, ``classes`` (counts in the order of CLASSES) and ``runs`` of common words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    df = docs.select("doc_id", "lang", text.alias("text")).withColumns(
        {
            "words": F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "marks": F.regexp_extract_all("text", F.lit(r"[\p{Lu}0-9!-/:-@\[-`{-~]"), F.lit(0)),
        }
    )
    df = df.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("marks", lambda c: c.isin(*"#*$%&|<>"))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        _runs(F.col("words")).alias("runs"),
        F.length("text").cast("long").alias("_chars"),
        F.octet_length("text").cast("long").alias("_bytes"),
        F.size("marks").cast("long").alias("_marks"),
        F.size(F.filter("marks", lambda c: c.between("0", "9"))).cast("long").alias("_digit"),
        F.size(F.filter("marks", lambda c: c.between("A", "Z") | (c > "~"))).cast("long").alias("_upper"),
    )
    wide = F.col("_bytes") - F.col("_chars")
    punct = F.col("_marks") - F.col("_digit") - F.col("_upper") - F.col("n_symbols")
    counts = [F.col("_chars") - F.col("word_chars"), F.col("_upper"), F.col("_digit"), F.col("n_symbols"), punct, wide]
    rest = F.greatest(F.lit(0).cast("long"), F.col("word_chars") - F.col("_marks") - wide)
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.array(*counts, rest).alias("classes"), "runs", _base_failed().alias("base_failed"))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def language_references(features: DataFrame) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Of each language: shares of the character classes, and of the common words among all words ('' is the rest).

    Collects one short row for each language and common word, whatever the size of the corpus.
    """
    usable = features.where(~F.col("base_failed") & F.col("lang").isNotNull())
    sums = [F.sum(F.get("classes", F.lit(i))).alias(c) for i, c in enumerate(CLASSES)]
    by_class = {r["lang"]: r for r in usable.groupBy("lang").agg(F.sum("n_words").alias("words"), *sums).where(F.col("words") >= MIN_REFERENCE_WORDS).collect()}
    words: dict[str, dict[str, int]] = {}
    for r in usable.select("lang", F.explode("runs").alias("r")).groupBy("lang", "r.word").agg(F.sum("r.n").alias("n")).collect():
        words.setdefault(r["lang"], {})[r["word"]] = r["n"]
    out = {}
    for lang, r in sorted(by_class.items()):
        total, known = sum(r[c] for c in CLASSES), words.get(lang, {})
        shares = {w: n / r["words"] for w, n in sorted(known.items())}
        out[lang] = [r[c] / total for c in CLASSES], shares | {"": max(0.0, 1 - sum(shares.values()))}
    return out


def _term(p: Column, q: Column) -> Column:
    """What a category with shares p > 0 and q adds to twice the divergence, less what it would add at p = 0."""
    both = p + q
    return F.when(p > 0, p * F.log2(2 * p / both) + F.when(q > 0, q * F.log2(2 * q / both)).otherwise(F.lit(0.0)) - q).otherwise(F.lit(0.0))


def _distance(terms: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), (F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + 1) / 2))


def _class_distance(shares: list[float]) -> Column:
    q = F.array(*map(F.lit, shares))
    total = F.greatest(_sum(F.col("classes")), F.lit(1).cast("long"))
    return _distance(F.transform("classes", lambda n, i: _term(n / total, F.get(q, i))))


def _common_distance(shares: dict[str, float]) -> Column:
    q = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    rest = F.col("n_words") - _sum(F.transform("runs", lambda r: r["n"]))
    runs = F.concat("runs", F.array(F.struct(F.lit("").alias("word"), rest.alias("n"))))
    return _distance(F.transform(runs, lambda r: _term(r["n"] / F.greatest(F.col("n_words"), F.lit(1).cast("long")), F.coalesce(F.try_element_at(q, r["word"]), F.lit(0.0)))))


def judge(features: DataFrame, references: dict) -> DataFrame:
    """Adds class_distance, common_distance (to the nearest reference; null without one) and kept."""
    least = lambda cols: F.array_min(F.array(*cols)) if cols else F.lit(None).cast("double")
    df = features.withColumns({"class_distance": least([_class_distance(s) for s, _ in references.values()]), "common_distance": least([_common_distance(w) for _, w in references.values()])})
    chars = _sum(F.col("classes"))
    far = ((chars >= MIN_CLASS_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | ((F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("common_distance") > MAX_COMMON_DISTANCE))
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Features, distances and verdict of every document. The features are written once, as both passes read them."""
    features = _spark.materialise(quality_features(docs), "quality")
    return judge(features, language_references(features))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_spark.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
