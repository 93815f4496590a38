"""Row predicates of the traversal language. Full and partial regular-expression matches are different operators."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.patterns import required, searched


def _looked_for(value: Column, pattern: str, test: Column) -> Column:
    """The test, run only on values that hold a literal that the pattern cannot match without."""
    literals = required(pattern)
    if not literals:
        return test
    low = F.lower(value)
    some = F.contains(low, F.lit(literals[0]))
    for x in literals[1:]:
        some |= F.contains(low, F.lit(x))
    return some & test


def full_match(value: Column, pattern: str, dotall: bool = False) -> Column:
    """The whole of ``value`` matches; a null value does not. A dot crosses lines only with ``dotall``."""
    return F.coalesce(_looked_for(value, pattern, value.rlike(rf"{'(?s)' if dotall else ''}\A(?:{pattern})\z")), F.lit(False))


def partial_match(value: Column, pattern: str) -> Column:
    return F.coalesce(_looked_for(value, pattern, value.rlike(searched(pattern))), F.lit(False))


def any_of(patterns: list[str]) -> str:
    """The alternatives of a rule as one pattern."""
    return f"({'|'.join(patterns)})"


def compiles(pattern: str, spark: SparkSession | None = None) -> bool:
    """Whether Java, which runs the pattern, compiles it."""
    jvm = (spark or SparkSession.active())._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # of which Java's error of pattern syntax is one
        return False
    return True


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows for which the sub-traversal is not empty."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def either(left: DataFrame, flags: list[DataFrame], on: str) -> DataFrame:
    """Rows that at least one of the sub-traversals holds."""
    keys = flags[0].select(on)
    for f in flags[1:]:
        keys = keys.union(f.select(on))
    return left.join(keys.distinct(), on, "left_semi")


def allowed_file(path: Column, exclusions: list[str]) -> Column:
    """No exclusion rule matches the whole path; a rule that does not compile is passed over."""
    out = F.lit(True)
    for pattern in exclusions:
        if compiles(pattern):
            out &= ~full_match(path, pattern)
    return out


def not_constant(name: Column, code: Column) -> Column:
    """Neither a constant in capitals nor the receiver itself."""
    return (name != F.upper(name)) & (code != "this")


def exact_declaration(nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """Nodes declared by file and name, and by line where the declaration names one."""
    d = declared.select(F.col("file").alias("_file"), F.col("name").alias("_name"), F.col("line").alias("_line"), "rule_id")
    same = (F.col("file") == F.col("_file")) & (F.col("name") == F.col("_name")) & (F.col("_line").isNull() | (F.col("_line") == F.col("line")))
    return nodes.join(d, same).drop("_file", "_name", "_line")


def parted(rows: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of which ``test`` holds, and the others, those of an unknown test with them."""
    good = F.coalesce(test, F.lit(False))
    return rows.where(good), rows.where(~good)


def by_name_or_hint(pattern: str, name: str = "method_full_name", hints: str = "type_hints") -> Column:
    """The full name matches, or some type hint does."""
    some = F.exists(hints, lambda h: h.rlike(rf"\A(?:{pattern})\z"))
    return full_match(F.col(name), pattern) | F.coalesce(some, F.lit(False))
