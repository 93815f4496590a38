"""Tags are rows (node, name, value); matching a rule catalogue against nodes yields them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.predicates import allowed_file, any_of, compiles, full_match, partial_match

RULE_SCHEMA = "id string, name string, category string, patterns array<string>, domains array<string>, sensitivity string, is_sensitive boolean, node_type string, cat_one string, cat_two string, language string, is_external boolean"


@dataclass(frozen=True)
class Rule:
    id: str
    patterns: tuple[str, ...]
    name: str = ""
    category: str = ""
    domains: tuple[str, ...] = ()
    sensitivity: str = ""
    is_sensitive: bool = False
    node_type: str = "REGULAR"
    cat_one: str = "sources"
    cat_two: str = ""
    language: str = "UNKNOWN"
    is_external: bool = False
    filter_property: str = "method_full_name"
    file: str = ""
    is_generated: bool = False
    tags: dict = field(default_factory=dict, compare=False)

    @property
    def pattern(self) -> str:
        return any_of(list(self.patterns))


def valid(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if all(map(compiles, r.patterns))]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.id, r.name, r.category, list(r.patterns), list(r.domains), r.sensitivity, r.is_sensitive, r.node_type, r.cat_one, r.cat_two, r.language, r.is_external) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def merge_rules(rules: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each id: attributes of its first rule, external ones before others; patterns of all, in that order."""
    ranked = F.struct((~F.col("is_external")).alias("internal"), F.col(order).alias("ord"), "patterns", "name")
    out = rules.groupBy("id").agg(F.array_sort(F.collect_list(ranked)).alias("all"))
    return out.select("id", F.col("all")[0]["name"].alias("name"), F.flatten(F.transform("all", lambda x: x["patterns"])).alias("patterns"))


def first_rules(rules: DataFrame, order: str = "ord") -> DataFrame:
    """The first rule of each id, external ones before others."""
    return rules.groupBy("id").agg(F.min_by(F.struct("name", "is_external"), F.struct((~F.col("is_external")).alias("i"), order)).alias("r")).select("id", "r.*")


def matches(values: DataFrame, column: str, rules: list[Rule], full: bool = True) -> DataFrame:
    """(value, rule_id): distinct values are matched once, each pattern a literal, so that names that repeat cost one match."""
    test = full_match if full else partial_match
    distinct = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    hits = F.array(*[F.when(test(F.col("value"), r.pattern), F.lit(r.id)) for r in valid(rules)])
    return distinct.select("value", F.explode(F.array_compact(hits)).alias("rule_id"))


def tag_nodes(nodes: DataFrame, column: str, rules: list[Rule], full: bool = True) -> DataFrame:
    """Nodes with the id of every rule that their ``column`` matches."""
    found = matches(nodes, column, rules, full)
    return nodes.join(found, nodes[column] == found["value"]).drop("value")


def token_matches(name: Column, pattern: str) -> Column:
    """Some part of a column name, cut at blanks and dots, matches wholly."""
    return F.exists(F.split(name, "[ .]"), lambda t: t.rlike(rf"\A(?:{pattern})\z"))


def match_rows(rows: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """Each row once for every rule whose test holds, with its rule_id: one scan and no exchange, for texts and for tests of several columns."""
    if not tests:
        return rows.withColumn("rule_id", F.lit("")).where(F.lit(False))
    hits = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(i)) for i, t in tests])
    return rows.withColumn("rule_id", F.explode(F.array_compact(hits)))


def rule_tags(tagged: DataFrame, rules: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    """(repo, node_id, name, value) rows of each match: id, node type, categories, the composite key, and whether the rule is external.

    Nothing is tagged in a file that an exclusion matches.
    """
    if exclusions:
        tagged = tagged.where(allowed_file(F.col("file"), exclusions))
    node = [*(["repo"] if "repo" in tagged.columns else []), "node_id"]
    r = tagged.select(*node, "rule_id").join(F.broadcast(rules.withColumnRenamed("id", "rule_id")), "rule_id")  # the catalogue, read on the driver
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    one = F.struct("rule_id", "node_type", "cat_one", "cat_two", "is_external")
    plain = lambda x: [
        pair(F.lit("id"), x["rule_id"]),
        pair(F.lit("nodeType"), x["node_type"]),
        pair(F.lit("catLevelOne"), x["cat_one"]),
        pair(F.lit("catLevelTwo"), x["cat_two"]),
        pair(F.concat(x["cat_two"], x["node_type"]), x["rule_id"]),
    ]
    pairs = lambda x: F.when(x["is_external"], F.array(*plain(x), pair(F.lit("externalRule"), F.lit("")))).otherwise(F.array(*plain(x)))
    own = r.groupBy(*node).agg(F.collect_set(one).alias("rules"))  # a node's rules meet before they become tags: a fifth of the rows, and no tag twice
    tags = F.when(F.size("rules") == 1, pairs(F.col("rules")[0])).otherwise(F.array_distinct(F.flatten(F.transform("rules", pairs))))
    return own.select(*node, F.explode(tags).alias("t")).select(*node, "t.name", "t.value")


def merge_semantics(semantics: DataFrame) -> DataFrame:
    """One row for each signature: the union of its flow tokens, ordered."""
    tokens = semantics.select("signature", F.explode(F.split("flow", " ")).alias("t")).where("t <> ''")
    return tokens.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("flow"))
