from pyspark.sql import functions as F

from sluice.functions import scalars as fn
from sluice.operators import flows, policy, predicates, tagging


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_full_match_is_not_partial(spark):
    df = spark.createDataFrame([("ab",), ("ab\n",), ("xab",), (None,)], "v string")
    got = df.select(predicates.full_match(F.col("v"), "ab").alias("f"), predicates.partial_match(F.col("v"), "ab").alias("p")).collect()
    assert [(r.f, r.p) for r in got] == [(True, True), (False, True), (False, True), (False, False)]


def test_reach_is_bounded_and_simple(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = rows(flows.reach(edges, ids(1), ids(1, 4, 5), 3).withColumn("p", flows.path_id(F.col("path"))), "source", "sink", "p")
    assert got == [(1, 4, "1-2-3-4")]


def test_suffix_dedup_keeps_longest(spark):
    df = spark.createDataFrame([("s", [1, 2, 3]), ("s", [2, 3]), ("s", [3]), ("t", [2, 3])], "k string, path array<long>")
    got = sorted((r.k, tuple(r.path)) for r in flows.suffix_dedup(df, ["k"]).collect())
    assert got == [("s", (1, 2, 3)), ("s", (3,)), ("t", (2, 3))]


def test_element_limit_keeps_one_of_long_pairs(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [1, 2, 3, 4]), (2, [1, 2, 3, 4]), (2, [1, 2, 3, 4, 5])], "k long, path array<long>")
    assert sorted((r.k, len(r.path)) for r in flows.element_limit(df, ["k"], 3).collect()) == [(1, 2), (2, 4)]


def test_this_filter_passes_short_paths(spark):
    nodes = spark.createDataFrame([(1, "this", None), (2, "a", "T"), (3, "b", "T"), (4, "c", None)], "id long, code string, this_type string")
    df = spark.createDataFrame([("one", [4]), ("torn", [2, 3, 4]), ("last", [1, 4]), ("good", [2, 4])], "path_id string, path array<long>")
    assert rows(flows.this_filter(df, nodes), "path_id") == [("good",), ("one",)]


def test_rules_merge_external_first(spark):
    df = spark.createDataFrame([("A", "in", ["x"], False, 1), ("A", "out", ["y"], True, 2)], "id string, name string, patterns array<string>, is_external boolean, ord int")
    assert [(r.name, r.patterns) for r in tagging.merge_rules(df).collect()] == [("out", ["y", "x"])]


def test_tags_of_a_rule(spark):
    rule = tagging.Rule("R", ("na.*",), cat_two="personal")
    nodes = spark.createDataFrame([(1, "name"), (2, "other"), (3, None)], "node_id long, name string")
    tags = tagging.rule_tags(tagging.tag_nodes(nodes, "name", [rule]), tagging.rule_table(spark, [rule]))
    assert (1, "personalREGULAR", "R") in rows(tags, "node_id", "name", "value") and {r.node_id for r in tags.collect()} == {1}


def test_policy_without_repositories_never_fails(spark):
    df = spark.createDataFrame([("r",)], "repo string")
    assert df.select(policy.applies(policy.Policy("p", repositories=()), F.col("repo")).alias("x")).first().x is False


def test_scalars(spark):
    df = spark.createDataFrame([("https://www.a.example/x", "UserAccount", 2048)], "u string, c string, n long")
    r = df.select(fn.url_host(F.col("u")).alias("h"), fn.class_table(F.col("c")).alias("t"), fn.size_text(F.col("n")).alias("s"), fn.arguments(F.lit('log(a, "b", c)')).alias("a")).first()
    assert (r.h, r.t, r.s, r.a) == ("a.example", "user_accounts", "2KB", ["log", "a", "c)"])
