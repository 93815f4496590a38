"""Literals of patterns: what they are, and that looking for them changes no match."""

import random

from pyspark.sql import functions as F

from sluice.functions.patterns import required, searched
from sluice.operators import predicates, tagging
from sluice.operators.tagging import Rule


def test_required_literals():
    assert required(r"(?i).*first[_-]?name.*") == ("first",)
    assert required(r".*(mongo|mysql|s3\.bucket).*") == ("mongo", "mysql", "s3.bucket")
    assert required(r"db[.]save.*") == ("db.save",) and required(r"org\.apache\.http.*") == ("org.apache.http",)
    assert required(r"(abcd)?x+") == () and required(r"a|bcd") == () and required(r"[abc]{4}") == () and required("") == ()
    assert required(r"\p{Lu}name") == () and required(r"étage") == () and required("(unclosed") == ()
    assert required(r"(?:token){2,}") == ("token",) and required(r"(?!secret)\w+") == ()


def test_matches_are_those_without_looking(spark, monkeypatch):
    rng = random.Random(3)
    words = ["first", "name", "mail", "card", "user", "x", "_", ".", "ID", "É"]
    values = sorted({"".join(rng.choice(words) for _ in range(rng.randrange(5))) for _ in range(400)})
    parts = ["first[_]?name", "(?i).*e?mail.*", ".*(card|user)[._]?id", "(user)?name", ".*(?:name){2}.*", "[a-z]+mail", ".*card.*|x+", "(?i)É?user.*", ".*", "(?i)(first|mail|card).*name"]
    rules = [Rule(f"R{k}", (rng.choice(parts), rng.choice(parts))) for k in range(60)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    run = lambda: {(r.value, r.rule_id) for full in (True, False) for r in tagging.matches(df, "v", rules, full).withColumn("rule_id", F.concat("rule_id", F.lit(str(full)))).collect()}
    with_ = run()
    monkeypatch.setattr(predicates, "required", lambda _: ())
    assert with_ == run() and len(with_) > 1000


def test_searches_are_without_open_ends(spark):
    assert searched(r"(.*[\w.]+@[\w.]+.*)") == r"([\w.]@[\w.]+)" and searched("((?i).*licen[sc]e.*)") == "((?i)licen[sc]e)" and searched(r"(All rights reserved\.)") == r"(All rights reserved\.)"
    for same in (r"(.*a|b.*)", r"(.*+a)", r"(.*(a)b)", r"(a\.*)", r"(^.*a)", r"([a-z]++a)", r"([^a]+b)", r"(a)(b)", "a.*", r"([a-z]+?b)", r"(a\b.*$)"):
        assert searched(same) == same
    lines = ["x" * 30000, "y " * 15000, "a@", "@b", "1.2@c", "LICENSE", "a\nlicence"]
    df = spark.createDataFrame([(x,) for x in [*lines, "\n".join([lines[0], lines[3], lines[1], "licens"])]], "v string")
    for pattern in (r"(.*[\w.]+@[\w.]+.*)", "((?i).*licen[sc]e.*)"):
        want = {r.v for r in df.where("length(v) < 100").where(F.col("v").rlike(pattern)).collect()}
        assert {r.v for r in df.where(predicates.partial_match(F.col("v"), pattern)).collect()} == want
