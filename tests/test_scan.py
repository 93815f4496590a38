"""Whole scans: every profile runs on one program, and what each pass adds is in the result."""

import pytest

from sluice.operators import graph
from sluice.plans import profiles
from sluice.sources import rules
from sluice.sources.rules import Catalogue, Flow, Verdict
from tests.program import got, node, program, properties
from sluice.operators.tagging import Rule

MAIL = Rule("Data.Sensitive.Mail", ("(?i)e?mail",), cat_one="sources", name="Mail", sensitivity="high", is_sensitive=True)
SINKS = (
    Rule("Storages.Db.Write", ("db[.]save.*",), cat_one="sinks", cat_two="storages", name="Db"),
    Rule("Storages.Db.Read", ("repo[.]find.*",), cat_one="sinks", cat_two="storages", name="Db(Read)"),
    Rule("Leakages.Log.Info", ("log[.]info.*",), cat_one="sinks", cat_two="leakages", name="Log"),
    Rule("Sinks.ThirdParties.API", (".*third[.]example.*",), cat_one="sinks", cat_two="third_parties", node_type="api", name="API"),
)
COLLECT = (Rule("Collections.Rest", ("(Get|Post)Mapping",), cat_one="collections", cat_two="annotations", name="Rest"),)
POLICIES = (
    Verdict("P.Flow", action="deny", flow=Flow(("Data.*",), ("Storages.*",))),
    Verdict("P.Process", action="deny", flow=Flow(("Data.*",), ())),
)
THREATS = (Verdict("Threats.Sharing.IsParameterHardcoded"), Verdict("Threats.Leakage.isDataLeakingToLog", flow=Flow(("Data.*",), ("Leakages.*",))))
CATALOGUE = Catalogue(sources=(MAIL,), sinks=SINKS, collections=COLLECT, policies=POLICIES, threats=THREATS)


def shop(spark):
    """A user class, a handler that takes a mail, passes it to a helper over a call, and saves it there; a log and a read beside."""
    nodes = [
        node(1, "TYPE_DECL", "User", type="a.User"), node(2, "MEMBER", "email", type="String"),
        node(10, "METHOD", "handle", full="a.C.handle:void()"), node(11, "PARAMETER", "mail", "mail=1", type="String", arg=1), node(12, "ANNOTATION", "PostMapping", '@PostMapping("/users")'),
        node(13, "IDENTIFIER", "email", type="String"), node(14, "CALL", "helper", "helper(email)", full="a.C.helper:void(String)"), node(15, "IDENTIFIER", "value", arg=1),
        node(20, "METHOD", "helper", full="a.C.helper:void(String)"), node(21, "PARAMETER", "x", type="String", arg=1), node(22, "CALL", "save", "db.save(x)", full="db.save:void(String)"), node(23, "IDENTIFIER", "x", arg=0),
        node(30, "CALL", "info", "log.info(email)", full="log.info:void(String)"), node(31, "IDENTIFIER", "email", "email", arg=0),
        node(40, "CALL", "findUser", "repo.findUser()", full="repo.findUser:a.User()", type="a.User"),
        node(50, "LITERAL", code='"https://third.example/v1"'), node(51, "CALL", "post", "client.post(url)", full="org.apache.http.Client.post:void(String)"), node(52, "IDENTIFIER", "url", arg=1),
    ]
    edges = [
        (1, "AST", 2), (10, "AST", 11), (10, "AST", 12), (10, "CONTAINS", 14), (14, "ARGUMENT", 15), (14, "CALL", 20), (20, "AST", 21), (20, "CONTAINS", 22), (22, "ARGUMENT", 23),
        (11, "FLOWS", 13), (13, "FLOWS", 15), (21, "FLOWS", 23), (23, "FLOWS", 22), (13, "FLOWS", 31), (31, "FLOWS", 30), (30, "ARGUMENT", 31), (50, "FLOWS", 52), (52, "FLOWS", 51), (51, "ARGUMENT", 52),
    ]
    return program(spark, nodes, edges)


def context(spark, language, **more):
    return profiles.Context(spark, shop(spark), CATALOGUE, language, properties=properties(spark, (90, "app.yml", "url", "/api/v1/users"), (91, "app.yml", "spring.application.name", "shop")), **more)


def test_java_scan_from_end_to_end(spark):
    done = profiles.scan(context(spark, "java"))
    final = {(r.source_id, r.sink_id, r.path_id) for r in done.flow_stages["final"].collect()}
    assert ("Data.Sensitive.Mail", "Storages.Db.Write", "13-15-21-23-22") in final  # over a call, by the summary of the sink
    assert ("Data.Sensitive.Mail", "Leakages.Log.Info", "13-31-30") in final
    assert ("Data.Sensitive.Mail", "Storages.Db.Read", "2-40") in final  # what the read returns has a sensitive member
    tags = {(r.node_id, r.name, r.value) for r in done.program.tags.collect()}
    assert (51, "apiUrlSinks.ThirdParties.API.third.example", '"https://third.example/v1"') in tags and (51, "id", "Sinks.ThirdParties.API.third.example") in tags
    found = {(r.policy_id, r.kind) for r in done.violations.collect()}
    assert {("P.Flow", "dataflow"), ("P.Process", "processing"), ("Threats.Sharing.IsParameterHardcoded", "threat"), ("Threats.Leakage.isDataLeakingToLog", "threat")} <= found
    points = [r for r in done.points.collect()]
    assert [(r.id, r.end_point) for r in points] == [(10, "/users")]
    sections = {k: v.count() for k, v in profiles.sections(done).items()}
    assert sections["collections"] == 1 and sections["egressProperties"] == 1 and sections["basePaths"] == 1 and sections["violations"] > 3 and sections["fileLinks"] == 0
    assert set(profiles.sheets(done)) >= {"elements", "flows", "apis", "urls", "http", "unresolved", "unresolvedFlows", "declarations"}


@pytest.mark.parametrize("language", ["javascript", "python", "ruby"])
def test_profiles_find_the_flow_over_the_call(spark, language):
    done = profiles.scan(context(spark, language))
    final = {(r.sink_id, r.path_id) for r in done.flow_stages["final"].collect()}
    assert ("Storages.Db.Write", "13-15-21-23-22") in final
    assert {"sources", "sinks", "dataFlow", "violations"} <= set(profiles.sections(done))


def test_default_profile_syncs_columns(spark):
    cols = spark.createDataFrame([("r", 1, "models/users.sql", "users", "email", "email", 1)], "repo string, id long, file string, table_name string, column_name string, name string, line int")
    syncs = spark.createDataFrame([("r", 2, "s.yml", "users", "Salesforce", False)], "repo string, id long, file string, model string, actual_destination_name string, schedule_paused boolean")
    c = Catalogue(sources=(MAIL,), sinks=(Rule("ThirdParties.Salesforce", ("Salesforce",), cat_one="sinks", cat_two="third_parties"),))
    done = profiles.scan(profiles.Context(spark, program(spark, [node(9, "FILE", "x")]), c, "default", sql_columns=cols, syncs=syncs))
    assert got(done.flow_stages["final"], "source_id", "sink_id", "path_id") == [("Data.Sensitive.Mail", "ThirdParties.Salesforce", "1-2")]


def test_two_repositories_in_one_scan_do_not_mix(spark):
    p = shop(spark)
    other = graph.Program(p.nodes.unionByName(p.nodes.selectExpr(*["'s' as repo" if c == "repo" else c for c in p.nodes.columns])), p.edges.unionByName(p.edges.selectExpr("'s' as repo", "src", "dst", "label")), p.tags)
    done = profiles.scan(profiles.Context(spark, other, CATALOGUE, "go"))
    rows = [(r.repo, r.sink_id, r.path_id) for r in done.flow_stages["final"].collect()]
    assert len(rows) == len(set(rows)) and {r[1:] for r in rows if r[0] == "r"} == {r[1:] for r in rows if r[0] == "s"}


def test_versions_of_the_api_tagger(spark):
    from sluice.operators import sinks

    setting = rules.Catalogue().setting
    imports = spark.createDataFrame([("r", "f", "org.apache.http.client")], "repo string, file string, name string")
    p = shop(spark)
    assert sinks.api_version(p, setting, imports) == "V2"
    bare = program(spark, [node(1, "CALL", "post", full="<unresolvedNamespace>.post"), node(2, "CALL", "post", full="<unresolvedNamespace>.post", file="g")])
    assert sinks.api_version(bare, setting, imports) == "V1" and got(sinks.calls_in_importing_files(bare, setting, imports), "id") == [(1,)]
    assert sinks.api_version(bare, setting, imports.limit(0)) == "skip"
