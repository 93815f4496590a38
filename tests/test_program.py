"""Taggers, steps and flows on programs of a few nodes."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import collections, flows, graph, linkers, semantics, sinks, sources
from sluice.operators.tagging import Rule
from sluice.sources.rules import Catalogue
from tests.program import got, node, program, properties

NAME = Rule("Data.Sensitive.Name", (".*(?i)firstname.*",), name="Name", cat_one="sources", sensitivity="high", is_sensitive=True)
MAIL = Rule("Data.Sensitive.Mail", ("(?i)email",), cat_one="sources")


def shop(spark, tags=(), more=(), edges=()):
    """class User { firstName; size }, class Admin extends User, class Box { User owner }, and objects of them."""
    nodes = [
        node(1, "TYPE_DECL", "User", type="a.User"),
        node(2, "MEMBER", "firstName", type="String"),
        node(3, "MEMBER", "size", type="int"),
        node(4, "TYPE_DECL", "Admin", type="a.Admin", inherits=["a.User"]),
        node(5, "TYPE_DECL", "Box", type="a.Box"),
        node(6, "MEMBER", "owner", type="a.User"),
        node(10, "IDENTIFIER", "user", type="a.User"),
        node(11, "IDENTIFIER", "admin", type="a.Admin"),
        node(12, "IDENTIFIER", "box", type="a.Box"),
        node(13, "IDENTIFIER", "FIRSTNAME", type="String"),
        node(14, "IDENTIFIER", "myFirstName", type="String"),
        node(15, "PARAMETER", "u", type="a.User", arg=1),
        node(20, "CALL", "<operator>.fieldAccess", "user.firstName"),
        node(21, "IDENTIFIER", "user", type="a.User", arg=1),
        node(22, "FIELD_IDENTIFIER", "firstName", arg=2),
        node(30, "CALL", "getFirstName", "user.getFirstName()", type="String", full="a.User.getFirstName"),
        node(31, "IDENTIFIER", "user", type="a.User", arg=0),
        node(32, "CALL", "getSize", "user.getSize()", type="int", full="a.User.getSize"),
        node(33, "IDENTIFIER", "user", type="a.User", arg=0),
        node(34, "CALL", "setSize", "user.setSize(1)", type="void", full="a.User.setSize"),
        node(35, "IDENTIFIER", "user", type="a.User", arg=0),
        *more,
    ]
    links = [(1, "AST", 2), (1, "AST", 3), (5, "AST", 6), (20, "ARGUMENT", 21), (20, "ARGUMENT", 22), (30, "ARGUMENT", 31), (32, "ARGUMENT", 33), (34, "ARGUMENT", 35)]
    return program(spark, nodes, [*links, *edges], tags)


def test_direct_sources_leave_constants_out(spark):
    p = shop(spark)
    found = sources.direct(p, [NAME], sources.PROFILES["java"])
    assert got(found, "id", "kind") == [(14, "VARIABLE_REGEX_IDENTIFIER"), (2, "VARIABLE_REGEX_MEMBER"), (20, "VARIABLE_REGEX_IDENTIFIER")]
    assert {13} == {r.id for r in sources.direct(p, [NAME], sources.PROFILES["python"]).collect()} - {r.id for r in found.collect()}
    assert 2 not in {r.id for r in sources.direct(p, [NAME], sources.PROFILES["ruby"]).collect()}


def test_a_field_access_with_two_receivers_is_one_finding(spark):
    nodes = [node(1, "CALL", "<operator>.fieldAccess"), node(2, "IDENTIFIER", "x", arg=1), node(3, "IDENTIFIER", "y", arg=1), node(4, "FIELD_IDENTIFIER", "first_name", arg=2)]
    p = program(spark, nodes, [(1, "ARGUMENT", 2), (1, "ARGUMENT", 3), (1, "ARGUMENT", 4)])
    rules = [Rule("Data.Name", ("first_name",))]
    assert got(sources.direct(p, rules, sources.PROFILES["ruby"]), "id", "rule_id") == [(1, "Data.Name")]
    assert p.field_accesses().count() == 2


def test_literals_of_properties_are_linked_without_a_distinct_over_the_pairs(spark):
    p = program(spark, [node(k, "LITERAL", code='"db.host"') for k in (1, 2)])
    found = linkers.java_properties(p, properties(spark, (7, "a.yml", "db.host", "v"), (8, "a.yml", "db.host", "w")))
    assert got(found, "property_id", "node_id") == [(7, 1), (7, 2), (8, 1), (8, 2)]
    assert found._jdf.queryExecution().analyzed().nodeName() == "Union"


def test_objects_of_one_type_are_dealt_over_tasks(spark):
    nodes = [node(1, "TYPE_DECL", "User", type="shop.User"), node(2, "MEMBER", "firstName"), *(node(100 + k, "IDENTIFIER", "u", type="shop.User") for k in range(300))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = sources.derived(program(spark, nodes, [(1, "AST", 2)]), [NAME], sources.PROFILES["go"]).select("id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(r.id for r in rows) == list(range(100, 400))
    assert len({r.task for r in rows}) > 1


def test_derived_sources_by_name_type_and_inheritance(spark):
    p = shop(spark)
    found = sources.derived(p, [NAME], sources.PROFILES["java"])
    assert got(found, "id", "family", "member") == [(10, "derived_by_member_name", "firstName"), (11, "derived_by_inheritance", "firstName"), (12, "derived_by_member_type", "owner"), (15, "derived_by_member_name", "firstName"), (21, "derived_by_member_name", "firstName"), (31, "derived_by_member_name", "firstName"), (33, "derived_by_member_name", "firstName"), (35, "derived_by_member_name", "firstName")]
    tags = sources.derived_tags(found.where("id = 11"))
    assert set(got(tags, "name", "value")) == {("OBJECT_OF_SENSITIVE_CLASS_BY_INHERITANCE", ""), ("Data.Sensitive.Name_derived_by_inheritance", "firstName"), ("catLevelOne", "DerivedSources"), ("derived_by_inheritance", "Data.Sensitive.Name"), ("id", "derived_derived_by_inheritance")}
    assert sources.derived(p, [NAME], sources.PROFILES["c"]).count() == 0


def test_getters_setters_and_what_is_not_personal(spark):
    p = shop(spark)
    types = sources.sensitive_types(p, [NAME])
    assert got(sources.getter_calls(p, types), "id") == [(30,)]
    assert got(sources.accesses_of(p, types), "id", "rule_id") == [(20, "Data.Sensitive.Name")]
    tags = got(sources.insensitive_tags(p, [NAME]), "node_id", "name")
    assert tags == [(32, "INSENSITIVE_METHOD_RETURN"), (34, "INSENSITIVE_SETTER")]
    assert got(sources.personal_members(p, [NAME]).where("type = 'a.User'"), "member", "personal") == [("firstName", True), ("size", False)]


def test_all_of_the_java_tagger(spark):
    p = sources.tag_sources(spark, shop(spark), [NAME], "java", exclusions=["nowhere/.*", "("])
    tags = {(r.node_id, r.name, r.value) for r in p.tags.collect()}
    assert (2, "id", "Data.Sensitive.Name") in tags and (20, "catLevelOne", "DerivedSources") in tags and (2, "ORIGINAL_SOURCE_FOR_DERIVED_NODE", "") in tags and (30, "SENSITIVE_METHOD_RETURN", "Data.Sensitive.Name") in tags
    assert got(graph.original_sources(p, p.nodes.where("id = 10")), "id", "source_id") == [(10, 2)]
    assert got(graph.original_sources(p, p.nodes.where("id = 10"), "other"), "id") == []
    assert (2, 10) in got(graph.derived_sources(p, p.nodes.where("id = 2")), "id", "derived_id")
    assert sources.tag_sources(spark, shop(spark), [NAME], "java", exclusions=["f"]).tags.where("name = 'id' and value not like 'derived%'").count() == 0


def test_declarations_tag_and_disable(spark):
    p = shop(spark)
    declared = spark.createDataFrame([("Data.Sensitive.Name", "f", "box", "Box", None), ("DISABLED_BY_DED", "f", "firstName", "String", 1), ("Data.Sensitive.Name", "f", "admin", "Admin", 9)], "rule_id string, file string, name string, type_in_src string, line int")
    tags = sources.declared_tags(spark, p, declared, [NAME], "DISABLED_BY_DED")
    assert {(12, "TAGGED_BY_DED"), (2, "TAGGING_DISABLED_BY_DED"), (20, "TAGGING_DISABLED_BY_DED")} <= set(got(tags, "node_id", "name")) and 11 not in {r.node_id for r in tags.collect()}
    after = p.with_tags(tags)
    assert 2 not in {r.id for r in sources.direct(after, [NAME], sources.PROFILES["java"]).collect()}
    external = after.with_tags(spark.createDataFrame([("r", 3, "externalRule", "")], graph.TAG))
    assert 2 in {r.id for r in sources.direct(external, [NAME], sources.PROFILES["java"]).collect()}


def test_external_class_by_one_access_a_rule(spark):
    more = [node(40, "TYPE_DECL", "Ext", type="x.Ext", external=True), node(41, "IDENTIFIER", "e", type="x.Ext"), node(42, "CALL", "<operator>.fieldAccess", "e.firstName"), node(43, "IDENTIFIER", "e", type="x.Ext", arg=1), node(44, "FIELD_IDENTIFIER", "firstName", arg=2)]
    p = shop(spark, [(42, "id", NAME.id), (42, "catLevelOne", "sources")], more, [(42, "ARGUMENT", 43), (42, "ARGUMENT", 44)])
    assert got(sources.external_class_objects(p, [NAME]), "id", "member") == [(41, "firstName"), (43, "firstName")]


def test_literals_columns_permissions_and_assets(spark):
    nodes = [node(1, "CALL", "getString"), node(2, "LITERAL", code='"email"'), node(3, "CALL", "other"), node(4, "LITERAL", code='"email"'), node(5, "CALL", graph.ASSIGNMENT), node(6, "LITERAL", code='"select email from t"'), node(7, "LITERAL", code="'mongo-host'"), node(8, "LITERAL", code="mongo.png"), node(9, "LITERAL", code=":email")]
    p = program(spark, nodes, [(1, "ARGUMENT", 2), (3, "ARGUMENT", 4), (5, "ARGUMENT", 6)])
    assert got(sources.literals(p, [MAIL]), "id") == [(2,), (6,)] and got(sources.literals(p, [MAIL], "javascript"), "id") == [(2,)]
    assert got(sources.symbols(p, [MAIL]), "id") == [(9,)]
    assert got(sources.assets(p), "node_id") == [(7,)]
    columns = spark.createDataFrame([(1, "u.email"), (2, "email_id"), (3, "a email"), (4, None)], "id long, column_name string")
    assert got(sources.columns_by_token(columns, [MAIL]), "id") == [(1,), (3,)]
    perms = spark.createDataFrame([(1, "android.permission.READ_CALENDAR"), (2, "READ_CALENDARS"), (3, None)], "id long, permission_type string")
    assert got(sources.permissions(perms), "id", "rule_id") == [(1, "Data.Sensitive.UserContentData.Calendar")]


def test_rails_symbols_schemas_and_documents(spark):
    nodes = [node(1, "CALL", "argument", type="Types.UserInput"), node(2, "LITERAL", code=":email"), node(3, "CALL", "field"), node(4, "LITERAL", code=":input", arg=1), node(5, "TYPE_REF", "UserInput", arg=2), node(6, "IDENTIFIER", "u", type="models.User"), node(7, "CALL", "field", "field :phone, type: String", type="models.User"), node(8, "CALL", "store_in", 'store_in client: "main"', type="models.User")]
    p = program(spark, nodes, [(1, "ARGUMENT", 2), (3, "ARGUMENT", 4), (3, "ARGUMENT", 5)], [(2, "id", MAIL.id)])
    assert got(sources.symbols_by_sibling(p), "id", "type") == [(4, "UserInput")]
    columns = spark.createDataFrame([("r", "users", MAIL.id)], "repo string, table_name string, rule_id string")
    assert got(sources.schema_identifiers(p, columns), "id") == [(6,)]
    fields = sources.document_fields(p)
    assert got(fields, "field", "data_type", "client") == [("phone", "String", "main")]
    props = properties(spark, (1, "mongoid.yml", "clients.main.database", "shop"), (2, "mongoid.yml", "clients.main.hosts[0]", "h:1"))
    assert got(sources.document_databases(fields, props), "table_name", "db_name", "db_location") == [("users", "shop", "h:1")]


def test_steps_of_the_graph(spark):
    nodes = [node(1, "METHOD", "a"), node(2, "CALL", "b()"), node(3, "METHOD", "b"), node(4, "CALL", "c()"), node(5, "METHOD", "c"), node(6, "CALL", "f"), node(7, "CALL", "g", arg=1), node(8, "IDENTIFIER", "x", arg=1), node(9, "BLOCK", code="{}")]
    p = program(spark, nodes, [(1, "CONTAINS", 2), (2, "CALL", 3), (3, "CONTAINS", 4), (4, "CALL", 5), (5, "CONTAINS", 2), (6, "ARGUMENT", 7), (7, "ARGUMENT", 8), (9, "AST", 6), (6, "AST", 7), (7, "AST", 8)])
    assert got(graph.called_within(p, p.nodes.where("id = 1"), 4), "reached", "steps") == [(1, 0), (3, 1), (5, 2)]
    assert got(graph.arguments_within(p, p.nodes.where("id = 6")), "arg_id", "level") == [(7, 1), (8, 2)]
    assert got(graph.climb(p, p.nodes.where("id = 8"), F.col("label") == "BLOCK"), "reached", "found") == [(9, True)]
    assert got(graph.climb(p, p.nodes.where("id = 8"), F.col("name") == "zzz"), "reached", "found") == [(9, False)]


def test_types_and_tables(spark):
    nodes = [node(1, "TYPE_DECL", "Person", type="a.Person"), node(2, "ANNOTATION", "Entity", "@Entity"), node(3, "ANNOTATION", "Table", '@Table(name = "People")'), node(4, "TYPE_DECL", "Repo", type="a.Repo", inherits=["org.x.Base"]), node(5, "TYPE_DECL", "Sub", type="a.Sub", inherits=["a.Repo"]), node(6, "TYPE_DECL", "Far", type="a.Far", inherits=["a.Sub"])]
    p = program(spark, nodes, [(1, "AST", 2), (1, "AST", 3)])
    assert got(graph.table_of_classes(p), "type_full_name", "table_name") == [("a.Person", "people")]
    assert got(graph.inherits_closure(p, r"org[.]x[.]Base"), "type_full_name", "level") == [("a.Repo", 1), ("a.Sub", 2)] and graph.inherits_closure(p, "()").count() == 0
    assert got(graph.types_annotated(p, "Entity"), "id") == [(1,)] and graph.types_annotated(p, "").count() == 0
    tables = spark.createDataFrame([("r", "PERSON"), ("r", "none")], "repo string, table_name string")
    assert got(graph.class_of_table(p.of("TYPE_DECL"), tables), "table_name", "type_full_name") == [("PERSON", "a.Person")]


SAVE = Rule("Storages.Db.Write", (r"db[.]save.*",), cat_one="sinks", cat_two="storages")
LOG = Rule("Leakages.Log.Error", (r"log[.]error.*",), cat_one="sinks", cat_two="leakages")
CODE = Rule("By.Code", (".*secret.*",), cat_one="sinks", cat_two="leakages", filter_property="code")


def test_regular_sinks(spark):
    nodes = [node(1, "CALL", "save", "db.save(x)", full="db.save:void"), node(2, "CALL", "x", "y(secret)", full="q", hints=["db.saveAll"]), node(3, "CALL", "<operator>.assignment", "db.save", full="db.save"), node(4, "CALL", "save", full="pkg.db.save.call")]
    p = program(spark, nodes)
    assert got(sinks.regular(p, [SAVE, CODE]), "id", "rule_id") == [(1, "Storages.Db.Write"), (2, "By.Code"), (2, "Storages.Db.Write")]
    assert got(sinks.regular(p, [SAVE], prefix=True), "id") == [(1,), (4,)]
    assert got(sinks.skipped(p.calls(), [Rule("s", ("q",))]), "id") == [(1,), (4,)]


def test_cookies_name_their_rules(spark):
    cookie = Rule(sinks.COOKIE_WRITE, ("set.*",), cat_one="sinks", name="Cookie")
    nodes = [node(1, "CALL", "set", full="setCookie"), node(2, "LITERAL", code='"lang"', arg=1), node(3, "CALL", "set", full="setCookie"), node(4, "IDENTIFIER", "n", arg=1), node(5, "CALL", graph.ASSIGNMENT), node(6, "IDENTIFIER", "n", arg=1), node(7, "LITERAL", code="'id'", arg=2), node(8, "CALL", "set", full="setCookie")]
    p = program(spark, nodes, [(1, "ARGUMENT", 2), (3, "ARGUMENT", 4), (5, "ARGUMENT", 6), (5, "ARGUMENT", 7)])
    found = sinks.cookies(p, sinks.regular(p, [cookie]))
    assert got(found, "id", "cookie", "rule_id") == [(1, "lang", f"{sinks.COOKIE_WRITE}.lang"), (3, "id", f"{sinks.COOKIE_WRITE}.id"), (8, None, sinks.COOKIE_WRITE)]
    assert got(sinks.generated_rules(cookie, found, "cookie"), "id", "name") == [(f"{sinks.COOKIE_WRITE}.id", "Cookie id"), (f"{sinks.COOKIE_WRITE}.lang", "Cookie lang")]


def test_argument_pairs(spark):
    nodes = [node(1, "CALL", "track"), node(2, "BLOCK", arg=1), node(3, "CALL", graph.ASSIGNMENT, "_tmp_0.a = 1"), node(4, "CALL", code="_tmp_0.a", arg=1), node(5, "LITERAL", code="1", arg=2), node(6, "CALL", graph.ASSIGNMENT, "_tmp_0.b = {}"), node(7, "CALL", code="_tmp_0.b", arg=1), node(8, "BLOCK", arg=2), node(9, "CALL", graph.ASSIGNMENT, "_tmp_1.c = x"), node(10, "CALL", code="_tmp_1.c", arg=1), node(11, "IDENTIFIER", "x", arg=2), node(12, "IDENTIFIER", "rest", "...rest"), node(13, "CALL", "pick", 'pick(u, ["m", "n"])', arg=2)]
    p = program(spark, nodes, [(1, "ARGUMENT", 2), (1, "ARGUMENT", 13), (2, "AST", 3), (2, "AST", 6), (2, "AST", 12), (3, "ARGUMENT", 4), (3, "ARGUMENT", 5), (6, "ARGUMENT", 7), (6, "ARGUMENT", 8), (8, "AST", 9), (9, "ARGUMENT", 10), (9, "ARGUMENT", 11)])
    pairs = sinks.argument_pairs(p, p.nodes.where("id = 1"))
    assert got(pairs, "key", "value") == [("a", "1"), ("b.c", "x"), ("m", ""), ("n", ""), ("rest", "")]
    text = sinks.pairs_text(pairs)
    assert text.select(sinks.text_pairs(F.col("arguments")).alias("m")).first().m["b.c"] == "x"


def test_api_sinks_by_address(spark):
    setting = Catalogue().setting
    nodes = [node(1, "LITERAL", code='"https://api.example.com/v1"'), node(2, "CALL", "get", full="java.net.http.HttpClient.get:void()"), node(3, "CALL", "post", full="java.net.http.HttpClient.post:void()"), node(4, "CALL", "get", full="java.util.Map.get:Object()")]
    third = Rule(sinks.THIRD_PARTY, (r"https?:.*",), name="Third party", cat_one="sinks", cat_two="third_parties", node_type="api")
    p = program(spark, nodes, [(1, "FLOWS", 2)])
    calls = sinks.http_calls(p, setting, "java")
    assert got(calls, "id") == [(2,), (3,)]
    seeds = sinks.addresses(p, properties(spark), third, setting)
    found = sinks.api_sinks(p, calls, seeds, third)
    assert got(found, "id", "rule_id") == [(2, "Sinks.ThirdParties.API.api.example.com"), (3, "Sinks.ThirdParties.API")]
    inner = Rule(sinks.INTERNAL, (r"https?:.*",), cat_one="sinks", node_type="api")
    assert got(sinks.api_sinks(p, calls, seeds, inner), "id", "rule_id") == [(2, sinks.INTERNAL)]
    inference = Rule("i", (r".*example[.]com",), domains=("inferred.com",), cat_two="api_endpoint", filter_property="endpoint_domain_with_literal")
    assert (2, "Sinks.ThirdParties.API.inferred.com") in got(sinks.api_sinks(p, calls, seeds, third, [inference]), "id", "rule_id")
    assert ("apiUrlSinks.ThirdParties.API", "API") in got(sinks.api_tags(found), "name", "value")
    assert sinks.api_version(p, setting, spark.createDataFrame([("r", "x")], "repo string, name string")) == "V2"


def test_inferred_endpoints_and_marks(spark):
    p = program(spark, [node(1, "CALL", "x", full="a.Client.call"), node(2, "CALL", "y", full="b.Other.call")])
    inf = [Rule("i", ("a[.]Client.*",), domains=("one.example",), cat_two="api_endpoint", filter_property="method_full_name_with_literal"), Rule("j", ("b[.].*",), domains=("key",), cat_two="api_endpoint", filter_property="method_full_name_with_property_name")]
    assert got(sinks.inferred_endpoints(p, properties(spark, (1, "f", "key", "https://two.example/x")), inf), "id", "rule_id") == [(1, "Sinks.ThirdParties.API.one.example"), (2, "Sinks.ThirdParties.API.two.example")]
    assert got(sinks.by_full_name(p, "a[.].*"), "node_id") == [(1,)]


def test_templates_scripts_and_graphql(spark):
    dom = spark.createDataFrame([(1, "HTMLElement", '<script src="https://www.cdn.example.com/a.js"></script>'), (2, "HTMLElement", '<script src=ENV_URL >'), (3, "HTMLElement", "<p>https://x.example.com/</p>")], "id int, name string, code string")
    third = Rule(sinks.THIRD_PARTY, (r"https?:.*",), node_type="api")
    assert got(sinks.template_apis(dom, third, "src=.*_URL.*"), "id", "rule_id", "api_url") == [(1, "Sinks.ThirdParties.API.cdn.example.com", "https://www.cdn.example.com/a.js"), (2, "Sinks.ThirdParties.API.src=ENV_URL", "src=ENV_URL")]
    p = program(spark, [node(1, "CALL", "loadExternalScript", 'loadExternalScript("https://s.example.org/x.js")'), node(2, "CALL", "useQuery", full="pkg:apollo"), node(3, "CALL", "useMutation", full="pkg:apollo"), node(4, "CALL", "gql", full="pkg:apollo")])
    assert got(sinks.script_calls(p, third), "rule_id") == [("Sinks.ThirdParties.API.s.example.org",)]
    assert got(sinks.graphql_apis(p, "pkg:apollo", "useQuery", "useMutation", third), "id", "api_url") == [(2, "API(Read)"), (3, "API(Write)"), (4, "API")]


def test_clients_by_parameter_annotation_and_maker(spark):
    nodes = [
        node(1, "METHOD", "client", full="c.Config.client", type="c.Client(String)"), node(2, "PARAMETER", "u", arg=1), node(3, "ANNOTATION", "Value", '@Value("${api.url}")'.replace("}", "").replace("${", "")),
        node(4, "MEMBER", "api", type="c.Client", file="s"), node(5, "CALL", "<operator>.fieldAccess", "this.api", file="s"), node(6, "IDENTIFIER", "this", arg=1), node(7, "FIELD_IDENTIFIER", "api", arg=2), node(8, "CALL", "fetch", "this.api.fetch()", full="c.Client.fetch:void()", file="s"),
        node(9, "ANNOTATION", "Named", '@Named("main")'), node(10, "METHOD", "<init>", full="d.Service.<init>:void()"), node(11, "PARAMETER", "p", arg=1), node(12, "ANNOTATION", "Named", '@Named("main")'), node(13, "MEMBER", "svc", type="d.Service", file="s"), node(14, "CALL", "<operator>.fieldAccess", "this.svc", file="s"), node(15, "IDENTIFIER", "this", arg=1), node(16, "FIELD_IDENTIFIER", "svc", arg=2), node(17, "CALL", "go", "this.svc.go()", full="d.Service.go:void()", file="s"),
        node(18, "LITERAL", code='"https://made.example/x"'),
    ]
    edges = [(2, "AST", 3), (1, "AST", 2), (5, "ARGUMENT", 6), (5, "ARGUMENT", 7), (8, "ARGUMENT", 5), (1, "AST", 9), (11, "AST", 12), (10, "AST", 11), (14, "ARGUMENT", 15), (14, "ARGUMENT", 16), (17, "ARGUMENT", 14), (1, "CONTAINS", 18)]
    p = program(spark, nodes, edges, [(8, "API_SINK_MARKED", "")])
    assert got(sinks.apis_by_parameter(p), "method_id", "id") == [(1, 8)]
    assert got(sinks.apis_by_marked_parameter(p), "method_id", "id") == [(1, 17)]
    made = sinks.apis_by_returning_method(p)
    assert got(made, "method_id", "id") == [(1, 8)]
    assert got(sinks.apis_with_method_urls(p, made, "https?:.*", properties(spark)), "id", "rule_id") == [(8, "Sinks.ThirdParties.API.made.example")]


def test_retrofit_feign_grpc_soap(spark):
    nodes = [
        node(1, "CALL", "create", "r.create(Api.class)"), node(2, "CALL", "<operator>.fieldAccess", "Api.class", arg=1), node(3, "CALL", "build", "b.build()"), node(4, "CALL", "baseUrl", 'b.baseUrl("https://h.example/")'), node(5, "LITERAL", code='"https://h.example/"', arg=1), node(6, "CALL", "users", full="a.Api.users:List()"),
        node(10, "TYPE_DECL", "F", type="a.F"), node(11, "ANNOTATION", "FeignClient", '@FeignClient(url = "${my.host}")'), node(12, "METHOD", "m", full="a.F.m"), node(13, "CALL", "m", full="a.F.m"), node(14, "TYPE_DECL", "G", type="a.G"), node(15, "METHOD", "n"), node(16, "ANNOTATION", "RequestLine", "@RequestLine"), node(17, "CALL", "n"),
        node(20, "METHOD", "send"), node(21, "PARAMETER", "o", type="io.StreamObserver<X>", arg=2), node(22, "CALL", "onCompleted"), node(23, "IDENTIFIER", "o", type="io.StreamObserver<X>", arg=0), node(24, "CALL", "send", "stub.send(o)"), node(25, "IDENTIFIER", "s", type="a.FooStub", arg=0), node(26, "PARAMETER", "r", type="a.Req", arg=1),
        node(30, "TYPE_DECL", "W", type="a.W"), node(31, "ANNOTATION", "WebService", "@WebService"), node(32, "METHOD", "op"), node(33, "CALL", "op"),
    ]
    edges = [(1, "ARGUMENT", 2), (3, "RECEIVER_OF", 1), (4, "RECEIVER_OF", 3), (4, "ARGUMENT", 5), (10, "AST", 11), (10, "AST", 12), (13, "CALL", 12), (14, "AST", 15), (15, "AST", 16), (17, "CALL", 15), (20, "AST", 21), (20, "AST", 26), (20, "CONTAINS", 22), (22, "ARGUMENT", 23), (24, "ARGUMENT", 25), (30, "AST", 31), (30, "AST", 32), (33, "CALL", 32)]
    p = program(spark, nodes, edges)
    assert got(sinks.retrofit_apis(p), "id", "api_url") == [(6, "https://h.example/")]
    third = Rule(sinks.THIRD_PARTY, ("https?:.*",), node_type="api")
    known, rest = sinks.feign_apis(p, third)
    assert got(known, "id", "api_url") == [(13, "my_host")] and got(rest, "id") == [(17,)]
    assert got(sinks.grpc_endpoints(p), "id") == [(20,)] and got(sinks.grpc_sinks(p), "id") == [(24,)]
    assert got(sinks.callers(p, sinks.soap_methods(p)), "id") == [(33,)]


def test_storage_classes(spark):
    nodes = [node(1, "TYPE_DECL", "Users", type="a.Users", inherits=["org.springframework.data.jpa.repository.JpaRepository"]), node(2, "CALL", "findAll", full="a.Users.findAll:List()"), node(3, "CALL", "saveAll", full="a.Users.saveAll:void()"), node(4, "TYPE_DECL", "Dao", type="k.D"), node(5, "ANNOTATION", "Dao", "@Dao"), node(6, "CALL", "insert", full="k.D.insert:void()"), node(7, "TYPE_DECL", "User", type="User", file="app/models/user.rb"), node(8, "CALL", "where"), node(9, "IDENTIFIER", "User", arg=0), node(10, "CALL", "save"), node(11, "IDENTIFIER", "us_er", arg=0), node(12, "CALL", "info"), node(13, "CALL", "logger", arg=0)]
    p = program(spark, nodes, [(4, "AST", 5), (8, "ARGUMENT", 9), (10, "ARGUMENT", 11), (12, "ARGUMENT", 13)])
    assert got(sinks.inherit_sinks(p, "java"), "id", "rule_id") == [(2, "Sinks.Database.JPA.Read"), (3, "Sinks.Database.JPA.Write")]
    assert (6, "Sinks.Database.Persistence.Room.Write") in got(sinks.inherit_sinks(p, "kotlin"), "id", "rule_id")
    assert got(sinks.inherit_sinks(p, "ruby"), "id", "rule_id") == [(10, "Sink.DataBase.ROR.Write"), (8, "Sink.DataBase.ROR.Read")]
    assert got(sinks.leakages_by_receiver(p), "id", "rule_id") == [(12, "Sink.Leakages.Log.Info")]
    assert sinks.inherit_sinks(p, "python").count() == 0


def test_logs_consumers_and_operators(spark):
    nodes = [node(1, "CALL", "capture"), node(2, "CALL", "error"), node(3, "TYPE_DECL", "L", inherits=["javax.jms.MessageListener"]), node(4, "METHOD", "onMessage"), node(5, "METHOD", "k"), node(6, "ANNOTATION", "KafkaListener"), node(7, "TYPE_DECL", "MyOp", inherits=["airflow.BaseOperator"]), node(8, "CALL", "MyOp"), node(9, "CALL", "S3Op")]
    p = program(spark, nodes, [(3, "AST", 4), (5, "AST", 6)], [(1, "id", "ThirdParties.SDK.Sentry"), (2, "id", "Leakages.Log.Error")])
    assert got(sinks.shared_logs(p), "id") == [(2,)] and sinks.shared_logs(program(spark, nodes, (), [(2, "id", "Leakages.Log.Error")])).count() == 0
    assert got(sinks.consumers(p), "id") == [(4,), (5,)]
    assert got(sinks.operators(p, [Rule("ThirdParties.Operator.S3", ("S3Op",))]), "id", "rule_id") == [(8, "Airflow.Custom.Operator"), (9, "ThirdParties.Operator.S3")]


def test_databases_and_buckets(spark):
    props = properties(spark, (1, "a.yml", "url", "jdbc:mysql://h:3306/shop?x=1"), (2, "prod.yml", "url", "jdbc:mysql://p:1/live"), (3, "a.yml", "m", "mongodb://u:p@host:1/db?q"), (4, "a.yml", "bad", "jdbc:x"), (5, "a.yml", "h2", "jdbc:h2:mem:test"), (6, "a.yml", "o", "jdbc:oracle:thin:@ora:1521/orcl"))
    java = {r.rule_id: r for r in sinks.database_details(props, "java").collect()}
    assert java["Storages.SpringFramework.Jooq"].db_name == "live" and java["Storages.MongoDB.SpringFramework.Read"].db_location == "u:p@host:1"
    assert {r.rule_id: r.db_name for r in sinks.database_details(props, "java", strict_parity=True).collect()}["Storages.SpringFramework.Jooq"] == "shop"
    go = properties(spark, (1, "e", "a", "https://dynamodb.eu-1.amazonaws.com/t"), (2, "e", "b", "postgres://u:p@10.0.0.1:5432/db"), (3, "e", "c", "mongodb+srv://u@h/x?y"))
    assert got(sinks.database_details(go, "go"), "rule_id", "db_name", "db_location") == [("Storages.AmazonDynamoDB.Write", "t", "eu-1"), ("Storages.MongoDB.Read", "x", "h"), ("Storages.MongoDB.Write", "x", "h"), ("Storages.Postgres.Read", "db", "10.0.0.1:5432"), ("Storages.Postgres.ReadAndWrite", "db", "10.0.0.1:5432")]
    one = spark.createDataFrame([("jdbc:h2:mem:test", "h2"), ("jdbc:oracle:thin:@ora:1521/orcl", "oracle"), ("jdbc:h2:file:/a/b;X=1", "h2")], "v string, f string").select(sinks.connection(F.col("f"), F.col("v")).alias("c"))
    assert [tuple(r.c) for r in one.collect()] == [("h2", "In-memory", "test"), ("oracle", "ora:1521", "orcl"), ("h2", "file:/a/b", "b")]
    nodes = [node(1, "CALL", "getObject"), node(2, "CALL", "bucket", 'x.bucket("my-bucket")'), node(3, "LITERAL", code='"my-bucket"', arg=1), node(4, "CALL", "Bucket"), node(5, "IDENTIFIER", "b", arg=1), node(6, "CALL", graph.ASSIGNMENT), node(7, "IDENTIFIER", "b", arg=1), node(8, "LITERAL", code="'data-lake'", arg=2)]
    p = program(spark, nodes, [(2, "AST", 1), (2, "ARGUMENT", 3), (4, "ARGUMENT", 5), (6, "ARGUMENT", 7), (6, "ARGUMENT", 8)], [(1, "id", "Storages.AmazonS3.Read"), (4, "id", "Storages.AmazonS3.ReadAndWrite")])
    assert got(sinks.java_buckets(p), "db_name", "db_operation") == [("my-bucket", "Read")] and got(sinks.python_buckets(p), "db_name", "db_operation") == [("data-lake", "Read/Write")]
    details = sinks.java_buckets(p)
    assert ("dbName", "my-bucket") in got(sinks.detail_tags(p.calls().where("id = 1").withColumn("rule_id", F.lit("Storages.AmazonS3.Read")), details), "name", "value")
    merged = sinks.merge_details(details.withColumn("tables", F.array(F.lit("a"))).unionByName(details.withColumn("tables", F.array(F.lit("b")))))
    assert merged.first().tables == ["a", "b"]


def test_dependencies_modules_and_packages(spark):
    mods = spark.createDataFrame([("r", "p", "com.stripe", "stripe-java"), ("r", "p", "x", "y")], "repo string, file string, group_id string, artifact_id string")
    assert got(sinks.dependency_categories(mods, [Rule("ThirdParties.SDK.Stripe", ("com[.]stripe:.*",), cat_two="third_parties")]), "artifact_id", "category") == [("stripe-java", "Know Third Party"), ("y", "Unknown")]
    deps = spark.createDataFrame([("r", 2, "a.b", "f"), ("r", 1, "a.b", "f")], "repo string, id long, name string, file string")
    info = spark.createDataFrame([("r", "a.b", "f", "R1"), ("r", "c", "f", "R2")], "repo string, name string, file string, rule_id string")
    assert got(sinks.dependency_tags(deps, info), "id", "rule_id") == [(1, "R1")]
    p = program(spark, [node(1, "CALL", "has_many", file="app/models/a.rb"), node(2, "CALL", "has_many", file="lib/a.rb"), node(3, "CALL", "render", file="app/controllers/c.rb")])
    assert got(sinks.rails_full_names(p), "id", "method_full_name") == [(1, "RubyOnRailsBuiltIn.has_many"), (2, ""), (3, "RubyOnRailsBuiltIn.render")]
    packages = spark.createDataFrame([("gem_a", "render"), ("gem_b", "render")], "package string, method string")
    assert (3, "gem_a.render") in got(sinks.package_full_names(p.calls(), packages), "id", "method_full_name")
    syncs = spark.createDataFrame([(1, "braze", False), (2, "braze", True), (3, "other", False)], "id int, actual_destination_name string, schedule_paused boolean")
    assert got(sinks.synced_sinks(syncs, [Rule("T", ("braze",))]), "id") == [(1,)]


def test_flink_steps(spark):
    nodes = [node(1, "METHOD", "m"), node(2, "CALL", "build", full="kafka.build"), node(3, "CALL", "addSink"), node(4, "TYPE_DECL", "S", type="a.S", inherits=["x.RichSinkFunction<A>"]), node(5, "METHOD", "invoke"), node(6, "CALL", "put", full="db.put"), node(7, "METHOD", "n"), node(8, "LOCAL", "s", type="a.S"), node(9, "IDENTIFIER", "s", type="a.S"), node(10, "METHOD", "o"), node(11, "CALL", "addSink"), node(12, "CALL", "addSink")]
    edges = [(1, "CONTAINS", 2), (1, "CONTAINS", 3), (4, "AST", 5), (5, "CONTAINS", 6), (7, "CONTAINS", 8), (9, "REF", 8), (10, "CONTAINS", 11), (9, "FLOWS", 11)]
    tags = [(2, "id", "K"), (2, "catLevelOne", "sinks"), (6, "id", "D"), (6, "catLevelOne", "sinks")]
    p = program(spark, nodes, edges, tags)
    out = sinks.flink(spark, p, spark.createDataFrame([("r", "org.apache.flink.x")], "repo string, name string"))
    ids = {(r.node_id, r.value) for r in out.tags.where("name = 'id'").collect()}
    assert {(3, "K"), (11, "D"), (12, sinks.FLINK_PRODUCER.id)} <= ids
    assert sinks.flink(spark, p, spark.createDataFrame([("r", "other")], "repo string, name string")).tags.count() == 4


def test_flow_selection_expansion_and_filters(spark):
    nodes = [node(1, "IDENTIFIER", "mail"), node(2, "CALL", "log", 'log("x" + mail)', full="log.error"), node(3, "IDENTIFIER", "other"), node(4, "CALL", "save", "save(mail)", full="db.save"), node(5, "IDENTIFIER", "mail", arg=1), node(6, "METHOD", "no")]
    tags = [(1, "id", "Data.Sensitive.Mail"), (1, "catLevelOne", "sources"), (3, "OBJECT_OF_SENSITIVE_CLASS_BY_MEMBER_NAME", "Data.Sensitive.Name"), (3, "catLevelOne", "DerivedSources"), (3, "id", "derived_x"), (3, "derived_by_member_name", "Data.Sensitive.Name"), (3, "derived_by_member_name", "Data.Sensitive.Mail"), (3, "Data.Sensitive.Name_derived_by_member_name", "firstName"), (3, "Data.Sensitive.Mail_derived_by_member_name", "mail"), (2, "catLevelOne", "sinks"), (2, "catLevelTwo", "leakages"), (2, "leakagesREGULAR", LOG.id), (4, "catLevelOne", "sinks"), (4, "catLevelTwo", "storages"), (4, "storagesREGULAR", SAVE.id), (5, "id", "Data.Sensitive.Mail"), (6, "catLevelOne", "sources")]
    p = program(spark, nodes, [(1, "FLOWS", 2), (1, "FLOWS", 4), (3, "FLOWS", 2), (3, "FLOWS", 4), (4, "ARGUMENT", 5)], tags)
    assert got(flows.source_nodes(p), "id") == [(1,), (3,)] and got(flows.sink_nodes(p), "id") == [(2,), (4,)] and got(flows.sink_nodes(p, 1), "id") == [(2,)]
    stages = flows.dataflow(p, [LOG, SAVE], {NAME.id: NAME.pattern, MAIL.id: MAIL.pattern})
    wide = got(stages["expanded"], "source_id", "sink_id", "path_id")
    assert wide == [("Data.Sensitive.Mail", "Leakages.Log.Error", "1-2"), ("Data.Sensitive.Mail", "Storages.Db.Write", "1-4"), ("Data.Sensitive.Name", "Leakages.Log.Error", "3-2"), ("Data.Sensitive.Name", "Storages.Db.Write", "3-4")]
    # 3-4: the call's argument is a mail, the nearest tagged element has both; 3-2: the log names mail, the member of the other rule
    kept = got(stages["filtered"], "source_id", "path_id")
    assert ("Data.Sensitive.Mail", "1-2") in kept and ("Data.Sensitive.Name", "3-2") not in kept
    assert set(got(stages["final"], "path_id")) <= set(got(stages["filtered"], "path_id"))
    assert got(flows.of_type(stages["unfiltered"], p.tags, "leakages"), "path_id") == [("1-2",), ("3-2",)]
    assert got(flows.described(stages["unfiltered"].where("path_id = '1-4'"), p.nodes, p.tags), "source_id", "sink_id") == [("Data.Sensitive.Mail", "db.save")]


def test_false_positives_cookies_and_bypass(spark):
    rows = [("r", flows.COOKIE_SOURCE, flows.COOKIE_WRITE + ".x", "storages", "REGULAR", "1-2", [1, 2]), ("r", flows.COOKIE_SOURCE, "T", "third_parties", "REGULAR", "1-3", [1, 3]), ("r", "S", "T", "third_parties", "api", "1-3", [1, 3])]
    df = spark.createDataFrame(rows, "repo string, source_id string, sink_id string, sink_sub_category string, sink_node_type string, path_id string, path array<long>")
    assert got(flows.without_cookies(df), "path_id") == [("1-3",), ("1-3",)] and got(flows.without_false_positives(df), "source_id", "path_id") == [(flows.COOKIE_SOURCE, "1-2"), ("S", "1-3")]
    p = program(spark, [node(3, "CALL", "c", line=7)])
    more = spark.createDataFrame([("r", "S", "T", "x", "y", "9-1-3", [9, 1, 3], True), ("r", "S", "T", "x", "y", "1-3", [1, 3], True), ("r", "S", "T", "x", "y", "8-2-3", [8, 2, 3], True), ("r", "S", "T", "x", "y", "7-3", [7, 3], False)], df.schema.add("apply_dedup", "boolean"))
    assert got(flows.store(p, more), "path_id") == [("7-3",), ("8-2-3",)] and flows.store(p, more, dedup=False).count() == 4
    assert got(flows.appended(df.limit(1).withColumns({"a": F.lit(5)}), ["a"], []), "path_id")[0][0].startswith("5-")


def test_reads_and_consumers_make_flows(spark):
    sensitive = spark.createDataFrame([("r", "a.User", "Data.Sensitive.Mail", 2)], "repo string, type string, rule_id string, member_id long")
    reads = spark.createDataFrame([("r", 9, "java.util.List<a.User>", "S", "storages", "REGULAR")], "repo string, id long, type_full_name string, sink_id string, sink_sub_category string, sink_node_type string")
    assert got(flows.read_flows(reads, sensitive), "source_id", "path_id", "apply_dedup") == [("Data.Sensitive.Mail", "2-9", False)]
    p = program(spark, [node(1, "METHOD", "on"), node(2, "CALL", "readValue", "m.readValue(s, User.class)"), node(3, "PARAMETER", "m", type="Msg")], [(1, "CONTAINS", 2), (1, "AST", 3)])
    consumer = spark.createDataFrame([("r", 1, "Kafka")], "repo string, id long, rule_id string")
    assert got(flows.consumer_flows(p, consumer, sensitive), "sink_id", "path_id") == [("Kafka", "2-1")]


def test_semantics(spark):
    nodes = [node(1, "METHOD", "put", full="a.Map.put:void(A)", external=True), node(2, "PARAMETER"), node(3, "PARAMETER"), node(4, "METHOD", "f", full="a.F.f:int(A)", external=True), node(5, "PARAMETER"), node(6, "METHOD", "s", full="a.S.s:java.lang.String(A)", external=True), node(7, "PARAMETER"), node(8, "CALL", "put"), node(9, "CALL", "save", full="db.save"), node(10, "IDENTIFIER", arg=0), node(11, "NAMED_ARGUMENT", "k", arg=1)]
    edges = [(1, "AST", 2), (1, "AST", 3), (4, "AST", 5), (6, "AST", 7), (8, "CALL", 1), (8, "CALL", 4), (8, "CALL", 6), (9, "ARGUMENT", 10), (9, "ARGUMENT", 11)]
    p = program(spark, nodes, edges, [(9, "catLevelOne", "sinks")])
    assert got(semantics.of_external(p), "signature", "flow") == [("a.F.f:int(A)", "0->0"), ("a.Map.put:void(A)", "0->0 1->0 1->1"), ("a.S.s:java.lang.String(A)", "0->-1 0->0")]
    assert got(semantics.of_sinks(p), "flow") == [("0->-1 0->0 1->-1 1->1",)]
    assert got(semantics.of_named_arguments(p), "flow") == [('0->-1 0->0 1->-1 1->1 2->-1 2->2 1 "k"->-1 1 "k"->1 "k"',)]
    rows = semantics.of_language(spark, p, [], "java")
    assert '"db.save" 0->-1 0->0 1->-1 1->1' in [r.line for r in semantics.text_lines(rows).collect()]


def test_queries_are_read(spark):
    nodes = [node(1, "LITERAL", code='"select email, id from users"'), node(2, "LITERAL", code='"select * from User"'), node(3, "CALL", "query", 'db.query("SELECT firstName " + " FROM t")'), node(4, "LITERAL", code='"nothing"')]
    p = program(spark, nodes)
    sensitive = spark.createDataFrame([("r", "a.User", NAME.id)], "repo string, type string, rule_id string")
    tables = spark.createDataFrame([], "repo string, type_full_name string, table_name string")
    found = semantics.read_tags(semantics.query_nodes(p), [NAME, MAIL], sensitive, tables)
    assert got(found, "id", "rule_id") == [(1, MAIL.id), (2, NAME.id), (3, NAME.id)]
    named = program(spark, [node(1, "ANNOTATION", "NamedQuery", '@NamedQuery(name = "Q", query = "select x from y")'), node(2, "CALL", "createNamedQuery", full="org.hibernate.S.createNamedQuery:Q()"), node(3, "LITERAL", code='"Q"', arg=1)], [(2, "ARGUMENT", 3)])
    assert got(semantics.named_query_uses(named), "id", "call") == [(1, 2)]
    flowing = program(spark, [node(1, "LITERAL"), node(2, "IDENTIFIER")], [(1, "FLOWS", 2)], [(2, "id", "Data.Sensitive.Mail")])
    assert got(semantics.star_reads(flowing, flowing.nodes.where("id = 1"), flowing.nodes.where("id = 2")), "id", "rule_id") == [(1, "Data.Sensitive.Mail")]


def test_property_links(spark):
    nodes = [node(1, "LITERAL", code='"db.url"'), node(2, "PARAMETER", "u", arg=1), node(3, "ANNOTATION", "Value", '@Value("${url}")'), node(4, "MEMBER", "m"), node(5, "ANNOTATION", "Value", '@Value("${db.url}")'), node(6, "CALL", "os.getenv"), node(7, "LITERAL", code='"HOST"', arg=1), node(8, "CALL", "get", full="os.environ.get"), node(9, "CALL", graph.ASSIGNMENT), node(10, "CALL", code="process.env.HOST"), node(11, "CALL", code="ENV['HOST']"), node(12, "CALL", code="config.db.url"), node(13, "TYPE_DECL", "D", type="x.DatabaseConfiguration"), node(14, "MEMBER", "host"), node(15, "CALL", code="Settings.db.url")]
    edges = [(2, "AST", 3), (4, "AST", 5), (6, "ARGUMENT", 7), (8, "ARGUMENT", 7), (9, "AST", 10), (9, "AST", 11), (9, "AST", 12), (9, "AST", 15), (13, "AST", 14)]
    p = program(spark, nodes, edges)
    props = properties(spark, (101, "a.yml", "db.url", "x"), (102, "a.yml", "HOST", "y"), (103, "a.yml", "empty", ""))
    pairs = lambda df: got(df, "property_id", "node_id")
    assert pairs(linkers.java_properties(p, props)) == [(101, 1), (101, 2), (101, 4), (102, 7)]
    assert pairs(linkers.yaml_properties(p, props)) == [(102, 7)]
    assert pairs(linkers.javascript_properties(p, props)) == [(101, 12), (102, 10)]
    assert pairs(linkers.python_properties(p, props)) == [(102, 14), (102, 7)]
    assert pairs(linkers.ruby_properties(p, props)) == [(101, 15), (102, 11)]
    linked = p.with_edges(linkers.link_edges(linkers.yaml_properties(p, props)))
    assert got(graph.property_uses(linked, props), "node_id", "value") == [(7, "y")]
    assert got(graph.original_property(linked, p.nodes.where("id in (1, 7)"), props), "id", "original_value") == [(1, None), (7, "y")]
    assert linkers.verified(props).count() == 3


def test_properties_in_code(spark):
    nodes = [node(1, "BLOCK", code="<empty>"), node(2, "CALL", graph.ASSIGNMENT), node(3, "IDENTIFIER", "config", arg=1), node(4, "BLOCK", code="{..}", arg=2), node(5, "CALL", graph.ASSIGNMENT), node(6, "CALL", "<operator>.fieldAccess", "_tmp_0.url", arg=1), node(7, "LITERAL", code="'http://x'", arg=2, line=4)]
    p = program(spark, nodes, [(1, "AST", 2), (2, "ARGUMENT", 3), (2, "ARGUMENT", 4), (4, "AST", 5), (5, "ARGUMENT", 6), (5, "ARGUMENT", 7)])
    assert got(linkers.properties_in_code(p, "javascript"), "name", "value", "line") == [("config.url", "http://x", 4)]


def test_full_names_types_and_imports(spark):
    nodes = [node(1, "CALL", "info", full="<unresolvedNamespace>.info"), node(2, "IDENTIFIER", "log", arg=0), node(3, "ANNOTATION", "Slf4j"), node(4, "CALL", "get", "axios.get()", file="a.js"), node(5, "CALL", "post", "client.post()", file="a.js"), node(6, "IDENTIFIER", "client", arg=0), node(7, "CALL", graph.ASSIGNMENT, file="a.js"), node(8, "IDENTIFIER", "client", arg=1, file="a.js"), node(9, "CALL", code="require('got')", arg=2), node(10, "CALL", "x", file="a.js"), node(11, "METHOD", "f", full="m.C.f"), node(12, "CALL", "f", hints=["m.C"])]
    p = program(spark, nodes, [(1, "ARGUMENT", 2), (5, "ARGUMENT", 6), (7, "ARGUMENT", 8), (7, "ARGUMENT", 9)])
    assert (1, "org.slf4j.Logger.info") in got(linkers.lombok_full_names(p), "id", "method_full_name")
    imports = spark.createDataFrame([("r", "a.js", "axios", "axios")], "repo string, file string, name string, alias string")
    named = got(linkers.fill_empty_names(linkers.javascript_full_names(p, imports)), "id", "method_full_name")
    assert {(4, "pkg:axios.get"), (5, "pkg:got.post"), (10, "pkg:x")} <= set(named)
    assert got(linkers.link_by_hints(p), "src", "dst") == [(12, 11)]
    chain = program(spark, [node(1, "CALL", graph.ASSIGNMENT), node(2, "IDENTIFIER", "a", arg=1), node(3, "CALL", type="T", arg=2), node(4, "CALL", graph.ASSIGNMENT), node(5, "IDENTIFIER", "b", arg=1), node(6, "IDENTIFIER", "a", arg=2)], [(1, "ARGUMENT", 2), (1, "ARGUMENT", 3), (4, "ARGUMENT", 5), (4, "ARGUMENT", 6)])
    assert got(linkers.recovered_types(chain).where("id = 5"), "type_hints") == [(["T"],)]
    files = spark.createDataFrame([("r", x) for x in ("src/b.ts", "lib/c.js", "pkg/mod.py", "pkg/__init__.py")], "repo string, file string")
    rel = spark.createDataFrame([("r", "src/a.ts", "./b"), ("r", "src/a.ts", "../lib/c.js"), ("r", "src/a.ts", "react"), ("r", "m.py", "pkg.mod.f"), ("r", "m.py", "pkg")], "repo string, file string, name string")
    assert got(linkers.file_imports(rel, files), "file", "imported") == [("src/a.ts", "lib/c.js"), ("src/a.ts", "src/b.ts")]
    assert got(linkers.module_imports(rel, files), "imported") == [("pkg/__init__.py",), ("pkg/mod.py",)]


def test_headers_requires_gems_and_captures(spark):
    p = program(spark, [node(1, "METHOD", "f", file="inc/a.h"), node(2, "TYPE_DECL", "User", type="User", file="lib/user.rb"), node(3, "IDENTIFIER", "v"), node(4, "IDENTIFIER", "v"), node(5, "METHOD", "o"), node(6, "METHOD", "l")], [(5, "CONTAINS", 3), (6, "CONTAINS", 4), (5, "CAPTURES", 6)])
    inc = spark.createDataFrame([("r", "x.c", "inc/a.h"), ("r", "x.rb", "./user")], "repo string, file string, name string")
    assert got(linkers.header_symbols(inc, p), "file", "id") == [("x.c", 1)]
    assert got(linkers.required_types(inc, p), "file", "type_full_name") == [("x.rb", "User")]
    assert ("User", "User") in got(linkers.global_symbols(p), "name", "type_full_name")
    calls = program(spark, [node(1, "CALL", "new", "Faraday.new")]).calls()
    assert got(linkers.gem_types(calls, spark.createDataFrame([("faraday", "Faraday")], "package string, module string")), "type_full_name") == [("faraday::Faraday",)]
    assert got(linkers.lambda_captures(p), "src", "dst") == [(3, 4)] and linkers.lambda_captures(p, 0).count() == 0
    cols = spark.createDataFrame([("r", 1, "S", "models/users.sql")], "repo string, id long, rule_id string, file string")
    syncs = spark.createDataFrame([("r", 2, "T", "users"), ("r", 3, "T", "other")], "repo string, id long, rule_id string, model string")
    assert got(linkers.synced_flows(cols, syncs), "path_id") == [("1-2",)]


COLLECT = Rule("Collections.Rest", ("(Get|Post)Mapping|RequestMapping",), cat_one="collections", cat_two="annotations")


def test_annotated_collection_points(spark):
    nodes = [node(1, "TYPE_DECL", "C", type="a.C"), node(2, "ANNOTATION", "RequestMapping", '@RequestMapping("/api")'), node(3, "METHOD", "m"), node(4, "ANNOTATION", "PostMapping", '@PostMapping("/user")'), node(5, "PARAMETER", "email", arg=1), node(6, "METHOD", "n"), node(7, "ANNOTATION", "GetMapping", '@GetMapping("/x")'), node(8, "PARAMETER", "z", type="a.User", arg=1), node(9, "IDENTIFIER", "u", type="a.User"), node(10, "METHOD", "o"), node(11, "ANNOTATION", "GetMapping", '@GetMapping("/no")', full="retrofit2.GetMapping")]
    edges = [(1, "AST", 2), (1, "AST", 3), (3, "AST", 4), (3, "AST", 5), (6, "AST", 7), (6, "AST", 8), (10, "AST", 11)]
    p = program(spark, nodes, edges, [(9, "OBJECT_OF_SENSITIVE_CLASS_BY_MEMBER_NAME", "x"), (8, "derived_by_member_name", "x")])
    handlers, classes = collections.annotated(p, COLLECT.pattern)
    assert got(handlers, "id", "url") == [(3, "/user"), (6, "/x")]
    points, tags = collections.points(p, handlers, COLLECT, [MAIL], classes)
    assert got(points, "id", "end_point") == [(3, "/api/user"), (6, "/x")]
    assert {(5, "id", MAIL.id), (3, collections.ENDPOINT, "/api/user"), (8, "derived_by_member_name", "x")} <= set(got(tags, "node_id", "name", "value"))
    assert got(collections.ingress_urls(collections.end_points(p, handlers, classes)), "end_point") == [("/api/user",), ("/x",)]


@pytest.mark.parametrize("language", ["javascript", "python", "ruby", "go", "php", "cherrypy", "java"])
def test_routes(spark, language):
    if language == "javascript":
        p = program(spark, [node(1, "CALL", "get", "app.get('/u', show)", full="express"), node(2, "LITERAL", code="'/u'", arg=1), node(3, "IDENTIFIER", "show", arg=2), node(4, "METHOD", "show")], [(1, "ARGUMENT", 2), (1, "ARGUMENT", 3)])
        assert got(collections.javascript_routes(p), "id", "url") == [(4, "/u")]
    if language == "python":
        p = program(spark, [node(1, "CALL", "assign", 'f = bp.route("/add")'), node(2, "METHOD_REF", "f", full="m.f", arg=2), node(3, "METHOD", "f", full="m.f")], [(1, "ARGUMENT", 2)])
        assert got(collections.python_routes(p), "id", "url") == [(3, "/add")]
    if language == "ruby":
        p = program(spark, [node(1, "CALL", "resources", "resources :users", file="config/routes.rb"), node(2, "LITERAL", code=":users", arg=1), node(3, "METHOD", "index", file="app/users_controller.rb"), node(4, "CALL", "get", 'get "/p", to: "pets#show"', file="config/routes.rb"), node(5, "METHOD", "show", file="app/pets_controller.rb")], [(1, "ARGUMENT", 2)])
        assert got(collections.ruby_routes(p), "id", "url") == [(3, "users -> index"), (5, "/p")]
    if language == "go":
        p = program(spark, [node(1, "CALL", "Methods"), node(2, "LITERAL", code='"POST"', arg=1), node(3, "CALL", "HandleFunc", arg=0), node(4, "LITERAL", code='"/a"', arg=1), node(5, "IDENTIFIER", "add", arg=2), node(6, "METHOD", "add"), node(7, "CALL", "GET", file="x/routes.go"), node(8, "LITERAL", code='"/b"', arg=1), node(9, "IDENTIFIER", "h.list", arg=2), node(10, "METHOD", "list")], [(1, "ARGUMENT", 2), (1, "ARGUMENT", 3), (3, "ARGUMENT", 4), (3, "ARGUMENT", 5), (7, "ARGUMENT", 8), (7, "ARGUMENT", 9)])
        assert got(collections.go_routes(p), "id", "url") == [(10, '"/b"'), (6, '"/a"')]
    if language == "php":
        p = program(spark, [node(1, "METHOD", "edit", full="App\\UserController->edit"), node(2, "CALL", "post", '$app->post("/s", Save::class)', full="Slim\\App->post"), node(3, "TYPE_REF", code="Save::class", arg=2), node(4, "METHOD", "handle", full="App\\Save->handle")], [(2, "ARGUMENT", 3)])
        props = properties(spark, (1, "config/routes.yaml", "user.path", "/u"), (2, "config/routes.yaml", "user.controller", "App\\UserController::edit"))
        assert got(collections.php_config_routes(p, props), "id", "url") == [(1, "/u")] and got(collections.php_routes(p), "id", "url") == [(4, "/s")]
    if language == "cherrypy":
        p = program(spark, [node(1, "CALL", "connect", "d.connect('n', '/r', controller=c, action='act')"), node(2, "METHOD", "act")])
        assert got(collections.cherrypy_routes(p), "id", "url") == [(2, "/r")]
    if language == "java":
        p = program(spark, [node(1, "CALL", "get", 'router.get("/j").handler(this::list)', full="io.Router.get", file="f"), node(2, "METHOD_REF", code="this::list", arg=1), node(3, "METHOD", "list", full="a.R.list", file="f")], [(1, "ARGUMENT", 2)])
        assert got(collections.java_routes(p, "io[.]Router.*"), "id", "url") == [(3, "/j")]


def test_controllers_forms_layouts_and_items(spark):
    nodes = [node(1, "TYPE_DECL", "UserController", type="a.UserController"), node(2, "ANNOTATION", "Route", '[Route("[controller]")]'), node(3, "METHOD", "Get"), node(4, "ANNOTATION", "HttpGet", '[HttpGet("list")]')]
    p = program(spark, nodes, [(1, "AST", 2), (1, "AST", 3), (3, "AST", 4)])
    handlers, classes = collections.csharp_controllers(p, "Route|HttpGet")
    assert got(collections.end_points(p, handlers, classes), "end_point") == [("/User/list",)]
    dom = spark.createDataFrame([(1, "HTMLOpenElement", '<input name="email" >'), (2, "HTMLElement", '<input name="email" > </input>'), (3, "HTMLOpenElement", '<p name="email">')], "id int, name string, code string")
    form = Rule("Collections.Webforms", ("(?i).*<input.*",), cat_two="webforms")
    assert got(collections.web_forms(dom, [form], [MAIL]), "id", "role") == [(1, "collection"), (2, "source")]
    q = program(spark, [node(1, "CALL", "<operator>.fieldAccess", "binding.emailInput"), node(2, "IDENTIFIER", "binding", arg=1), node(3, "FIELD_IDENTIFIER", "emailInput", arg=2)], [(1, "ARGUMENT", 2), (1, "ARGUMENT", 3)])
    layouts = spark.createDataFrame([("r", "emailInput"), ("r", "other")], "repo string, name string")
    assert got(collections.layout_points(q, layouts, Rule("A", (".*(?i)email.*",))), "id", "source") == [(1, "emailInput")]
    m = program(spark, [node(1, "FILE", "app/users_controller.rb"), node(2, "METHOD", "index", file="app/users_controller.rb"), node(3, "CALL", "c", file="app/users_controller.rb"), node(4, "METHOD", "help", file="lib/h.rb"), node(5, "CALL", "d", file="lib/h.rb")], [(2, "CONTAINS", 3), (3, "CALL", 4), (4, "CONTAINS", 5)], [(5, "id", "x")])
    items, tags = collections.repository_items(m)
    assert got(items, "item", "files") == [("app--users", ["app/users_controller.rb", "lib/h.rb"])] and got(tags, "node_id", "value") == [(5, "app--users")]


def test_rules_of_a_node_meet_before_they_become_tags(spark):
    from sluice.operators import tagging

    rules = [Rule("A", ("a",), cat_two="x"), Rule("B", ("b",), cat_two="y", is_external=True)]
    matched = spark.createDataFrame([("r", 1, "A"), ("r", 1, "A"), ("r", 1, "B"), ("r", 2, "A")], "repo string, node_id long, rule_id string")
    tags = tagging.rule_tags(matched, tagging.rule_table(spark, rules))
    own = [("id", "A"), ("nodeType", "REGULAR"), ("catLevelOne", "sources"), ("catLevelTwo", "x"), ("xREGULAR", "A")]
    other = [("id", "B"), ("catLevelTwo", "y"), ("yREGULAR", "B"), ("externalRule", "")]
    assert got(tags, "node_id", "name", "value") == sorted([(1, *t) for t in own + other] + [(2, *t) for t in own], key=repr)
    plan = tags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_expanding_makes_flows_distinct_and_not_all_tags(spark, capsys):
    tags = [(1, "id", "Data.A"), (1, "id", "Data.A"), (2, "id", "S"), (2, "catLevelTwo", "leakages"), (2, "catLevelTwo", "leakages"), (2, "leakagesREGULAR", "S"), (2, "leakagesREGULAR", "S")]
    p = program(spark, [], [], tags)
    raw = spark.createDataFrame([("r", [1, 2], "1-2")], "repo string, path array<long>, path_id string")
    wide = flows.expand(raw, p.tags, spark.createDataFrame([("leakages", "REGULAR")], "cat_two string, node_type string"))
    assert got(wide, "source_id", "sink_id", "path_id") == [("Data.A", "S", "1-2")]
    capsys.readouterr()
    wide.explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("Aggregate [") == 2  # of the kinds, and of the flows
