"""The rule catalogue, policies and threats, readers, documents and scans."""

import json

from pyspark.sql import functions as F

from sluice.exporters import audit, document
from sluice.functions import scalars as fn
from sluice.operators import graph, policy, predicates, sources, tagging, threats
from sluice.operators.tagging import Rule
from sluice.plans import profiles
from sluice.sources import code_sql, repository, rules, xml
from tests.program import got, node, program, properties

YAML = {
    "rules/sources/personal.yaml": "sources:\n  - id: Data.Name\n    name: Name\n    isSensitive: true\n    sensitivity: high\n    patterns: ['.*(?i)first_?name.*']\n    tags: {law: GDPR}\n  - id: Bad\n    patterns: ['(']\n",
    "rules/sinks/storages/db/java.yaml": "sinks:\n  - id: Storages.Db\n    name: Db\n    domains: [db.example]\n    patterns: ['db[.].*']\n",
    "rules/sinks/third_parties/api/python.yaml": "sinks:\n  - id: Api\n    patterns: ['x']\n",
    "rules/collections/annotations/rest/java.yaml": "collections:\n  - id: C\n    patterns: ['Get']\n",
    "rules/policies/p.yaml": "policies:\n  - id: P\n    action: Deny\n    type: Compliance\n    dataFlow:\n      sources: ['Data.*']\n      sourceFilters: {isSensitive: true, allowedSourceFilters: {sources: [Mail]}}\n      sinks: ['**']\n      sinkFilters: {domains: [db.example]}\n    repositories: ['acc.*']\n    tags:\n      - purpose: audit\nthreats:\n  - id: T.Storage.X\n    action: maybe\n    config: {a: 1}\n",
    "config/exclusions/java.yaml": "exclusions:\n  - id: E\n    patterns: ['.*/test/.*']\n  - id: F\n    patterns: ['a', 'b']\n",
    "config/semantics/java.yaml": "semantics:\n  - signature: a.b\n    flow: 0->0\n  - signature: a.b\n    flow: 1->1\n",
    "config/system/default.yaml": "systemConfig:\n  - {key: apiIdentifier, value: 'x'}\n  - {key: apiIdentifier, value: 'y'}\n",
    "ded/a/java.yaml": "dedRules:\n  - filePath: src/A.java\n    classificationData:\n      - id: Data.Name\n        variables: [{name: n, typeInSrc: String, lineNumber: 3}, {name: m, typeInSrc: String}]\n  - filePath: b\n    classificationData: [{id: x, variables: [{name: z}]}]\n",
    "broken.yaml": "a: [",
    "other.yaml": "nonsense: 1\nsources: {}\n",
}


def folder(tmp_path):
    for name, text in YAML.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_load_places_and_filters(spark, tmp_path):
    c = rules.load(spark, folder(tmp_path), {"java"})
    assert [r.id for r in c.sources] == ["Data.Name"] and [r.id for r in c.sinks] == ["Storages.Db"] and [r.id for r in c.collections] == ["C"]
    assert (c.sources[0].cat_one, c.sources[0].language, c.sources[0].tags) == ("sources", "unknown", {"law": "GDPR"})
    assert (c.sinks[0].cat_two, c.sinks[0].node_type, c.sinks[0].language) == ("storages", "REGULAR", "java") and c.collections[0].language == "unknown"
    p = c.policies[0]
    assert (p.action, p.kind, p.flow.is_sensitive, p.flow.allowed_sources, p.repositories, p.tags) == ("deny", "compliance", True, ("Mail",), ("acc.*",), {"purpose": "audit"})
    assert c.threats[0].action is None and c.threats[0].repositories == ("**",) and c.threats[0].config == {"a": "1"}
    assert rules.exclusion_pattern(c.exclusions) == "(.*/test/.*)|(a|b)" and rules.exclusion_pattern(c.exclusions[:1]) == ".*/test/.*"
    assert c.setting("apiIdentifier") == "(?i)(x|y)" and c.raw_setting("apiIdentifier") == "xy" and "okhttp" in c.setting("apiHttpLibraries") and c.setting("none") == ""
    assert [d.file_path for d in c.declared] == ["src/A.java"] and rules.declared_table(spark, c).count() == 2
    assert {k for k, _ in c.problems} and any("pattern of Bad" in p for _, p in c.problems) and any("no YAML" in p for _, p in c.problems)
    assert [r.node_type for r in rules.load(spark, folder(tmp_path), {"python"}).sinks] == ["api"]


def test_java_judges_patterns(spark):
    good = ["(?<n>a)", r"\p{L}+", "foo|(?i)bar", r"a\z", ".*(?i)zipCode.*"]
    assert [predicates.compiles(p) for p in [*good, "(?P<n>a)", "("]] == [True] * 5 + [False] * 2


def test_merge_leads_with_external_rules():
    r = lambda i, p, name="", d=(), f="method_full_name": Rule(i, (p,), name=name, domains=d, filter_property=f)
    inner = rules.Catalogue(sources=(r("A", "a1"), r("B", "b")), sinks=(r("ThirdParties.SDK.X", "x1", "X", ("x.com",)), r("Other", "o", "O", ("o.com",))), semantics=(rules.Semantic("s", "1"),))
    outer = rules.Catalogue(sources=(r("A", "a0", "outer"),), sinks=(r("New", "x2", "N", ("x.com",)), r("Lone", "l", "L", ("l.com",))), semantics=(rules.Semantic("s", "0"),))
    m = rules.merge(outer, inner)
    assert [(x.id, x.name, x.patterns) for x in m.sources] == [("A", "outer", ("a0", "a1")), ("B", "", ("b",))]
    assert [(x.id, x.patterns) for x in m.sinks] == [("ThirdParties.SDK.X", ("x1", "x2")), ("Other", ("o",)), ("Lone", ("l",))]
    assert [s.flow for s in m.semantics] == ["0"]
    assert len(m.with_rule(r("A", "z")).sources) == 2 and len(m.with_rule(r("Z", "z")).sources) == 3 and m.rule("B").id == "B" and m.rule("?") is None


def test_check_names_faults(spark, tmp_path):
    found = rules.check(spark, folder(tmp_path))
    text = "\n".join(f"{a}: {b}" for a, b in found)
    for part in ("broken.yaml: no YAML", "other.yaml: unknown list nonsense", "other.yaml: sources is no list", "pattern of Bad", "action maybe", "declaration of b"):
        assert part in text


def test_policies_of_the_catalogue(spark, tmp_path):
    c = rules.load(spark, folder(tmp_path), {"java"})
    p = policy.from_verdict(c.policies[0])
    flows = spark.createDataFrame([("acc1", "Data.Name", "Storages.Db", "1-2"), ("shop", "Data.Name", "Storages.Db", "3-4"), ("acc1", "Data.Mail", "Storages.Db", "5-6")], "repo string, source_id string, sink_id string, path_id string")
    src = spark.createDataFrame([("Data.Name", "Name", "high", True), ("Data.Mail", "Mail", "high", True)], "id string, name string, sensitivity string, is_sensitive boolean")
    snk = spark.createDataFrame([("Storages.Db", "Db", ["db.example"])], "id string, name string, domains array<string>")
    assert got(policy.flow_violations(policy.with_rules(flows, src, snk), [p], repo=True), "repo", "source_id", "paths") == [("acc1", "Data.Name", ["1-2"])]
    api = policy.Policy("a", sinks=("Sinks.ThirdParties.API.*",), domains=("amazonaws",))
    df = spark.createDataFrame([("Sinks.ThirdParties.API.x.amazonaws.com", "n", []), ("Sinks.ThirdParties.API.y.org", "n", ["amazonaws"])], "sink_id string, sink_name string, sink_domains array<string>")
    assert [r.x for r in df.select(policy.sink_test(api).alias("x")).collect()] == [True, False]
    sources_ = spark.createDataFrame([("r", "Data.Name", True)], "repo string, source_id string, source_is_sensitive boolean")
    only = policy.Policy("only", sources=("Data.*",), sinks=())
    assert policy.processing_violations(sources_, [only]).count() == 1 and policy.processing_violations(sources_, [only], strict_parity=True).count() == 0
    assert policy.categories_of({"a": "x, y", "b": "z"}) == {"x": "a", "y": "a", "z": "b"}


MANIFEST = """<?xml version="1.0" encoding="utf-8"?>
<manifest xmlns:android="http://schemas.android.com/apk/res/android">
  <uses-sdk android:targetSdkVersion="28"/>
  <uses-permission android:name="android.permission.WRITE_EXTERNAL_STORAGE"/>
  <application android:allowBackup="true">
    <provider android:name=".Open" android:exported="true"/>
    <provider android:name=".Safe" android:exported="true" android:permission="p"/>
    <provider android:name=".Closed"/>
    <provider android:name=".Path" android:exported="true"><path-permission android:readPermission="q"/></provider>
  </application>
</manifest>"""
LAYOUT = '<L xmlns:android="a"><EditText android:id="@+id/email"/><EditText android:id="@+id/note" android:inputType="textPersonName|textNoSuggestions"/><B><EditText android:id="@+id/passport"/></B></L>'


def app(spark):
    files = spark.createDataFrame([("r", "app/AndroidManifest.xml", MANIFEST), ("r", "res/l.xml", LAYOUT), ("r", "bad.xml", "<a>"), ("r", "evil.xml", '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'), ("r", "none.xml", None)], "repo string, file string, content string")
    return xml.elements(files)


def test_xml_elements_layouts_and_permissions(spark):
    e = app(spark)
    assert {r.file for r in e.collect()} == {"app/AndroidManifest.xml", "res/l.xml"}
    assert got(e.where("element = 'uses-sdk'"), "path", "line") == [("/manifest[1]/uses-sdk[1]", 3)]
    assert got(xml.layouts(e), "name", "type_full_name") == [("email", "EditText"), ("note", "EditText"), ("passport", "EditText")]
    assert got(xml.permissions(e), "permission_type") == [("android.permission.WRITE_EXTERNAL_STORAGE",)]


def test_threats_of_apps(spark):
    mail = Rule("Data.Sensitive.Mail", ("(?i)email",))
    passport = Rule("Data.Sensitive.NationalIdentificationNumbers.Passport", ("(?i)passport",))
    nodes = [node(1, "IDENTIFIER", "x", type="T"), node(2, "CALL", "open", "open(MODE_WORLD_READABLE)"), node(3, "IDENTIFIER", code="MODE_WORLD_READABLE"), node(4, "PARAMETER", "o")]
    p = program(spark, nodes, [(2, "ARGUMENT", 3)], [(1, "catLevelOne", "sources"), (1, "id", mail.id), (4, "catLevelOne", "DerivedSources")])
    s = threats.Scan(p, elements=app(spark), sources=[mail, passport])
    sample = lambda f: [x for (x,) in got(f(s), "sample")]
    assert sample(threats.keyboard_cache) == ["@+id/email"] and sample(threats.data_backup) == ['android:allowBackup="true"']
    assert sample(threats.unmasked_input) == ['id="@+id/passport"']
    assert sample(threats.ipc_sharing) == [".Open", 'protectionLevel="normal"']
    assert sample(threats.external_storage) == ["android.permission.WRITE_EXTERNAL_STORAGE", "open(MODE_WORLD_READABLE)"]
    assert got(threats.background_screenshot(s), "repo") == [("r",)] and got(threats.cookie_consent(s), "source_id") == [(mail.id,)]
    assert got(threats.object_parameter(s), "source_id") == [("o",)]
    names = ["X.Storage.isAppDataBackupAllowed", "X.Sharing.IsObjectsWithPIIsPassedAsParameter", "X.Unknown.z"]
    found = threats.violations(s, [rules.Verdict(n) for n in names])
    assert got(found, "policy_id") == [("X.Sharing.IsObjectsWithPIIsPassedAsParameter",), ("X.Storage.isAppDataBackupAllowed",)]
    flow = spark.createDataFrame([("r", "Data.A", "Leakages.Log", "1-2")], "repo string, source_id string, sink_id string, path_id string")
    leak = threats.violations(threats.Scan(p, flows=flow), [rules.Verdict("X.Leakage.isDataLeakingToLog", flow=rules.Flow(("Data.*",), ("Leakages.*",)))], "dataflow")
    assert got(leak, "source_id", "sample") == [("Data.A", "Leakages.Log")]


def test_beans_and_hocon(spark):
    text = '<beans><bean class="a.Db"><property name="url" value="${db.url}"/><property name="user"><value>sa</value></property></bean></beans>'
    found = xml.elements(spark.createDataFrame([("r", "b.xml", text)], "repo string, file string, content string"))
    beans = xml.beans(found, properties(spark, (1, "p", "db.url", "jdbc:x")))
    assert got(beans, "class", "name", "value") == [("a.Db", "url", "jdbc:x"), ("a.Db", "user", "sa")]
    p = program(spark, [node(1, "TYPE_DECL", "Db", type="a.Db"), node(2, "MEMBER", "url")], [(1, "AST", 2)])
    assert got(xml.bean_links(beans, p.members()), "name", "node_id") == [("url", 2)]
    conf = 'a { b = 1, c.d : "x y" } # n\nhost = h.example\nurl = ${host}"/p"\nlist = [1, {k = v}]\na.b = 2\nweb : http://x\n'
    assert {n: v for n, v, _ in xml.hocon_rows(conf)} == {"a.b": "2", "a.c.d": "x y", "host": "h.example", "url": "h.example/p", "list[0]": "1", "list[1].k": "v", "web": "http:"}
    assert list(xml.hocon_rows("")) == [] and list(xml.hocon_rows("{")) == []


def test_hocon_over_files(spark):
    from sluice.sources import conf

    files = spark.createDataFrame(
        [
            ("r", "c/app.conf", 'include "base"\nurl = ${scheme}"://"${host}${?nothing}\npath = /bin\npath = ${path}":/usr/bin"\na = ${b}\nb = ${a}\nc = ${b}x\nmissing = ${nowhere}\nafter = ${missing}'),
            ("r", "c/base.conf", 'include "app.conf"\ninclude file("deep.conf")\nhost = base.example\nscheme = ${proto}'),
            ("r", "c/deep.conf", "host = deep.example\nproto = https"),
            ("s", "c/app.conf", "host = other"),
        ],
        "repo string, file string, content string",
    )
    rows = {(r.repo, r.file, r.name): (r.value, r.problem) for r in conf.resolved(files).collect()}
    app = {n: v for (r, f, n), v in rows.items() if (r, f) == ("r", "c/app.conf")}
    assert app["url"] == ("https://base.example", None) and app["path"] == ("/bin:/usr/bin", None) and app["proto"] == ("https", None)
    assert {n for n, v in app.items() if v[1] == "cycle"} == {"a", "b", "c"} and app["missing"] == ("${nowhere}", "missing") and app["after"][1] == "missing"
    assert rows["r", "c/deep.conf", "host"] == ("deep.example", None) and rows["s", "c/app.conf", "host"] == ("other", None)


def test_repository_readers(spark, tmp_path):
    java = "package a;\n/* c */\nimport java.util.List;\nimport static a.B.*;\n\nclass X {}\nimport no.More;\n"
    assert [n for n, _, _ in repository.import_rows(java, "java")] == ["java.util.List", "a.B.*"]
    assert [(n, a) for n, a, _ in repository.import_rows("import os\nfrom a.b import c as d\nx = 1\nimport z", "python")] == [("os", "os"), ("a.b.c", "d")]
    assert [(n, a) for n, a, _ in repository.import_rows("import x from './y'\nconst z = require('q')\nfoo()", "javascript")] == [("./y", "x"), ("q", "z")]
    pom = "<project><parent><groupId>g</groupId><artifactId>up</artifactId><version>1</version></parent><artifactId>a</artifactId><properties><v>2</v></properties><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId><version>${v}</version></dependency></dependencies></project>"
    gradle = "group = 'h'\ndependencies {\n  implementation 'i:j:3'\n}"
    found = repository.modules(spark.createDataFrame([("r", "pom.xml", pom), ("r", "build.gradle", gradle), ("r", "x.txt", "")], "repo string, file string, content string"))
    assert got(found, "kind", "group_id", "artifact_id", "version") == [("dependency", "i", "j", "3"), ("dependency", "x", "y", "2"), ("module", "g", "a", "1"), ("module", "h", "", "")]
    edges = repository.module_dependencies(found)
    assert got(edges, "module", "dependency", "internal") == [("g:a", "x:y", False), ("h:", "i:j", False)]
    assert got(audit.dependencies(edges, [Rule("S", ("x:y",), cat_two="storages")]), "library", "category", "rule") == [("i.j", "Unknown", "--"), ("x.y", "Storage", "S")]
    names = repository.package_names(spark.createDataFrame([("r", "package.json", '{"dependencies": {"a": "1"}}'), ("r", "Gemfile", "gem 'rails', '~> 5'\n# gem 'no'"), ("r", "composer.json", '{"require": {"p/q": "1"}}'), ("r", "package.json", "{")], "repo string, file string, content string"))
    assert got(names, "name") == [("a",), ("p/q",), ("rails",)]
    (tmp_path / "d.json").write_text(json.dumps([{"groupId": "a", "name": "b", "ruleId": "R", "filePath": "f", "version": "1"}]))
    info = repository.dependency_info(spark, str(tmp_path / "d.json"))
    assert got(info, "name", "file", "rule_id") == [("a.b", "f", "R")] and got(repository.dependency_nodes(info, "r"), "label") == [("DEPENDENCY",)]
    git = tmp_path / ".git" / "logs"
    git.mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "HEAD").write_text("0 abc user\n")
    (tmp_path / ".git" / "config").write_text("[remote]\n url = https://u:t@h/x.git\n")
    assert repository.git_metadata(str(tmp_path)) == {"branch": "main", "commitId": "abc", "remoteUrl": "https://h/x.git"} and repository.git_metadata("/nowhere") == {} and repository.system_info()["os"]
    listing = spark.createDataFrame([("r", "a.py", 1), ("r", "b.py", 2), ("r", "c.go", 3), ("s", "x.txt", 4)], "repo string, file string, size long")
    assert got(repository.languages(listing), "repo", "language") == [("r", "python"), ("s", "default")]
    assert [r.extension for r in repository.extension_totals(listing).collect()][0] == ".py"


def test_data_tools(spark):
    schema = "models:\n  - name: users\n    columns: [{name: id}, {name: email}]\nsources:\n  - name: raw\n    tables: [{name: t}]\n"
    found = repository.read_dbt(spark.createDataFrame([("r", "m.yml", schema), ("r", "b.yml", "a: ["), ("r", "x.sql", schema)], "repo string, file string, content string"))
    assert got(found, "model", "column_name", "kind") == [("t", "", "source"), ("users", "email", "model"), ("users", "id", "model")]
    project = repository.dbt_project(spark, "name: shop\nprofile: p\n", "p:\n  target: dev\n  outputs:\n    dev: {type: postgres, host: h, dbname: d, schema: s}\n")
    assert project["rule_id"] == "Storages.DBT.postgres.Write" and project["location"] == "h"
    row = repository.dbt_schema(found, project).first()
    assert row.db_name == "d" and row.schema.tables[1].columns == ["email", "id"]
    syncs = repository.read_syncs(spark.createDataFrame([("r", "s.yml", "model: users\ndestination: d1\nschedulePaused: true\n"), ("r", "manifest.yml", "destinations:\n  d1: {type: braze}\n"), ("r", "users.yml", "slug: users\nrawSql: select email from t\n")], "repo string, file string, content string"))
    assert got(repository.synced(syncs), "model", "actual_destination_name", "schedule_paused") == [("users", "braze", True)]


def test_sql_elsewhere(spark):
    props = properties(spark, (1, "a.yml", "query", "select a, b from t"), (2, "a.yml", "queries", "select x from y"))
    found = code_sql.in_properties(props)
    assert got(found, "table_name", "column_name") == [("t", "a"), ("t", "b")]
    q, t, c = code_sql.table_nodes(found)
    assert (q.count(), t.count(), c.count()) == (1, 1, 2) and got(c.join(t.select(F.col("id").alias("parent_id"), F.col("name").alias("n")), "parent_id"), "n", "name") == [("t", "a"), ("t", "b")]
    p = program(spark, [node(1, "CALL", "Query"), node(2, "CALL", "<operator>.addition", '"select a " + "from t"', arg=1), node(3, "LITERAL", code='"select a "', arg=1), node(4, "LITERAL", code='"from t"', arg=2)], [(1, "AST", 2), (1, "ARGUMENT", 2), (2, "AST", 3), (2, "AST", 4)])
    assert got(code_sql.in_code(p), "table_name", "column_name") == [("t", "a")]
    schema = 'ActiveRecord::Schema.define do\n  create_table "users", force: :cascade do |t|\n    t.string "email"\n    t.index ["email"]\n    t.integer :age\n  end\nend\n'
    assert got(code_sql.ruby_schema(spark.createDataFrame([("r", "db/schema.rb", schema)], "repo string, file string, content string")), "table_name", "column_name", "line") == [("users", "age", 5), ("users", "email", 3)]
    m = program(spark, [node(1, "TYPE_DECL", "User", type="m.User"), node(2, "MEMBER", "Email"), node(3, "CALL", "Create"), node(4, "IDENTIFIER", "u", type="*m.User", arg=1)], [(1, "AST", 2), (3, "ARGUMENT", 4)])
    assert got(code_sql.of_mapped_types(m, m.calls()), "table_name", "column_name") == [("User", "Email")]
    g = program(spark, [node(1, "LITERAL", code="`query Q($id: ID) { user(id: $id) { email firstName } }`"), node(2, "LITERAL", code="`query`")])
    assert got(code_sql.graphql(g, [Rule("M", ("email",)), Rule("N", ("(?i)firstname",))]), "id", "rule_id", "name") == [(1, "M", "email"), (1, "N", "firstName")]


def tagged(spark):
    nodes = [node(1, "IDENTIFIER", "mail", line=3, file="a.cs"), node(2, "IDENTIFIER", "mail", line=3, file="a.cs"), node(3, "IDENTIFIER", "mailX", line=4, file="b.java"), node(4, "CALL", "send", full="api.send", line=9, file="a.cs"), node(5, "ANDROID_XML_PERMISSION_NODE", "p", file="m.xml")]
    tags = [(i, n, v) for i in (1, 2, 3) for n, v in (("id", "Data.Mail"), ("catLevelOne", "sources"))] + [(4, "id", "Api"), (4, "catLevelOne", "sinks"), (4, "apiUrlApi", "h.example"), (5, "id", "Data.P")]
    return program(spark, nodes, [(1, "FLOWS", 4)], tags)


MAIL, API = Rule("Data.Mail", ("mail",), name="Mail", is_sensitive=True), Rule("Api", ("api.*",), name="Api", domains=("h.example",), cat_one="sinks", cat_two="third_parties", node_type="api")


def test_documents(spark, tmp_path):
    p, r = tagged(spark), document.rule_rows(spark, [MAIL, API])
    flows = spark.createDataFrame([("r", "Data.Mail", "Api", "third_parties", "api", "1-4", [1, 4]), ("r", "Data.Mail", "Api", "third_parties", "api", "3-1-4", [3, 1, 4])], "repo string, source_id string, sink_id string, sink_sub_category string, sink_node_type string, path_id string, path array<long>")
    assert got(document.sources(p, r), "id", "isSensitive") == [("Data.Mail", True)]
    sink = document.sinks(p, r).first()
    assert (sink.id, sink.sinkType, sink.apiUrl) == ("Api", "api", ["h.example"])
    own = document.source_processing(p, flows).first()
    assert [(o.fileName, o.lineNumber) for o in own.occurrences] == [("a.cs", 4), ("b.java", 4)] and len(document.source_processing(p, dedup=False).first().occurrences) == 2
    assert document.sink_processing(p).first().occurrences[0].lineNumber == 10  # C# counts from 0
    flow = document.dataflows(p, flows, r).first()
    assert flow.kind == "third_parties" and [x.pathId for x in flow.sinks[0].paths] == ["1-4", "3-1-4"] and flow.sinks[0].name == "Api" and len(flow.sinks[0].paths[1].path) == 3
    kept, removed = document.limited(flows, document.Options(element_limit=2))
    assert got(kept, "path_id") == [("1-4",)] and got(removed, "path_id") == [("3-1-4",)]
    kept, removed = document.limited(flows, document.Options(paths_per_pair=1))
    assert got(kept, "path_id") == [("1-4",)] and removed.count() == 1
    sections = {"sources": document.sources(p, r), "dataFlow": document.dataflows(p, flows, r)}

    @document.script("note")
    def note(doc):
        return doc.withColumn("note", F.lit("seen"))

    doc = document.document(p.nodes.select("repo").distinct(), sections)
    document.write(doc, str(tmp_path), options=document.Options(script="note"), removed=removed)
    back = spark.read.json(str(tmp_path / "result")).first()
    assert back.note == "seen" and json.loads(back.sources[0])["id"] == "Data.Mail"
    assert got(document.summary(sections), "section", "n") == [("dataFlow", 1), ("sources", 1)]
    document.write_items(doc.withColumn("repo_item", F.lit("app--users")), str(tmp_path / "items"))
    assert spark.read.json(str(tmp_path / "items")).first().repoName == "r/app/users"
    assert got(document.intermediate_flows(flows), "source") == [("Data.Mail",)]
    v = document.violations(spark, policy.combined([], [policy.flow_violations(flows, [policy.Policy("P")])], []), [rules.Verdict("P", name="Pol")])
    assert got(v, "policy_id", "name") == [("P", "Pol")]
    points = spark.createDataFrame([("r", 4, "C", "/x")], "repo string, id long, rule_id string, end_point string")
    col = document.collections(points, spark.createDataFrame([("r", 4, "Data.Mail")], "repo string, id long, rule_id string"), p.nodes, r).first()
    assert col.collectionId == "C" and col.collections[0].occurrences[0].endPoint == "/x"
    links = document.file_links(flows.select("repo", "path_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("file")), spark.createDataFrame([("r", "a", "c")], "repo string, file string, imported string"), spark.createDataFrame([("r", "n", "a")], "repo string, namespace string, file string"), spark.createDataFrame([("r", "a", "p")], "repo string, file string, property_file string"), spark.createDataFrame([("r", "a", "o")], "repo string, file string, origin_file string"))
    assert got(links["dataflow"], "file", "files") == [("a", ["b"]), ("b", ["a"])] and set(links) == {"dataflow", "imports", "namespaces", "properties", "origins"}
    excerpts = document.with_excerpts(p.nodes.where("id = 3"), spark.createDataFrame([("r", "b.java", "1\n2\n3\n4\n5")], "repo string, file string, content string"), 1)
    assert excerpts.first().excerpt == "3\n4 /* <===  */ \n5"
    document.write_semantics(spark.createDataFrame([('"a" 0->0',)], "line string"), str(tmp_path / "sem"))
    assert spark.read.text(str(tmp_path / "sem")).first().value == '"a" 0->0'


def test_feign_addresses(spark):
    p = program(spark, [node(1, "TYPE_DECL", "F"), node(2, "ANNOTATION", "FeignClient", '@FeignClient(url = "http://h")'), node(3, "METHOD", "m"), node(4, "ANNOTATION", "GetMapping", '@GetMapping("/u")')], [(1, "AST", 2), (1, "AST", 3), (3, "AST", 4)])
    assert got(document.feign_urls(p), "url") == [("http://h/u",)]


def test_audit_sheets(spark, tmp_path):
    nodes = [node(1, "TYPE_DECL", "User", type="a.User"), node(2, "MEMBER", "email", type="String", file="U.java"), node(3, "MEMBER", "age", type="int", file="U.java"), node(4, "METHOD", "getEmail"), node(5, "TYPE_DECL", "UserService", type="a.UserService"), node(6, "MEMBER", "x"), node(7, "METHOD", "getX"), node(8, "METHOD", "post", full="a.C.post"), node(9, "PARAMETER", "u", type="a.User"), node(10, "CALL", "get", "httpClient.get(url)", full="q.get:void()"), node(11, "CALL", "f", "f(mail)", full="<unresolvedNamespace>.f"), node(12, "IDENTIFIER", "mail", type="x")]
    p = program(spark, nodes, [(1, "AST", 2), (1, "AST", 3), (1, "AST", 4), (5, "AST", 6), (5, "AST", 7), (8, "AST", 9), (12, "FLOWS", 11)], [(2, "id", "Data.Mail"), (8, "COLLECTION_METHOD_ENDPOINT", "/u"), (12, "id", "Data.Mail"), (12, "catLevelOne", "sources")])
    sheet = {r.name: r for r in audit.java_elements(p).collect()}
    assert set(sheet) == {"email", "age"} and (sheet["email"].tagged, sheet["age"].tagged, sheet["email"].end_point, sheet["email"].score) == ("YES", "--", "/u", 0.75)
    assert {r.name: r.score for r in audit.other_elements(p, "go").collect()}["email"] == 1.0
    cand = {r.name: r for r in audit.declaration_candidates(p).collect()}
    assert cand["email"].source_rule_id == "Data.Mail" and "x" not in cand
    assert got(audit.unresolved_flows(p, p.nodes.where("id = 12")), "source_id", "path_id") == [("Data.Mail", "12-11")]
    setting = rules.Catalogue().setting
    assert got(audit.api_candidates(p, setting), "code") == [("httpClient.get(url)",)]
    cols = spark.createDataFrame([("r", 1, "f", "users", "email", 1), ("r", 2, "f", "users", "id", 1)], "repo string, id long, file string, table_name string, column_name string, line int")
    assert got(audit.sql_elements(cols), "name") == [("email",)]
    sheets = audit.assembled(p, "java", {"a": spark.createDataFrame([("r", "S", "T", "1-2")], "repo string, source_id string, sink_id string, path_id string")}, properties(spark), None, [], setting, cols)
    audit.workbook({"elements": sheets["elements"]}, str(tmp_path))
    assert spark.read.option("header", "true").csv(str(tmp_path / "elements")).count() == 2 and {"flows", "apis", "urls", "http", "sql_elements", "unresolved"} <= set(sheets)


def test_scalars_of_the_catalogue(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(fn.url_host(F.lit(u))) for u in ("api.example.com/path", '"https://www.a.org:80/x"', "http://b.c?q", "not a url:x")] == ["api.example.com", "a.org", "b.c", "not a url:x"]
    assert one(fn.clean_url(F.lit('""a"'))) == '"a' and one(fn.service_domain(F.lit("http://users"))) == "users"
    assert one(fn.type_name(F.lit("a.py:<module>.C.<init>"))) == "a.py:<module>.C" and one(fn.placeholder(F.lit("${a.b:x}"))) == "a.b"
    assert one(fn.item_path(F.lit("a--b"))) == "a/b" and one(fn.item_name(F.lit("a/b"))) == "a--b" and one(fn.size_text(F.lit(5))) == "5 bytes"
    assert tagging.match_rows(spark.range(2), []).count() == 0
    kept, rest = predicates.parted(spark.range(4), F.col("id") > 2)
    assert (kept.count(), rest.count()) == (1, 3)


def test_scan_by_profile(spark):
    nodes = [node(1, "TYPE_DECL", "User", type="a.User"), node(2, "MEMBER", "email"), node(3, "IDENTIFIER", "email", type="String"), node(4, "CALL", "save", "db.save(email)", full="db.save:void()"), node(5, "IDENTIFIER", "email", arg=1)]
    p = program(spark, nodes, [(1, "AST", 2), (3, "FLOWS", 4), (4, "ARGUMENT", 5)])
    c = rules.Catalogue(sources=(Rule("Data.Sensitive.Mail", ("email",), cat_one="sources"),), sinks=(Rule("Storages.Db", ("db[.]save.*",), cat_one="sinks", cat_two="storages"),), policies=(rules.Verdict("P", action="deny", flow=rules.Flow(("Data.*",), ("**",))),))
    seen = []
    out = profiles.scan(profiles.Context(spark, p, c, "go"), each=lambda name, _: seen.append(name))
    assert seen == [f.__name__ for f in profiles.PROFILES["go"]] and len(out.metrics) == len(seen)
    assert got(out.flow_stages["final"], "source_id", "sink_id", "path_id") == [("Data.Sensitive.Mail", "Storages.Db", "3-4")]
    assert got(out.violations, "policy_id", "kind", "sink_id", "detail") == [("P", "dataflow", "Storages.Db", "3-4")]
    found = profiles.sections(out)
    assert {"sources", "sinks", "dataFlow", "violations", "metrics", "fileLinks"} <= set(found) and found["violations"].count() == 1
    assert profiles.profile("cobol") == profiles.PROFILES["default"] and len(profiles.profile("php", metadata=True)) == 1
    times = profiles.pass_times(spark.createDataFrame(list(out.metrics), "name string, seconds double"))
    assert times.count() == len(set(seen))
    assert graph.FIELD_ACCESS and sources.PROFILES


def test_commands(spark, tmp_path):
    from sluice.__main__ import main

    folder(tmp_path / "rules")
    assert main(["validate", str(tmp_path / "rules")]) == 1
    p = program(spark, [node(1, "IDENTIFIER", "firstname", type="String"), node(2, "CALL", "save", full="db.save:void()")], [(1, "FLOWS", 2)])
    for name, df in (("nodes", p.nodes), ("edges", p.edges), ("tags", p.tags), ("properties", properties(spark))):
        df.write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    assert main(["scan", str(tmp_path / "in"), str(tmp_path / "rules"), "go", str(tmp_path / "out")]) == 0
    doc = spark.read.json(str(tmp_path / "out" / "result")).first()
    assert doc.repo == "r" and json.loads(doc.sources[0])["id"] == "Data.Name"


def test_properties_of_a_language(spark):
    from sluice.sources import files, properties as props

    df = spark.createDataFrame([("r", "a/b.conf", "x = 1"), ("r", "c.properties", "y=2"), ("r", ".env", "Z=3"), ("r", "p/generated-config/q.json", '{"k": 4}')], "repo string, file string, content string")
    assert got(props.read_all(df, "java"), "name", "value") == [("x", "1"), ("y", "2")] and got(props.read_all(df, "go"), "name") == [("Z",)]
    assert got(props.read_all(df, "cobol"), "name") == [("Z",), ("k",), ("x",), ("y",)] and got(props.generated(df), "name", "value") == [("k", "4")]
    assert got(files.numbered(df.select("file")), "file", "ord") == [(".env", 0), ("a/b.conf", 0), ("c.properties", 0), ("p/generated-config/q.json", 0)]
