"""Scans by language: which taggers, linkers and checks run, in their order. A profile is data; a pass is a function from a scan to a scan."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.exporters import audit, document
from sluice.operators import collections, flows, graph, linkers, policy, semantics, sinks, sources, threats
from sluice.operators._stage import keep
from sluice.operators.graph import Program
from sluice.operators.sources import apply_rules
from sluice.sources import rules as catalogue
from sluice.sources.rules import Catalogue


@dataclass(frozen=True)
class Context:
    """A scan: program, properties and rules, what was found, and how long each pass took to plan. Never changed in place."""

    spark: SparkSession
    program: Program
    catalogue: Catalogue
    language: str = "default"
    properties: DataFrame | None = None
    imports: DataFrame | None = None
    sql_columns: DataFrame | None = None
    dom: DataFrame | None = None
    syncs: DataFrame | None = None
    layouts: DataFrame | None = None
    elements: DataFrame | None = None
    dependencies: DataFrame | None = None
    dependency_info: DataFrame | None = None
    modules: DataFrame | None = None
    semantics: DataFrame | None = None
    more_flows: DataFrame | None = None
    consumers: DataFrame | None = None
    flow_stages: dict[str, DataFrame] = field(default_factory=dict)
    violations: DataFrame | None = None
    details: DataFrame | None = None
    points: DataFrame | None = None
    metrics: tuple[tuple[str, float], ...] = ()

    @property
    def exclusions(self) -> list[str]:
        return [p for r in self.catalogue.exclusions for p in r.patterns]

    def tagged(self, *tags: DataFrame) -> Context:
        return replace(self, program=self.program.with_tags(*tags))

    def with_sinks(self, found: DataFrame, rules: Sequence) -> Context:
        """With the rule tags of matched sinks (repo, id, file, rule_id), for rules that are in the catalogue."""
        return self.tagged(apply_rules(self.spark, found.select("repo", "id", "file", "rule_id"), rules, self.exclusions))


Pass = Callable[[Context], Context]


def link_properties(c: Context) -> Context:
    if c.properties is None:
        return c
    how = {"java": (linkers.java_properties, linkers.yaml_properties), "kotlin": (linkers.java_properties,), "go": (linkers.yaml_properties,), "javascript": (linkers.javascript_properties,), "python": (linkers.python_properties,), "ruby": (linkers.ruby_properties,)}
    program = c.program
    for link in how.get(c.language, ()):
        program = program.with_edges(linkers.link_edges(link(program, c.properties)))
    return replace(c, program=program)


def full_names(c: Context) -> Context:
    """Full names that the front end left open."""
    if c.language in ("java", "kotlin"):
        calls = linkers.lombok_full_names(c.program)
    elif c.language == "javascript" and c.imports is not None:
        calls = linkers.fill_empty_names(linkers.javascript_full_names(c.program, c.imports))
    elif c.language == "ruby":
        calls = sinks.rails_full_names(c.program)
    else:
        return c
    nodes = c.program.nodes.where("label <> 'CALL'").unionByName(calls.select(*c.program.nodes.columns))
    return replace(c, program=replace(c.program, nodes=nodes))


def recover(c: Context) -> Context:
    """Types spread along assignments, and calls linked by them: Python, Ruby and C."""
    program = replace(c.program, nodes=linkers.recovered_types(c.program))
    return replace(c, program=program.with_edges(linkers.link_by_hints(program)))


def declared(c: Context) -> Context:
    if not c.catalogue.declared:
        return c
    table = catalogue.declared_table(c.spark, c.catalogue)
    return c.tagged(sources.declared_tags(c.spark, c.program, table, c.catalogue.sources, catalogue.DISABLED_BY_DECLARATION))


def source_tagger(c: Context) -> Context:
    if c.language not in sources.PROFILES:
        return c
    return replace(c, program=sources.tag_sources(c.spark, c.program, c.catalogue.sources, c.language, c.exclusions))


def literal_tagger(c: Context) -> Context:
    found = sources.symbols(c.program, c.catalogue.sources) if c.language == "ruby" else sources.literals(c.program, c.catalogue.sources, c.language if c.language in sources.LITERAL_CALLS else "common")
    return c.tagged(apply_rules(c.spark, found, c.catalogue.sources, c.exclusions), sources.mark(found, "VARIABLE_REGEX_LITERAL"))


def sql_tagger(c: Context) -> Context:
    if c.sql_columns is None:
        return c
    found = sources.columns_by_token(c.sql_columns, c.catalogue.sources, "name")
    return c.tagged(apply_rules(c.spark, found, c.catalogue.sources, c.exclusions), sources.mark(found, "VARIABLE_REGEX_LITERAL"))


def insensitive(c: Context) -> Context:
    return c.tagged(sources.insensitive_tags(c.program, c.catalogue.sources))


def database_config(c: Context) -> Context:
    return c if c.properties is None else replace(c, details=sinks.database_details(c.properties, c.language))


def sink_tagger(c: Context) -> Context:
    found = sinks.regular(c.program, c.catalogue.sinks, prefix=c.language == "javascript", skip_meta=c.language in ("javascript", "ruby"))
    out = c.with_sinks(found, c.catalogue.sinks)
    return out.tagged(sinks.detail_tags(found, c.details)) if c.details is not None else out


def api_rules(c: Context) -> list:
    return [r for r in c.catalogue.sinks if r.node_type == "api" and not r.is_generated]


def with_apis(c: Context, found: DataFrame, rule) -> Context:
    """With API sinks (repo, id, file, rule_id, api_url). What was made of a rule by a domain has the rule's other values: its table is joined, never read here."""
    own = found.select("repo", "id", "file", "rule_id")
    rule_tags = sources.apply_rules(c.spark, own.withColumn("rule_id", F.lit(rule.id)), [rule], c.exclusions)
    made = own.select("repo", F.col("id").alias("node_id"), F.col("rule_id").alias("made")).distinct()
    named = rule_tags.join(made, ["repo", "node_id"]).withColumn("value", F.when(F.col("value") == rule.id, F.col("made")).otherwise(F.col("value")))
    return c.tagged(named.select(*graph.TAG_COLUMNS), sinks.api_tags(found))


def api_tagger(c: Context) -> Context:
    """Calls of HTTP libraries that addresses flow to. Java has two forms: by the libraries' calls, or, where none is resolved, by any request in a file that imports one."""
    language = c.language if c.language in sinks.API_PROFILES else "generic"
    if c.properties is None:
        return c
    version = "V2"
    if c.language in ("java", "kotlin") and c.imports is not None:
        version = sinks.api_version(c.program, c.catalogue.setting, c.imports)
        if version == "skip":
            return c
    out = c
    for rule in api_rules(c):
        calls = sinks.http_calls(out.program, c.catalogue.setting, language) if version == "V2" else sinks.calls_in_importing_files(out.program, c.catalogue.setting, c.imports)
        seeds = sinks.addresses(out.program, c.properties, rule, c.catalogue.setting, language)
        out = with_apis(out, keep(sinks.api_sinks(out.program, calls, seeds, rule, c.catalogue.inferences), "apis"), rule)
    return out


def remote_apis(c: Context) -> Context:
    """APIs that need no address: gRPC stubs, callers of SOAP methods, Retrofit services."""
    out = c
    for rule in (r for r in api_rules(c) if r.id == sinks.THIRD_PARTY):
        api = lambda rows: rows.select("repo", "id", "file", F.lit(rule.id).alias("rule_id"), F.lit(sinks.API).alias("api_url"))  # noqa: B023, E731
        found = api(sinks.grpc_sinks(c.program)).unionByName(api(sinks.callers(c.program, sinks.soap_methods(c.program))))
        from_base = sinks.retrofit_apis(c.program).join(c.program.nodes.select("repo", "id", "file"), ["repo", "id"])
        known = from_base.select("repo", "id", "file", F.when(F.col("api_url").isNotNull(), F.concat_ws(".", F.lit(rule.id), sinks.fn.url_host(F.col("api_url")))).otherwise(F.lit(rule.id)).alias("rule_id"), F.coalesce("api_url", F.lit(sinks.API)).alias("api_url"))
        out = with_apis(out, keep(found.unionByName(known).distinct(), "remote"), rule)
    return out


def page_apis(c: Context) -> Context:
    """Scripts and frames of templates, and calls that load a script, by the address they load from."""
    out = c
    for rule in api_rules(c):
        found = sinks.script_calls(c.program, rule)
        if c.dom is not None:
            found = found.unionByName(sinks.template_apis(c.dom, rule, c.catalogue.setting("apiIdentifier")).select(*found.columns))
        out = with_apis(out, keep(found, "pages"), rule)
    return out


def cookie_sinks(c: Context) -> Context:
    """Cookie writes by the cookie's name, each with the values of the base rule."""
    base = next((r for r in c.catalogue.sinks if r.id == sinks.COOKIE_WRITE), None)
    if base is None:
        return c
    named = sinks.cookies(c.program, sinks.regular(c.program, [base], prefix=True, skip_meta=True)).where("cookie is not null")
    tags = named.select("repo", F.col("id").alias("node_id"), F.explode(F.array(F.struct(F.lit("id").alias("name"), F.col("rule_id").alias("value")), F.struct(F.lit(f"{base.cat_two}{base.node_type}").alias("name"), F.col("rule_id").alias("value")))).alias("t"))
    return c.tagged(tags.select("repo", "node_id", "t.name", "t.value"))


def buckets(c: Context) -> Context:
    """Names of buckets that tagged calls read and write, as database details."""
    found = sinks.python_buckets(c.program) if c.language == "python" else sinks.java_buckets(c.program)
    return replace(c, details=found if c.details is None else c.details.unionByName(found, allowMissingColumns=True))


def dependency_tagger(c: Context) -> Context:
    if c.dependencies is None or c.dependency_info is None:
        return c
    return c.with_sinks(sinks.dependency_tags(c.dependencies, c.dependency_info), c.catalogue.sinks)


def skip_listed(c: Context) -> Context:
    """Sinks that the catalogue's skip list names lose their tags."""
    if not c.catalogue.sink_skips:
        return c
    calls = c.program.tagged(c.program.calls(), "catLevelOne", "sinks")
    gone = calls.select("repo", "id").join(sinks.skipped(calls, c.catalogue.sink_skips).select("repo", "id"), ["repo", "id"], "left_anti")
    return replace(c, program=replace(c.program, tags=c.program.tags.join(gone.withColumnRenamed("id", "node_id"), ["repo", "node_id"], "left_anti")))


def captures(c: Context) -> Context:
    """Flows in and out of lambdas."""
    return replace(c, program=c.program.with_edges(linkers.lambda_captures(c.program)))


def properties_in_code(c: Context) -> Context:
    """Properties that the code itself declares, beside those of files."""
    found = linkers.properties_in_code(c.program, c.language).withColumnRenamed("node_id", "id")
    return replace(c, properties=keep(found if c.properties is None else c.properties.unionByName(found.select(*c.properties.columns)), "properties"))


def literal_derived(c: Context) -> Context:
    """Ruby: symbols beside tagged ones, objects of models with a tagged column, and settings of document databases."""
    beside = sources.symbols_by_sibling(c.program).join(c.program.nodes.select("repo", "id", "file"), ["repo", "id"])
    out = c.tagged(apply_rules(c.spark, beside.select("repo", "id", "file", "rule_id"), c.catalogue.sources, c.exclusions), sources.mark(beside, "VARIABLE_REGEX_LITERAL"))
    if c.sql_columns is not None:
        tagged = sources.columns_by_token(c.sql_columns, c.catalogue.sources, "name")
        found = sources.schema_identifiers(c.program, tagged)
        out = out.tagged(apply_rules(c.spark, found, c.catalogue.sources, c.exclusions), sources.mark(found, "VARIABLE_REGEX_IDENTIFIER"))
    if c.properties is not None:
        found = sources.document_databases(sources.document_fields(c.program), c.properties)
        out = replace(out, details=found if out.details is None else out.details.unionByName(found, allowMissingColumns=True))
    return out


def asset_tagger(c: Context) -> Context:
    return c.tagged(sources.assets(c.program))


def permission_tagger(c: Context) -> Context:
    if c.elements is None:
        return c
    nodes = permission_nodes(c.elements)
    return c.tagged(apply_rules(c.spark, sources.permissions(nodes).select("repo", "id", "file", "rule_id"), c.catalogue.sources, c.exclusions))


def permission_nodes(elements: DataFrame) -> DataFrame:
    """(repo, id, file, line, name, permission_type): the permissions that manifests ask for."""
    named = threats.attribute("name")
    own = elements.where("element like 'uses-permission%'").select("repo", "file", named.alias("name"))
    return own.select("repo", F.xxhash64("repo", "file", "name").alias("id"), "file", F.lit(None).cast("int").alias("line"), "name", F.element_at(F.split("name", r"\."), -1).alias("permission_type")).distinct()


def repository_items(c: Context) -> Context:
    return c.tagged(collections.repository_items(c.program)[1])


def database_reads(c: Context) -> Context:
    """Queries by the data elements that their columns are, and so sources of flows."""
    rules = c.catalogue.sources
    sensitive = keep(sources.sensitive_types(c.program, rules).select("repo", "type", "rule_id").distinct(), "sensitive")
    queries = keep(semantics.query_nodes(c.program), "queries")
    found = semantics.read_tags(queries, rules, sensitive, graph.table_of_classes(c.program), "python" if c.language == "python" else "java")
    if c.language != "python":
        calls = semantics.named_query_uses(c.program)
        named = c.program.of("ANNOTATION").join(calls.select("repo", "id").distinct(), ["repo", "id"], "left_semi")
        by_name = semantics.read_tags(named, rules, sensitive, graph.table_of_classes(c.program))
        found = found.unionByName(by_name.join(calls, ["repo", "id"]).select("repo", F.col("call").alias("id"), "rule_id"))
    placed = keep(found.distinct().join(c.program.nodes.select("repo", "id", "file"), ["repo", "id"]), "reads")
    return c.tagged(apply_rules(c.spark, placed, rules, c.exclusions))


def _with_members(c: Context) -> DataFrame:
    """(repo, type, rule_id, member_id): sensitive classes with the member that makes them so; the first by id."""
    return sources.matching_members(c.program, c.catalogue.sources).groupBy("repo", F.col("owner").alias("type"), "rule_id").agg(F.min("id").alias("member_id"))


def read_flows(c: Context) -> Context:
    """Flows of what storage reads return, and of messages that consumers take."""
    sensitive = keep(_with_members(c), "members")
    kinds = {(r.id, r.cat_two, r.node_type) for r in c.catalogue.sinks if r.cat_two == "storages"}
    if not kinds:
        return c
    table = c.spark.createDataFrame(sorted(kinds), "sink_id string, sink_sub_category string, sink_node_type string")
    ids = c.program.tags.where("name = 'id'").select("repo", F.col("node_id").alias("id"), F.col("value").alias("sink_id"))
    reads = c.program.calls().join(ids.join(F.broadcast(table), "sink_id").where(F.col("sink_id").rlike("(?i)read")), ["repo", "id"])  # the catalogue's rules
    found = flows.read_flows(reads, sensitive)
    if c.consumers is not None:
        found = found.unionByName(flows.consumer_flows(c.program, c.consumers, sensitive))
    return replace(c, more_flows=keep(found if c.more_flows is None else c.more_flows.unionByName(found), "reads"))


def synced(c: Context) -> Context:
    """Flows of columns to the data syncs of their models."""
    if c.syncs is None or c.sql_columns is None:
        return c
    columns = sources.columns_by_token(c.sql_columns, c.catalogue.sources, "name").select("repo", "id", "rule_id", "file")
    found = keep(linkers.synced_flows(columns, sinks.synced_sinks(c.syncs, c.catalogue.sinks).select("repo", "id", "rule_id", "model")), "synced")
    return replace(c, more_flows=found if c.more_flows is None else c.more_flows.unionByName(found))


def marked_apis(c: Context) -> Context:
    """APIs by full name and by inference, which all languages mark before their API tagger."""
    pattern = c.catalogue.setting("apiSinkByMethodFullName")
    out = c.tagged(sinks.by_full_name(c.program, pattern)) if pattern else c
    if c.properties is None or not c.catalogue.inferences:
        return out
    found = keep(sinks.inferred_endpoints(out.program, c.properties, c.catalogue.inferences), "endpoints")
    return out.tagged(sinks.api_tags(found), sources.mark(found, "API_SINK_MARKED"), sources.mark(found, "API_URL_MARKED"))


def java_apis(c: Context) -> Context:
    """APIs by the parameters, annotations and makers of their clients, and by Retrofit and Feign."""
    found = sinks.apis_by_parameter(c.program).unionByName(sinks.apis_by_marked_parameter(c.program))
    out = c.tagged(sources.mark(found, "API_SINK_MARKED"))
    for rule in (r for r in c.catalogue.sinks if r.id == sinks.THIRD_PARTY):
        known, _ = sinks.feign_apis(out.program, rule)
        out = out.tagged(sinks.api_tags(known))
        if c.properties is not None:
            out = out.tagged(sinks.api_tags(sinks.apis_with_method_urls(out.program, sinks.apis_by_returning_method(out.program).unionByName(found), rule.pattern, c.properties)))
    return out


def class_sinks(c: Context) -> Context:
    rules = {"java": sinks.JAVA_CLASSES, "python": sinks.PYTHON_CLASSES, "ruby": sinks.RUBY_CLASSES, "kotlin": (*sinks.KOTLIN_ANNOTATED, *sinks.JAVA_CLASSES)}[c.language]
    return c.with_sinks(sinks.inherit_sinks(c.program, c.language), rules)


def leakage_sinks(c: Context) -> Context:
    return c.with_sinks(sinks.leakages_by_receiver(c.program), sinks.RUBY_LEAKAGES)


def shared_log_sinks(c: Context) -> Context:
    return c.with_sinks(sinks.shared_logs(c.program), [r for r in c.catalogue.sinks if r.id == "ThirdParties.SDK.Sentry"])


def message_consumers(c: Context) -> Context:
    found = keep(sinks.consumers(c.program), "consumers")
    return replace(c.with_sinks(found, c.catalogue.sinks), consumers=found.select("repo", "id", "rule_id"))


def airflow(c: Context) -> Context:
    return c.with_sinks(sinks.operators(c.program, c.catalogue.sinks), (*c.catalogue.sinks, sinks.AIRFLOW_CUSTOM))


def flink(c: Context) -> Context:
    return c if c.imports is None else replace(c, program=sinks.flink(c.spark, c.program, c.imports, c.catalogue.raw_setting("flinkConnectorProducerRuleIds")))


def graphql_apis(c: Context) -> Context:
    rule = next((r for r in c.catalogue.sinks if r.id == sinks.THIRD_PARTY), None)
    packages = c.catalogue.raw_setting("apiGraphqlLibraries")
    if rule is None or not packages:
        return c
    found = sinks.graphql_apis(c.program, packages, c.catalogue.raw_setting("apiGraphqlReadSink"), c.catalogue.raw_setting("apiGraphqlWriteSink"), rule)
    made = [replace(rule, id=rule.id + k) for k in ("", "(Read)", "(Write)")]
    return c.with_sinks(found, made).tagged(sinks.api_tags(found))


def _handlers(c: Context, rule) -> tuple[DataFrame, DataFrame | None]:
    pattern, p = rule.pattern, c.program
    if c.language in ("java", "kotlin"):
        methods, classes = collections.annotated(p, pattern)
        remote = sinks.grpc_endpoints(p).unionByName(sinks.soap_methods(p)).select("repo", "id", F.lit("").alias("url"))
        return methods.unionByName(remote.select(*methods.columns)).unionByName(collections.java_routes(p, ROUTE_CALLS).select(*methods.columns)), classes
    if c.language == "python":
        return collections.python_routes(p).unionByName(collections.cherrypy_routes(p)), None
    if c.language == "csharp":
        return collections.csharp_controllers(p, pattern)
    if c.language == "php":
        methods, classes = collections.annotated(p, pattern, slash=True)
        routes = methods.unionByName(collections.php_routes(p))
        return routes if c.properties is None else routes.unionByName(collections.php_config_routes(p, c.properties)), classes
    by_language = {"javascript": collections.javascript_routes, "ruby": collections.ruby_routes, "go": collections.go_routes}
    return by_language[c.language](p), None


ROUTE_CALLS = r"(?i)(?:spark[.]Spark|io[.]javalin|io[.]vertx|ratpack)[.].*(?:get|post|put|patch|delete|route|handler):?.*"
WHAT = {"python": ("PARAMETER", "LOCAL", "GET_LITERAL"), "ruby": ("PARAMETER", "LOCAL", "LITERAL"), "go": ("PARAMETER", "LOCAL", "LITERAL")}


def collection_tagger(c: Context) -> Context:
    out, every = c, c.points
    for rule in (r for r in c.catalogue.collections if r.cat_two in ("annotations", "default")):
        handlers, classes = _handlers(out, rule)
        points, tags = collections.points(out.program, handlers, rule, c.catalogue.sources, classes, WHAT.get(c.language, ("PARAMETER",)), "self" if c.language in ("python", "ruby") else "this")
        out = out.with_sinks(points, c.catalogue.collections).tagged(tags)
        every = points if every is None else every.unionByName(points)
    return replace(out, points=every)


def layout_collections(c: Context) -> Context:
    """Inputs of app layouts that the code reads."""
    if c.layouts is None:
        return c
    out = c
    for rule in (r for r in c.catalogue.collections if r.cat_two == "android"):
        found = keep(collections.layout_points(c.program, c.layouts, rule), "layouts")
        out = out.with_sinks(found, c.catalogue.collections).tagged(sources.mark(found, "collectionSource", F.col("source")))
    return out


def forms(c: Context) -> Context:
    if c.dom is None:
        return c
    own = [r for r in c.catalogue.collections if r.cat_two == "webforms"]
    found = collections.web_forms(c.dom, own, c.catalogue.sources)
    col = found.where("role = 'collection'").select("repo", "id", "file", F.col("collection_id").alias("rule_id"), "source_id")
    src = found.where("role = 'source'").select("repo", "id", "file", F.col("source_id").alias("rule_id"))
    out = c.with_sinks(col, own).tagged(sources.mark(col, "collectionSource", F.col("source_id")))
    return out.tagged(apply_rules(c.spark, src, c.catalogue.sources, c.exclusions))


def synced_sinks(c: Context) -> Context:
    return c if c.syncs is None else c.with_sinks(sinks.synced_sinks(c.syncs, c.catalogue.sinks), c.catalogue.sinks)


def dataflow(c: Context) -> Context:
    patterns = {r.id: r.pattern for r in c.catalogue.sources}
    rows = keep(semantics.of_language(c.spark, c.program, c.catalogue.semantics, c.language), "semantics")
    stages = flows.dataflow(c.program, c.catalogue.sinks, patterns, language=c.language, semantics=rows, more=c.more_flows)
    return replace(c, flow_stages=stages, semantics=rows)


VIOLATION = ["repo", "policy_id", "kind", "source_id", "sink_id", "detail"]


def policies(c: Context) -> Context:
    """Violations of all kinds, by repository: of flows, of processing, of collections, and what the threats find."""
    own = [policy.from_verdict(v) for v in c.catalogue.policies]
    row = lambda df, kind, sink="cast(null as string)", detail="cast(null as string)": df.select("repo", "policy_id", F.lit(kind).alias("kind"), F.col("source_id").cast("string"), F.expr(sink).cast("string").alias("sink_id"), F.expr(detail).cast("string").alias("detail"))
    found = []
    src = c.spark.createDataFrame([(r.id, r.name, r.sensitivity, r.is_sensitive) for r in c.catalogue.sources], "id string, name string, sensitivity string, is_sensitive boolean")
    snk = c.spark.createDataFrame([(r.id, r.name, list(r.domains)) for r in c.catalogue.sinks], "id string, name string, domains array<string>")
    ids = document._ids(c.program.tags).join(flows.source_nodes(c.program).select("repo", "id"), ["repo", "id"], "left_semi").withColumnRenamed("rule_id", "source_id")
    final = policy.with_rules(c.flow_stages["final"], src, snk) if c.flow_stages else None
    if own:
        if final is not None:
            found.append(row(policy.flow_violations(final, own, repo=True), "dataflow", "sink_id", "array_join(paths, ',')"))
        about = src.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("sensitivity").alias("source_sensitivity"), F.col("is_sensitive").alias("source_is_sensitive"))
        processed = ids.join(F.broadcast(about), "source_id")  # the catalogue
        found.append(row(policy.processing_violations(processed, own), "processing", detail="id"))
        if c.points is not None:
            taken = point_sources(c).join(c.points.select("repo", "id", F.col("rule_id").alias("collection_id"), "end_point"), ["repo", "id"]).withColumnRenamed("rule_id", "source_id")
            found.append(row(policy.collection_violations(taken.select("repo", "collection_id", "source_id", "end_point"), own), "collection", "collection_id", "end_point"))
    scan = threats.Scan(c.program, c.elements, final, None, c.catalogue.sources)
    for kind in ("processing", "dataflow") if final is not None else ("processing",):
        rows = threats.violations(scan, c.catalogue.threats, kind)
        if rows is not None:
            found.append(row(rows, "threat", "cast(null as string)", "concat_ws(' ', sample, file)"))
    if not found:
        return c
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return replace(c, violations=keep(every.distinct(), "violations"))


def point_sources(c: Context) -> DataFrame:
    """(repo, id, rule_id): the data elements that collection points take: rule tags of what is under them."""
    under = c.program.hop(c.points.select("repo", "id").distinct(), "AST", to="node_id")
    ids = c.program.tags.where((F.col("name") == "id") & ~F.col("value").startswith("derived_")).select("repo", "node_id", F.col("value").alias("rule_id"))
    return under.join(ids, ["repo", "node_id"]).where(F.col("rule_id").isin([r.id for r in c.catalogue.sources])).select("repo", "id", "rule_id").distinct()


def sections(c: Context) -> dict[str, DataFrame]:
    """What a scan found, as the sections of its document: rows with ``repo``."""
    about = document.rule_rows(c.spark, (*c.catalogue.sources, *c.catalogue.sinks, *c.catalogue.collections))
    out = {"sources": document.sources(c.program, about), "sinks": document.sinks(c.program, about, c.details), "probableSinks": document.probable_sinks(c.program, c.catalogue.sink_skips, c.language == "python")}
    out["egress"] = document.egress_urls_in_code(c.program)
    if c.flow_stages:
        final = c.flow_stages["final"]
        out |= {"processing": document.source_processing(c.program, final), "sinkProcessing": document.sink_processing(c.program, final), "dataFlow": document.dataflows(c.program, final, about), "metrics": document.metrics(c.program, final)}
        elements = final.select("repo", "path_id", F.explode("path").alias("id")).distinct().join(c.program.nodes.select("repo", "id", "file"), ["repo", "id"])
        out["fileLinks"] = flows.co_occurrence(elements.withColumn("flow", F.concat_ws("|", "repo", "path_id")).withColumn("place", F.struct("repo", "file")), "flow", "place").select("place.repo", "place.file", F.col("others.file").alias("files"))
    if c.points is not None:
        out["collections"] = document.collections(c.points, point_sources(c), c.program.nodes, about)
    if c.properties is not None:
        out["egressProperties"] = document.egress_urls(c.properties, document.feign_urls(c.program) if c.language in ("java", "kotlin") else None)
        out |= {"basePaths": document.base_paths(c.properties, c.language in ("java", "kotlin")), "probableAssets": document.probable_assets(c.properties)}
        asked = c.catalogue.raw_setting("repoConfiguration")
        if asked:
            out["configuration"] = document.configuration(c.properties, [asked])
    if c.elements is not None:
        out["permissions"] = document.android_permissions(permission_nodes(c.elements), c.program.tags)
    if c.violations is not None:
        out["violations"] = c.violations
    return out


def sheets(c: Context) -> dict[str, DataFrame]:
    """The sheets of the audit of a scan."""
    stages = {k: v for k, v in c.flow_stages.items() if "source_id" in v.columns}
    properties = c.properties if c.properties is not None else c.spark.createDataFrame([], graph.PROPERTY)
    out = audit.assembled(c.program, c.language, stages, properties, c.modules, c.catalogue.sinks, c.catalogue.setting)
    out["declarations"] = audit.declaration_candidates(c.program)
    out["unresolvedFlows"] = audit.unresolved_flows(c.program, flows.source_nodes(c.program), c.semantics)
    return out


TAG = (declared, source_tagger, literal_tagger, sql_tagger)
SINK = (database_config, sink_tagger, marked_apis, api_tagger, shared_log_sinks, skip_listed, dependency_tagger)
LAST = (asset_tagger, captures, dataflow, policies)
PROFILES: dict[str, tuple[Pass, ...]] = {
    "java": (full_names, link_properties, *TAG, insensitive, java_apis, remote_apis, *SINK, class_sinks, message_consumers, flink, buckets, collection_tagger, forms, layout_collections, permission_tagger, database_reads, read_flows, *LAST),
    "kotlin": (full_names, link_properties, *TAG, insensitive, remote_apis, *SINK, class_sinks, collection_tagger, forms, layout_collections, permission_tagger, read_flows, *LAST),
    "javascript": (full_names, properties_in_code, link_properties, *TAG, *SINK, cookie_sinks, page_apis, graphql_apis, collection_tagger, forms, *LAST),
    "python": (recover, properties_in_code, link_properties, *TAG, *SINK, class_sinks, airflow, buckets, collection_tagger, forms, database_reads, *LAST),
    "ruby": (full_names, recover, link_properties, *TAG, literal_derived, *SINK, class_sinks, leakage_sinks, collection_tagger, repository_items, *LAST),
    "go": (link_properties, *TAG, *SINK, collection_tagger, *LAST),
    "php": (*TAG, *SINK, collection_tagger, forms, *LAST),
    "csharp": (*TAG, *SINK, collection_tagger, *LAST),
    "c": (recover, *TAG, *SINK, *LAST),
    "default": (sql_tagger, forms, synced_sinks, synced, *LAST),
}
METADATA = ("javascript", "python")


def profile(language: str, *, metadata: bool = False) -> tuple[Pass, ...]:
    """The passes of a language; of an unknown one those of texts alone. A metadata scan tags nothing, and is of JavaScript unless the language is Python."""
    if metadata:
        return PROFILES["python" if language == "python" else "javascript"][:1]
    return PROFILES.get(language, PROFILES["default"])


def scan(context: Context, *, metadata: bool = False, each: Callable[[str, Context], None] | None = None) -> Context:
    """All passes of the context's language, in their order; ``each`` is called after every pass."""
    c = context
    for p in profile(c.language, metadata=metadata):
        began = time.perf_counter()
        done = p(c)
        c = replace(done, program=done.program.kept(c.program), metrics=(*c.metrics, (p.__name__, time.perf_counter() - began)))
        if each:
            each(p.__name__, c)
    return c


def pass_times(runs: DataFrame) -> DataFrame:
    """(name, n, mean, most): the seconds of passes (name, seconds) over many scans."""
    return runs.groupBy("name").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most"))
