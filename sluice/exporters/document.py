"""The result document: one row of nested sections for each repository, and the files it is written to."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import scalars as fn
from sluice.operators import flows as flow_ops
from sluice.operators.graph import Program
from sluice.operators.predicates import full_match
from sluice.operators.tagging import Rule

COOKIE_WRITE = "Storages.Web.Cookie.Write"


def place(prefix: str = "") -> Column:
    """Where a node stands, as the documents show it: sample, line, column (-1 without) and file."""
    c = lambda name: F.col(prefix + name)
    shown = lambda name: F.coalesce(fn.shown_position(c(name), c("file")), F.lit(-1))
    return F.struct(c("code").alias("sample"), shown("line").alias("lineNumber"), shown("col").alias("columnNumber"), c("file").alias("fileName"))


def with_excerpts(nodes: DataFrame, sources: DataFrame, around: int = 5) -> DataFrame:
    """Nodes with the lines around them, from source files (repo, file, content)."""
    lines = sources.select("repo", "file", F.split("content", "\n").alias("_lines"))
    return nodes.join(lines, ["repo", "file"], "left").withColumn("excerpt", F.coalesce(fn.excerpt(F.col("_lines"), F.col("line"), around), F.lit(""))).drop("_lines")


def _ids(tags: DataFrame) -> DataFrame:
    """(repo, id, rule_id): rules that nodes carry, by their id and by the families of derived sources."""
    own = tags.where(((F.col("name") == "id") & ~F.col("value").startswith("derived_")) | F.col("name").startswith("derived_by_"))
    return own.select("repo", F.col("node_id").alias("id"), F.col("value").alias("rule_id")).distinct()


def rule_rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.id, r.name, r.category, list(r.domains), r.sensitivity, r.is_sensitive, dict(r.tags), r.cat_two, r.node_type) for r in rules]
    return spark.createDataFrame(rows, "id string, name string, category string, domains array<string>, sensitivity string, isSensitive boolean, tags map<string,string>, cat_two string, node_type string")


def section_rules(program: Program, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, rule row): the rules that some of the nodes carry."""
    own = nodes.select("repo", "id").join(_ids(program.tags), ["repo", "id"]).select("repo", F.col("rule_id").alias("id")).distinct()
    return own.join(F.broadcast(rules), "id")  # the catalogue, read on the driver


def source_nodes(program: Program, derived: bool = False) -> DataFrame:
    """Nodes of the sources section: tagged as sources (with ``derived``, as derived ones too), of all labels a source may have."""
    kinds = ["sources", "DerivedSources"] if derived else ["sources"]
    keys = program.tags.where((F.col("name") == "catLevelOne") & F.col("value").isin(kinds)).select("repo", F.col("node_id").alias("id")).distinct()
    return program.nodes.join(keys, ["repo", "id"], "left_semi")


def sources(program: Program, rules: DataFrame) -> DataFrame:
    return section_rules(program, source_nodes(program), rules).select("repo", F.lit("REGULAR").alias("sourceType"), "id", "name", "category", "sensitivity", "isSensitive", "tags")


def first_wins(rows: DataFrame, group: list[str], passes: Sequence[str], order: str = "id") -> DataFrame:
    """Rows that outlast a pass for each column: of equal values in a group the first by ``order``. Each pass is an aggregate that is combined before its exchange."""
    out = rows
    for column in passes:
        row = F.struct(*[c for c in out.columns if c not in (*group, column)])
        kept = out.groupBy(*group, column).agg(F.min_by(row, order).alias("_row"))
        out = kept.select(*[F.col(c) if c in (*group, column) else F.col(f"_row.{c}").alias(c) for c in rows.columns])
    return out


def occurrences(program: Program, nodes: DataFrame, *, dedup: bool = True, originals: bool = False, keep: str | None = None) -> DataFrame:
    """(repo, rule_id, place): where each rule occurs. With ``dedup`` the first of a code, then of a line, then of a file, by node id, stays.

    ``originals``: a derived node stands where the first member it derives from does. Rules that start with ``keep`` are never reduced.
    """
    own = nodes.select("repo", "id").join(_ids(program.tags), ["repo", "id"])
    if originals:
        up = program.hop(own.select("repo", "id").distinct(), "ORIGINAL_SOURCE", to="origin").groupBy("repo", "id").agg(F.min("origin").alias("origin"))
        own = own.join(up, ["repo", "id"], "left").select("repo", F.coalesce("origin", "id").alias("id"), "rule_id").distinct()
    rows = own.join(program.nodes.select("repo", "id", "code", "file", "line", "col"), ["repo", "id"])
    if dedup:
        exempt = rows.where(F.col("rule_id").startswith(keep)) if keep else None
        rest = rows.where(~F.col("rule_id").startswith(keep)) if keep else rows
        rows = first_wins(rest, ["repo", "rule_id"], ["code", "line", "file"])
        rows = rows.unionByName(exempt) if exempt is not None else rows
    return rows.select("repo", "rule_id", place().alias("place")).distinct()


def processing(own: DataFrame, ends: DataFrame | None, name: str) -> DataFrame:
    """(repo, id, occurrences): places of each rule, with those of the flows that start or end there."""
    every = own if ends is None else own.unionByName(ends)
    return every.groupBy("repo", F.col("rule_id").alias(name)).agg(F.array_sort(F.collect_set("place")).alias("occurrences"))


def flow_ends(program: Program, flows: DataFrame, first: bool) -> DataFrame:
    """(repo, rule_id, place) of the first nodes of flows for their sources, or the last for their sinks."""
    at, rule = (1, "source_id") if first else (-1, "sink_id")
    ends = flows.select("repo", F.col(rule).alias("rule_id"), F.element_at("path", at).alias("id")).distinct()
    return ends.join(program.nodes.select("repo", "id", "code", "file", "line", "col"), ["repo", "id"]).select("repo", "rule_id", place().alias("place"))


def source_processing(program: Program, flows: DataFrame | None = None, *, dedup: bool = True) -> DataFrame:
    return processing(occurrences(program, source_nodes(program), dedup=dedup, originals=True), flow_ends(program, flows, True) if flows is not None else None, "sourceId")


def sink_nodes(program: Program) -> DataFrame:
    keys = program.tags.where("name = 'catLevelOne' and value = 'sinks'").select("repo", F.col("node_id").alias("id")).distinct()
    return program.nodes.join(keys, ["repo", "id"], "left_semi")


def sinks(program: Program, rules: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Sinks with the addresses of APIs and the details of their database; a sink of several buckets has a row for each."""
    own = section_rules(program, sink_nodes(program), rules)
    urls = program.tags.where(F.col("name").startswith("apiUrl")).select("repo", F.expr("substring(name, 7)").alias("id"), "value").groupBy("repo", "id").agg(F.array_sort(F.collect_set("value")).alias("apiUrl"))
    out = own.join(urls, ["repo", "id"], "left").select("repo", F.col("cat_two").alias("sourceType"), F.col("node_type").alias("sinkType"), "id", "name", "category", "domains", F.coalesce("apiUrl", F.array().cast("array<string>")).alias("apiUrl"))
    if details is None:
        return out
    d = details.select("repo", F.col("rule_id").alias("id"), F.struct("db_name", "db_vendor", "db_location", "db_operation").alias("databaseDetails")).distinct()
    return out.join(d, ["repo", "id"], "left")


def sink_processing(program: Program, flows: DataFrame | None = None, *, dedup: bool = True) -> DataFrame:
    return processing(occurrences(program, sink_nodes(program), dedup=dedup, keep=COOKIE_WRITE), flow_ends(program, flows, False) if flows is not None else None, "sinkId")


PATH_KEYS = ["sink_sub_category", "source_id", "sink_id", "sink_node_type"]


def dataflow_paths(program: Program, flows: DataFrame, arguments: DataFrame | None = None) -> DataFrame:
    """(repo, sink_sub_category, source_id, sink_id, sink_node_type, pathId, path, arguments): the paths of the section, a row each, with the place of every node; and a sink call's arguments, where known."""
    steps = flows.select("repo", "path_id", F.posexplode("path").alias("pos", "id")).distinct().join(program.nodes.select("repo", "id", "code", "file", "line", "col"), ["repo", "id"])
    shown = steps.groupBy("repo", "path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", place().alias("p")))), lambda x: x["p"]).alias("places"))
    own = flows.withColumn("id", F.element_at("path", -1)).select("repo", "path_id", "id", *PATH_KEYS).distinct()
    if arguments is not None:
        own = own.join(arguments, ["repo", "id"], "left").select("repo", "path_id", *PATH_KEYS, "arguments").distinct()
    else:
        own = own.withColumn("arguments", F.lit(None).cast("string"))
    return own.join(shown, ["repo", "path_id"]).select("repo", *PATH_KEYS, F.col("path_id").alias("pathId"), F.col("places").alias("path"), "arguments")


def dataflows(program: Program, flows: DataFrame, rules: DataFrame | None = None, arguments: DataFrame | None = None) -> DataFrame:
    """(repo, kind, sourceId, sinks): for each sub-category, source and sink its ``dataflow_paths``."""
    paths = dataflow_paths(program, flows, arguments).groupBy("repo", *PATH_KEYS).agg(F.array_sort(F.collect_set(F.struct("pathId", "path", "arguments"))).alias("paths"))
    urls = program.tags.where(F.col("name").startswith("apiUrl")).select("repo", F.expr("substring(name, 7)").alias("sink_id"), "value").groupBy("repo", "sink_id").agg(F.array_sort(F.collect_set("value")).alias("apiUrl"))
    with_urls = paths.join(urls, ["repo", "sink_id"], "left")
    name = F.lit(None).cast("string")
    if rules is not None:
        with_urls = with_urls.join(F.broadcast(rules.select(F.col("id").alias("sink_id"), F.col("name").alias("_name"))), "sink_id", "left")
        name = F.col("_name")
    sink = F.struct(F.col("sink_id").alias("id"), F.col("sink_node_type").alias("sinkType"), name.alias("name"), F.coalesce("apiUrl", F.array().cast("array<string>")).alias("apiUrl"), "paths")
    return with_urls.groupBy("repo", F.col("sink_sub_category").alias("kind"), F.col("source_id").alias("sourceId")).agg(F.array_sort(F.collect_list(sink)).alias("sinks"))


def intermediate_flows(flows: DataFrame) -> DataFrame:
    """source to sinks to path ids, before any filter."""
    return flow_ops.by_pair(flows.withColumnsRenamed({"source_id": "source", "sink_id": "sink"}), "repo") if "source_id" in flows.columns else flow_ops.by_pair(flows, "repo")


def collections(points: DataFrame, sources_of: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, collectionId, name, isSensitive, collections): collection points by rule, source and end point. ``sources_of`` is (repo, id, rule_id) of a point's sources."""
    places = nodes.select("repo", "id", "code", "line", "col", "file")
    own = points.select("repo", "id", F.col("rule_id").alias("collectionId"), "end_point").join(sources_of.select("repo", "id", F.col("rule_id").alias("sourceId")).distinct(), ["repo", "id"]).join(places, ["repo", "id"])
    seen = own.groupBy("repo", "collectionId", "sourceId").agg(F.array_sort(F.collect_set(F.struct(F.col("end_point").alias("endPoint"), place().alias("place")))).alias("occurrences"))
    by_rule = seen.groupBy("repo", "collectionId").agg(F.array_sort(F.collect_list(F.struct("sourceId", "occurrences"))).alias("collections"))
    return by_rule.join(F.broadcast(rules.select(F.col("id").alias("collectionId"), "name", "isSensitive")), "collectionId", "left").select("repo", "collectionId", "name", "isSensitive", "collections")


def violations(spark: SparkSession, found: DataFrame, verdicts: Sequence) -> DataFrame:
    """Violations (policy_id, kind, source_id, sink_id, detail) by policy, with what the policy says of itself."""
    rows = [(v.id, v.name, v.description, v.fix, v.action or "", v.kind or "", dict(v.tags)) for v in verdicts]
    about = spark.createDataFrame(rows, "policy_id string, name string, description string, fix string, action string, type string, tags map<string,string>")
    own = found.groupBy("policy_id", "kind").agg(F.array_sort(F.collect_set(F.struct("source_id", "sink_id", "detail"))).alias("occurrences"))
    return own.join(F.broadcast(about), "policy_id", "left")


def android_permissions(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """(repo, permissionType, isUsed, sourceId, occurrences): permissions tagged as sources, by type; the source of the first by id."""
    ids = tags.where("name = 'id'").groupBy("repo", F.col("node_id").alias("id")).agg(F.min("value").alias("rule_id"))
    own = nodes.join(ids, ["repo", "id"])
    where = F.struct(F.col("file").alias("fileName"), F.coalesce("line", F.lit(-1)).alias("lineNumber"), F.col("name").alias("sample"))
    return own.groupBy("repo", F.col("permission_type").alias("permissionType")).agg(F.lit(True).alias("isUsed"), F.min_by("rule_id", "id").alias("sourceId"), F.array_sort(F.collect_set(where)).alias("occurrences"))


def configuration(properties: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(repo, name, values): properties that the configuration asks for by name."""
    test = F.lit(False)
    for k in keys:
        test |= full_match(F.col("name"), k)
    return properties.where(test).groupBy("repo", "name").agg(F.array_sort(F.collect_set("value")).alias("values"))


# What an asset's property looks like, and what it does not.
ASSET_KEY = "(?i).*(connection|host|database|uri$|mongo|sql|postgres|pgsql|s3|oracle|redis|bucket|dynamo|hbase|neo4j|cassandra|couchbase|memcached|couchdb|litedb|LiteDatabase|tinydb|maria|db(_)?name).*"
ASSET_VALUE = "(?i).*(mongo|sql|postgres|pgsql|aws|oracle|redis|dynamo|hbase|neo4j|cassandra|couchbase|memcached|couchdb|litedb|LiteDatabase|tinydb|maria).*"


def probable_assets(properties: DataFrame) -> DataFrame:
    """(repo, key, value, fileName) of properties that may name an asset."""
    value = F.col("value")
    keep = (full_match(F.col("name"), ASSET_KEY) | full_match(value, ASSET_VALUE)) & ~full_match(F.col("file"), r".*package(-lock)?.json") & ~full_match(value, ".*[.](png|jpg|jpeg|jar|zip|xml|json|yml)$") & ~full_match(value, "^(true|false)$") & (value != "require(")
    return properties.where(keep).select("repo", F.col("name").alias("key"), "value", F.col("file").alias("fileName")).distinct()


# Sinks and addresses that no rule knows


def probable_sinks(program: Program, skip: Sequence[Rule] = (), python: bool = False) -> DataFrame:
    """(repo, name): external methods that no tagged sink calls, not on the skip list, by their first six segments."""
    bare = lambda c: F.col(c) if python else F.split(F.col(c), ":")[0]
    tagged = sink_nodes(program).where("label = 'CALL'").select("repo", bare("method_full_name").alias("name")).distinct()
    own = program.of("METHOD").where("is_external").select("repo", bare("method_full_name").alias("name")).distinct().join(tagged, ["repo", "name"], "left_anti")
    own = own.where(~F.col("name").endswith(".println") & ~F.col("name").contains("<operator>"))
    for r in skip:
        own = own.where(~full_match(F.col("name"), r.pattern))
    return own.select("repo", fn.method_prefix(F.col("name")).alias("name")).distinct()


# Addresses that leave, and what only looks like one.
_FILE = r'.*[.][a-z]{2,5}(\")?$'
_FALSE = r".*(BEGIN PRIVATE KEY|sha512|googleapis|sha1|amazonaws|github|</div>|</p>|<img|<class|require\(|\s).*"
_RELATIVE = r"^(\.\/|\.\.|\/\/).*"
_PATHS = (r"/.{2,}", r".*/.*/.*", r".*\.[a-z]{2,5}/[a-z]{2,}.*")
_TEXT_URL = "^(?=.*/)[${}/\"'a-zA-Z0-9:.,%?_=]+"
_BASE_PATH = "(?i)(server[.]servlet[.]context-path|server[.]servlet[.]contextPath)|(spring[.]application[.]name)"


def is_egress(value: Column) -> Column:
    """Like an address: not a file, not relative, nothing known to be none, and with a path."""
    test = F.lit(False)
    for p in _PATHS:
        test |= full_match(value, p)
    return test & ~full_match(value, _FILE) & ~full_match(value, _FALSE) & ~full_match(value, _RELATIVE)


def egress_urls(properties: DataFrame, feign: DataFrame | None = None) -> DataFrame:
    """(repo, url) of properties, and of Feign clients (repo, url)."""
    own = properties.where(is_egress(F.col("value"))).select("repo", F.col("value").alias("url"))
    return (own if feign is None else own.unionByName(feign.select("repo", "url"))).distinct()


def egress_urls_in_code(program: Program) -> DataFrame:
    """(repo, url): literals like a path, put together over the arguments of the call they are in; none of imports."""
    code = F.col("code")
    seeds = program.of("LITERAL").where(code.rlike(rf"\A(?:{_TEXT_URL})\z") & code.rlike("[a-zA-Z]") & ~full_match(code, r"(?s).*(\.\.|\./|\n).*"))
    calls = program.hop(seeds.select("repo", F.col("id").alias("arg")), "ARGUMENT", key="arg", to="id", back=True).select("repo", "id").distinct()
    own = program.of("CALL").join(calls, ["repo", "id"], "left_semi").where(~F.col("name").isin("require", "import"))
    joined = F.col("name").isin("<operator>.addition", "<operator>.formatString")
    args = program.arguments(own).join(own.select("repo", "id", "name"), ["repo", "id"])
    part = F.when(F.col("arg_label") == "LITERAL", F.col("arg_code")).when(joined, F.regexp_replace("arg_code", "[{}]", "")).otherwise("")
    whole = args.groupBy("repo", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arg_argument_index", "arg_id", part.alias("p")))), lambda x: x["p"]), "").alias("url"))
    return whole.where("url <> ''").select("repo", F.replace("url", F.lit('"'), F.lit("")).alias("url")).distinct()


def base_paths(properties: DataFrame, java: bool = True) -> DataFrame:
    """(repo, path): a Spring application's context path and name, and a serverless service's name."""
    spring = full_match(F.col("name"), _BASE_PATH) if java else F.lit(False)
    serverless = full_match(F.col("file"), ".*serverless.yml") & (F.col("name") == "service")
    return properties.where(spring | serverless).select("repo", F.col("value").alias("path")).distinct()


def feign_urls(program: Program) -> DataFrame:
    """(repo, url): the address of a Feign client's annotation with the path of each of its methods' mapping annotation."""
    def ends(pattern: str, part: str, label: str) -> DataFrame:
        marks = program.of("ANNOTATION").where(full_match(F.col("name"), pattern)).select("repo", F.col("id").alias("mark"), F.regexp_extract("code", part, 1).alias("url"))
        up = program.hop(marks, "AST", key="mark", to="id", back=True)
        return up.join(program.of(label).select("repo", "id"), ["repo", "id"], "left_semi").select("repo", "id", "url")

    types = ends("FeignClient", r'url\s*=\s*"([^"]*)"', "TYPE_DECL").where("url <> ''")
    methods = ends("(Get|Post|Put|Patch|Delete|Request)Mapping", r'"([^"]*)"', "METHOD")
    own = program.hop(types.select("repo", F.col("id").alias("type_id"), "url"), "AST", key="type_id", to="id").join(methods.withColumnRenamed("url", "path"), ["repo", "id"])
    return own.select("repo", F.concat("url", "path").alias("url")).distinct()


# The document


@dataclass(frozen=True)
class Options:
    """What the document holds beside its sections."""

    element_limit: int | None = None
    paths_per_pair: int | None = None
    script: str | None = None


SCRIPTS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def script(name: str) -> Callable:
    """Register a callable (document to document) that an export may run by name. Nothing is evaluated from text."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        SCRIPTS[name] = f
        return f

    return add


def limited(flows: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by the limits of elements and of paths for a (source, sink) pair, shortest first."""
    keys = ["repo", "source_id", "sink_id"]
    kept, removed = (flows, flows.limit(0)) if options.element_limit is None else flow_ops.limited(flows, keys, options.element_limit)
    if options.paths_per_pair is not None:
        first = flow_ops.top_paths(kept, keys, options.paths_per_pair)
        removed = removed.unionByName(kept.join(first.select(*keys, "path_id"), [*keys, "path_id"], "left_anti"))
        kept = first
    return kept, removed


def document(repos: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One row a repository: its columns, and each section (rows with ``repo``) as an array of its rows, in order of their values; empty without any."""
    out = repos
    for name, rows in sections.items():
        fields = [c for c in rows.columns if c != "repo"]
        own = rows.groupBy("repo").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*fields)))).alias(name))
        out = out.join(own, "repo", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def write(doc: DataFrame, folder: str, name: str = "result", options: Options = Options(), removed: DataFrame | None = None) -> None:
    """Write the document (after its script, if one is named), and the flows that a limit removed, as JSON lines by repository."""
    if options.script:
        doc = SCRIPTS[options.script](doc)
    doc.write.mode("overwrite").json(f"{folder}/{name}")
    if removed is not None:
        removed.write.mode("overwrite").json(f"{folder}/removedDataflows")


def write_items(doc: DataFrame, folder: str) -> None:
    """A folder of documents for each repository item (repo_item), names with / for --."""
    doc.withColumn("repoName", F.concat_ws("/", "repo", fn.item_path(F.col("repo_item")))).write.mode("overwrite").partitionBy("repo_item").json(folder)


def file_links(elements: DataFrame, imports: DataFrame, namespaces: DataFrame, properties: DataFrame, origins: DataFrame) -> dict[str, DataFrame]:
    """Five maps of each file to the files it goes with: in flows, by imports, by namespace, by a property used, and by derived sources."""
    group = lambda rows, a, b: rows.where(F.col(a) != F.col(b)).groupBy("repo", F.col(a).alias("file")).agg(F.array_sort(F.collect_set(b)).alias("files"))
    flow = elements.select("repo", "path_id", "file").distinct()
    both = flow.join(flow.withColumnRenamed("file", "other"), ["repo", "path_id"])
    return {
        "dataflow": group(both, "file", "other"),
        "imports": group(imports.withColumnRenamed("imported", "other"), "file", "other"),
        "namespaces": namespaces.groupBy("repo", "namespace").agg(F.array_sort(F.collect_set("file")).alias("files")),
        "properties": group(properties.withColumnRenamed("property_file", "other"), "file", "other"),
        "origins": group(origins.withColumnRenamed("origin_file", "other"), "file", "other"),
    }


def summary(doc_sections: dict[str, DataFrame]) -> DataFrame:
    """(section, repo, n): how much each section holds, as the console shows it."""
    out = None
    for name, rows in doc_sections.items():
        own = rows.groupBy("repo").agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "repo", "n")
        out = own if out is None else out.unionByName(own)
    return out


def metrics(program: Program, flows: DataFrame) -> DataFrame:
    """(repo, metric, n): rules matched, and flows of each sub-category."""
    ids = _ids(program.tags).groupBy("repo").agg(F.count_distinct("rule_id").alias("n")).select("repo", F.lit("rulesMatched").alias("metric"), "n")
    return ids.unionByName(flows.groupBy("repo", F.concat(F.lit("flows."), "sink_sub_category").alias("metric")).agg(F.count_distinct("path_id").alias("n")).select("repo", "metric", "n"))


def write_semantics(lines: DataFrame, folder: str) -> None:
    lines.select("line").write.mode("overwrite").text(folder)

