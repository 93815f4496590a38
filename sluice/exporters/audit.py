"""Audit sheets: what the scan found, kept, dropped and did not know, as flat tables of one sheet each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import flows as flow_ops
from sluice.operators.calls import reach_by_calls
from sluice.operators.graph import Program
from sluice.operators.predicates import full_match
from sluice.operators.sinks import dependency_categories
from sluice.operators.tagging import Rule

YES, NO = "YES", "--"
# Which classes and names count, by language.
NOT_DATA_CLASS = "^(.*)(Controller|Service|Impl|Helper|Util|Processor|Dao)$"
GETTER_SETTER_MARK = ".*(Getter|Setter).*"
GETTER_SETTER = "^(get|set).*"
JS_FILES = ".*(types|dto(s)?|data|constants|components|model(s)?).*|.*(types.ts|constants.ts|models.ts)"
JS_TYPES = r".*__ecma\.(String|Number|Boolean|Object).*"
JS_NOT_PARAMETER = "(?i)(this|request|response|req|error|req|res|state|e|i|formik)|param.*|_tmp.*"
JS_NOT_TYPE = ".*(?i)(anonymous|props|response|request).*"
JS_NOT_NAME = "^(?i)(modules?|loggers?|val|console|require|_|get|key|value|data|page|url|Set|filter|<init>|err|errors|axios|express|router|component|Instance|utils?|app|undefined|context|process|...props?|async|await|const|let|var|this)$"
HTTP_CALL = ".*(?i)(client|http|api|instance|fetch|request|requests|service|rest|network|connector|communicator|adaptor|controller|handler|web|remote|caller|connection).*"


def unique_rows(rows: DataFrame, keys: Sequence[str] = ("repo", "file", "name"), order: str = "id") -> DataFrame:
    """The first row, by ``order``, of each file and name."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def _tagged(program: Program, rows: DataFrame) -> DataFrame:
    """Rows with YES or -- for a source tag, and the least source rule."""
    ids = program.tags.where((F.col("name") == "id") & ~F.col("value").startswith("derived_")).groupBy("repo", F.col("node_id").alias("id")).agg(F.min("value").alias("source_rule_id"))
    return rows.join(ids, ["repo", "id"], "left").withColumn("tagged", F.when(F.col("source_rule_id").isNotNull(), YES).otherwise(NO)).withColumn("source_rule_id", F.coalesce("source_rule_id", F.lit(NO)))


def java_elements(program: Program) -> DataFrame:
    """Members and parameters of data classes with tag, collection and the file's score.

    A class counts if it has getters or setters, or is annotated to have them, and is not named like a service. A file scores a quarter for each: that a
    class of it counts, that some member is tagged, that a type of it is a collection's input; and a quarter more for more than one tagged member.
    """
    members = program.members().select("repo", "id", "owner", "owner_id", "name", "type_full_name", "file", "line")
    methods = program.hop(program.of("TYPE_DECL").select("repo", F.col("id").alias("owner_id")), "AST", key="owner_id", to="m").join(program.of("METHOD").select("repo", F.col("id").alias("m"), F.col("name").alias("method")), ["repo", "m"])
    has = methods.where(full_match(F.col("method"), GETTER_SETTER)).select("repo", "owner_id")
    marks = program.hop(program.of("ANNOTATION").where(full_match(F.col("name"), GETTER_SETTER_MARK) | F.col("name").isin("Data")).select("repo", F.col("id").alias("mark")), "AST", key="mark", to="owner_id", back=True).select("repo", "owner_id")
    counts = has.unionByName(marks).distinct()
    own = members.where(~full_match(F.element_at(F.split("owner", r"\."), -1), NOT_DATA_CLASS)).join(counts, ["repo", "owner_id"], "left_semi")
    sheet = _tagged(program, own)
    ends = program.tags.where("name = 'COLLECTION_METHOD_ENDPOINT'").select("repo", F.col("node_id").alias("method_id"), F.col("value").alias("end_point"))
    inputs = program.hop(ends, "AST", key="method_id", to="p").join(program.of("PARAMETER").select("repo", F.col("id").alias("p"), F.col("type_full_name").alias("owner")), ["repo", "p"]).join(program.of("METHOD").select("repo", F.col("id").alias("method_id"), F.col("method_full_name").alias("method_name")), ["repo", "method_id"])
    first = inputs.groupBy("repo", "owner").agg(F.min_by(F.struct("end_point", "method_name"), "end_point").alias("c"))
    sheet = sheet.join(first, ["repo", "owner"], "left").withColumns({"collection": F.when(F.col("c").isNotNull(), YES).otherwise(NO), "end_point": F.coalesce("c.end_point", F.lit(NO)), "method_name": F.coalesce("c.method_name", F.lit(NO))}).drop("c")
    n = F.count_if(F.col("tagged") == YES)
    score = sheet.groupBy("repo", "file").agg((F.lit(0.25) + F.when(n > 0, 0.25).otherwise(0.0) + F.when(n > 1, 0.25).otherwise(0.0) + F.max(F.when(F.col("collection") == YES, 0.25).otherwise(0.0))).alias("score"))
    out = sheet.join(score, ["repo", "file"]).select("repo", "id", F.col("owner").alias("class"), "file", "score", "name", F.col("type_full_name").alias("type"), "tagged", "source_rule_id", "collection", "end_point", "method_name", "line", F.lit("Member").alias("node_type"))
    return unique_rows(out)


def other_elements(program: Program, language: str = "javascript") -> DataFrame:
    """Members, parameters and identifiers of other languages: by files and types that hold data, names that say something, and a score of 1 for members, a half for parameters, a quarter for identifiers."""
    own = program.of("MEMBER", "PARAMETER", "IDENTIFIER").where(F.length("name") > 2)
    if language == "javascript":
        own = own.where(full_match(F.col("file"), JS_FILES) | full_match(F.coalesce("type_full_name", F.lit("")), JS_TYPES))
        own = own.where(~full_match(F.col("name"), JS_NOT_NAME) & ~full_match(F.col("name"), JS_NOT_PARAMETER) & ~full_match(F.coalesce("type_full_name", F.lit("")), JS_NOT_TYPE))
    score = F.when(F.col("label") == "MEMBER", 1.0).when(F.col("label") == "PARAMETER", 0.5).otherwise(0.25)
    kind = F.when(F.col("label") == "MEMBER", "Member").when(F.col("label") == "PARAMETER", "Method Parameter").otherwise("Identifier")
    rows = _tagged(program, own.select("repo", "id", "file", "name", F.col("type_full_name").alias("type"), "line", score.alias("score"), kind.alias("node_type")))
    return unique_rows(rows)


def sql_elements(columns: DataFrame, stop_tables: str = "(?i)(information_schema|sys|pg_).*", stop_columns: str = "(?i)(id|created_at|updated_at|\\*|count|1)") -> DataFrame:
    """SQL columns as rows of the sheet, without tables and columns that say nothing."""
    own = columns.where(~full_match(F.col("table_name"), stop_tables) & ~full_match(F.col("column_name"), stop_columns))
    return own.select("repo", "id", "file", F.col("column_name").alias("name"), F.col("table_name").alias("type"), "line", F.lit(1.0).alias("score"), F.lit("SqlNode").alias("node_type")).distinct()


def declaration_candidates(program: Program, stop: str = JS_NOT_NAME, types: str = ".*") -> DataFrame:
    """Names that a declaration could name: of more than two letters, no stop word, of a wanted type; grouped by file and name with their lines and kinds, and what is tagged."""
    own = program.of("IDENTIFIER", "MEMBER", "LOCAL", "PARAMETER").where((F.length("name") > 2) & ~full_match(F.col("name"), stop) & (F.col("name") != F.upper("name")) & full_match(F.coalesce("type_full_name", F.lit("")), types))
    rows = _tagged(program, own.select("repo", "id", "file", "name", F.col("type_full_name").alias("type"), "line", "label"))
    at = F.struct("id", "type", "label")
    return rows.groupBy("repo", "file", "name").agg(F.min_by(at, F.struct((F.col("label") != "MEMBER").alias("m"), "id")).alias("a"), F.array_sort(F.collect_set("line")).alias("lines"), F.max("tagged").alias("tagged"), F.max("source_rule_id").alias("source_rule_id")).select("repo", F.col("a.id").alias("id"), "file", "name", F.col("a.type").alias("type"), F.col("a.label").alias("node_type"), "lines", "tagged", "source_rule_id")


def stages(flows: dict[str, DataFrame]) -> DataFrame:
    """(repo, source_id, sink_id, path_id, a column for each stage): YES where a flow is still there, -- where a stage dropped it. One pass: stages are flags, not joins."""
    keys, out = ["repo", "source_id", "sink_id", "path_id"], None
    for name, rows in flows.items():
        own = rows.select(*keys).distinct().withColumn("_stage", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(*keys).agg(*[F.when(F.bool_or(F.col("_stage") == n), YES).otherwise(NO).alias(n) for n in flows])


def api_candidates(program: Program, setting) -> DataFrame:
    """(repo, code, file, line): calls named and written like a request that are not tagged as APIs."""
    calls = program.calls().where(~F.col("name").startswith("<init") & full_match(F.col("name"), setting("apiSinks")) & ~full_match(F.col("method_full_name"), setting("ignoredSinks")) & full_match(F.col("code"), HTTP_CALL))
    api = program.tags.where((F.col("name") == "nodeType") & (F.col("value") == "api")).select("repo", F.col("node_id").alias("id")).distinct()
    return calls.join(api, ["repo", "id"], "left_anti").select("repo", "code", "file", F.coalesce("line", F.lit(0)).alias("line"))


def texts_like(program: Program, properties: DataFrame, pattern: str) -> DataFrame:
    """(repo, text, file, line): literals and property values that match, as they stand."""
    literal = program.of("LITERAL").where(full_match(F.col("code"), pattern)).select("repo", F.col("code").alias("text"), "file", F.coalesce("line", F.lit(0)).alias("line"))
    own = properties.where(full_match(F.col("value"), pattern)).select("repo", F.col("value").alias("text"), "file", F.coalesce("line", F.lit(0)).alias("line"))
    return literal.unionByName(own)


URLS, HTTP = ".*(/).*", ".*http.*"


def dependencies(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(repo, file, library, artifact, processed, category, rule): dependencies (group_id, artifact_id, internal) with their category; those of the module's own group are internal."""
    own = dependency_categories(edges.where("not internal"), rules)
    rows = own.select("repo", "file", F.concat_ws(".", "group_id", "artifact_id").alias("library"), F.col("artifact_id").alias("artifact"), F.when(F.col("rule_id").isNotNull(), YES).otherwise(NO).alias("processed"), "category", F.coalesce("rule_id", F.lit(NO)).alias("rule"))
    inside = edges.where("internal").select("repo", "file", F.concat_ws(".", "group_id", "artifact_id").alias("library"), F.col("artifact_id").alias("artifact"), F.lit(NO).alias("processed"), F.lit("Internal").alias("category"), F.lit(NO).alias("rule"))
    return rows.unionByName(inside).distinct()


def unresolved_flows(program: Program, sources: DataFrame, semantics: DataFrame | None = None) -> DataFrame:
    """(repo, source_id, sink, path_id, code): flows of tagged sources to calls of an unresolved namespace, sub-flows left out."""
    sinks = program.of("CALL").where(F.col("method_full_name").contains("unresolvedNamespace"))
    found = flow_ops.unique_paths(reach_by_calls(program, sources.select("repo", "id"), sinks.select("repo", "id"), semantics))
    ids = program.tags.where((F.col("name") == "id") & ~F.col("value").startswith("derived_")).select("repo", F.col("node_id").alias("source"), F.col("value").alias("source_id"))
    last = sinks.select("repo", F.col("id").alias("sink"), F.col("method_full_name").alias("sink_name"), "code")
    return found.join(ids, ["repo", "source"]).join(last, ["repo", "sink"]).select("repo", "source_id", F.col("sink_name").alias("sink"), flow_ops.path_id(F.col("path")).alias("path_id"), "code").distinct()


def unresolved_methods(program: Program) -> DataFrame:
    """(repo, calls, operators, unresolved_namespace, unresolved_signature, resolved): how many calls the front end resolved."""
    name = F.col("method_full_name")
    op = F.col("name").startswith("<operator")
    space, signature = F.contains(name, F.lit("unresolvedNamespace")), F.contains(name, F.lit("unresolvedSignature"))
    own = program.of("CALL").groupBy("repo").agg(F.count("*").alias("calls"), F.count_if(op).alias("operators"), F.count_if(~op & space).alias("unresolved_namespace"), F.count_if(~op & ~space & signature).alias("unresolved_signature"))
    return own.withColumn("resolved", F.expr("calls - operators - unresolved_namespace - unresolved_signature"))


def workbook(sheets: dict[str, DataFrame], folder: str) -> None:
    """A folder of CSV for each sheet, with headings; arrays as JSON."""
    for name, rows in sheets.items():
        flat = rows.select(*[F.to_json(c).alias(c) if "array" in t or "map" in t or "struct" in t else F.col(c) for c, t in rows.dtypes])
        flat.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")


def assembled(program: Program, language: str, flow_stages: dict[str, DataFrame], properties: DataFrame, module_edges: DataFrame | None, rules: Sequence[Rule], setting, sql_columns: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sheets of a language: elements, flows, APIs, addresses and texts; dependencies and unresolved calls for Java."""
    elements = java_elements(program) if language in ("java", "kotlin") else other_elements(program, language)
    out = {"elements": elements, "flows": stages(flow_stages), "apis": api_candidates(program, setting), "urls": texts_like(program, properties, URLS), "http": texts_like(program, properties, HTTP)}
    if sql_columns is not None:
        out["sql_elements"] = sql_elements(sql_columns)
    if language in ("java", "kotlin"):
        out["unresolved"] = unresolved_methods(program)
        if module_edges is not None:
            out["dependencies"] = dependencies(module_edges, rules)
    return out

