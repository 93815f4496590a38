"""Taint summaries of methods: which argument reaches which. Rows (signature, flow), flow a text ``0->0 1->-1``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.scalars import unquoted
from sluice.operators import tagging
from sluice.operators.calls import reach_by_calls
from sluice.operators.graph import Program
from sluice.operators.predicates import full_match
from sluice.sources import sql_text

NONE = -2


def flow_text(n: Column, to: int = NONE) -> Column:
    """Every argument to itself, and to ``to`` unless that is NONE, in the order of their text."""
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(at, lambda k: F.concat(k.cast("string"), F.lit("->"), k.cast("string")))
    more = F.transform(at, lambda k: F.concat(k.cast("string"), F.lit(f"->{to}"))) if to != NONE else F.array().cast("array<string>")
    return F.array_join(F.array_sort(F.array_distinct(F.concat(own, more))), " ")


def merged(rows: DataFrame) -> DataFrame:
    """One row for each signature: all its tokens, ordered."""
    return tagging.merge_semantics(rows)


def _arity(program: Program, calls: DataFrame, extra: int = 0) -> DataFrame:
    n = program.arguments(calls).groupBy("repo", "id").agg(F.count("*").cast("int").alias("n"))
    return calls.join(n, ["repo", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + extra)


def of_sinks(program: Program, extra: int = 0) -> DataFrame:
    """Sink calls: every argument reaches the return value (-1)."""
    calls = _arity(program, program.tagged(program.of("CALL"), "catLevelOne", "sinks"), extra)
    return calls.select(F.col("method_full_name").alias("signature"), flow_text(F.col("n"), -1).alias("flow"))


MUTATORS = r".*\.(add|put|set|get|append|store|insert|update|merge).*"
NOT_PLAIN = r".*\.(add|put|<init>|set|get|append|store|insert|update|merge).*"


def of_external(program: Program) -> DataFrame:
    """External methods that something calls: without a result or with a number nothing leaves an argument, but mutators taint their receiver; texts are tainted by all arguments."""
    called = program.edges.where("label = 'CALL'").select("repo", F.col("dst").alias("id")).distinct()
    params = program.hop(program.of("METHOD").select("repo", "id"), "AST", to="p").join(program.of("PARAMETER").select("repo", F.col("id").alias("p")), ["repo", "p"], "left_semi").groupBy("repo", "id").agg(F.count("*").cast("int").alias("n"))
    own = program.of("METHOD").where("is_external").join(called, ["repo", "id"], "left_semi").join(params, ["repo", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    name = F.col("method_full_name")
    plain = full_match(name, r".*:(void|boolean|long|int)\(.*")
    flow = (
        F.when(plain & full_match(name, MUTATORS), flow_text(F.col("n"), 0))
        .when(plain & ~full_match(name, NOT_PLAIN), flow_text(F.col("n")))
        .when(full_match(name, r".*:java.lang.String\(.*") & ~full_match(name, r".*\.set[A-Za-z_]*:.*"), flow_text(F.col("n"), -1))
    )
    return own.select(name.alias("signature"), flow.alias("flow")).where("flow is not null")


def of_members(program: Program) -> DataFrame:
    """Getters and setters of members that are not personal kill taint; setters of those that are taint their receiver."""
    call = lambda tag, but: program.untagged(program.tagged(program.of("CALL"), tag), but) if but else program.tagged(program.of("CALL"), tag)
    row = lambda calls, to: _arity(program, calls).select(F.col("method_full_name").alias("signature"), flow_text(F.col("n"), to).alias("flow"))
    return row(call("INSENSITIVE_METHOD_RETURN", "SENSITIVE_METHOD_RETURN"), NONE).unionByName(row(call("INSENSITIVE_SETTER", "SENSITIVE_SETTER"), NONE)).unionByName(row(call("SENSITIVE_SETTER", None), 0))


def of_named_arguments(program: Program, to: int = -1) -> DataFrame:
    """Python: sink calls with the names of their arguments beside the places; one place more, for the receiver."""
    calls = program.tagged(program.of("CALL"), "catLevelOne", "sinks")
    args = program.arguments(calls).where("arg_name is not null and arg_label = 'NAMED_ARGUMENT'")
    item = F.concat(F.col("arg_argument_index").cast("string"), F.lit(' "'), "arg_name", F.lit('"'))
    tokens = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.concat(item, F.lit(f"->{to}")), F.concat(item, F.lit("->"), item))))))
    named = args.groupBy("repo", "id").agg(F.array_join(tokens, " ").alias("named"))
    wide = _arity(program, calls, 1).join(named, ["repo", "id"], "left")
    return wide.select(F.col("method_full_name").alias("signature"), F.trim(F.concat_ws(" ", flow_text(F.col("n"), to), "named")).alias("flow"))


def of_catalogue(spark, semantics: Sequence) -> DataFrame:
    return spark.createDataFrame([(s.signature.strip(), s.flow) for s in semantics if s.signature], "signature string, flow string")


def of_language(spark, program: Program, semantics: Sequence, language: str) -> DataFrame:
    """All semantics of a language, a row a signature. Java, Python and JavaScript have them; elsewhere calls do what the front end's flows say."""
    own = of_catalogue(spark, semantics)
    if language == "python":
        return of_named_arguments(program).unionByName(own).distinct()
    if language == "javascript":
        return merged(own.unionByName(of_sinks(program, 1)))
    if language == "java":
        return merged(own.unionByName(of_sinks(program)).unionByName(of_external(program)).unionByName(of_members(program)))
    return own.where(F.lit(False))


def text_lines(rows: DataFrame) -> DataFrame:
    """One quoted line for each signature, as the file of semantics has them."""
    return rows.select(F.trim(F.concat(F.lit('"'), "signature", F.lit('" '), "flow")).alias("line")).orderBy("line")


# Reads of databases: a query's text tags the node with what its columns are

SELECT = r"(?i)SELECT\s+(.*)\sFROM.+"


def whole_query(code: Column, language: str = "java") -> Column:
    """The SELECT of a query that is put together from pieces: joined over +, quotes, line ends and braces; empty if there is none."""
    cut = r"[+\n{}]|\\?\"" if language == "java" else r"\|\+|\"|\n|\{|\}"
    joined = F.array_join(F.transform(F.split(code, cut), lambda x: F.regexp_replace(x, r"^[ \t]*\|", "")), "")
    found = F.regexp_extract(joined, SELECT, 0)
    open_ = F.regexp_count(found, F.lit(r"\(")) < F.regexp_count(found, F.lit(r"\)"))  # the call's own bracket, behind the query
    return F.when(open_, F.regexp_replace(found, r"\)[^()]*$", "")).otherwise(found)


def query_nodes(program: Program, calls: str = r"(?i).*(query|select|find|execute|prepare|read_sql)\w*") -> DataFrame:
    """Literals that read from tables, and calls whose code does."""
    has = F.col("code").rlike(r"(?i)\bselect\b[\s\S]*\bfrom\b")
    return program.of("LITERAL").where(has).unionByName(program.of("CALL").where(has & full_match(F.col("name"), calls)))


def named_query_uses(program: Program) -> DataFrame:
    """(repo, id, call): queries of ``@NamedQuery`` annotations and the calls that create a query by that name."""
    marks = program.of("ANNOTATION").where("name = 'NamedQuery'").select("repo", "id", F.regexp_extract("code", r'name\s*=\s*"([^"]+)"', 1).alias("query_name"))
    calls = program.calls().where(full_match(F.col("method_full_name"), "org[.]hibernate[.].*create[a-zA-Z]{0,10}Query:.*"))
    args = program.arguments(calls).select("repo", F.col("id").alias("call"), unquoted(F.col("arg_code")).alias("query_name"))
    return marks.where("query_name <> ''").join(args, ["repo", "query_name"]).select("repo", "id", "call").distinct()


def matching_columns(columns: Column, pattern: str) -> Column:
    """Some column matches whole."""
    return F.coalesce(F.exists(columns, lambda c: c.rlike(rf"\A(?:{pattern})\z")), F.lit(False))


def read_tags(nodes: DataFrame, rules: Sequence, sensitive: DataFrame, tables: DataFrame, language: str = "java") -> DataFrame:
    """(repo, id, rule_id): queries with the rules of the columns they read; of ``*`` those of the sensitive class of the table.

    ``sensitive`` is (repo, type, rule_id), ``tables`` (repo, type_full_name, table_name); a class is also found by ending in the table's name. In Python a query on a
    sensitive class is tested against that class's rules only.
    """
    queries = nodes.select("repo", "id", whole_query(F.col("code"), language).alias("content")).where("content <> ''")
    found = sql_text.query_columns(queries).groupBy("repo", "id", F.lower("table_name").alias("table")).agg(F.array_sort(F.collect_set("column_name")).alias("columns"))
    by_map = sensitive.join(tables.select("repo", F.col("type_full_name").alias("type"), F.lower("table_name").alias("table")), ["repo", "type"]).select("repo", "table", "rule_id")
    short = F.lower(F.element_at(F.split("type", r"\."), -1))
    by_name = sensitive.select("repo", short.alias("table"), "rule_id")
    known = by_map.unionByName(by_name).distinct()
    star = (F.size("columns") == 1) & (F.col("columns")[0] == "*")
    of_class = found.where(star).join(known, ["repo", "table"]).select("repo", "id", "rule_id")
    plain = tagging.match_rows(found.where(~star), [(r.id, matching_columns(F.col("columns"), r.pattern)) for r in rules])
    if language == "python":
        classes = known.select("repo", "table").distinct()
        inside = plain.join(known, ["repo", "table", "rule_id"], "left_semi")
        plain = inside.unionByName(plain.join(classes, ["repo", "table"], "left_anti"))
    return of_class.unionByName(plain.select("repo", "id", "rule_id")).distinct()


def star_reads(program: Program, nodes: DataFrame, sources: DataFrame, semantics: DataFrame | None = None) -> DataFrame:
    """(repo, id, rule_id): queries of all columns of an unknown class, by the data elements that their result flows to."""
    found = reach_by_calls(program, nodes.select("repo", "id"), sources.select("repo", "id"), semantics)
    ids = program.tags.where(F.col("value").startswith("Data.Sensitive.")).select("repo", F.col("node_id").alias("sink"), F.col("value").alias("rule_id"))
    return found.select("repo", F.col("source").alias("id"), "sink").distinct().join(ids, ["repo", "sink"]).select("repo", "id", "rule_id").distinct()
