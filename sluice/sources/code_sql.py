"""SQL that stands elsewhere than in SQL files: in properties, code, mapped types and schema definitions; and GraphQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.scalars import unquoted
from sluice.operators import graph, tagging
from sluice.operators.graph import Program
from sluice.operators.predicates import full_match
from sluice.operators.sinks import graphql_names
from sluice.sources import sql_text
from sluice.sources._rows import parsed

VERBS = "(?i)(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE)"


def in_properties(properties: DataFrame) -> DataFrame:
    """Columns of the queries that are values of properties named ``query``; their lines count from the property's."""
    own = properties.where(full_match(F.col("name"), "(?i)query")).select("repo", F.col("id").alias("property_id"), "file", F.coalesce("line", F.lit(-1)).alias("at"), F.col("value").alias("content"))
    found = sql_text.query_columns(own)
    return found.withColumn("line", F.when(F.col("at") > 0, F.col("at") + F.col("line") - 1).otherwise(F.col("line")))


def in_code(program: Program) -> DataFrame:
    """Columns of queries in literals, whole where pieces are added up: the argument with a verb of the nearest call that is no addition."""
    literal = program.of("LITERAL").where(F.col("code").rlike(VERBS))
    joins = F.col("name").isin("<operator>.addition", "<operator>.stringExpressionList")
    top = graph.climb(program, literal, (F.col("label") == "CALL") & ~joins, "AST").where("found").select("repo", F.col("reached").alias("id")).distinct()
    args = program.arguments(top).where(F.col("arg_code").rlike(VERBS)).select("repo", F.col("arg_id").alias("id")).distinct()
    nodes = program.nodes.join(args, ["repo", "id"]).select("repo", F.col("id").alias("node_id"), "file", F.col("line").alias("at"), unquoted(F.regexp_replace("code", r'["`]\s*\+\s*["`]', "")).alias("content"))
    found = sql_text.query_columns(nodes)
    return found.withColumn("line", F.coalesce(F.col("at"), F.lit(0)) + F.col("line") - 1)


def of_mapped_types(program: Program, sinks: DataFrame) -> DataFrame:
    """(repo, table_name, column_name, file, line, ord): types that objects given to storage sinks have, as tables with their members for columns."""
    args = program.arguments(sinks).select("repo", F.regexp_replace("arg_type_full_name", r"^[*\[\]&]+", "").alias("owner")).distinct()
    members = program.members().join(args, ["repo", "owner"], "left_semi")
    ord_ = F.row_number().over(_by_owner()) - 1
    return members.select("repo", F.element_at(F.split("owner", r"\."), -1).alias("table_name"), F.col("name").alias("column_name"), "file", "line", ord_.cast("int").alias("ord"))


def _by_owner():
    from pyspark.sql import Window

    return Window.partitionBy("repo", "owner").orderBy("line", "id")  # the members of one type


SCHEMA = "table_name string, table_line int, column_name string, column_type string, line int, ord int"
_CREATE = re.compile(r"""^\s*create_table\s*\(?\s*["':](\w+)["']?""")
_COLUMN = re.compile(r"""^\s*\w+\.(\w+)\s*\(?\s*["':](\w+)["']?""")


def schema_rows(text: str) -> Iterator[tuple]:
    """Tables and columns of ``create_table`` blocks, up to their ``end``; indexes are no columns."""
    table, at, n = None, 0, 0
    for k, line in enumerate(text.split("\n"), 1):
        if m := _CREATE.match(line):
            table, at, n = m[1], k, 0
        elif table and re.match(r"^\s*end\b", line):
            table = None
        elif table and (m := _COLUMN.match(line)) and m[1] not in ("index", "foreign_key", "check_constraint"):
            yield table, at, m[2], m[1], k, n
            n += 1


def ruby_schema(files: DataFrame) -> DataFrame:
    """Columns of schema.rb files (repo, file, content)."""
    return parsed(files.where(F.col("file").endswith("/schema.rb")), "content", schema_rows, SCHEMA)


def table_nodes(columns: DataFrame, keys: tuple[str, ...] = ("repo", "file")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, tables, columns) as node tables with ids and parents: ids by a hash of what tells a node, so that a part read again has the same."""
    k = [c for c in keys if c in columns.columns]
    query = F.xxhash64(F.lit("query"), *k, "statement_line", "query_ord")
    table = F.xxhash64(F.lit("table"), *k, "statement_line", "query_ord", "table_name")
    q = columns.select(*k, query.alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("kind").alias("name"), F.col("statement").alias("code"), F.col("statement_line").alias("line"), F.lit(0).alias("col"), F.col("query_ord").alias("ord")).distinct()
    t = columns.select(*k, table.alias("id"), query.alias("parent_id"), F.col("table_name").alias("name"), F.col("table_name").alias("code"), F.col("table_line").alias("line"), F.lit(0).alias("col"), F.lit(0).alias("ord")).distinct()
    c = columns.select(*k, F.xxhash64(F.lit("column"), *k, "statement_line", "query_ord", "table_name", "ord").alias("id"), table.alias("parent_id"), F.col("column_name").alias("name"), F.col("column_name").alias("code"), "line", "col", "ord").distinct()
    return q, t, c


def graphql(program: Program, rules) -> DataFrame:
    """(repo, id, rule_id, name): GraphQL literals with the rules that a field or variable of theirs matches."""
    texts = program.of("LITERAL").where(F.col("code").rlike(r"(?i)(query|mutation|subscription|fragment)\b[^{]*\{"))
    names = texts.select("repo", "id", F.explode(graphql_names(F.col("code"))).alias("name"))
    return tagging.tag_nodes(names, "name", list(rules)).select("repo", "id", "rule_id", "name").distinct()
