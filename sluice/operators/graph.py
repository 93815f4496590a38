"""A scanned program as tables of nodes, edges and tags, and the steps between them.

All tables carry ``repo``, and every join is on it, so that one job serves many repositories and a repository is never a
task of its own. Node ids are unique over all of them: reachability goes by id alone. Nodes are a sparse table; tags are rows (repo, node_id, name, value) and the only thing that a tagger adds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators._stage import keep
from sluice.operators.predicates import full_match

NODE = (
    "repo string, id long, label string, name string, code string, type_full_name string, method_full_name string, "
    "type_hints array<string>, inherits array<string>, argument_index int, is_external boolean, file string, line int, col int"
)
EDGE = "repo string, src long, dst long, label string"
TAG = "repo string, node_id long, name string, value string"
PROPERTY = "repo string, id long, file string, name string, value string, line int"
TAG_COLUMNS = ["repo", "node_id", "name", "value"]

FIELD_ACCESS = ("<operator>.fieldAccess", "<operator>.indirectFieldAccess")
ASSIGNMENT = "<operator>.assignment"
INDEX_ACCESS = "<operator>.indexAccess"


@dataclass(frozen=True)
class Program:
    """The tables of scanned repositories; steps return new ones."""

    nodes: DataFrame
    edges: DataFrame
    tags: DataFrame

    def of(self, *labels: str) -> DataFrame:
        """Nodes of the labels: the starters of the traversal language. The label is a partition column of stored tables."""
        return self.nodes.where(F.col("label").isin(*labels))

    def calls(self) -> DataFrame:
        """Calls that are no operators."""
        return self.of("CALL").where(~F.col("name").startswith("<operator"))

    def operators(self, *names: str) -> DataFrame:
        return self.of("CALL").where(F.col("name").isin(*names))

    def with_tags(self, *more: DataFrame) -> Program:
        tags = self.tags
        for m in more:
            tags = tags.unionByName(m.select(*TAG_COLUMNS))
        return replace(self, tags=tags.distinct())

    def with_edges(self, more: DataFrame) -> Program:
        return replace(self, edges=self.edges.unionByName(more.select("repo", "src", "dst", "label")).distinct())

    def kept(self, since: Program | None = None) -> Program:
        """With tags and edges written to the shared folder: later steps read tables, not the plans of all steps before. Those of ``since`` are there already."""
        own = lambda name: getattr(self, name) if since is not None and getattr(self, name) is getattr(since, name) else keep(getattr(self, name), name)
        return replace(self, tags=own("tags"), edges=own("edges"))

    # Steps

    def tagged(self, nodes: DataFrame, name: str, value: str | None = None, key: str = "id") -> DataFrame:
        """Nodes with a tag of exactly this name, and value if one is given."""
        return nodes.join(self._tag_keys(name, value, key), ["repo", key], "left_semi")

    def untagged(self, nodes: DataFrame, name: str, value: str | None = None, key: str = "id") -> DataFrame:
        return nodes.join(self._tag_keys(name, value, key), ["repo", key], "left_anti")

    def _tag_keys(self, name: str, value: str | None, key: str) -> DataFrame:
        own = self.tags.where(F.col("name") == name)
        if value is not None:
            own = own.where(F.col("value") == value)
        return own.select("repo", F.col("node_id").alias(key))

    def hop(self, keys: DataFrame, label: str, key: str = "id", to: str = "to", back: bool = False) -> DataFrame:
        """``keys`` with the other end of each of their edges as ``to``."""
        a, b = ("dst", "src") if back else ("src", "dst")
        step = self.edges.where(F.col("label") == label).select("repo", F.col(a).alias(key), F.col(b).alias(to))
        return keys.join(step, ["repo", key])

    def out(self, nodes: DataFrame, label: str, *, back: bool = False) -> DataFrame:
        """The nodes at the other ends, each once."""
        ends = self.hop(nodes.select("repo", "id"), label, back=back).select("repo", F.col("to").alias("id")).distinct()
        return self.nodes.join(ends, ["repo", "id"], "left_semi")

    def arguments(self, calls: DataFrame, key: str = "id") -> DataFrame:
        """repo, key, and the argument nodes with their columns prefixed ``arg_``."""
        arg = self.nodes.select("repo", *[F.col(c).alias(f"arg_{c}") for c in ("id", "label", "name", "code", "type_full_name", "argument_index")])
        return self.hop(calls.select("repo", key).distinct(), "ARGUMENT", key, "arg_id").join(arg, ["repo", "arg_id"])

    def members(self) -> DataFrame:
        """Members with the full name of their type as ``owner``."""
        types = self.of("TYPE_DECL").select("repo", F.col("id").alias("owner_id"), F.col("type_full_name").alias("owner"))
        up = self.edges.where("label = 'AST'").select("repo", F.col("src").alias("owner_id"), F.col("dst").alias("id"))
        return self.of("MEMBER").join(up, ["repo", "id"]).join(types, ["repo", "owner_id"])

    def accessed_fields(self) -> DataFrame:
        """Field accesses with the code of the field."""
        found = self.operators(*FIELD_ACCESS)
        return found.join(self.arguments(found).where("arg_argument_index = 2").select("repo", "id", F.col("arg_code").alias("field")), ["repo", "id"])

    def field_accesses(self) -> DataFrame:
        """Field accesses with receiver (``on_``: id, label, name, type) and the code of the field; one with several receivers has a row for each."""
        found = self.operators(*FIELD_ACCESS)
        args = self.arguments(found)
        on = args.where("arg_argument_index = 1").select("repo", "id", F.col("arg_id").alias("on_id"), F.col("arg_label").alias("on_label"), F.col("arg_name").alias("on_name"), F.col("arg_type_full_name").alias("on_type"))
        field = args.where("arg_argument_index = 2").select("repo", "id", F.col("arg_code").alias("field"))
        return found.join(field, ["repo", "id"]).join(on, ["repo", "id"], "left")


def property_uses(program: Program, properties: DataFrame) -> DataFrame:
    """Properties with the id of each node that they are used at."""
    return program.hop(properties, "IS_USED_AT", to="node_id")


def original_property(program: Program, nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """Nodes with the first property (by id) that they come from, as original_id, original_name and original_value; null without."""
    back = program.hop(nodes.select("repo", "id"), "ORIGINAL_PROPERTY", to="property_id")
    p = properties.select("repo", F.col("id").alias("property_id"), F.struct("name", "value").alias("p"))
    first = back.join(p, ["repo", "property_id"]).groupBy("repo", "id").agg(F.min("property_id").alias("original_id"), F.min_by("p", "property_id").alias("p"))
    return nodes.join(first, ["repo", "id"], "left").select(*nodes.columns, "original_id", F.col("p.name").alias("original_name"), F.col("p.value").alias("original_value"))


def original_sources(program: Program, derived: DataFrame, rule_id: str | None = None) -> DataFrame:
    """(derived id, source id) over ORIGINAL_SOURCE edges; with a rule id only sources that carry it."""
    found = program.hop(derived.select("repo", "id"), "ORIGINAL_SOURCE", to="source_id")
    return found if rule_id is None else program.tagged(found, "id", rule_id, key="source_id")


def derived_sources(program: Program, sources: DataFrame) -> DataFrame:
    return program.hop(sources.select("repo", "id"), "DERIVED_SOURCE", to="derived_id")


def climb(program: Program, nodes: DataFrame, until: Column, label: str = "AST") -> DataFrame:
    """(id, reached, found): from each node up the edges to the nearest ancestor of which ``until`` holds, or to the last one.

    Pointers double: after k joins a node points 2**k levels up, unless it has met such an ancestor before, so 1,000 levels take ten joins. A node
    whose ways up go in a circle is not found.
    """
    parent = program.edges.where(F.col("label") == label).groupBy("repo", F.col("dst").alias("id")).agg(F.min("src").alias("at"))
    good = program.nodes.select("repo", F.col("id").alias("at"), F.coalesce(until, F.lit(False)).alias("found"))
    up = keep(parent.join(good, ["repo", "at"]), "climb")
    levels, covered = up.count(), 1
    while covered <= levels:
        onward = up.select("repo", F.col("id").alias("at"), F.col("at").alias("_at"), F.col("found").alias("_found"))
        stays = F.col("found") | F.col("_at").isNull()
        up = keep(up.join(onward, ["repo", "at"], "left").select("repo", "id", F.when(stays, F.col("at")).otherwise(F.col("_at")).alias("at"), F.when(stays, F.col("found")).otherwise(F.col("_found")).alias("found"), (~stays).alias("_moved")), "climb")
        covered *= 2
        if up.where("_moved").isEmpty():
            break
        up = up.drop("_moved")
    own = nodes.select("repo", "id").distinct().join(up.select("repo", "id", "at", "found"), ["repo", "id"], "left")
    return own.select("repo", "id", F.coalesce("at", "id").alias("reached"), F.coalesce("found", F.lit(False)).alias("found"))


def called_within(program: Program, methods: DataFrame, depth: int = 4) -> DataFrame:
    """(id, reached, steps): methods that a method calls in at most ``depth`` calls, and their fewest calls."""
    inside = program.edges.where("label = 'CONTAINS'").select("repo", F.col("src").alias("at"), F.col("dst").alias("call"))
    callee = program.edges.where("label = 'CALL'").select("repo", F.col("src").alias("call"), F.col("dst").alias("to"))
    step = inside.join(callee, ["repo", "call"]).select("repo", "at", "to").distinct()
    front = methods.select("repo", "id", F.col("id").alias("at")).distinct()
    found = front.withColumn("steps", F.lit(0))
    for n in range(1, depth + 1):
        front = front.join(step, ["repo", "at"]).select("repo", "id", F.col("to").alias("at")).distinct()
        found = found.unionByName(front.withColumn("steps", F.lit(n)))
    return found.groupBy("repo", "id", F.col("at").alias("reached")).agg(F.min("steps").alias("steps"))


def arguments_within(program: Program, calls: DataFrame, depth: int = 3) -> DataFrame:
    """(id, arg_id, arg_label, level): arguments of a call, of calls among these, and so on."""
    front = program.arguments(calls).where("arg_argument_index > 0").select("repo", "id", "arg_id", "arg_label")
    found = front.withColumn("level", F.lit(1))
    for n in range(2, depth + 1):
        inner = front.where("arg_label = 'CALL'").select("repo", "id", F.col("arg_id").alias("call"))
        front = program.arguments(inner.select("repo", F.col("call")).distinct(), "call").join(inner, ["repo", "call"]).select("repo", "id", "arg_id", "arg_label")
        found = found.unionByName(front.withColumn("level", F.lit(n)))
    return found.distinct()


def inherits_closure(program: Program, pattern: str) -> DataFrame:
    """(repo, type_full_name, level) of types that extend a match of ``pattern`` (1), or extend such a type (2). An empty pattern has none."""
    if pattern in ("", "()"):
        return program.of("TYPE_DECL").where(F.lit(False)).select("repo", "type_full_name", F.lit(1).alias("level"))
    up = program.of("TYPE_DECL").select("repo", "type_full_name", F.explode("inherits").alias("parent"))
    one = up.where(full_match(F.col("parent"), pattern)).select("repo", "type_full_name").distinct()
    two = up.join(one.select("repo", F.col("type_full_name").alias("parent")), ["repo", "parent"], "left_semi").select("repo", "type_full_name")
    both = one.withColumn("level", F.lit(1)).unionByName(two.withColumn("level", F.lit(2)))
    return both.groupBy("repo", "type_full_name").agg(F.min("level").alias("level"))


def types_annotated(program: Program, pattern: str) -> DataFrame:
    """Types with an annotation whose name matches; an empty pattern has none."""
    if pattern in ("", "()"):
        return program.of("TYPE_DECL").where(F.lit(False))
    marks = program.of("ANNOTATION").where(full_match(F.col("name"), pattern))
    return program.out(marks, "AST", back=True).where("label = 'TYPE_DECL'")


def table_of_classes(program: Program) -> DataFrame:
    """(repo, type_full_name, table_name): classes annotated as entities; the table is named by the annotation, else by the class, in lower case."""
    own = program.hop(program.of("TYPE_DECL").select("repo", "id", "name", "type_full_name"), "AST", to="mark_id")
    marks = program.of("ANNOTATION").where(F.col("name").isin("Entity", "Table")).select("repo", F.col("id").alias("mark_id"), F.col("name").alias("mark"), F.regexp_extract("code", r"""name\s*=\s*["']([^"']+)["']""", 1).alias("named"))
    found = own.join(marks, ["repo", "mark_id"]).groupBy("repo", "type_full_name", "name").agg(F.max(F.when(F.col("named") != "", F.col("named"))).alias("named"))
    return found.select("repo", "type_full_name", F.lower(F.coalesce("named", "name")).alias("table_name"))


def class_of_table(types: DataFrame, tables: DataFrame) -> DataFrame:
    """(repo, table_name, type_full_name): the first class by full name that ends in the table's name, whatever the case.

    Classes are met by their suffixes, an equi-join; names are short, and an empty table name has no class.
    """
    low = F.lower("type_full_name")
    ends = types.select("repo", "type_full_name").distinct().select("repo", "type_full_name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda k: F.right(low, k))).alias("_end"))
    wanted = tables.select("repo", "table_name").distinct().withColumn("_end", F.lower("table_name")).where("_end <> ''")
    return wanted.join(ends, ["repo", "_end"]).groupBy("repo", "table_name").agg(F.min("type_full_name").alias("type_full_name"))
