"""Edges between properties and the code that uses them, full names that the code leaves open, and imports between files.

A linker gives (repo, property_id, node_id), which ``link_edges`` makes both edges of. Looking a property's name up in code is an
equi-join on a name cut out of the code, never a pattern for each property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import scalars as fn
from sluice.operators import graph
from sluice.operators._stage import keep
from sluice.operators.graph import Program
from sluice.operators.predicates import full_match

USED, ORIGIN = "IS_USED_AT", "ORIGINAL_PROPERTY"


def link_edges(links: DataFrame) -> DataFrame:
    """The edges of uses and origins, both ways."""
    forth = links.select("repo", F.col("property_id").alias("src"), F.col("node_id").alias("dst"), F.lit(USED).alias("label"))
    return forth.unionByName(links.select("repo", F.col("node_id").alias("src"), F.col("property_id").alias("dst"), F.lit(ORIGIN).alias("label"))).distinct()


def named(properties: DataFrame, *, source: DataFrame | None = None) -> DataFrame:
    """Properties with a name and a value, the name trimmed; without those made from code (``source``: their ids)."""
    p = properties.where("name <> '' and value <> ''").select("repo", F.col("id").alias("property_id"), F.trim("name").alias("name"))
    return p if source is None else p.join(source.select("repo", F.col("id").alias("property_id")), ["repo", "property_id"], "left_anti")


def verified(properties: DataFrame) -> DataFrame:
    """Properties as lines of a report: each that is complete."""
    return properties.where("name is not null and value is not null").select("repo", "file", "name", "value", "line")


def _tails(p: DataFrame) -> DataFrame:
    """Every tail of a property's dotted name: a.b.c, b.c and c."""
    parts = F.split("name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return p.select("repo", "property_id", F.explode(tails).alias("key"))


def java_properties(program: Program, properties: DataFrame) -> DataFrame:
    """Literals of the property's name; parameters annotated with ``@Value("${name}")`` or ``@Named``, by the name or a tail of it; members so annotated by the whole
    name; and the member that a method so annotated accesses."""
    p = named(properties)
    exact = p.select("repo", "property_id", F.col("name").alias("key"))
    literal = program.of("LITERAL").where(F.col("code").startswith('"')).select("repo", F.col("id").alias("node_id"), fn.unquoted(F.col("code")).alias("key"))
    marks = program.of("ANNOTATION").where("name in ('Value', 'Named')").select("repo", F.col("id").alias("mark_id"), "name", F.regexp_extract("code", r'"\$\{([^}]*)\}"', 1).alias("value"), F.regexp_extract("code", r"""([^."'(=\s]+)["')\s]*$""", 1).alias("last"))
    key = F.when(F.col("name") == "Value", F.col("value")).otherwise(F.col("last"))
    ends = program.hop(marks.select("repo", "mark_id", "name", key.alias("key")).where("key <> ''"), "AST", key="mark_id", to="node_id", back=True)
    on = lambda label: ends.join(program.of(label).select("repo", F.col("id").alias("node_id")), ["repo", "node_id"], "left_semi")
    values = F.col("name") == "Value"
    methods = on("METHOD").where(values).select("repo", "key", F.col("node_id").alias("method_id"))
    access = program.hop(methods, "CONTAINS", key="method_id", to="access").join(program.field_accesses().select("repo", F.col("id").alias("access"), F.col("field").alias("name"), "file"), ["repo", "access"])
    member = program.of("MEMBER").select("repo", F.col("id").alias("node_id"), "name", "file")
    by_method = access.join(member, ["repo", "name", "file"]).groupBy("repo", "key", "method_id").agg(F.min("node_id").alias("node_id"))
    other = on("PARAMETER").join(_tails(p), ["repo", "key"]).select("repo", "property_id", "node_id")
    other = other.unionByName(on("MEMBER").where(values).join(exact, ["repo", "key"]).select("repo", "property_id", "node_id"))
    other = other.unionByName(by_method.join(exact, ["repo", "key"]).select("repo", "property_id", "node_id")).distinct()
    # a literal has one value and a property one name, so their pairs, of which a frequent name has many, need no exchange to be distinct
    return literal.join(exact, ["repo", "key"]).select("repo", "property_id", "node_id").unionByName(other)


def yaml_properties(program: Program, properties: DataFrame) -> DataFrame:
    """Literals of a YAML property's name inside a call like ``getenv``: Java and Go."""
    p = named(properties.where(F.col("file").rlike(r"(?i)\.ya?ml$"))).withColumnRenamed("name", "key")
    inside = program.arguments(program.calls().where(full_match(F.col("name"), "(?i).*getenv"))).where("arg_label = 'LITERAL'")
    return inside.select("repo", F.col("arg_id").alias("node_id"), fn.unquoted(F.col("arg_code")).alias("key")).join(p, ["repo", "key"]).select("repo", "property_id", "node_id").distinct()


def _operands(program: Program) -> DataFrame:
    """Children of assignments and field accesses, with their code."""
    calls = program.operators(graph.ASSIGNMENT, graph.FIELD_ACCESS[0])
    ends = program.hop(calls.select("repo", "id"), "AST", to="node_id").select("repo", "node_id").distinct()
    return ends.join(program.nodes.select("repo", F.col("id").alias("node_id"), "code"), ["repo", "node_id"])


def _in_words(operands: DataFrame, p: DataFrame, gate: Column) -> DataFrame:
    """Operands whose code, where the gate holds, has the property's name among its words and dotted names, or as part of one."""
    words = F.array_distinct(F.regexp_extract_all("code", F.lit(r"[\w.-]+"), 0))
    pieces = F.flatten(F.transform(words, lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(F.split(w, r"\."))), lambda i: F.transform(F.sequence(i, F.size(F.split(w, r"\."))), lambda j: F.array_join(F.slice(F.split(w, r"\."), i, j - i + 1), "."))))))
    return operands.where(gate).select("repo", "node_id", F.explode(F.array_distinct(pieces)).alias("name")).join(p, ["repo", "name"]).select("repo", "property_id", "node_id")


def javascript_properties(program: Program, properties: DataFrame, from_code: DataFrame | None = None) -> DataFrame:
    """Operands with ``process.env.NAME`` or ``process.env['NAME']``, or in a configuration (``conf…`` before the name)."""
    p, ops = named(properties, source=from_code).where(~F.col("name").contains("**")), _operands(program)
    env = F.regexp_extract_all("code", F.lit(r"""process\.env(?:\.([\w.-]+)|\[['"`]([^'"`]+)['"`]\])"""), 0)
    names = F.transform(env, lambda e: F.regexp_replace(F.regexp_replace(e, r"""^process\.env(?:\.|\[['"`])""", ""), r"""['"`]\]$""", ""))
    by_env = ops.select("repo", "node_id", F.explode(F.array_distinct(names)).alias("name")).join(p, ["repo", "name"]).select("repo", "property_id", "node_id")
    after = ops.withColumn("code", F.regexp_extract("code", r"(?s)[cC]onf(.*)$", 1))
    return by_env.unionByName(_in_words(after, p, F.col("code") != "")).distinct()


# Which member of a database configuration a property of a name stands for; the first that matches.
DATABASE_MEMBERS = (("host", "(?i).*host.*"), ("url", "(?i).*(url|uri).*"), ("database", "(?i).*(database|db).*"), ("port", "(?i).*(port).*"), ("password", "(?i).*(pass)word?.*"), ("username", "(?i).*(user)name?.*"))


def python_properties(program: Program, properties: DataFrame, from_code: DataFrame | None = None) -> DataFrame:
    """Literals in ``environ.get``, and members of a ``DatabaseConfiguration`` by what the property's name says."""
    p = named(properties, source=from_code)
    inside = program.arguments(program.calls().where(full_match(F.col("method_full_name"), r".*\(?environ\)?\.get"))).where("arg_label = 'LITERAL'")
    by_env = inside.select("repo", F.col("arg_id").alias("node_id"), fn.unquoted(F.col("arg_code")).alias("name")).join(p, ["repo", "name"]).select("repo", "property_id", "node_id")
    kind = F.lit(None).cast("string")
    for member, pattern in reversed(DATABASE_MEMBERS):
        test = full_match(F.col("name"), pattern)
        if member == "url":
            test &= F.col("name").contains(".") | F.col("name").contains("__")
        kind = F.when(test, member).otherwise(kind)
    members = program.members().where(F.col("owner").contains("DatabaseConfiguration")).select("repo", F.col("id").alias("node_id"), F.col("name").alias("member"))
    return by_env.unionByName(p.withColumn("member", kind).join(members, ["repo", "member"]).select("repo", "property_id", "node_id")).distinct()


def ruby_properties(program: Program, properties: DataFrame) -> DataFrame:
    """Operands with ``ENV['NAME']``, ``ENV.fetch['NAME']`` or ``ENV.NAME``, or the name behind ``Settings``."""
    p, ops = named(properties).where(~F.col("name").contains("**")), _operands(program)
    env = F.regexp_extract_all("code", F.lit(r"""ENV(?:\.fetch)?(?:\.[\w.-]+|\[['"`][^'"`]+['"`]\])"""), 0)
    names = F.transform(env, lambda e: F.regexp_replace(F.regexp_replace(e, r"""^ENV(?:\.fetch)?(?:\.|\[['"`])""", ""), r"""['"`]\]$""", ""))
    by_env = ops.select("repo", "node_id", F.explode(F.array_distinct(names)).alias("name")).join(p, ["repo", "name"]).select("repo", "property_id", "node_id")
    after = ops.withColumn("code", F.regexp_extract("code", r"(?s)Settings(.*)$", 1))
    return by_env.unionByName(_in_words(after, p, F.col("code") != "")).distinct()


def properties_in_code(program: Program, language: str, depth: int = 4) -> DataFrame:
    """(repo, name, value, file, line, node_id): configuration objects in code as properties; keys of nested objects with dots.

    Keys are field accesses in JavaScript (``_tmp_0.key``) and index accesses in Python (``tmp["key"]``).
    """
    access = graph.FIELD_ACCESS[0] if language == "javascript" else graph.INDEX_ACCESS
    args = program.arguments(program.operators(graph.ASSIGNMENT))
    left = args.where("arg_argument_index = 1").select("repo", "id", F.col("arg_label").alias("l_label"), F.col("arg_name").alias("l_name"), F.col("arg_code").alias("l_code"))
    right = args.where("arg_argument_index = 2").select("repo", "id", F.col("arg_id").alias("r_id"), F.col("arg_label").alias("r_label"), F.col("arg_code").alias("r_code"))
    pairs = left.join(right, ["repo", "id"])
    temporary = F.split("l_code", r"\.")[0].contains("_tmp_")
    field = F.when(temporary, F.element_at(F.split("l_code", r"\."), -1)).otherwise(F.col("l_code")) if language == "javascript" else F.array_join(F.regexp_extract_all("l_code", F.lit(r"""\[["']([^"']+)["']\]"""), 1), ".")
    key = F.when(F.col("l_name") == access, field).when(F.col("l_label") == "IDENTIFIER", F.col("l_name"))
    known = pairs.withColumn("key", key).where("key is not null")
    children = program.edges.where("label = 'AST'").select("repo", F.col("src").alias("at"), F.col("dst").alias("id"))
    inner = known.join(children, ["repo", "id"])
    empty = program.of("BLOCK").where(F.coalesce("code", F.lit("")).isin("", "<empty>")).select("repo", F.col("id").alias("at"))
    front = inner.where("r_label = 'BLOCK'").join(empty, ["repo", "at"], "left_semi").select("repo", F.col("key").alias("prefix"), F.col("r_id").alias("at"))
    found = None
    for _ in range(depth):
        step = front.join(inner, ["repo", "at"]).withColumn("name", F.concat_ws(".", "prefix", "key"))
        leaf = step.where((F.col("r_label") != "BLOCK") & (F.col("l_name") == access)).select("repo", "name", fn.unquoted(F.col("r_code")).alias("value"), F.col("r_id").alias("node_id"))
        found = leaf if found is None else found.unionByName(leaf)
        front = step.where("r_label = 'BLOCK'").select("repo", F.col("name").alias("prefix"), F.col("r_id").alias("at"))
    place = program.nodes.select("repo", F.col("id").alias("node_id"), "file", "line")
    return found.distinct().join(place, ["repo", "node_id"]).select("repo", "name", "value", "file", "line", "node_id")


# Full names and types that the code leaves open. All of it is name look-up over tables that a front end wrote.

LOMBOK = {  # fixed values: annotations and the logger they make
    "CommonsLog": "org.apache.commons.logging.Log",
    "Flogger": "com.google.common.flogger.FluentLogger",
    "Log": "java.util.logging.Logger",
    "Log4j2": "org.apache.logging.log4j.Logger",
    "Slf4j": "org.slf4j.Logger",
}
UNRESOLVED = "<unresolvedNamespace>"


def lombok_full_names(program: Program) -> DataFrame:
    """Calls on ``log`` of an unresolved namespace with the logger that the repository's annotation (the least by id) makes."""
    first = program.of("ANNOTATION").where(F.col("name").isin(*LOMBOK)).groupBy("repo").agg(F.min_by("name", "id").alias("logger"))
    kinds = F.create_map(*[F.lit(x) for kv in LOMBOK.items() for x in kv])
    on_log = program.arguments(program.calls()).where("arg_label = 'IDENTIFIER' and arg_name = 'log'").select("repo", "id").distinct().withColumn("_log", F.lit(True))
    calls = program.of("CALL").join(on_log, ["repo", "id"], "left").join(first, "repo", "left")
    fill = F.col("_log") & F.col("method_full_name").startswith(UNRESOLVED) & F.col("logger").isNotNull()
    name = F.when(fill, F.replace("method_full_name", F.lit(UNRESOLVED), F.try_element_at(kinds, F.col("logger")))).otherwise(F.col("method_full_name"))
    return calls.withColumn("method_full_name", name).select(*program.nodes.columns)


def _open() -> Column:
    return F.coalesce("method_full_name", F.lit("")).isin("", "<unknownFullName>")


def javascript_full_names(program: Program, imports: DataFrame) -> DataFrame:
    """Calls without a full name: ``pkg:<package>.<name>`` by the import's alias that they are called on, or by a variable that ``require`` or ``new`` of it gave; else ``pkg:<name>`` where the name is imported."""
    alias = imports.select("repo", "file", F.col("alias").alias("on"), F.col("name").alias("package")).distinct()
    first = program.arguments(program.calls()).groupBy("repo", "id").agg(F.min_by("arg_name", "arg_argument_index").alias("first"))
    given = program.arguments(program.operators(graph.ASSIGNMENT))
    left = given.where("arg_argument_index = 1").select("repo", "id", F.col("arg_name").alias("variable"))
    right = given.where("arg_argument_index = 2").select("repo", "id", F.coalesce(F.nullif(F.regexp_extract("arg_code", r"""require\(["']([^"']+)["']\)""", 1), F.lit("")), F.nullif(F.regexp_extract("arg_code", r"new (\w+)", 1), F.lit(""))).alias("made"))
    files = program.of("CALL").select("repo", "id", "file")
    made = left.join(right, ["repo", "id"]).where("made is not null").join(files, ["repo", "id"])
    named_ = made.join(alias.withColumnRenamed("on", "made"), ["repo", "file", "made"], "left").select("repo", "file", F.col("variable").alias("on"), F.coalesce("package", "made").alias("package"))
    known = alias.unionByName(named_).groupBy("repo", "file", "on").agg(F.min("package").alias("package"))
    calls = program.of("CALL").join(first, ["repo", "id"], "left").withColumn("on", F.coalesce(F.nullif(F.regexp_extract("code", r"^(\w+)\.", 1), F.lit("")), F.col("first")))
    by_receiver = calls.join(known, ["repo", "file", "on"], "left").join(alias.select("repo", "file", F.col("on").alias("name"), F.col("package").alias("own_package")).distinct(), ["repo", "file", "name"], "left")
    name = F.when(_open() & F.col("package").isNotNull(), F.concat(F.lit("pkg:"), F.col("package"), F.lit("."), F.col("name"))).when(_open() & F.col("own_package").isNotNull(), F.concat(F.lit("pkg:"), F.col("own_package"), F.lit("."), F.col("name"))).otherwise(F.col("method_full_name"))
    return by_receiver.withColumn("method_full_name", name).select(*program.nodes.columns).distinct()


def fill_empty_names(calls: DataFrame) -> DataFrame:
    """``pkg:<name>`` for calls that still have no full name."""
    return calls.withColumn("method_full_name", F.when(_open() & (F.col("name") != ""), F.concat(F.lit("pkg:"), "name")).otherwise(F.col("method_full_name")))


def link_by_hints(program: Program) -> DataFrame:
    """CALL edges from calls without one to the method that a type hint of theirs names: ``hint`` itself, ``hint.name`` or ``hint.__init__``."""
    linked = program.edges.where("label = 'CALL'").select("repo", F.col("src").alias("id")).distinct()
    hints = program.of("CALL").join(linked, ["repo", "id"], "left_anti").select("repo", "id", "name", F.explode("type_hints").alias("hint"))
    names = F.explode(F.array(F.col("hint"), F.concat_ws(".", "hint", "name"), F.concat_ws(".", "hint", F.lit("__init__"))))
    wanted = hints.select("repo", "id", names.alias("method_full_name"))
    methods = program.of("METHOD").select("repo", "method_full_name", F.col("id").alias("dst"))
    return wanted.join(methods, ["repo", "method_full_name"]).select("repo", F.col("id").alias("src"), "dst", F.lit("CALL").alias("label")).distinct()


def type_slots(program: Program) -> tuple[DataFrame, DataFrame]:
    """(repo, slot, type) as written, and copies (repo, slot, origin).

    A slot is a variable or a field of a file, or the result of a method: ``v|file|name``, ``f|file|name``, ``r|full name``. A variable or field has the
    types of what is assigned to it; a method's result those of what it returns.
    """
    slot = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *parts)
    fields = program.field_accesses().select("repo", F.col("id").alias("value_id"), "field")
    methods = program.edges.where("label = 'CALL'").select("repo", F.col("src").alias("value_id"), F.col("dst").alias("id")).join(program.of("METHOD").select("repo", "id", "method_full_name"), ["repo", "id"]).groupBy("repo", "value_id").agg(F.min("method_full_name").alias("callee"))

    def values(args: DataFrame) -> DataFrame:
        """Argument rows (repo, id, file, arg_...) with the slot that the argument stands for and the type that it is written with."""
        own = args.withColumn("value_id", F.col("arg_id")).join(fields, ["repo", "value_id"], "left").join(methods, ["repo", "value_id"], "left")
        at = F.when(F.col("arg_label") == "IDENTIFIER", slot("v", "file", "arg_name")).when(F.col("field").isNotNull(), slot("f", "file", "field")).when(F.col("callee").isNotNull(), slot("r", "callee"))
        written = F.when(~F.coalesce("arg_type_full_name", F.lit("")).isin("", "ANY"), F.col("arg_type_full_name"))
        return own.select("repo", "id", "arg_argument_index", at.alias("at"), written.alias("type"))

    place = program.nodes.select("repo", "id", "file")
    given = values(program.arguments(program.operators(graph.ASSIGNMENT)).join(place, ["repo", "id"]))
    left = given.where("arg_argument_index = 1 and at is not null").select("repo", "id", F.col("at").alias("slot"))
    right = given.where("arg_argument_index = 2").select("repo", "id", "at", "type")
    back = program.edges.where("label = 'CONTAINS'").select("repo", F.col("src").alias("m"), F.col("dst").alias("id")).join(program.of("METHOD").select("repo", F.col("id").alias("m"), "method_full_name"), ["repo", "m"])
    returns = values(program.arguments(program.of("RETURN")).join(place, ["repo", "id"])).join(back, ["repo", "id"]).select("repo", slot("r", "method_full_name").alias("slot"), "at", "type")
    pairs = keep(left.join(right, ["repo", "id"]).select("repo", "slot", "at", "type").unionByName(returns), "pairs")
    return pairs.where("type is not null").select("repo", "slot", "type").distinct(), pairs.where("at is not null and at <> slot").select("repo", "slot", F.col("at").alias("origin")).distinct()


def leaders(known: DataFrame, copies: DataFrame) -> DataFrame:
    """(repo, slot, leader): slots that have what one other slot has, and nothing else, with the first slot up that way which is none of these.

    Pointers double, so a way of 1,000 copies takes ten rounds. Slots whose way ends in a circle have no types and no leader: they are what is left when a
    round brings no pointer home.
    """
    one = copies.groupBy("repo", "slot").agg(F.count("*").alias("n"), F.min("origin").alias("leader")).where("n = 1").select("repo", "slot", "leader")
    one = keep(one.join(known, ["repo", "slot"], "left_anti"), "followers")
    rows, left = one.withColumn("_open", F.lit(True)), None
    while True:
        onward = rows.select("repo", F.col("slot").alias("leader"), F.col("leader").alias("_leader"), F.col("_open").alias("_more"))
        home = F.col("_leader").isNull()
        moved = rows.where("_open").join(onward, ["repo", "leader"], "left").select("repo", "slot", F.coalesce("_leader", "leader").alias("leader"), (~home & F.col("_more")).alias("_open"))
        rows = keep(moved.unionByName(rows.where("not _open")), "followers")
        now = rows.where("_open").count()
        if now == 0 or now == left:
            return rows.where("not _open").select("repo", "slot", "leader")
        left = now


def spread(known: DataFrame, copies: DataFrame) -> DataFrame:
    """(repo, slot, type): all that slots get over any number of copies.

    Slots that only repeat another one take the types of their leader at the end; between leaders each round joins only what the one before has added, until nothing is.
    """
    new = keep(known.select("repo", "slot", "type").distinct(), "types")
    copies = keep(copies.select("repo", "slot", "origin").distinct(), "copies")
    led = leaders(new, copies)
    among = copies.join(led.select("repo", "slot"), ["repo", "slot"], "left_anti").join(led.select("repo", F.col("slot").alias("origin"), "leader"), ["repo", "origin"], "left")
    among = keep(among.select("repo", "slot", F.coalesce("leader", "origin").alias("origin")).where("slot <> origin").distinct(), "copies")
    every = new
    while not among.isEmpty() and not new.isEmpty():
        came = among.join(new.withColumnRenamed("slot", "origin"), ["repo", "origin"]).select("repo", "slot", "type").distinct()
        new = keep(came.join(every, ["repo", "slot", "type"], "left_anti"), "types")
        every = every.unionByName(new)
    return every.unionByName(led.join(every.withColumnRenamed("slot", "leader"), ["repo", "leader"]).select("repo", "slot", "type"))


def recovered_types(program: Program) -> DataFrame:
    """Nodes with type hints spread over assignments, fields and returns to a fix point; variables and fields have those of their slot."""
    hints = spread(*type_slots(program)).groupBy("repo", "slot").agg(F.array_sort(F.collect_set("type")).alias("_found"))
    kind = F.when(F.col("label") == "IDENTIFIER", F.concat_ws("|", F.lit("v"), "file", "name")).when(F.col("label") == "FIELD_IDENTIFIER", F.concat_ws("|", F.lit("f"), "file", "code"))
    nodes = program.nodes.withColumn("slot", kind).join(hints, ["repo", "slot"], "left")
    own = F.coalesce("type_hints", F.array().cast("array<string>"))
    return nodes.withColumn("type_hints", F.when(F.col("_found").isNotNull(), F.array_sort(F.array_union(own, "_found"))).otherwise(F.col("type_hints"))).select(*program.nodes.columns)


def file_imports(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")) -> DataFrame:
    """(repo, file, imported): imports by relative path (./x, ../y/z) of files of the repository, with what a path may leave out."""
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    raw = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), "name"), "/")
    step = lambda acc, x: F.when(x.isin(".", ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    path = F.array_join(F.aggregate(raw, F.array().cast("array<string>"), step), "/")
    wanted = imports.where(F.col("name").startswith(".")).select("repo", "file", F.explode(F.array(*[F.concat(path, F.lit(e)) for e in extensions])).alias("imported"))
    return wanted.join(files.select("repo", F.col("file").alias("imported")).distinct(), ["repo", "imported"]).select("repo", "file", "imported").distinct()


def module_imports(imports: DataFrame, files: DataFrame, suffix: str = ".py") -> DataFrame:
    """(repo, file, imported): imports of dotted modules (a.b.c, or a member of one) that are files of the repository, or its ``__init__``."""
    dotted = F.replace("name", F.lit("."), F.lit("/"))
    parent = F.regexp_replace(dotted, "/[^/]*$", "")
    wanted = imports.select("repo", "file", F.explode(F.array(*[F.concat(d, F.lit(e)) for d in (dotted, parent) for e in (suffix, f"/__init__{suffix}")])).alias("imported"))
    return wanted.join(files.select("repo", F.col("file").alias("imported")).distinct(), ["repo", "imported"]).where("file <> imported").select("repo", "file", "imported").distinct()


def header_symbols(includes: DataFrame, program: Program) -> DataFrame:
    """(repo, file, id): methods and types declared in a header, for each file that includes it by name."""
    own = program.of("METHOD", "TYPE_DECL").select("repo", "id", F.regexp_extract("file", "[^/]+$", 0).alias("header"))
    wanted = includes.select("repo", "file", F.regexp_extract("name", r"""([^/"<>]+)[">]?$""", 1).alias("header")).distinct()
    return wanted.join(own, ["repo", "header"]).select("repo", "file", "id")


def required_types(requires: DataFrame, program: Program) -> DataFrame:
    """(repo, file, type_full_name): types and namespaces of the file that a Ruby ``require`` names by its end."""
    own = program.of("TYPE_DECL", "NAMESPACE").select("repo", "type_full_name", F.regexp_replace(F.regexp_extract("file", "[^/]+$", 0), r"\.rb$", "").alias("entity"))
    wanted = requires.select("repo", "file", F.regexp_extract("name", r"([^/]+)$", 1).alias("entity")).distinct()
    return wanted.join(own, ["repo", "entity"]).select("repo", "file", "type_full_name").distinct()


def global_symbols(program: Program) -> DataFrame:
    """(repo, name, type_full_name): the repository's own types and modules, which every Ruby file sees."""
    return program.of("TYPE_DECL", "NAMESPACE").where("not coalesce(is_external, false)").select("repo", "name", "type_full_name").distinct()


def gem_types(calls: DataFrame, packages: DataFrame) -> DataFrame:
    """Calls with the type of the gem (package, module) that their receiver's constant names."""
    on = calls.withColumn("module", F.regexp_extract("code", r"^([A-Z]\w*)", 1)).join(packages.groupBy("module").agg(F.min("package").alias("package")), "module", "left")
    return on.withColumn("type_full_name", F.when(F.col("package").isNotNull() & F.coalesce("type_full_name", F.lit("ANY")).isin("", "ANY"), F.concat_ws("::", "package", "module")).otherwise(F.col("type_full_name"))).select(*calls.columns)


def definitions(program: Program) -> DataFrame:
    """(repo, m, at, name, def): where a method's variables get values: ``def`` is the parameter or the left side, ``at`` the node of the control flow that gives it."""
    inside = program.edges.where("label = 'CONTAINS'").select("repo", F.col("src").alias("m"), F.col("dst").alias("at"))
    left = program.arguments(program.operators(graph.ASSIGNMENT)).where("arg_argument_index = 1 and arg_label = 'IDENTIFIER'")
    given = left.select("repo", F.col("id").alias("at"), F.col("arg_name").alias("name"), F.col("arg_id").alias("def")).join(inside, ["repo", "at"])
    taken = program.hop(program.of("METHOD").select("repo", F.col("id").alias("m")), "AST", "m", "def").join(program.of("PARAMETER").select("repo", F.col("id").alias("def"), "name"), ["repo", "def"])
    return given.select("repo", "m", "at", "name", "def").unionByName(taken.select("repo", "m", F.col("m").alias("at"), "name", "def"))


def few_definitions(defs: DataFrame, limit: int) -> DataFrame:
    """Definitions of methods that have ``limit`` at most; the limit is the feature's."""
    return defs.join(defs.groupBy("repo", "m").count().where(F.col("count") <= limit), ["repo", "m"], "left_semi")


def blocks(follow: DataFrame) -> DataFrame:
    """(repo, at, head, pos): nodes of the control flow (repo, at, to) by their unbranched run, and their place in it from 0.

    Pointers to the head double, so that a run of 1,000 nodes takes ten rounds; the nodes of a circle without a branch are runs of their own.
    """
    one = lambda side: follow.groupBy("repo", side).count().where("count = 1").select("repo", side)
    link = follow.join(one("at"), ["repo", "at"], "left_semi").join(one("to"), ["repo", "to"], "left_semi")
    up = keep(link.select("repo", F.col("to").alias("at"), F.col("at").alias("head"), F.lit(1).cast("long").alias("pos"), F.lit(False).alias("done")), "blocks")
    left = up.count()
    while left:
        onward = up.select("repo", F.col("at").alias("head"), F.col("head").alias("_head"), F.col("pos").alias("_pos"), F.col("done").alias("_done"))
        moved = up.where("not done").join(onward, ["repo", "head"], "left")
        moved = moved.select("repo", "at", F.coalesce("_head", "head").alias("head"), (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos"), F.coalesce("_done", F.lit(True)).alias("done"))
        up = keep(up.where("done").unionByName(moved), "blocks")
        before, left = left, up.where("not done").count()
        if left == before:
            break
    own = up.where("done").drop("done")
    heads = follow.select("repo", "at").union(follow.select("repo", "to")).distinct().join(own, ["repo", "at"], "left_anti")
    return own.unionByName(heads.select("repo", "at", F.col("at").alias("head"), F.lit(0).cast("long").alias("pos")))


def reaching(program: Program, limit: int = 4000, targets: DataFrame | None = None) -> DataFrame:
    """(repo, def, name, at): nodes of the control flow that each definition reaches; with ``targets`` (repo, at, or with name too) only those.

    A definition is generated at its node and goes along the CFG edges; an assignment of the same variable kills it, after it has been reached itself.
    Facts go from run to run in rounds, each of which joins what the one before has added, until nothing is; within a run places tell what is reached.
    """
    defs = few_definitions(definitions(program), limit)
    follow = keep(program.edges.where("label = 'CFG'").select("repo", F.col("src").alias("at"), F.col("dst").alias("to")).distinct(), "control")
    place = keep(blocks(follow), "places")
    own = keep(defs.select("repo", "def", "name", "at").distinct().join(place, ["repo", "at"]).drop("at"), "definitions")
    run = Window.partitionBy("repo", "head", "name").orderBy("pos")
    kills = keep(own.select("repo", "head", "name", "pos").distinct().withColumn("hi", F.lead("pos").over(run)).withColumn("first", F.row_number().over(run) == 1), "kills")
    local = keep(own.join(kills, ["repo", "head", "name", "pos"]).select("repo", "def", "name", "head", (F.col("pos") + 1).alias("lo"), "hi"), "local")
    at = place.select("repo", "at", "head")
    to = place.where("pos = 0").select("repo", F.col("at").alias("to"))
    onward = keep(follow.join(to, ["repo", "to"], "left_semi").join(at, ["repo", "at"]).select("repo", "head", "to").distinct(), "onward")
    front, every = local.where("hi is null").select("repo", "def", "name", "head").distinct(), None
    while True:
        came = front.join(onward, ["repo", "head"]).select("repo", "def", "name", F.col("to").alias("head")).distinct()
        new = keep(came if every is None else came.join(every, ["repo", "def", "name", "head"], "left_anti"), "reaching")
        if every is not None and new.isEmpty():
            break
        every = new if every is None else every.unionByName(new)
        front = new.join(kills, ["repo", "head", "name"], "left_anti")
    stop = kills.where("first").select("repo", "head", "name", F.col("pos").alias("hi"))
    spans = local.unionByName(every.join(stop, ["repo", "head", "name"], "left").select("repo", "def", "name", "head", F.lit(0).cast("long").alias("lo"), "hi"))
    wanted = place if targets is None else targets.join(place, ["repo", "at"])
    inside = (F.col("pos") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("pos") <= F.col("hi")))
    return spans.join(wanted, [c for c in ("repo", "head", "name") if c in wanted.columns]).where(inside).select("repo", "def", "name", "at").distinct()


def definition_uses(program: Program, limit: int = 4000) -> DataFrame:
    """FLOWS edges from each definition to the uses of its variable that it reaches; the left side of an assignment is no use."""
    left = program.arguments(program.operators(graph.ASSIGNMENT)).where("arg_argument_index = 1").select("repo", F.col("arg_id").alias("at"))
    uses = program.of("IDENTIFIER").select("repo", F.col("id").alias("at"), "name").join(left, ["repo", "at"], "left_anti")
    return reaching(program, limit, uses).select("repo", F.col("def").alias("src"), F.col("at").alias("dst"), F.lit("FLOWS").alias("label")).distinct()


def lambda_captures(program: Program, limit: int = 4000) -> DataFrame:
    """FLOWS edges between a method's variables and a lambda that captures them (CAPTURES edges).

    A variable of the method goes to its first use in the lambda where it stands on that line or before; the last use there goes to it where it stands on that
    line or after; a parameter of the method goes to every use in the lambda. Where the method has control flow, only values that reach the
    lambda's METHOD_REF go in: one that is assigned anew before is killed. Methods of more than ``limit`` variables, each of which
    counts as a definition, take no part.
    """
    held = program.edges.where("label = 'CAPTURES'").select("repo", F.col("src").alias("m"), F.col("dst").alias("inner"))
    inside = program.edges.where("label = 'CONTAINS'").select("repo", F.col("src").alias("m"), F.col("dst").alias("id"))
    uses = keep(inside.join(program.of("IDENTIFIER").select("repo", "id", "name", "line"), ["repo", "id"]), "uses")
    defs = definitions(program)
    large = uses.groupBy("repo", "m").count().where(F.col("count") > limit).select("repo", "m")
    held = keep(held.join(large, ["repo", "m"], "left_anti"), "captures")
    place = F.struct("line", "id")
    ends = uses.groupBy("repo", F.col("m").alias("inner"), "name").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    pairs = held.join(uses, ["repo", "m"]).join(ends, ["repo", "inner", "name"])
    forth = pairs.where(F.col("line") <= F.col("first.line")).select("repo", "m", "inner", "name", F.col("id").alias("src"), F.col("first.id").alias("dst"))
    back = pairs.where((F.col("line") >= F.col("last.line")) & (F.col("line") > F.col("first.line"))).select("repo", F.col("last.id").alias("src"), F.col("id").alias("dst"))
    refs = program.edges.where("label = 'REF'").select("repo", F.col("src").alias("at"), F.col("dst").alias("inner")).join(program.of("METHOD_REF").select("repo", F.col("id").alias("at")), ["repo", "at"])
    flows_in = program.edges.where("label = 'CFG'").select("repo", F.col("dst").alias("at")).distinct()
    seen = keep(refs.join(flows_in, ["repo", "at"], "left_semi"), "refs")
    live = reaching(program, limit, seen.select("repo", "at").distinct()).join(seen, ["repo", "at"]).select("repo", "inner", "name", F.col("def").alias("src")).distinct()
    known = seen.select("repo", "inner").distinct()
    given = defs.select("repo", F.col("def").alias("src")).distinct()
    killed = forth.join(known, ["repo", "inner"], "left_semi").join(given, ["repo", "src"], "left_semi").join(live, ["repo", "inner", "name", "src"], "left_anti")
    forth = forth.join(killed.select("repo", "inner", "src"), ["repo", "inner", "src"], "left_anti")
    params = held.join(program.hop(held.select("repo", "m").distinct(), "AST", "m", "src"), ["repo", "m"]).join(program.of("PARAMETER").select("repo", F.col("id").alias("src")), ["repo", "src"])
    into = params.join(uses.select("repo", F.col("m").alias("inner"), F.col("id").alias("dst")), ["repo", "inner"])
    every = forth.select("repo", "src", "dst").unionByName(back).unionByName(into.select("repo", "src", "dst"))
    return every.select("repo", "src", "dst", F.lit("FLOWS").alias("label")).distinct()


GRAM = 6


def synced_flows(columns: DataFrame, sinks: DataFrame) -> DataFrame:
    """Two-node flows from tagged columns (repo, id, rule_id, file) to data syncs (repo, id, rule_id, model): the column's file has the sync's model anywhere in its name.

    Files are met by their pieces of up to ``GRAM`` characters, of which the model's first ones are one: an equi-join, then the test. A sync without a model has no flow.
    """
    files = columns.select("repo", "file").distinct()
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda k: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(c, k, n)))))
    wanted = sinks.where("model <> ''").select("repo", "model", F.left("model", F.lit(GRAM)).alias("_piece"), F.col("id").alias("sync_id"), F.col("rule_id").alias("sink_id"))
    met = files.select("repo", "file", F.explode(pieces(F.col("file"))).alias("_piece")).join(wanted, ["repo", "_piece"]).where(F.contains("file", F.col("model"))).drop("_piece")
    exact = columns.select("repo", "file", F.col("id").alias("column_id"), F.col("rule_id").alias("source_id")).join(met, ["repo", "file"])
    path = F.array("column_id", "sync_id")
    return exact.select("repo", "source_id", "sink_id", F.lit("third_parties").alias("sink_sub_category"), F.lit("REGULAR").alias("sink_node_type"), F.concat_ws("-", "column_id", "sync_id").alias("path_id"), path.alias("path"), F.lit(False).alias("apply_dedup")).distinct()
