"""Taggers of data elements: direct matches, what derives from them, declarations, literals, columns, permissions and assets.

Each takes a program (and rules) and returns tag rows; nothing is changed in place. The families of derived tags carry
constant names (``derived_by_member_name`` and so on), so that two runs agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import graph, tagging
from sluice.operators._stage import keep
from sluice.operators.graph import Program
from sluice.operators.predicates import full_match, not_constant
from sluice.operators.tagging import Rule

BY_NAME, BY_TYPE, BY_INHERITANCE = "derived_by_member_name", "derived_by_member_type", "derived_by_inheritance"
# Internal tags.
OBJECT_TAGS = {BY_NAME: "OBJECT_OF_SENSITIVE_CLASS_BY_MEMBER_NAME", BY_TYPE: "OBJECT_OF_SENSITIVE_CLASS_BY_MEMBER_TYPE", BY_INHERITANCE: "OBJECT_OF_SENSITIVE_CLASS_BY_INHERITANCE"}
ORIGINAL, DERIVED = "ORIGINAL_SOURCE", "DERIVED_SOURCE"
TYPE_PARTS = 32  # over which the objects of one type are dealt


@dataclass(frozen=True)
class Profile:
    """What a language's tagger reads, and how it derives sources."""

    members: bool = True
    accesses: bool = True
    index_literals: bool = False
    constants: bool = True  # whether names in capitals count
    derive: tuple[str, ...] = ()


PROFILES = {
    "java": Profile(constants=False, derive=(BY_NAME, BY_TYPE, BY_INHERITANCE)),
    "kotlin": Profile(constants=False, derive=(BY_NAME, BY_TYPE, BY_INHERITANCE)),
    "python": Profile(index_literals=True, derive=(BY_NAME, BY_INHERITANCE)),
    "javascript": Profile(index_literals=True, derive=(BY_NAME, BY_INHERITANCE)),
    "go": Profile(constants=False, derive=(BY_NAME, BY_TYPE)),
    "php": Profile(derive=(BY_NAME, BY_TYPE)),
    "csharp": Profile(constants=False, derive=(BY_NAME, BY_TYPE)),
    "c": Profile(constants=False),
    "ruby": Profile(members=False),
}


def mark(nodes: DataFrame, name: str, value: Column | str = "", key: str = "id") -> DataFrame:
    """One tag row for each node."""
    return nodes.select("repo", F.col(key).alias("node_id"), F.lit(name).alias("name"), (value if isinstance(value, Column) else F.lit(value)).alias("value")).distinct()


def apply_rules(spark: SparkSession, matched: DataFrame, rules: Sequence[Rule], exclusions: list[str] | None = None) -> DataFrame:
    """Rule tags of matched nodes (id, rule_id)."""
    rows = matched.withColumnRenamed("id", "node_id")
    return tagging.rule_tags(rows, tagging.rule_table(spark, list(rules)), exclusions)


def by_name(nodes: DataFrame, rules: Sequence[Rule], column: str = "name") -> DataFrame:
    """Nodes with the rules that their name matches whole; names that repeat are matched once."""
    return tagging.tag_nodes(nodes, column, list(rules))


def named_nodes(program: Program, label: str, constants: bool) -> DataFrame:
    nodes = program.of(label)
    return nodes if constants else nodes.where(not_constant(F.col("name"), F.coalesce("code", F.lit(""))))


def enabled(program: Program, nodes: DataFrame) -> DataFrame:
    """Without the nodes that a declaration disables, unless some node of the repository carries an external rule."""
    external = program.tagged(nodes, "externalRule").select("repo").distinct()
    off = program.tagged(nodes, "TAGGING_DISABLED_BY_DED").select("repo", "id").join(external, "repo", "left_anti")
    return nodes.join(off, ["repo", "id"], "left_anti")


def matching_members(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """Members with owner and rule_id: those that match by name and those that a declaration gave the rule."""
    members = program.members()
    inner, outer = [r for r in rules if not r.is_external], [r for r in rules if r.is_external]
    own = by_name(enabled(program, members), inner).unionByName(by_name(members, outer)) if outer else by_name(enabled(program, members), inner)
    declared = program.tagged(members, "TAGGED_BY_DED")
    ids = program.tags.where("name = 'id'").select("repo", F.col("node_id").alias("id"), F.col("value").alias("rule_id"))
    known = declared.join(ids, ["repo", "id"]).where(F.col("rule_id").isin([r.id for r in rules]))
    return own.unionByName(known.select(*own.columns)).distinct()


def types_with_members(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """(repo, owner, rule_id, members): types and their matching members."""
    return matching_members(program, rules).groupBy("repo", "owner", "rule_id").agg(F.array_sort(F.collect_set("name")).alias("members"))


def direct(program: Program, rules: Sequence[Rule], profile: Profile) -> DataFrame:
    """(repo, id, file, rule_id, kind) of identifiers, members, field accesses and index literals that match by name."""
    pick = lambda df, kind: df.select("repo", "id", "file", "rule_id", F.lit(kind).alias("kind"))
    out = pick(by_name(named_nodes(program, "IDENTIFIER", profile.constants), rules), "VARIABLE_REGEX_IDENTIFIER")
    if profile.members:
        members = named_nodes(program, "MEMBER", profile.constants)
        out = out.unionByName(pick(by_name(enabled(program, members), rules), "VARIABLE_REGEX_MEMBER"))
    if profile.accesses:
        out = out.unionByName(pick(by_name(enabled(program, program.accessed_fields()), rules, "field"), "VARIABLE_REGEX_IDENTIFIER"))
    if profile.index_literals:
        keys = program.arguments(program.operators(graph.INDEX_ACCESS)).where("arg_label = 'LITERAL'").select("repo", F.col("arg_id").alias("id")).distinct()
        literals = program.of("LITERAL").join(keys, ["repo", "id"], "left_semi").withColumn("bare", F.regexp_replace("code", "^[\"'`]|[\"'`]$", ""))
        out = out.unionByName(pick(by_name(literals, rules, "bare"), "INDEX_ACCESS_CALL"))
    return out


def objects(program: Program, constants: bool = False) -> DataFrame:
    """Identifiers and parameters, as objects of a type."""
    return named_nodes(program, "IDENTIFIER", constants).unionByName(named_nodes(program, "PARAMETER", constants))


def sensitive_types(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """(repo, type, rule_id, member, family): the types whose objects are derived sources, and by what."""
    members = matching_members(program, rules)
    first = members.select("repo", F.col("owner").alias("type"), "rule_id", F.col("name").alias("member"), F.lit(BY_NAME).alias("family"))
    named = by_name(program.members(), rules).select("repo", F.col("owner").alias("held"), "rule_id").distinct()
    holders = program.members().select("repo", "owner", "name", F.col("type_full_name").alias("held"))
    second = holders.join(named, ["repo", "held"]).select("repo", F.col("owner").alias("type"), "rule_id", F.col("name").alias("member"), F.lit(BY_TYPE).alias("family"))
    parents = program.of("TYPE_DECL").select("repo", F.col("type_full_name").alias("child"), F.explode("inherits").alias("type")).distinct()
    third = parents.join(named.withColumnRenamed("held", "type"), ["repo", "type"], "left_semi").join(first.drop("family"), ["repo", "type"])
    third = third.select("repo", F.col("child").alias("type"), "rule_id", "member", F.lit(BY_INHERITANCE).alias("family"))
    return first.unionByName(second).unionByName(third).distinct()


def derived(program: Program, rules: Sequence[Rule], profile: Profile) -> DataFrame:
    """(repo, id, file, rule_id, member, family) of objects of sensitive types."""
    types = sensitive_types(program, rules).where(F.col("family").isin(list(profile.derive)))
    return _of_types(objects(program, profile.constants), types)


def derived_kinds(program: Program, rules: Sequence[Rule], profile: Profile) -> DataFrame:
    """(repo, id, file, type, rule_id, family) of objects of sensitive types, once whatever the number of members that make the type sensitive."""
    types = sensitive_types(program, rules).where(F.col("family").isin(list(profile.derive)))
    return _on_types(objects(program, profile.constants), types.select("repo", "type", "rule_id", "family").distinct())


def _on_types(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """(repo, type, id, file, ...) of nodes with each row of ``types`` of their type.

    Few types may have nearly all objects, and each object many rows. So a type's objects are dealt over parts, to each of which its rows go; merged,
    as a side that is small in bytes would else be sent to the few tasks of the other.
    """
    own = nodes.select("repo", "id", "file", F.col("type_full_name").alias("type"), F.pmod(F.xxhash64("id"), F.lit(TYPE_PARTS)).alias("_part"))
    every = types.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TYPE_PARTS - 1).cast("long"))))
    return own.join(every.hint("merge"), ["repo", "type", "_part"]).drop("_part")


def _of_types(nodes: DataFrame, types: DataFrame) -> DataFrame:
    return _on_types(nodes, types).select("repo", "id", "file", "type", "rule_id", "member", "family")


def external_class_objects(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """Objects of a class outside the program, known by one tagged field access of it for each rule: the first by id."""
    access = program.field_accesses().where("on_label = 'IDENTIFIER'").select("repo", "id", "field", "on_type")
    ids = program.tags.where("name = 'id'").select("repo", F.col("node_id").alias("id"), F.col("value").alias("rule_id"))
    tagged = program.tagged(access, "catLevelOne", "sources").join(ids, ["repo", "id"]).where(F.col("rule_id").isin([r.id for r in rules]))
    first = tagged.groupBy("repo", "rule_id").agg(F.min_by(F.struct("on_type", "field"), "id").alias("a"))
    outside = program.of("TYPE_DECL").where("is_external").select("repo", F.col("type_full_name").alias("type"))
    types = first.select("repo", "rule_id", F.col("a.on_type").alias("type"), F.col("a.field").alias("member"), F.lit(BY_NAME).alias("family")).join(outside, ["repo", "type"], "left_semi")
    return _of_types(objects(program), types)


def derived_tags(found: DataFrame) -> DataFrame:
    """Tag rows of derived objects: the kind of object, category, family with rule, and rule with family and member."""
    t = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in OBJECT_TAGS.items() for x in kv]), F.col("family"))
    rows = F.array(
        t(kind, F.when(F.col("family") == BY_NAME, F.col("rule_id")).otherwise("")),
        t(F.lit("id"), F.concat(F.lit("derived_"), F.col("family"))),
        t(F.lit("catLevelOne"), F.lit("DerivedSources")),
        t(F.col("family"), F.col("rule_id")),
        t(F.concat_ws("_", "rule_id", "family"), F.col("member")),
    )
    return found.select("repo", F.col("id").alias("node_id"), F.explode(rows).alias("t")).select("repo", "node_id", "t.name", "t.value").distinct()


def original_edges(program: Program, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Edges both ways between derived objects and the members they derive from, and the tag of these members."""
    members = matching_members(program, rules).select("repo", F.col("id").alias("member_id"), F.col("owner").alias("type"))
    own = objects(program).select("repo", F.col("id").alias("object_id"), F.col("type_full_name").alias("type")).join(members, ["repo", "type"])
    forth = own.select("repo", F.col("object_id").alias("src"), F.col("member_id").alias("dst"), F.lit(ORIGINAL).alias("label"))
    back = own.select("repo", F.col("member_id").alias("src"), F.col("object_id").alias("dst"), F.lit(DERIVED).alias("label"))
    return forth.unionByName(back).distinct(), mark(own, "ORIGINAL_SOURCE_FOR_DERIVED_NODE", key="member_id")


def accesses_of(program: Program, types: DataFrame) -> DataFrame:
    """Field accesses (repo, id, file, rule_id) of a member of a type in ``types`` (type, member, rule_id), whatever the case."""
    access = program.field_accesses().select("repo", "id", "file", F.col("on_type").alias("type"), F.lower("field").alias("_field"))
    return access.join(types.withColumn("_field", F.lower("member")), ["repo", "type", "_field"]).select("repo", "id", "file", "rule_id").distinct()


def _calls_on(program: Program) -> DataFrame:
    """Calls with the type of the identifier that they are called on."""
    args = program.arguments(program.calls()).where("arg_argument_index = 0 and arg_label = 'IDENTIFIER'").select("repo", "id", F.col("arg_type_full_name").alias("type"))
    return program.calls().select("repo", "id", "name", "file", F.col("type_full_name").alias("returns")).join(args, ["repo", "id"])


def getter_calls(program: Program, types: DataFrame) -> DataFrame:
    """Calls of get<member> and is<member> on an object of the type, and of its methods that return the member."""
    on = _calls_on(program).withColumn("_bare", F.lower(F.regexp_extract("name", "(?i)^(?:get|is)(.+)$", 1)))
    t = types.withColumn("_bare", F.lower("member"))
    named = on.join(t, ["repo", "type", "_bare"]).select("repo", "id", "file", "rule_id")
    types_ids = program.of("TYPE_DECL").select("repo", F.col("id").alias("type_id"), F.col("type_full_name").alias("type"))
    method = program.hop(types_ids, "AST", key="type_id", to="method_id")
    value = F.lower(F.regexp_extract("code", r"(?i)^return (?:this\.)?(\w+);?$", 1)).alias("_bare")
    returns = program.of("RETURN").select("repo", F.col("id").alias("return_id"), value)
    gives = program.hop(method.select("repo", "type", "method_id"), "CONTAINS", key="method_id", to="return_id").join(returns, ["repo", "return_id"])
    callers = program.hop(gives.join(t, ["repo", "type", "_bare"]).select("repo", "method_id", "rule_id").distinct(), "CALL", key="method_id", to="id", back=True)
    files = program.calls().select("repo", "id", "file")
    return named.unionByName(callers.join(files, ["repo", "id"]).select("repo", "id", "file", "rule_id")).distinct()


def setter_calls(program: Program, types: DataFrame, returns: str = "void") -> DataFrame:
    """Calls of set<member> that return nothing, on an object of the type."""
    on = _calls_on(program).where(F.col("returns") == returns).withColumn("_bare", F.lower(F.regexp_extract("name", "(?i)^set(.+)$", 1)))
    return on.join(types.withColumn("_bare", F.lower("member")), ["repo", "type", "_bare"]).select("repo", "id", "file", "rule_id").distinct()


def personal_members(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """(repo, type, member, personal): own and inherited members of types that have a personal one; the others are not."""
    own = program.members().select("repo", F.col("owner").alias("type"), F.col("name").alias("member"))
    up = program.of("TYPE_DECL").select("repo", F.col("type_full_name").alias("child"), F.explode("inherits").alias("type"))
    every = own.unionByName(up.join(own, ["repo", "type"]).select("repo", F.col("child").alias("type"), "member")).distinct()
    known = sensitive_types(program, rules).select("repo", "type", "member").distinct()
    return every.join(known.select("repo", "type").distinct(), ["repo", "type"], "left_semi").join(known.withColumn("personal", F.lit(True)), ["repo", "type", "member"], "left").withColumn("personal", F.coalesce("personal", F.lit(False)))


def insensitive_tags(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """Tags of getters, setters and accesses of members that are not personal, and of setters of those that are."""
    members = personal_members(program, rules).withColumn("rule_id", F.lit(""))
    plain, personal = members.where("not personal"), members.where("personal")
    access = program.untagged(accesses_of(program, plain), "id")
    return (
        mark(getter_calls(program, plain), "INSENSITIVE_METHOD_RETURN", "Data.Sensitive.NonPersonal.Method")
        .unionByName(mark(setter_calls(program, plain), "INSENSITIVE_SETTER"))
        .unionByName(mark(access, "INSENSITIVE_FIELD_ACCESS", "Data.Sensitive.NonPersonal.MemberAccess"))
        .unionByName(mark(setter_calls(program, personal), "SENSITIVE_SETTER"))
    )


def tag_sources(spark: SparkSession, program: Program, rules: Sequence[Rule], language: str, exclusions: list[str] | None = None) -> Program:
    """The program with all tags and edges of a language's source tagger."""
    p = PROFILES[language]
    found = keep(direct(program, rules, p), "direct")
    program = program.with_tags(apply_rules(spark, found, rules, exclusions), found.select("repo", F.col("id").alias("node_id"), F.col("kind").alias("name"), F.lit("").alias("value"))).kept()
    if not p.derive:
        return program
    types = keep(sensitive_types(program, rules), "types").where(F.col("family").isin(list(p.derive)))
    access, getters = keep(accesses_of(program, types), "accesses"), getter_calls(program, types)
    tags = [derived_tags(_of_types(objects(program, p.constants), types)), derived_tags(external_class_objects(program, rules))]
    tags += [apply_rules(spark, access, rules, exclusions), mark(access, "SENSITIVE_FIELD_ACCESS"), mark(access, "catLevelOne", "DerivedSources"), mark(getters, "SENSITIVE_METHOD_RETURN", F.col("rule_id"))]
    edges, originals = original_edges(program, rules)
    return program.with_tags(*tags, originals).with_edges(edges).kept()


# Literals


def _literals_in(program: Program, call: Column, spaces: bool = False) -> DataFrame:
    """Literals that are arguments of a call of which ``call`` holds."""
    inside = program.arguments(program.of("CALL").where(call)).where("arg_label = 'LITERAL'").select("repo", F.col("arg_id").alias("id")).distinct()
    out = program.of("LITERAL").join(inside, ["repo", "id"], "left_semi")
    return out if spaces else out.where(~F.col("code").rlike(r"\s"))


QUOTED = "(?:\"|'|`)(%s)(?:\"|'|`)"
QUERY = "(?:\"|'|`|\"\"\")(.*\\s%s\\s.*)(?:\"|'|`|\"\"\")"
LITERAL_CALLS = {  # language: names of calls whose literals without blanks count, and whether queries in assignments do
    "common": ("(?:add|get|put|pop).*|sql|query|select|find|execute|hasattr", True),
    "javascript": ("(?:add|get|push|pop).*", False),
    "python": ("(?:add|get|put|pop).*|sql|query|select|find|execute|hasattr", True),
}


def literals(program: Program, rules: Sequence[Rule], language: str = "common") -> DataFrame:
    """(repo, id, file, rule_id) of quoted names in look-ups, and of queries that name them."""
    calls, queries = LITERAL_CALLS[language]
    tests = lambda form: [(r.id, full_match(F.col("code"), form % r.pattern)) for r in rules]
    out = tagging.match_rows(_literals_in(program, full_match(F.col("name"), calls)), tests(QUOTED))
    if queries:
        verbs = F.col("code").rlike("(?i)(CREATE|DELETE|ALTER|INSERT|SELECT|UPDATE)")
        out = out.unionByName(tagging.match_rows(_literals_in(program, F.col("name") == graph.ASSIGNMENT, True).where(verbs), tests(QUERY)))
    return out.select("repo", "id", "file", "rule_id").distinct()


def symbols(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """Ruby symbols (:name) that match a rule."""
    return tagging.match_rows(program.of("LITERAL"), [(r.id, full_match(F.col("code"), f":({r.pattern})")) for r in rules]).select("repo", "id", "file", "rule_id")


def symbols_by_sibling(program: Program) -> DataFrame:
    """Symbols that stand beside a type with tagged ``argument`` symbols: (repo, id, type, rule_id)."""
    ids = program.tags.where("name = 'id'").select("repo", F.col("node_id").alias("id"), F.col("value").alias("rule_id"))
    calls = program.calls().where("name = 'argument'").select("repo", "id", F.col("type_full_name").alias("type"))
    inner = program.arguments(calls).where("arg_label = 'LITERAL'").select("repo", F.col("id").alias("call"), F.col("arg_id").alias("id")).join(ids, ["repo", "id"])
    held = inner.join(calls.withColumnRenamed("id", "call"), ["repo", "call"]).select("repo", F.element_at(F.split("type", r"\."), -1).alias("type_name"), "rule_id").distinct()
    args = program.arguments(program.calls())
    named = args.where("arg_label in ('IDENTIFIER', 'TYPE_REF')").select("repo", "id", F.col("arg_name").alias("type_name"))
    beside = args.where("arg_label = 'LITERAL' and arg_code like ':%'").select("repo", "id", "arg_id")
    return beside.join(named, ["repo", "id"]).join(held, ["repo", "type_name"]).select("repo", F.col("arg_id").alias("id"), F.col("type_name").alias("type"), "rule_id").distinct()


# Columns, declarations, permissions, schemas, assets


def columns_by_token(columns: DataFrame, rules: Sequence[Rule], name: str = "column_name") -> DataFrame:
    """Columns with each rule that some part of their name, cut at blanks and dots, matches whole."""
    return tagging.match_rows(columns, [(r.id, tagging.token_matches(F.col(name), r.pattern)) for r in rules])


def declared_tags(spark: SparkSession, program: Program, declared: DataFrame, rules: Sequence[Rule], disabled: str) -> DataFrame:
    """Tags of what a declaration names by file, name and line: those of its rule, or that tagging is off."""
    from sluice.operators.predicates import exact_declaration

    plain = program.of("IDENTIFIER", "MEMBER", "LOCAL", "PARAMETER").select("repo", "id", "file", "name", "line")
    access = program.field_accesses().select("repo", "id", "file", F.col("field").alias("name"), "line")
    found = exact_declaration(plain.unionByName(access), declared)
    known = found.where(F.col("rule_id").isin([r.id for r in rules]))
    return (
        apply_rules(spark, known, rules)
        .unionByName(mark(known, "TAGGED_BY_DED"))
        .unionByName(mark(known, "VARIABLE_REGEX_IDENTIFIER"))
        .unionByName(mark(found.where(F.col("rule_id") == disabled), "TAGGING_DISABLED_BY_DED"))
    )


# Permissions that stand for a data element.
_ANDROID = "(android[.]permission[.]){0,1}"
PERMISSIONS = [
    ("Data.Sensitive.AudioVisualAndSensoryData.Video", _ANDROID + "(CAMERA|CAMERA_DISABLE_TRANSMIT_LED)"),
    ("Data.Sensitive.LocationData.ApproximateLocation", _ANDROID + "(ACCESS_COARSE_LOCATION)"),
    ("Data.Sensitive.LocationData.PreciseLocation", _ANDROID + "(ACCESS_BACKGROUND_LOCATION|ACCESS_FINE_LOCATION|ACCESS_MEDIA_LOCATION|ACCESS_LOCATION_EXTRA_COMMANDS|LOCATION_HARDWARE)"),
    ("Data.Sensitive.UserContentData.Calendar", _ANDROID + "(READ_CALENDAR|WRITE_CALENDAR)"),
    ("Data.Sensitive.ContactData.PhoneNumber", _ANDROID + "(READ_CONTACTS|WRITE_CONTACTS|READ_PHONE_NUMBERS)"),
    (
        "Data.Sensitive.UserContentData.EmailsorTextMessages",
        _ANDROID + "(READ_CALL_LOG|WRITE_CALL_LOG|USE_SIP|CALL_PHONE|ACCEPT_HANDOVER|ANSWER_PHONE_CALLS|PROCESS_OUTGOING_CALLS|READ_SMS|RECEIVE_SMS|SEND_SMS|RECEIVE_MMS|RECEIVE_WAP_PUSH)|(com[.]android[.]voicemail[.]permission[.]ADD_VOICEMAIL)",
    ),
    ("Data.Sensitive.AudioVisualAndSensoryData.AudioRecordings", _ANDROID + "(RECORD_AUDIO|MODIFY_AUDIO_SETTINGS)"),
    ("Data.Sensitive.UserContentData.DeviceStorage", _ANDROID + "(READ_EXTERNAL_STORAGE|WRITE_EXTERNAL_STORAGE)"),
    ("Data.Sensitive.AudioVisualAndSensoryData.IoTorSensorData", _ANDROID + "(ACTIVITY_RECOGNITION|BODY_SENSORS)"),
    ("Data.Sensitive.AudioVisualAndSensoryData.IoTorSensorData", _ANDROID + "BLUETOOTH(_ADMIN|_ADVERTISE|_CONNECT|_SCAN){0,1}"),
    ("Data.Sensitive.AccountData.AccountID", _ANDROID + "(GET_ACCOUNTS|READ_PHONE_STATE)"),
    ("Data.Sensitive.AudioVisualAndSensoryData.IoTorSensorData", _ANDROID + "(NFC|NFC_PREFERRED_PAYMENT_INFO|NFC_TRANSACTION_EVENT)"),
]
PERMISSION_RULES = [
    Rule("Data.Sensitive.LocationData.ApproximateLocation", ("",), name="Approximate Location", category="Location Data", sensitivity="high"),
    Rule("Data.Sensitive.UserContentData.Calendar", ("",), name="Calendar", category="User Content Data", sensitivity="medium"),
    Rule("Data.Sensitive.UserContentData.DeviceStorage", ("",), name="Device Storage", category="User Content Data", sensitivity="low"),
]


def permissions(nodes: DataFrame, table: Sequence[tuple[str, str]] = tuple(PERMISSIONS)) -> DataFrame:
    """Permission nodes (permission_type) with the rule that the permission stands for."""
    return tagging.match_rows(nodes, [(i, full_match(F.col("permission_type"), p)) for i, p in table])


def schema_identifiers(program: Program, columns: DataFrame) -> DataFrame:
    """(repo, id, rule_id): objects of the model class of a table with a tagged column; a table's class is its singular in camel case."""
    one = F.regexp_replace("table_name", "ies$", "y")
    model = F.replace(F.initcap(F.replace(F.when(one != F.col("table_name"), one).otherwise(F.regexp_replace("table_name", "s$", "")), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    tables = columns.select("repo", model.alias("model"), "rule_id").distinct()
    own = objects(program, True).withColumn("model", F.element_at(F.split("type_full_name", r"\.|::"), -1))
    return own.join(tables, ["repo", "model"]).select("repo", "id", "file", "rule_id").distinct()


def document_fields(program: Program) -> DataFrame:
    """(repo, type_full_name, field, data_type, client) of document classes: ``field :name, type: T`` calls, and ``store_in client:``."""
    calls = program.calls().where(F.col("name").isin("field", "store_in")).select("repo", "name", "code", "type_full_name")
    field = F.regexp_extract("code", r"field\s*\(?\s*:(\w+)", 1)
    kind = F.regexp_extract("code", r"type:\s*:?(\w+)", 1)
    client = calls.where("name = 'store_in'").groupBy("repo", "type_full_name").agg(F.max(F.regexp_extract("code", r"client:\s*[\"':]?(\w+)", 1)).alias("client"))
    rows = calls.where("name = 'field'").select("repo", "type_full_name", field.alias("field"), kind.alias("data_type")).where("field <> ''")
    return rows.join(client, ["repo", "type_full_name"], "left").select("repo", "type_full_name", "field", "data_type", F.coalesce("client", F.lit("default")).alias("client"))


def document_databases(fields: DataFrame, properties: DataFrame) -> DataFrame:
    """Database details of document classes: the client's settings of a configuration file, and the fields as columns of the class's table."""
    from sluice.functions.scalars import class_table

    client = F.regexp_extract("name", r"clients\.(\w+)\.", 1)
    settings = properties.withColumn("client", client).where("client <> ''")
    pick = lambda end: F.max(F.when(F.col("name").endswith(end), F.col("value")))
    clients = settings.groupBy("repo", "client").agg(F.coalesce(pick(".database"), F.lit("")).alias("db_name"), F.coalesce(pick(".hosts[0]"), pick(".uri"), F.lit("")).alias("db_location"), F.max("file").alias("config_file"))
    tables = fields.groupBy("repo", "client", "type_full_name").agg(F.array_sort(F.collect_set(F.struct("field", "data_type"))).alias("columns"))
    table = class_table(F.element_at(F.split("type_full_name", r"\.|::"), -1))
    return tables.join(clients, ["repo", "client"], "left").select("repo", "client", table.alias("table_name"), "columns", "db_name", F.lit("MongoDB").alias("db_vendor"), "db_location", "config_file")


# Names of assets.
ASSET_NAME = "(?i).*(mongo|sql|s3|aws(_)?bucket|oracle|dynamo|maria|hive|redis|dbName|database|sqs|queue|engine).*"
ASSET_VALUE = "(?i).*(mongo|sql|s3|oracle|dynamo|maria|hive|redis|sqs|queue).*"
STATIC_FILE = ".*[.](png|jpg|jpeg|jar|zip|xml|json|yml)$"


def assets(program: Program) -> DataFrame:
    """Tags of literals, identifiers, members and fields that look like an asset."""
    code = F.col("code")
    literal = program.of("LITERAL").where(full_match(code, ASSET_VALUE) & ~full_match(code, STATIC_FILE))
    named = program.of("IDENTIFIER", "MEMBER").where(full_match(F.col("name"), ASSET_NAME))
    field = program.field_accesses().where(full_match(F.col("field"), ASSET_NAME))
    return mark(literal.select("repo", "id").unionByName(named.select("repo", "id")).unionByName(field.select("repo", "id")), "PROBABLE_ASSET")
