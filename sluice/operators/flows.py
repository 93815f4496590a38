"""Paths from sources to sinks over an edge table, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import calls
from sluice.operators._stage import keep
from sluice.operators.calls import EngineContext


def path_id(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), "-")


def hop(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    return nodes.join(edges, nodes[key] == edges["src"]).drop("src")


def reach(edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int = 4) -> DataFrame:
    """(source, sink, path) of all simple paths of 1 to ``depth`` edges. Depth bounds the plan, so nothing is collected."""
    step = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct()
    front = sources.select(F.col("id").alias("source"), F.array("id").alias("path"))
    found = None
    for _ in range(depth):
        front = front.join(step, F.element_at("path", -1) == F.col("_at")).where(~F.array_contains("path", F.col("_to"))).select("source", F.concat("path", F.array("_to")).alias("path"))
        found = front if found is None else found.unionByName(front)
    ends = found.withColumn("sink", F.element_at("path", -1))
    return ends.join(sinks.select(F.col("id").alias("sink")), "sink", "left_semi").select("source", "sink", "path")


def suffix_dedup(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Without paths that are a proper suffix, of two nodes or more, of another path of the same keys."""
    proper = F.when(F.size("path") > 2, F.transform(F.sequence(F.lit(2), F.size("path") - 1), lambda n: F.slice("path", -n, n))).otherwise(F.array().cast("array<array<bigint>>"))
    suffixes = flows.select(*keys, F.explode(proper).alias("path")).distinct()
    return flows.join(suffixes, [*keys, "path"], "left_anti")


def shortest(flows: DataFrame, keys: list[str]) -> DataFrame:
    """The shortest path of each location; ties by path id. An aggregate that is combined before its exchange, not a window."""
    row = F.struct(*[c for c in flows.columns if c not in keys])
    best = flows.groupBy(*keys).agg(F.min_by(row, F.struct(F.size("path"), path_id(F.col("path")))).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in flows.columns])


def top_paths(flows: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.size("path"), path_id(F.col("path")))
    return flows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def element_limit(flows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Paths of up to ``limit`` elements; the shortest where a pair has none."""
    return limited(flows, keys, limit)[0]


def limited(flows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by ``element_limit``. Pairs are summed up before the exchange; no pair is a task's group."""
    short = F.size("path") <= limit
    pairs = flows.groupBy(*keys).agg(F.bool_or(short).alias("_some"), F.min(F.struct(F.size("path").alias("n"), path_id(F.col("path")).alias("id"))).alias("_least"))
    judged = flows.join(pairs, keys)
    good = short | (~F.col("_some") & (path_id(F.col("path")) == F.col("_least.id")))
    return judged.where(good).select(*flows.columns), judged.where(~good).select(*flows.columns)


def by_pair(flows: DataFrame, kind: str) -> DataFrame:
    """kind, source, paths of each sink: the nested section of an exported document, one array for each level."""
    paths = flows.groupBy(kind, "source", "sink").agg(F.array_sort(F.collect_set(path_id(F.col("path")))).alias("paths"))
    return paths.groupBy(kind, "source").agg(F.array_sort(F.collect_list(F.struct("sink", "paths"))).alias("sinks"))


def this_filter(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without flows in which two receivers of one type have other codes, or whose last hop but one is ``this``."""
    elements = flows.select("path_id", F.posexplode("path").alias("pos", "id")).join(nodes.where("this_type is not null").select("id", "code", "this_type"), "id")
    torn = elements.groupBy("path_id", "this_type").agg(F.count_distinct("code").alias("n")).where("n > 1").select("path_id")
    last = flows.select("path_id", F.try_element_at("path", F.lit(-2)).alias("id")).join(nodes.where("code = 'this'").select("id"), "id", "left_semi").select("path_id")
    return flows.join(torn.union(last).distinct(), "path_id", "left_anti")


def stage_matrix(base: DataFrame, stages: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """YES or -- for each flow and stage."""
    out = base.select(*keys).distinct()
    for name, stage in stages.items():
        out = out.join(stage.select(*keys).distinct().withColumn(name, F.lit("YES")), keys, "left")
    return out.select(*keys, *[F.coalesce(n, F.lit("--")).alias(n) for n in stages])


def co_occurrence(elements: DataFrame, flow: str, file: str) -> DataFrame:
    """Each file with the other files of its flows."""
    a = elements.select(flow, file).distinct()
    b = a.select(flow, F.col(file).alias("other"))
    return a.join(b, flow).where(F.col(file) != F.col("other")).groupBy(file).agg(F.array_sort(F.collect_set("other")).alias("others"))


def unique_paths(paths: DataFrame) -> DataFrame:
    """Paths that are no proper suffix of another one, whatever their sources."""
    return suffix_dedup(paths, [])


# From paths to flows of the store


def source_nodes(program, all_derived: bool = True) -> DataFrame:
    """Nodes that are data elements: of the data labels, tagged as source or derived, and not disabled by a declaration.

    Without ``all_derived`` of the derived ones only objects known by a member's name: those that flows start at.
    """
    own = program.of("LITERAL", "IDENTIFIER", "CALL", "FIELD_IDENTIFIER", "MEMBER")
    kinds = program.tags.where("name = 'catLevelOne'").where(F.col("value").isin("sources", "DerivedSources")).select("repo", F.col("node_id").alias("id"), F.col("value").alias("kind"))
    if not all_derived:
        first = program.tags.where("name = 'OBJECT_OF_SENSITIVE_CLASS_BY_MEMBER_NAME'").select("repo", F.col("node_id").alias("id")).distinct()
        kinds = kinds.where("kind = 'sources'").select("repo", "id").unionByName(first)
    found = own.join(kinds.select("repo", "id").distinct(), ["repo", "id"], "left_semi")
    return program.untagged(found, "TAGGING_DISABLED_BY_DED")


def sink_nodes(program, limit: int | None = None) -> DataFrame:
    """Calls and data syncs tagged as sinks; with a limit the first of each repository by id, as the limit is the feature."""
    found = program.tagged(program.of("CALL", "HIGHTOUCH_SINK"), "catLevelOne", "sinks")
    if limit is None:
        return found
    first = found.select("repo", "id").withColumn("_rank", F.row_number().over(Window.partitionBy("repo").orderBy("id"))).where(F.col("_rank") <= limit)  # groups are cut before the exchange
    return found.join(first.select("repo", "id"), ["repo", "id"], "left_semi")


def expand(flows: DataFrame, tags: DataFrame, sink_kinds: DataFrame, all_derived: bool = False) -> DataFrame:
    """(repo, source_id, sink_id, sink_sub_category, sink_node_type, path_id, path): a row for each source tag of a path's first node and each sink tag of its last.

    ``sink_kinds`` has the distinct (cat_two, node_type) of the sink rules; the sink tag of a kind is named by both together.
    Tags that are there twice end with the last ``distinct``, over flows, not over all tags.
    """
    ends = flows.select("repo", "path_id", "path", F.element_at("path", 1).alias("_first"), F.element_at("path", -1).alias("_last"))
    derived = F.col("name").startswith("derived_by_") if all_derived else F.col("name") == "OBJECT_OF_SENSITIVE_CLASS_BY_MEMBER_NAME"
    source = tags.where(((F.col("name") == "id") & ~F.col("value").startswith("derived_")) | derived).select("repo", "node_id", F.col("value").alias("source_id"))
    kinds = F.broadcast(sink_kinds.select("cat_two", "node_type").distinct().withColumn("name", F.concat("cat_two", "node_type")))  # kinds of rules, a handful
    sink = tags.join(kinds, "name").select("repo", "node_id", F.col("value").alias("sink_id"), F.col("cat_two").alias("sink_sub_category"), F.col("node_type").alias("sink_node_type"))
    of_type = tags.where("name = 'catLevelTwo'").select("repo", "node_id", F.col("value").alias("sink_sub_category"))
    ending = sink.join(of_type, ["repo", "node_id", "sink_sub_category"], "left_semi").withColumnRenamed("node_id", "_last")
    both = ends.join(source.withColumnRenamed("node_id", "_first"), ["repo", "_first"]).join(ending, ["repo", "_last"])
    return both.select("repo", "source_id", "sink_id", "sink_sub_category", "sink_node_type", "path_id", "path").distinct()


COOKIE_WRITE, COOKIE_SOURCE = "Storages.Web.Cookie.Write", "Data.Sensitive.OnlineIdentifiers.Cookies"
# Sources that are no findings where the sink is a third party or an API.
FALSE_POSITIVES = ("Data.Sensitive.OnlineIdentifiers.Cookies", "Data.Sensitive.OnlineIdentifiers.IPAddress", "Data.Sensitive.PersonalCharacteristics.Signature", "Data.Sensitive.BiometricData.FingerprintScans")


def without_cookies(flows: DataFrame) -> DataFrame:
    """Without flows of the cookie source to cookie writes."""
    return flows.where(~(F.col("sink_id").startswith(COOKIE_WRITE) & (F.col("source_id") == COOKIE_SOURCE)))


def without_false_positives(flows: DataFrame) -> DataFrame:
    return flows.where(~(((F.col("sink_sub_category") == "third_parties") | (F.col("sink_node_type") == "api")) & F.col("source_id").isin(*FALSE_POSITIVES)))


def of_type(flows: DataFrame, tags: DataFrame, sub_category: str) -> DataFrame:
    """Paths whose last node has the sub-category."""
    own = tags.where((F.col("name") == "catLevelTwo") & (F.col("value") == sub_category)).select("repo", F.col("node_id").alias("_last")).distinct()
    last = flows.withColumn("_last", F.element_at("path", -1))
    return last.join(own, ["repo", "_last"], "left_semi").drop("_last")


def overlapping(program, flows: DataFrame) -> DataFrame:
    """Flows whose own source is what the sink takes: the tagged element nearest to the sink carries it, or the sink's arguments do, to three levels.

    ``Data.Sensitive.*`` values count. Identifiers count among the sink's own arguments, calls at every level.
    """
    from sluice.operators.graph import arguments_within

    sensitive = program.tags.where(F.col("value").startswith("Data.Sensitive.")).select("repo", "node_id", "value").distinct()
    elements = flows.select("repo", "path_id", F.posexplode("path").alias("pos", "node_id")).distinct().join(sensitive, ["repo", "node_id"])
    nearest = elements.groupBy("repo", "path_id", "pos").agg(F.collect_set("value").alias("v")).groupBy("repo", "path_id").agg(F.max_by("v", "pos").alias("near"))
    ends = flows.select("repo", F.element_at("path", -1).alias("id")).distinct()
    args = arguments_within(program, ends).where("arg_label = 'CALL' or (arg_label = 'IDENTIFIER' and level = 1)")
    taken = args.select("repo", "id", F.col("arg_id").alias("node_id")).join(sensitive, ["repo", "node_id"]).groupBy("repo", "id").agg(F.collect_set("value").alias("taken"))
    both = flows.withColumn("id", F.element_at("path", -1)).join(nearest, ["repo", "path_id"], "left").join(taken, ["repo", "id"], "left")
    has = lambda c: F.coalesce(F.array_contains(c, F.col("source_id")), F.lit(False))
    return both.where(has("near") | has("taken")).select(*flows.columns)


def member_names(tags: DataFrame) -> DataFrame:
    """(repo, node_id, family, rule_id, member): what each derived node is known by; the member is that of the tag named by rule and family, the first by name."""
    own = tags.where(F.col("name").startswith("derived_by_")).select("repo", "node_id", F.col("name").alias("family"), F.col("value").alias("rule_id")).distinct()
    named = tags.select("repo", "node_id", F.col("name").alias("_key"), F.col("value").alias("member")).groupBy("repo", "node_id", "_key").agg(F.min("member").alias("member"))
    return own.withColumn("_key", F.concat_ws("_", "rule_id", "family")).join(named, ["repo", "node_id", "_key"], "left").drop("_key")


def consumed(program, flows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Leakages of a derived object whose log names other members go, unless it names the flow's own member too; all else stays.

    An argument names a member if it holds the member's name, in any case, or matches the member's rule (``patterns`` by rule id).
    """
    from sluice.functions.scalars import arguments

    leak = flows.where("sink_sub_category = 'leakages'")
    first = leak.select("repo", "path_id", "source_id", F.element_at("path", 1).alias("node_id"), F.element_at("path", -1).alias("id")).distinct()
    code = program.nodes.select("repo", "id", arguments(F.col("code")).alias("args"))
    names = first.join(member_names(program.tags), ["repo", "node_id"]).join(code, ["repo", "id"])
    pattern = F.try_element_at(F.create_map(*[F.lit(x) for kv in patterns.items() for x in kv]).cast("map<string,string>"), F.col("rule_id"))
    holds = F.exists("args", lambda a: F.contains(F.lower(a), F.lower(F.col("member"))))
    fits = F.coalesce(F.exists("args", lambda a: F.rlike(a, F.concat(F.lit("\\A(?:"), pattern, F.lit(")\\z")))), F.lit(False))
    hit = F.when(F.col("member").isNotNull(), holds | fits)
    own = F.col("rule_id") == F.col("source_id")
    verdict = names.groupBy("repo", "path_id", "source_id").agg(F.bool_or(~own & F.coalesce(hit, F.lit(False))).alias("other"), F.coalesce(F.bool_and(F.when(own, F.coalesce(hit, F.lit(False)))), F.lit(True)).alias("mine"))
    wrong = verdict.where("other and not mine").select("repo", "path_id", "source_id").withColumn("sink_sub_category", F.lit("leakages"))
    return flows.join(wrong, ["repo", "path_id", "source_id", "sink_sub_category"], "left_anti").select(*flows.columns)


def location_key(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flows with line and file of the sink node, which tell the place of a sink in the store."""
    n = nodes.select("repo", F.col("id").alias("_last"), F.col("line").alias("sink_line"), F.col("file").alias("sink_file"))
    return flows.withColumn("_last", F.element_at("path", -1)).join(n, ["repo", "_last"], "left").drop("_last")


def store(program, flows: DataFrame, *, dedup: bool = True) -> DataFrame:
    """The flow store: suffixes of a source's paths go, then all but the shortest at each (source, line, file, sink); rows of ``apply_dedup`` false stay as they are."""
    rows = flows if "apply_dedup" in flows.columns else flows.withColumn("apply_dedup", F.lit(True))
    own, exempt = rows.where("apply_dedup"), rows.where("not apply_dedup")
    if dedup:
        kept = location_key(suffix_dedup(own, ["repo", "source_id"]), program.nodes)
        own = shortest(kept, ["repo", "source_id", "sink_line", "sink_file", "sink_id"]).select(*rows.columns)
    return own.unionByName(exempt)


def dataflow(program, sink_rules, source_patterns: dict[str, str], *, language: str = "java", semantics: DataFrame | None = None, context: EngineContext | None = None, all_derived: bool = False, separate: bool = True, dedup: bool = True, limit: int | None = None, more: DataFrame | None = None) -> dict[str, DataFrame]:
    """All stages from reachability to the store, each written once: unfiltered, this, expanded, filtered and final.

    Flows start at sources and at objects known by a member's name, unless ``all_derived``; calls are followed by ``context`` and stand for what ``semantics`` say.
    ``more`` are flows of reads, messages and syncs, which no path search finds and no de-duplication touches.
    """
    sources, sinks = source_nodes(program, all_derived), sink_nodes(program, limit)
    found = calls.reach_by_calls(program, sources.select("repo", "id"), sinks.select("repo", "id"), semantics, context or calls.engine_context(language))
    raw = keep(found.withColumn("path_id", path_id(F.col("path"))), "paths")
    kept = raw
    if language in ("java", "javascript"):
        kept = keep(this_filter(raw, this_nodes(program)), "this")
    kinds = program.nodes.sparkSession.createDataFrame(sorted({(r.cat_two, r.node_type) for r in sink_rules}), "cat_two string, node_type string")
    wide = keep(expand(kept, program.tags, kinds, all_derived), "expanded")
    if separate and language in ("java", "javascript"):
        narrow = without_cookies(without_false_positives(consumed(program, overlapping(program, wide), source_patterns)))
    else:
        narrow = without_cookies(wide)
    narrow = narrow.withColumn("apply_dedup", F.lit(True))
    narrow = keep(narrow if more is None else narrow.unionByName(more.select(*narrow.columns)), "filtered")
    return {"unfiltered": raw, "this": kept, "expanded": wide, "filtered": narrow, "final": keep(store(program, narrow, dedup=dedup), "flows")}


def this_nodes(program) -> DataFrame:
    """Node id, code, and the type of the receiver where it is ``this``: the first argument of a field access, else argument 0."""
    calls = program.of("CALL").select("repo", F.col("id"), "name")
    args = program.arguments(calls).where("arg_code = 'this'").join(calls, ["repo", "id"])
    at = F.when(F.col("name") == "<operator>.fieldAccess", 1).otherwise(0)
    own = args.where(F.col("arg_argument_index") == at).groupBy("repo", "id").agg(F.min("arg_type_full_name").alias("this_type"))
    return program.nodes.select("repo", "id", "code").join(own, ["repo", "id"], "left")


def described(flows: DataFrame, nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Paths with the first source id of the first node and the last sink id of the last; without one, its type or method name."""
    ids = tags.where("name = 'id'").groupBy("repo", F.col("node_id").alias("n")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    n = nodes.select("repo", F.col("id").alias("n"), "type_full_name", "method_full_name")
    ends = flows.withColumns({"_a": F.element_at("path", 1), "_b": F.element_at("path", -1)})
    a = n.join(ids, ["repo", "n"], "left").select("repo", F.col("n").alias("_a"), F.coalesce("low", "type_full_name").alias("source_id"))
    b = n.join(ids, ["repo", "n"], "left").select("repo", F.col("n").alias("_b"), F.coalesce("high", "method_full_name").alias("sink_id"))
    return ends.drop("source_id", "sink_id").join(a, ["repo", "_a"], "left").join(b, ["repo", "_b"], "left").drop("_a", "_b")


def appended(flows: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """Paths with the nodes of the columns before and after them."""
    return flows.withColumn("path", F.concat(F.array(*before).cast("array<bigint>"), "path", F.array(*after).cast("array<bigint>"))).withColumn("path_id", path_id(F.col("path")))


def read_flows(reads: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Flows of storage reads that return a sensitive class: (repo, call, type) joined with (repo, type, rule_id, member_id); path of member and call, never de-duplicated."""
    own = reads.select("repo", F.col("id").alias("call"), F.regexp_extract("type_full_name", r"(?:.*<)?([^<>]+)>?$", 1).alias("type"), "sink_id", "sink_sub_category", "sink_node_type")
    out = own.join(sensitive.select("repo", "type", F.col("rule_id").alias("source_id"), "member_id"), ["repo", "type"])
    path = F.array("member_id", "call")
    return out.select("repo", "source_id", "sink_id", "sink_sub_category", "sink_node_type", path_id(path).alias("path_id"), path.alias("path"), F.lit(False).alias("apply_dedup")).distinct()


def consumer_flows(program, consumers: DataFrame, sensitive: DataFrame, sub_category: str = "storages") -> DataFrame:
    """Flows into message consumers (repo, id, rule_id): the types of their parameters, and those that a call inside reads a message as (``readValue(m, T.class)``)."""
    params = program.hop(consumers.select("repo", "id", "rule_id"), "AST", to="p").join(program.of("PARAMETER").select("repo", F.col("id").alias("p"), F.col("type_full_name").alias("type")), ["repo", "p"])
    inner = program.hop(consumers.select("repo", "id", "rule_id"), "CONTAINS", to="c").join(program.calls().where(F.col("name").rlike("(?i)^(readValue|deserialize|fromJson|convertValue)$")).select("repo", F.col("id").alias("c"), "type_full_name", F.regexp_extract("code", r"([\w.]+)(?:\.class|::class)", 1).alias("named")), ["repo", "c"])
    read = inner.select("repo", "id", "rule_id", F.explode(F.array("type_full_name", "named")).alias("type"))
    takes = params.select("repo", "id", "rule_id", "type").unionByName(read).where("type <> ''").distinct()
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    known = sensitive.select("repo", "type", F.col("rule_id").alias("source_id"), "member_id")
    exact = takes.join(known, ["repo", "type"])
    by_name = takes.where(~F.col("type").contains(".")).withColumnRenamed("type", "_short").join(known.withColumn("_short", short(F.col("type"))), ["repo", "_short"]).drop("_short")
    path = F.array("member_id", "id")
    both = exact.select("repo", "id", "rule_id", "source_id", "member_id").unionByName(by_name.select("repo", "id", "rule_id", "source_id", "member_id")).distinct()
    return both.select("repo", "source_id", F.col("rule_id").alias("sink_id"), F.lit(sub_category).alias("sink_sub_category"), F.lit("REGULAR").alias("sink_node_type"), path_id(path).alias("path_id"), path.alias("path"), F.lit(False).alias("apply_dedup"))
