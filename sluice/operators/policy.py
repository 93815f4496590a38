"""Policies and threats over flows, tags and tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.predicates import full_match, partial_match

THIRD_PARTY_API = "Sinks.ThirdParties.API."
FORMS = "Collections.Webforms"


@dataclass(frozen=True)
class Policy:
    """Who may flow where. Empty filters pass everything; ``sources`` and ``sinks`` are patterns of ids, ** for all."""

    id: str
    action: str | None = "deny"
    sources: tuple[str, ...] = ("**",)
    sinks: tuple[str, ...] = ("**",)
    repositories: tuple[str, ...] = ("**",)
    sensitivity: str = ""
    is_sensitive: bool | None = None
    source_name: str = ""
    allowed_sources: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    sink_type: str = ""
    sink_name: str = ""
    collection_type: str = ""
    end_point: str = ""


def from_verdict(v) -> Policy:
    """The policy of a catalogue's policy or threat."""
    f = v.flow
    return Policy(v.id, v.action, f.sources, f.sinks, v.repositories, f.sensitivity, f.is_sensitive, f.source_name, f.allowed_sources, f.domains, f.allowed_domains, f.sink_type, f.sink_name, f.collection_type, f.end_point)


def _ids(column: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= F.lit(True) if p == "**" else full_match(column, p)
    return out


def _some(column: Column, patterns: tuple[str, ...]) -> Column:
    """Some pattern is found somewhere in the column."""
    out = F.lit(False)
    for p in patterns:
        out |= partial_match(column, p)
    return out


def applies(policy: Policy, repo: Column) -> Column:
    """Denied where a repository matches, or not among the allowed; always without an action; never with no repositories."""
    found = _ids(repo, policy.repositories)
    if policy.action is None:
        return F.lit(True)
    return found if policy.action == "deny" else ~found


def source_test(policy: Policy, prefix: str = "source_") -> Column:
    """Whether a source (id, name, sensitivity, is_sensitive, behind ``prefix``) is one of the policy's."""
    c = lambda name: F.col(prefix + name)
    test = _ids(c("id"), policy.sources)
    if policy.sensitivity:
        test &= c("sensitivity") == policy.sensitivity
    if policy.is_sensitive is not None:
        test &= c("is_sensitive") == policy.is_sensitive
    if policy.source_name:
        test &= partial_match(c("name"), policy.source_name)
    if policy.allowed_sources:
        test &= ~_some(c("id"), policy.allowed_sources)
    return F.coalesce(test, F.lit(False))


def sink_test(policy: Policy, prefix: str = "sink_") -> Column:
    """Whether a sink (id, name, domains, behind ``prefix``) is one of the policy's. An API's domain is told by its id, in part."""
    c = lambda name: F.col(prefix + name)
    test = _ids(c("id"), policy.sinks)
    if policy.sink_type:
        test &= F.lower(c("id")).contains(policy.sink_type.lower())
    api = F.contains(c("id"), F.lit(THIRD_PARTY_API))
    shares = lambda d: F.arrays_overlap(c("domains"), F.array(*map(F.lit, d)))
    if policy.domains:
        test &= F.when(api, _some(c("id"), policy.domains)).otherwise(shares(policy.domains))
    if policy.allowed_domains:
        test &= F.when(api, ~_some(c("id"), policy.allowed_domains)).otherwise(~shares(policy.allowed_domains))
    if policy.sink_name:
        test &= partial_match(c("name"), policy.sink_name)
    return F.coalesce(test, F.lit(False))


def _by_policy(rows: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    if not tests:
        return rows.withColumn("policy_id", F.lit("")).where(F.lit(False))
    return rows.withColumn("policy_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in tests]))))


def with_rules(flows: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Flows with what the policies ask of their rules: name, sensitivity and is_sensitive of the source, name and domains of the sink."""
    a = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("sensitivity").alias("source_sensitivity"), F.col("is_sensitive").alias("source_is_sensitive"))
    b = sinks.select(F.col("id").alias("sink_id"), F.col("name").alias("sink_name"), F.col("domains").alias("sink_domains"))
    return flows.join(F.broadcast(a), "source_id", "left").join(F.broadcast(b), "sink_id", "left")  # the catalogue, read on the driver


def flow_violations(flows: DataFrame, policies: Sequence[Policy], repo: bool = False) -> DataFrame:
    """policy_id, source_id, sink_id, paths: both ends match the policy. One pass over the flows serves all policies.

    With ``repo`` the flows' repository must be one that the policy applies to, and is a column of the result.
    """
    keys = ["repo"] if repo else []
    tests = [(p.id, source_test(p) & sink_test(p) & (applies(p, F.col("repo")) if repo else F.lit(True))) for p in policies]
    return _by_policy(flows, tests).groupBy(*keys, "policy_id", "source_id", "sink_id").agg(F.array_sort(F.collect_set("path_id")).alias("paths"))


def processing_violations(sources: DataFrame, policies: Sequence[Policy], strict_parity: bool = False) -> DataFrame:
    """policy_id and source rows of the policies without sinks and collection: processing alone breaks them. Empty with ``strict_parity``, as ever."""
    own = [] if strict_parity else [p for p in policies if not p.sinks and not p.collection_type and not p.end_point]
    return _by_policy(sources, [(p.id, source_test(Policy(p.id, sources=p.sources, sensitivity=p.sensitivity, is_sensitive=p.is_sensitive)) & applies(p, F.col("repo"))) for p in own])


def collection_violations(collections: DataFrame, policies: Sequence[Policy], matching: DataFrame | None = None) -> DataFrame:
    """Collections (collection_id, source_id, end_point) that policies without sinks but with a type of collection forbid.

    Web forms for the type ``form``, all others for any other type; end points that the policy's pattern is found in. A policy that matches no source of
    ``matching`` (all ids of sources in flows; those of the collections if null) takes all.
    """
    out = None
    for p in (q for q in policies if not q.sinks and q.collection_type):
        form = F.col("collection_id") == FORMS
        rows = collections.where(form if p.collection_type == "form" else ~form)
        if p.end_point:
            rows = rows.where(partial_match(F.col("end_point"), p.end_point))
        ids = (matching if matching is not None else collections).select("source_id").distinct().where(_ids(F.col("source_id"), p.sources))
        if ids.limit(1).count():  # one number decides, on the driver
            rows = rows.join(ids, "source_id", "left_semi")
        rows = rows.withColumn("policy_id", F.lit(p.id)).select("policy_id", *collections.columns)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else collections.withColumn("policy_id", F.lit("")).where(F.lit(False)).select("policy_id", *collections.columns)


def occurrence_violations(sources: DataFrame, occurrences: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """policy_id, source_id and the first node by id of each source that a policy matches."""
    first = occurrences.groupBy("source_id").agg(F.min("node_id").alias("node_id"))
    return _by_policy(sources, [(p.id, source_test(p)) for p in policies]).select("policy_id", "source_id").distinct().join(first, "source_id")


VIOLATION = "policy_id string, kind string, source_id string, sink_id string, detail string"


def combined(processing: Sequence[DataFrame], flow: Sequence[DataFrame], collection: Sequence[DataFrame]) -> DataFrame:
    """All violations as rows (policy_id, kind, source_id, sink_id, detail), in the order processing, flow, collection by their kind."""
    shape = lambda df, kind: df.select("policy_id", F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in ("source_id", "sink_id", "detail")])
    parts = [shape(d, k) for k, own in (("processing", processing), ("dataflow", flow), ("collection", collection)) for d in own]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Tables


def _repo(columns: DataFrame) -> list[str]:
    return ["repo"] if "repo" in columns.columns else []


def in_several_tables(columns: DataFrame) -> DataFrame:
    """source_id, n_tables, tables of source ids that more than one table (of a repository, where there are several) holds."""
    own = _repo(columns)
    t = columns.select(*own, "source_id", F.lower("table_name").alias("t")).distinct()
    return t.groupBy(*own, "source_id").agg(F.count("*").alias("n_tables"), F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tables")).where("n_tables > 1")


def mixed_values(columns: DataFrame, values: dict[str, str], name: str) -> DataFrame:
    """Tables whose source ids map to more than one value (category, retention)."""
    own = _repo(columns)
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    v = columns.select(*own, "table_name", F.try_element_at(pairs, F.col("source_id")).alias("v")).where("v is not null").distinct()
    return v.groupBy(*own, "table_name").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias(name), F.count("*").alias("n")).where("n > 1")


def categories_of(config: dict[str, str]) -> dict[str, str]:
    """Source id to category, of a configuration of category to a list of ids with commas."""
    return {i.strip(): k for k, ids in config.items() for i in ids.split(",") if i.strip()}


def entity_columns(sensitive: DataFrame, tables: DataFrame) -> DataFrame:
    """(repo, table_name, source_id) of entity classes, as the columns that the table threats read."""
    return tables.join(sensitive.select("repo", F.col("type").alias("type_full_name"), F.col("rule_id").alias("source_id")).distinct(), ["repo", "type_full_name"]).select("repo", "table_name", "source_id")
