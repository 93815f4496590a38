"""A query for each language's source tagger and API tagger, over the stand-in program; the SQL follows from the language's profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import sinks, sources
from sluice.plans.catalogue import query
from sluice.plans.program_queries import _DERIVED, RULES, program

_NOT_CONSTANT = " AND name <> upper(name) AND code <> 'this'"
_TYPES = {sources.BY_NAME: "first", sources.BY_TYPE: "second", sources.BY_INHERITANCE: "third"}
SETTINGS = {"apiHttpLibraries": "(?i)db[.]t[1-5].*", "apiSinks": "(?i)(find.*|error)", "ignoredSinks": "(?i).*t3.*"}


def source_sql(profile: sources.Profile) -> str:
    test = "" if profile.constants else _NOT_CONSTANT
    named = lambda label, kind: f"SELECT id, rule_id, '{kind}' AS kind FROM nodes JOIN rules ON regexp_full_match(name, re) WHERE label = '{label}'{test}"
    parts = [named("IDENTIFIER", "VARIABLE_REGEX_IDENTIFIER")]
    if profile.members:
        parts.append(named("MEMBER", "VARIABLE_REGEX_MEMBER"))
    if profile.accesses:
        parts.append("SELECT c.id, rule_id, 'VARIABLE_REGEX_IDENTIFIER' FROM nodes c JOIN edges e ON e.src = c.id AND e.label = 'ARGUMENT' JOIN nodes f ON f.id = e.dst AND f.argument_index = 2 JOIN rules ON regexp_full_match(f.code, re) WHERE c.name = '<operator>.fieldAccess'")
    for family in profile.derive:
        parts.append(f"SELECT DISTINCT n.id, t.rule_id, '{family}' FROM nodes n JOIN {_TYPES[family]} t ON t.type = n.type_full_name WHERE n.label IN ('IDENTIFIER', 'PARAMETER'){test}")
    return _DERIVED + " UNION ALL ".join(parts)


def api_sql(profile: sinks.ApiProfile) -> str:
    package = f"regexp_full_match(method_full_name, '{SETTINGS['apiHttpLibraries']}')" + (f" OR regexp_full_match(code, '{SETTINGS['apiHttpLibraries']}')" if profile.on_code else "")
    out = f"{_DERIVED} SELECT id, name FROM nodes WHERE label = 'CALL' AND NOT starts_with(name, '<operator') AND regexp_full_match(name, '{SETTINGS['apiSinks']}') AND ({package})"
    return out + (f" AND NOT regexp_full_match(method_full_name, '{SETTINGS['ignoredSinks']}')" if profile.ignored else "")


def _sources(language: str):
    profile = sources.PROFILES[language]

    def run(spark, sf_dir):
        p = program(spark, sf_dir)
        direct = sources.direct(p, RULES, profile).select("id", "rule_id", "kind")
        if not profile.derive:
            return direct
        return direct.unionByName(sources.derived_kinds(p, RULES, profile).select("id", "rule_id", F.col("family").alias("kind")).distinct())

    run.__name__ = f"source_tags_{language}"
    return run


def _apis(language: str):
    def run(spark, sf_dir):
        return sinks.http_calls(program(spark, sf_dir), SETTINGS.get, language).select("id", "name")

    run.__name__ = f"api_calls_{language}"
    return run


for _language, _profile in sources.PROFILES.items():
    query(source_sql(_profile))(_sources(_language))
for _language, _api in sinks.API_PROFILES.items():
    query(api_sql(_api))(_apis(_language))
