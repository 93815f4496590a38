"""The rule catalogue: YAML files of sources, sinks, collections, policies, threats, exclusions and the rest.

Fields fall back to defaults, and what does not parse contributes nothing but is reported. Category, node type and language come from where a
file lies. Whether a pattern is valid is told by the engine that will run it, Java's. The catalogue is small and read on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sluice.operators.predicates import compiles
from sluice.operators.tagging import Rule

# Fixed values of the catalogue's file format.
LANGUAGES = frozenset("java javascript python ruby kotlin go php csharp c default unknown".split())
CATEGORIES = frozenset("sources sinks collections policies threats inferences ded unknown".split())
NODE_TYPES = frozenset(("api", "REGULAR", "Unknown"))
FILTERS = frozenset("method_full_name code method_full_name_with_literal method_full_name_with_property_name endpoint_domain_with_literal endpoint_domain_with_property_name".split())
RULE_LISTS = ("sources", "sinks", "collections", "exclusions", "sinkSkipList", "auditConfig", "inferences")
DISABLED_BY_DECLARATION = "DISABLED_BY_DED"


@dataclass(frozen=True)
class Flow:
    """The dataFlow part of a policy or threat."""

    sources: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()
    is_sensitive: bool | None = None
    sensitivity: str = ""
    source_name: str = ""
    allowed_sources: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    sink_type: str = ""
    sink_name: str = ""
    allowed_domains: tuple[str, ...] = ()
    collection_type: str = ""
    end_point: str = ""


@dataclass(frozen=True)
class Verdict:
    """A policy or a threat."""

    id: str
    name: str = ""
    description: str = ""
    fix: str = ""
    kind: str | None = None
    action: str | None = None
    flow: Flow = Flow()
    repositories: tuple[str, ...] = ("**",)
    tags: dict = field(default_factory=dict, compare=False)
    config: dict = field(default_factory=dict, compare=False)
    file: str = ""
    tree: tuple[str, ...] = ()


@dataclass(frozen=True)
class Declared:
    """Declarations of data elements in one file: (rule id, variable, type in the source, line or null)."""

    id: str
    file_path: str
    variables: tuple[tuple[str, str, str, int | None], ...] = ()
    language: str = "unknown"


@dataclass(frozen=True)
class Semantic:
    signature: str
    flow: str = ""
    language: str = "unknown"


@dataclass(frozen=True)
class Setting:
    key: str
    value: str
    language: str = "unknown"


@dataclass(frozen=True)
class Catalogue:
    sources: tuple[Rule, ...] = ()
    sinks: tuple[Rule, ...] = ()
    collections: tuple[Rule, ...] = ()
    policies: tuple[Verdict, ...] = ()
    threats: tuple[Verdict, ...] = ()
    exclusions: tuple[Rule, ...] = ()
    semantics: tuple[Semantic, ...] = ()
    sink_skips: tuple[Rule, ...] = ()
    settings: tuple[Setting, ...] = ()
    audit: tuple[Rule, ...] = ()
    inferences: tuple[Rule, ...] = ()
    declared: tuple[Declared, ...] = ()
    problems: tuple[tuple[str, str], ...] = ()

    def __add__(self, other: Catalogue) -> Catalogue:
        return Catalogue(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)))

    def rule(self, rule_id: str) -> Rule | None:
        return next((r for r in (*self.sources, *self.sinks, *self.collections, *self.inferences) if r.id == rule_id), None)

    def with_rule(self, rule: Rule) -> Catalogue:
        """With a rule made during the run; one of the same id stays as it is."""
        part = {"sources": "sources", "collections": "collections"}.get(rule.cat_one, "sinks")
        own = getattr(self, part)
        return self if any(r.id == rule.id for r in own) else replace(self, **{part: (*own, rule)})

    def setting(self, key: str) -> str:
        """The values of a key as one pattern that ignores case; the built-in default where there is none."""
        values = [s.value for s in self.settings if s.key == key]
        return f"(?i)({'|'.join(values)})" if values else DEFAULT_SETTINGS.get(key, "")

    def raw_setting(self, key: str) -> str:
        return "".join(s.value for s in self.settings if s.key == key)


# What a catalogue without the setting uses.
DEFAULT_SETTINGS = {
    "ignoredSinks": r"(?i).*(?<=map|list|jsonobject|json|array|arrays|jsonnode|objectmapper|objectnode).*(put:|get:).*",
    "apiSinks": r"(?i)(?:url|client|openConnection|request|execute|newCall|load|host|access|fetch|get|getInputStream|getApod|getForObject|getForEntity|list|set|put|post|proceed|trace|patch|Path|send|sendAsync|remove|delete|write|read|assignment|provider|exchange|postForEntity)",
    "apiHttpLibraries": r"^(?i)(org.apache.http|okhttp|org.glassfish.jersey|com.mashape.unirest|java.net.http|java.net.URL|org.springframework.(web|core.io)|groovyx.net.http|org.asynchttpclient|kong.unirest.java|org.concordion.cubano.driver.http|javax.net.ssl).*",
}


def _texts(value: Any) -> tuple[str, ...]:
    return tuple(str(x) for x in value) if isinstance(value, list) else () if value is None else (str(value),)


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _named(value: str, known: Iterable[str], default: str) -> str:
    return value if value in known else default


def _rule(raw: dict, part: str, tree: tuple[str, ...], file: str, external: bool) -> Rule:
    at = lambda k: tree[k] if len(tree) > k else ""
    one = "inferences" if part == "inferences" else _named(at(1), CATEGORIES, "unknown")
    two = at(2) if part in ("sinks", "collections", "auditConfig", "inferences") else ""
    node_type = _named(at(3), NODE_TYPES, "REGULAR") if part in ("sinks", "inferences") else "REGULAR"
    return Rule(
        id=_text(raw.get("id")),
        name=_text(raw.get("name")),
        category=_text(raw.get("category")),
        patterns=_texts(raw.get("patterns")),
        domains=_texts(raw.get("domains")),
        sensitivity=_text(raw.get("sensitivity")),
        is_sensitive=raw.get("isSensitive") is True,
        node_type=node_type,
        cat_one=one,
        cat_two=two,
        # A collection has no language by its place, and so passes every filter of languages.
        language="unknown" if part == "collections" else _named(tree[-1] if tree else "", LANGUAGES, "unknown"),
        is_external=external,
        filter_property=_named(_text(raw.get("filterProperty")), FILTERS, "method_full_name"),
        file=file,
        tags={str(k): _text(v) for k, v in raw["tags"].items()} if isinstance(raw.get("tags"), dict) else {},
    )


def _part(raw: Any, *names: str) -> Any:
    for n in names:
        raw = raw.get(n) if isinstance(raw, dict) else None
    return raw


def _verdict(raw: dict, tree: tuple[str, ...], file: str) -> Verdict:
    f = raw.get("dataFlow") if isinstance(raw.get("dataFlow"), dict) else {}
    kept = lambda v, known: low if (low := _text(v).lower()) in known else None
    tags = raw.get("tags")
    pairs = tags if isinstance(tags, dict) else {k: v for t in tags if isinstance(t, dict) for k, v in t.items()} if isinstance(tags, list) else {}
    return Verdict(
        id=_text(raw.get("id")),
        name=_text(raw.get("name")),
        description=_text(raw.get("description")),
        fix=_text(raw.get("fix")),
        kind=kept(raw.get("type"), ("threat", "compliance")),
        action=kept(raw.get("action"), ("allow", "deny")),
        flow=Flow(
            sources=_texts(f.get("sources")),
            sinks=_texts(f.get("sinks")),
            is_sensitive=v if isinstance(v := _part(f, "sourceFilters", "isSensitive"), bool) else None,
            sensitivity=_text(_part(f, "sourceFilters", "sensitivity")),
            source_name=_text(_part(f, "sourceFilters", "name")),
            allowed_sources=_texts(_part(f, "sourceFilters", "allowedSourceFilters", "sources")),
            domains=_texts(_part(f, "sinkFilters", "domains")),
            sink_type=_text(_part(f, "sinkFilters", "sinkType")),
            sink_name=_text(_part(f, "sinkFilters", "name")),
            allowed_domains=_texts(_part(f, "sinkFilters", "allowedSinkFilters", "domains")),
            collection_type=_text(_part(f, "collectionFilters", "collectionType")),
            end_point=_text(_part(f, "collectionFilters", "endPoint")),
        ),
        repositories=_texts(raw["repositories"]) if raw.get("repositories") is not None else ("**",),
        tags={str(k): _text(v) for k, v in pairs.items()},
        config={str(k): _text(v) for k, v in raw["config"].items()} if isinstance(raw.get("config"), dict) else {},
        file=file,
        tree=tree,
    )


def _declared(raw: dict, language: str) -> Declared:
    rows = []
    for c in raw.get("classificationData") or []:
        for v in (c.get("variables") or []) if isinstance(c, dict) else []:
            if isinstance(v, dict):
                line = v.get("lineNumber")
                rows.append((_text(c.get("id")), _text(v.get("name")), _text(v.get("typeInSrc")), line if isinstance(line, int) else None))
    path = _text(raw.get("filePath"))
    return Declared(path, path.strip(), tuple(rows), language)  # the file's path is its id


def valid_declaration(d: Declared) -> bool:
    """An id, a path, a class, and every variable with a name and a type."""
    return bool(d.id and d.file_path and d.variables) and all(i and n and t for i, n, t, _ in d.variables)


def parse(text: str, relative: str, file: str = "", external: bool = False) -> Catalogue:
    """The catalogue of one file; ``relative`` is its path under the rules folder."""
    import yaml

    tree = tuple(relative.split(".")[0].split("/"))
    language = _named(tree[-1], LANGUAGES, "unknown")
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return Catalogue(problems=((file or relative, f"no YAML: {str(e).splitlines()[0]}"),))
    if not isinstance(raw, dict):
        return Catalogue(problems=((file or relative, "no mapping"),))
    rows = lambda key: [x for x in raw.get(key) or [] if isinstance(x, dict)] if isinstance(raw.get(key), list) else []
    rules = {p: tuple(_rule(x, p, tree, file, external) for x in rows(p)) for p in RULE_LISTS}
    declared = [_declared(x, language) for x in rows("dedRules")]
    return Catalogue(
        sources=rules["sources"],
        sinks=rules["sinks"],
        collections=rules["collections"],
        policies=tuple(_verdict(x, tree, file) for x in rows("policies")),
        threats=tuple(_verdict(x, (), "") for x in rows("threats")),
        exclusions=rules["exclusions"],
        semantics=tuple(Semantic(_text(x.get("signature")), _text(x.get("flow")), language) for x in rows("semantics")),
        sink_skips=rules["sinkSkipList"],
        settings=tuple(Setting(_text(x.get("key")), _text(x.get("value")), language) for x in rows("systemConfig")),
        audit=rules["auditConfig"],
        inferences=rules["inferences"],
        declared=tuple(d for d in declared if valid_declaration(d)),
        problems=tuple((file or relative, f"declaration of {d.id or '?'}") for d in declared if not valid_declaration(d)),
    )


def for_languages(c: Catalogue, languages: set[str]) -> Catalogue:
    """What is of one of the languages, of all (default) or of no known one."""
    wanted = languages | {"default", "unknown"}
    keep = lambda rows: tuple(r for r in rows if r.language in wanted)
    parts = ("sources", "sinks", "collections", "exclusions", "semantics", "sink_skips", "settings", "audit", "inferences", "declared")
    return replace(c, **{p: keep(getattr(c, p)) for p in parts})


def validated(spark: SparkSession, c: Catalogue) -> Catalogue:
    """Without sources, sinks, collections and inferences whose pattern Java does not compile; these are among the problems."""
    out, problems = {}, list(c.problems)
    for p in ("sources", "sinks", "collections", "inferences"):
        good = []
        for r in getattr(c, p):
            if compiles(r.pattern, spark):
                good.append(r)
            else:
                problems.append((r.file, f"pattern of {r.id}"))
        out[p] = tuple(good)
    return replace(c, **out, problems=tuple(problems))


def load(spark: SparkSession, folder: str, languages: set[str], external: bool = False) -> Catalogue:
    """All YAML files under ``folder``, in the order of their paths."""
    root, out = Path(folder), Catalogue()
    for f in sorted(p for p in root.rglob("*") if p.suffix.lower() in (".yaml", ".yml")):
        out += parse(f.read_text(encoding="utf-8", errors="replace"), f.relative_to(root).as_posix(), str(f), external)
    return validated(spark, for_languages(out, languages))


def _merged(rules: Sequence[Rule]) -> tuple[Rule, ...]:
    """A rule for each id: the first one's attributes and the patterns of all."""
    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.id, []).append(r)
    return tuple(replace(own[0], patterns=tuple(p for r in own for p in r.patterns)) for own in groups.values())


def _first(rows: Sequence, key: str) -> tuple:
    return tuple({getattr(r, key): r for r in reversed(rows)}.values())[::-1]


def merge_found_sinks(external: Sequence[Rule], internal: Sequence[Rule]) -> tuple[Rule, ...]:
    """Sinks, those found in dependencies folded into the rules of the same library.

    A found sink gives its patterns to the first package rule (not one on code) of its domain or name; else it stands for itself.
    """
    head = lambda r: r.domains[0] if r.domains else ""
    known = {(head(r), r.name, r.filter_property): r for r in internal}
    for e in external:
        for key, r in known.items():
            if (key[0] == head(e) or key[1] == e.name) and "ThirdParties.SDK" in r.id and key[2] != "code":
                known[key] = replace(r, patterns=r.patterns + e.patterns)
                break
        else:
            known[head(e), e.name, e.filter_property] = e
    return tuple(known.values())


def merge(external: Catalogue, internal: Catalogue) -> Catalogue:
    """One catalogue of both; where they have the same id, the external one leads."""
    both = external + internal
    return replace(
        both,
        sources=_merged(both.sources),
        sinks=_merged(merge_found_sinks(external.sinks, internal.sinks)),
        collections=_merged(both.collections),
        policies=_first(both.policies, "id"),
        exclusions=_merged(both.exclusions),
        threats=_first(both.threats, "id"),
        semantics=_first(both.semantics, "signature"),
        sink_skips=_first(both.sink_skips, "id"),
        audit=_first(both.audit, "id"),
        inferences=_merged(both.inferences),
    )


def exclusion_pattern(rules: Sequence[Rule]) -> str:
    """One rule: its patterns with bars between; several: each rule's in parentheses."""
    own = ["|".join(r.patterns) for r in rules]
    return own[0] if len(own) == 1 else "|".join(f"({p})" for p in own)


def declared_table(spark: SparkSession, c: Catalogue) -> DataFrame:
    rows = [(i, d.file_path, n, t, line) for d in c.declared for i, n, t, line in d.variables]
    return spark.createDataFrame(rows, "rule_id string, file string, name string, type_in_src string, line int")


def check(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(file, problem) of a rules folder: what ``load`` drops, fields of a wrong kind, and lists that no catalogue has."""
    import yaml

    root, out = Path(folder), []
    parts = {*RULE_LISTS, "policies", "threats", "semantics", "systemConfig", "dedRules"}
    for f in sorted(p for p in root.rglob("*") if p.suffix.lower() in (".yaml", ".yml")):
        name = f.relative_to(root).as_posix()
        text = f.read_text(encoding="utf-8", errors="replace")
        c = validated(spark, parse(text, name, name))
        out += c.problems
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError:
            continue
        for key, rows in raw.items() if isinstance(raw, dict) else ():
            if key not in parts:
                out.append((name, f"unknown list {key}"))
            elif not isinstance(rows, list):
                out.append((name, f"{key} is no list"))
            else:
                for k, x in enumerate(rows):
                    out += [(name, f"{key}[{k}]: {p}") for p in _faults(key, x)]
    return out


def _faults(part: str, x: Any) -> list[str]:
    if not isinstance(x, dict):
        return ["no mapping"]
    needed = {"semantics": ("signature",), "systemConfig": ("key", "value"), "dedRules": ("filePath", "classificationData")}.get(part, ("id",))
    out = [f"no {k}" for k in needed if not x.get(k)]
    if part in ("sources", "sinks", "collections", "inferences", "exclusions", "sinkSkipList") and not isinstance(x.get("patterns"), list):
        out.append("no patterns")
    if "isSensitive" in x and not isinstance(x["isSensitive"], bool):
        out.append("isSensitive is no truth value")
    if x.get("filterProperty") is not None and x["filterProperty"] not in FILTERS:
        out.append(f"filterProperty {x['filterProperty']}")
    if part in ("policies", "threats") and x.get("action") is not None and str(x["action"]).lower() not in ("allow", "deny"):
        out.append(f"action {x['action']}")
    return out
