"""Taggers of sinks: rules on calls, APIs and their addresses, classes that extend or are annotated, databases, buckets, streams and dependencies.

All return rows: matches (repo, id, file, rule_id and what the sink has more) or tags. A rule that is made during a run (an
API's domain, a cookie's name) is a row of a rule table, made from the match by concatenation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import scalars as fn
from sluice.operators import flows, graph, tagging
from sluice.operators.calls import EngineContext, reach_by_calls
from sluice.operators.graph import Program
from sluice.operators.predicates import by_name_or_hint, full_match, partial_match
from sluice.operators.sources import mark
from sluice.operators.tagging import Rule

THIRD_PARTY, INTERNAL = "Sinks.ThirdParties.API", "Sinks.API.InternalAPI"
COOKIE_WRITE = "Storages.Web.Cookie.Write"
SERVICE_URL = r".*(http|https):\/\/[a-zA-Z0-9_-]+$"
API = "API"


def regular(program: Program, rules: Sequence[Rule], prefix: bool = False, skip_meta: bool = False) -> DataFrame:
    """Calls with each rule that their code (for rules on code) or full name or a type hint matches.

    ``prefix``: a full name may stand behind ``pkg.`` and go on (JavaScript). ``skip_meta``: not calls in generated ``<meta>`` methods.
    """
    calls = program.calls()
    if skip_meta:
        inside = program.of("METHOD").where(full_match(F.col("name"), ".*<meta.*>$"))
        calls = calls.join(program.hop(inside.select("repo", "id"), "CONTAINS", to="call").select("repo", F.col("call").alias("id")).distinct(), ["repo", "id"], "left_anti")

    def test(r: Rule) -> Column:
        if r.filter_property == "code":
            return full_match(F.col("code"), r.pattern)
        return full_match(F.col("method_full_name"), f"(pkg.){{0,1}}({r.pattern}).*") if prefix else by_name_or_hint(r.pattern)

    return tagging.match_rows(calls, [(r.id, test(r)) for r in rules if r.node_type == "REGULAR"])


def skipped(sinks: DataFrame, rules: Sequence[Rule], column: str = "method_full_name") -> DataFrame:
    """Without the sinks that a skip list names."""
    out = sinks
    for r in rules:
        out = out.where(~full_match(F.col(column), r.pattern))
    return out


def cookies(program: Program, matched: DataFrame) -> DataFrame:
    """Cookie writes with the cookie's name and rule id: the first argument, or that named ``name``; of a variable what is assigned to it first."""
    own = matched.where(F.col("rule_id") == COOKIE_WRITE)
    args = program.arguments(own).where("arg_argument_index = 1 or arg_name = 'name'")
    first = args.groupBy("repo", "id").agg(F.min_by(F.struct("arg_label", "arg_code"), F.struct("arg_argument_index", "arg_id")).alias("a"))
    given = program.arguments(program.operators(graph.ASSIGNMENT))
    left = given.where("arg_argument_index = 1").select("repo", "id", F.col("arg_code").alias("variable"))
    right = given.where("arg_argument_index = 2").select("repo", "id", F.col("arg_code").alias("value"))
    assigned = left.join(right, ["repo", "id"]).groupBy("repo", "variable").agg(F.min_by("value", "id").alias("value"))
    named = own.join(first, ["repo", "id"], "left").join(assigned, (own["repo"] == assigned["repo"]) & (F.col("a.arg_label") == "IDENTIFIER") & (F.col("a.arg_code") == F.col("variable")), "left").drop(assigned["repo"])
    name = fn.unquoted(F.coalesce("value", F.col("a.arg_code")))
    return named.select("repo", "id", "file", F.col("rule_id").alias("base_id"), name.alias("cookie"), F.when(name.isNotNull(), F.concat_ws(".", "rule_id", name)).otherwise(F.col("rule_id")).alias("rule_id"))


def generated_rules(base: Rule, found: DataFrame, part: str) -> DataFrame:
    """A rule row for each distinct ``part`` of the sinks found: the base rule's id and name with the part behind."""
    p = found.where(F.col(part).isNotNull()).select(F.col(part).alias("_p")).distinct()
    return p.select(F.concat_ws(".", F.lit(base.id), "_p").alias("id"), F.concat_ws(" ", F.lit(base.name), "_p").alias("name"), F.lit(base.category).alias("category"), F.lit(True).alias("is_generated"))


# Arguments


def argument_pairs(program: Program, calls: DataFrame, depth: int = 3) -> DataFrame:
    """(repo, id, key, value) of the object arguments of calls: assignments in blocks to ``depth`` levels (``a.b``), spreads and picks of objects.

    A spread ``...x`` gives the key ``x`` with an empty value, ``pick(x, ["a", "b"])`` the keys a and b.
    """
    children = program.edges.where("label = 'AST'").select("repo", F.col("src").alias("at"), F.col("dst").alias("child"))
    node = program.nodes.select("repo", F.col("id").alias("child"), F.col("label").alias("c_label"), F.col("name").alias("c_name"), F.col("code").alias("c_code"))
    args = program.arguments(program.of("CALL"))
    left = args.where("arg_argument_index = 1").select("repo", F.col("id").alias("child"), F.regexp_extract("arg_code", r"""([^.\]\["']+)["'\]]*$""", 1).alias("field"))
    right = args.where("arg_argument_index = 2").select("repo", F.col("id").alias("child"), F.col("arg_id").alias("value_id"), F.col("arg_label").alias("value_label"), F.col("arg_code").alias("value"))
    front = program.arguments(calls).where("arg_label = 'BLOCK'").select("repo", "id", F.lit("").alias("prefix"), F.col("arg_id").alias("at"))
    found = None
    for _ in range(depth):
        inner = front.join(children, ["repo", "at"]).join(node, ["repo", "child"])
        set_ = inner.where(F.col("c_name") == graph.ASSIGNMENT).join(left, ["repo", "child"]).join(right, ["repo", "child"])
        key = F.concat(F.when(F.col("prefix") == "", "").otherwise(F.concat("prefix", F.lit("."))), "field")
        plain = set_.where("value_label <> 'BLOCK'").select("repo", "id", key.alias("key"), "value")
        spread = inner.where(F.col("c_code").startswith("...")).select("repo", "id", F.expr("substring(c_code, 4)").alias("key"), F.lit("").alias("value"))
        step = plain.unionByName(spread)
        found = step if found is None else found.unionByName(step)
        front = set_.where("value_label = 'BLOCK'").select("repo", "id", key.alias("prefix"), F.col("value_id").alias("at"))
    picks = program.arguments(calls).where(full_match(F.col("arg_code"), r"(?s).*\bpick\(.*")).select("repo", "id", F.explode(F.regexp_extract_all("arg_code", F.lit("[\"']([^\"']+)[\"']"), 1)).alias("key"), F.lit("").alias("value"))
    return found.unionByName(picks).distinct()


def pairs_text(pairs: DataFrame) -> DataFrame:
    """(repo, id, arguments): the pairs of a call as one JSON text, ordered by key."""
    own = F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value"))))
    return pairs.groupBy("repo", "id", "key").agg(F.max("value").alias("value")).groupBy("repo", "id").agg(F.to_json(own).alias("arguments"))


def text_pairs(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


# APIs


@dataclass(frozen=True)
class ApiProfile:
    """Which calls of a language are HTTP calls, and what may be an address."""

    hints: bool = True
    on_code: bool = False
    ignored: bool = False
    members: bool = False
    services: bool = False
    optional_quotes: bool = True
    extra: tuple[str, str] | None = None  # patterns on code and name of calls that count beside
    constructors: bool = False


API_PROFILES = {
    "generic": ApiProfile(hints=False, ignored=True, members=True, services=True, optional_quotes=False),
    "go": ApiProfile(hints=False, ignored=True, members=True, services=True, optional_quotes=False),
    "csharp": ApiProfile(hints=False, ignored=True, members=True, services=True, optional_quotes=False),
    "java": ApiProfile(hints=False, ignored=True, members=True, services=True, optional_quotes=False),
    "javascript": ApiProfile(hints=False, on_code=True, ignored=True, members=True, services=True, optional_quotes=False),
    "python": ApiProfile(),
    "ruby": ApiProfile(extra=("(?i).*(client|connection).*[.](get|post|delete|put|patch).*", "get|post|post_json|delete|put|patch")),
    "php": ApiProfile(constructors=True),
}


def http_calls(program: Program, setting, language: str = "generic") -> DataFrame:
    """Calls named like a request whose package is an HTTP library; ``setting`` gives the catalogue's patterns by key."""
    p, libraries, names = API_PROFILES[language], setting("apiHttpLibraries"), setting("apiSinks")
    calls = program.calls().where(~F.col("name").startswith("<init"))
    named = full_match(F.col("name"), names)
    if p.constructors:
        named |= full_match(F.col("method_full_name"), f"(?i).*{names}(->)__construct") & (F.col("name") == "__construct")
    package = by_name_or_hint(libraries) if p.hints else full_match(F.col("method_full_name"), libraries)
    if p.on_code:
        package |= full_match(F.col("code"), libraries)
    test = named & package
    if p.ignored:
        test &= ~full_match(F.col("method_full_name"), setting("ignoredSinks"))
    if p.extra:
        test |= full_match(F.col("code"), p.extra[0]) & full_match(F.col("name"), p.extra[1])
    return calls.where(test)


def api_version(program: Program, setting, imports: DataFrame) -> str:
    """Which form of the Java tagger a program takes: by HTTP calls, by imports alone, or none. One number decides, on the driver."""
    libraries = setting("apiHttpLibraries")
    if http_calls(program, setting, "java").limit(1).count():
        return "V2"
    return "V1" if imports.where(partial_match(F.col("name"), libraries)).limit(1).count() else "skip"


def calls_in_importing_files(program: Program, setting, imports: DataFrame) -> DataFrame:
    """Calls named like a request in files that import an HTTP library, for programs whose full names are not resolved."""
    files = imports.where(partial_match(F.col("name"), setting("apiHttpLibraries"))).select("repo", "file").distinct()
    return program.calls().where(full_match(F.col("name"), setting("apiSinks"))).join(files, ["repo", "file"], "left_semi")


def own_prefixes(program: Program, n: int = 30) -> DataFrame:
    """(repo, prefix, n): first two segments of the first ``n`` methods (by id) of each repository's own; the rank keeps ``n`` rows a repository before its exchange."""
    own = program.of("METHOD").where("not coalesce(is_external, false)")
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("id"))
    first = own.select("repo", "id", "method_full_name").withColumn("_rank", rank).where(F.col("_rank") <= n)  # Spark cuts groups to n rows on both sides of the exchange
    prefix = F.array_join(F.slice(F.split("method_full_name", "[.:]"), 1, 2), ".")
    return first.groupBy("repo", prefix.alias("prefix")).agg(F.count("*").alias("n"))


def addresses(program: Program, properties: DataFrame, rule: Rule, setting, language: str = "generic") -> DataFrame:
    """(repo, id, address) of nodes that may hold the address of an API of the rule: literals, uses of properties, and names like an address."""
    p = API_PROFILES[language]
    quote = "(?:\"|'){0,1}" if p.optional_quotes else "(?:\"|'|`)"
    literal = program.of("LITERAL").where(full_match(F.col("code"), f"{quote}({rule.pattern}){quote}")).select("repo", "id", fn.literal_code(F.col("code")).alias("address"))
    value = full_match(F.col("value"), rule.pattern)
    if p.services:
        value |= full_match(F.col("value"), SERVICE_URL)
    named = setting("apiIdentifier")
    if rule.id != INTERNAL and named:
        value |= full_match(F.col("name"), named)
        like = program.of(*(("IDENTIFIER", "MEMBER") if p.members else ("IDENTIFIER",))).where(full_match(F.col("name"), named))
        literal = literal.unionByName(like.select("repo", "id", F.when(F.col("label") == "MEMBER", F.col("name")).otherwise(fn.literal_code(F.col("code"))).alias("address")))
    used = graph.property_uses(program, properties.where(value)).select("repo", F.col("node_id").alias("id"), F.col("value").alias("address"))
    return literal.unionByName(used).distinct()


def api_sinks(program: Program, calls: DataFrame, seeds: DataFrame, rule: Rule, inferences: Sequence[Rule] = (), properties: DataFrame | None = None, excluded: list[str] | None = None, context: EngineContext = EngineContext(), show: bool = True) -> DataFrame:
    """(repo, id, file, rule_id, api_url) of API calls: those that an address flows to get its domain's rule, the others ``API``.

    Calls that are tagged already are left out. An internal rule tags only what an address reaches.
    """
    open_calls = program.untagged(program.untagged(calls, "API_URL_MARKED"), "nodeType", "api")
    kept = flows.unique_paths(reach_by_calls(program, seeds.select("repo", "id").distinct(), open_calls.select("repo", "id"), context=context))
    hit = kept.select("repo", F.col("source").alias("seed"), F.col("sink").alias("id")).distinct().join(seeds.withColumnRenamed("id", "seed"), ["repo", "seed"]).select("repo", "id", "address").distinct()
    own = open_calls.select("repo", "id", "file")
    if rule.id == INTERNAL:
        return own.join(hit, ["repo", "id"]).select("repo", "id", "file", F.lit(rule.id).alias("rule_id"), F.col("address").alias("api_url"))
    domain = inferred_domain(fn.service_domain(F.col("address")), inferences)
    with_domain = own.join(hit, ["repo", "id"]).select("repo", "id", "file", F.concat_ws(".", F.lit(rule.id), domain).alias("rule_id"), F.col("address").alias("api_url"))
    if not show:
        return with_domain
    rest = own.join(hit.select("repo", "id").distinct(), ["repo", "id"], "left_anti").select("repo", "id", "file", F.lit(rule.id).alias("rule_id"), F.lit(API).alias("api_url"))
    return with_domain.unionByName(rest)


def inferred_domain(domain: Column, inferences: Sequence[Rule]) -> Column:
    """The domain that the first matching inference names, else the domain itself."""
    out = None
    for r in inferences:
        if r.cat_two == "api_endpoint" and r.domains and r.filter_property == "endpoint_domain_with_literal":
            hit = full_match(domain, r.pattern)
            out = F.when(hit, r.domains[0]) if out is None else out.when(hit, r.domains[0])
    return domain if out is None else out.otherwise(domain)


def api_tags(found: DataFrame) -> DataFrame:
    """The address of each API sink as a tag named by its rule."""
    return found.select("repo", F.col("id").alias("node_id"), F.concat(F.lit("apiUrl"), "rule_id").alias("name"), F.col("api_url").alias("value")).distinct()


def by_full_name(program: Program, pattern: str) -> DataFrame:
    """Marks of calls that the configuration names as APIs."""
    return mark(program.calls().where(full_match(F.col("method_full_name"), pattern)), "API_SINK_MARKED")


def inferred_endpoints(program: Program, properties: DataFrame, inferences: Sequence[Rule]) -> DataFrame:
    """(repo, id, rule_id, api_url) of calls whose endpoint an inference names outright, or by the property of that name."""
    by_literal = [r for r in inferences if r.cat_two == "api_endpoint" and r.filter_property == "method_full_name_with_literal"]
    by_property = [r for r in inferences if r.cat_two == "api_endpoint" and r.filter_property == "method_full_name_with_property_name"]
    head = lambda r: r.domains[0] if r.domains else ""
    calls = program.calls()
    out = tagging.match_rows(calls, [(head(r), by_name_or_hint(r.pattern)) for r in by_literal]).select("repo", "id", F.col("rule_id").alias("api_url"))
    named = tagging.match_rows(calls, [(head(r), by_name_or_hint(r.pattern)) for r in by_property]).select("repo", "id", F.col("rule_id").alias("name"))
    value = properties.groupBy("repo", "name").agg(F.min_by("value", "id").alias("api_url"))
    both = out.unionByName(named.join(value, ["repo", "name"]).select("repo", "id", "api_url"))
    return both.select("repo", "id", F.concat_ws(".", F.lit(THIRD_PARTY), fn.url_host(F.col("api_url"))).alias("rule_id"), "api_url").distinct()


def template_apis(dom: DataFrame, rule: Rule, identifier: str) -> DataFrame:
    """(…, rule_id, api_url) of script and iframe elements (name, code) that load from an address of the rule, or name one."""
    wanted = rf'(?i)["]*<(script|iframe).*({rule.pattern}|{identifier}).*' if identifier else rf'(?i)["]*<(script|iframe).*({rule.pattern}).*'
    found = dom.where(full_match(F.col("name"), "(?i)(jsxElement|HTMLElement)") & full_match(F.col("code"), wanted, True))
    url, domain = fn.template_url(F.col("code")), fn.template_domain(F.col("code"))
    named = fn.identifier_in(F.col("code"), identifier) if identifier else F.lit(None).cast("string")
    part = F.when(domain != fn.UNKNOWN_DOMAIN, domain).otherwise(named)
    out = found.withColumns({"_part": part, "api_url": F.when(domain != fn.UNKNOWN_DOMAIN, url).otherwise(named)}).where("_part is not null")
    rule_id = F.lit(rule.id) if rule.id == INTERNAL else F.concat_ws(".", F.lit(rule.id), "_part")
    return out.withColumn("rule_id", rule_id).drop("_part")


def script_calls(program: Program, rule: Rule) -> DataFrame:
    """Calls that load an external script, with the address in their code."""
    calls = program.calls().where(F.col("name").isin("loadExternalScript", "loadThirdPartyScript"))
    url, domain = fn.template_url(F.col("code")), fn.template_domain(F.col("code"))
    return calls.select("repo", "id", "file", (F.lit(rule.id) if rule.id == INTERNAL else F.concat_ws(".", F.lit(rule.id), domain)).alias("rule_id"), url.alias("api_url"))


def graphql_apis(program: Program, packages: str, reads: str, writes: str, rule: Rule) -> DataFrame:
    """Calls of a GraphQL client as reading, writing or plain API."""
    kind = F.when(full_match(F.col("name"), reads), "(Read)").when(full_match(F.col("name"), writes), "(Write)").otherwise("")
    return program.calls().where(full_match(F.col("method_full_name"), packages)).select("repo", "id", "file", F.concat(F.lit(rule.id), kind).alias("rule_id"), F.concat(F.lit(API), kind).alias("api_url"))


STREAM = "(?i)(.*)(StreamObserver)(.*)"
STUB = "(?i)(.*)(stub)(.*)"


def grpc_endpoints(program: Program) -> DataFrame:
    """Methods with a stream observer for a parameter that they complete."""
    own = program.out(program.of("PARAMETER").where(full_match(F.col("type_full_name"), STREAM)), "AST", back=True).where("label = 'METHOD'")
    args = program.arguments(program.calls().where("name = 'onCompleted'"))
    one = args.groupBy("repo", "id").agg(F.count("*").alias("n"), F.bool_or(full_match(F.col("arg_type_full_name"), STREAM)).alias("stream")).where("n = 1 and stream")
    inside = program.hop(one.select("repo", "id"), "CONTAINS", to="method", back=True).select("repo", F.col("method").alias("id")).distinct()
    return own.join(inside, ["repo", "id"], "left_semi")


def grpc_sinks(program: Program) -> DataFrame:
    """Calls of a gRPC endpoint's name on one of its parameter types, on a stub or an unknown type, and two-argument calls on a stub; none inside ``onNext``."""
    endpoints = grpc_endpoints(program).select("repo", "name", F.col("id").alias("method_id"))
    typed = program.hop(endpoints, "AST", key="method_id", to="parameter").join(program.of("PARAMETER").select("repo", F.col("id").alias("parameter"), F.col("type_full_name").alias("type")), ["repo", "parameter"]).select("repo", "name", "type").distinct()
    args = program.arguments(program.calls())
    held = args.where("arg_label = 'IDENTIFIER'").select("repo", "id", F.col("arg_type_full_name").alias("type"))
    calls = program.calls().select("repo", "id", "name").join(endpoints.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    by_type = calls.join(held, ["repo", "id"]).join(typed, ["repo", "name", "type"], "left_semi").select("repo", "id")
    by_stub = calls.join(held.where((F.col("type") == "ANY") | full_match(F.col("type"), STUB)), ["repo", "id"], "left_semi").select("repo", "id")
    two = args.groupBy("repo", "id").agg(F.count("*").alias("n"), F.bool_or((F.col("arg_label") == "CALL") & full_match(F.col("arg_type_full_name"), STUB)).alias("stub")).where("n = 2 and stub").select("repo", "id")
    stub_calls = program.calls().where(~F.lower("name").contains("operator")).select("repo", "id").join(two, ["repo", "id"], "left_semi")
    every = by_type.unionByName(by_stub).unionByName(stub_calls).distinct()
    sent = graph.climb(program, program.calls().join(every, ["repo", "id"], "left_semi"), F.col("name") == "onNext", "ARGUMENT").where("found").select("repo", "id")
    return program.calls().join(every.join(sent, ["repo", "id"], "left_anti"), ["repo", "id"], "left_semi")


def soap_methods(program: Program) -> DataFrame:
    """Methods of types annotated as web services."""
    return program.out(graph.types_annotated(program, "WebService"), "AST").where("label = 'METHOD'")


def callers(program: Program, methods: DataFrame) -> DataFrame:
    return program.out(methods, "CALL", back=True).where("label = 'CALL'")


URL_PARAMETER = "(?i).*(url|endpoint)"


def _url_methods(program: Program) -> DataFrame:
    """(repo, method_id, name, code, mark): methods with a parameter after the first whose annotation names a url or endpoint."""
    marks = program.of("ANNOTATION").where(full_match(F.regexp_replace("code", r"""[\s"')]+$""", ""), URL_PARAMETER))
    params = program.out(marks, "AST", back=True).where("label = 'PARAMETER' and argument_index <> 0")
    return program.out(params, "AST", back=True).where("label = 'METHOD'")


def _client_types(methods: DataFrame) -> DataFrame:
    """(repo, method_id, type): what a method makes: its class for a constructor, else what it returns."""
    made = F.when(F.col("name") == "<init>", F.regexp_extract("method_full_name", r"^(.*?)[.]<init", 1)).otherwise(F.regexp_extract("type_full_name", r"^[^(]*", 0))
    return methods.select("repo", F.col("id").alias("method_id"), made.alias("type")).where("type <> ''")


def _uses_of_clients(program: Program, clients: DataFrame) -> DataFrame:
    """(repo, method_id, id): calls on fields that are members of a client's type, in the member's file."""
    members = program.of("MEMBER").select("repo", "file", F.col("name").alias("field"), F.col("type_full_name").alias("type"))
    access = program.field_accesses().select("repo", "file", "field", F.col("id").alias("access"))
    held = clients.join(members, ["repo", "type"]).join(access, ["repo", "file", "field"])
    up = program.hop(held.select("repo", "method_id", "access"), "ARGUMENT", key="access", to="id", back=True)
    return up.join(program.calls().select("repo", "id"), ["repo", "id"], "left_semi").select("repo", "method_id", "id").distinct()


def apis_by_parameter(program: Program) -> DataFrame:
    """(repo, method_id, id): calls of clients whose making takes an address: by what makes them, or by a constructor that takes what was made."""
    methods = _url_methods(program)
    direct = _client_types(methods.where("name <> '<init>'"))
    config = _client_types(methods.where("name = '<init>'"))
    params = program.of("PARAMETER").where("argument_index <> 0").select("repo", F.col("id").alias("p"), F.col("type_full_name").alias("type"))
    makers = program.of("METHOD").where("name = '<init>'")

    def takers(types: DataFrame) -> DataFrame:
        up = program.hop(types.join(params, ["repo", "type"]).select("repo", "method_id", "p"), "AST", key="p", to="id", back=True)
        made = up.join(makers.select("repo", "id", "method_full_name"), ["repo", "id"])
        return made.select("repo", "method_id", F.regexp_extract("method_full_name", r"^(.*?)[.]<init", 1).alias("type")).distinct()

    held = program.of("MEMBER").select("repo", F.col("type_full_name").alias("type")).distinct()
    first = takers(config)
    second = takers(first.join(held, ["repo", "type"], "left_anti")).join(held, ["repo", "type"], "left_semi")
    return _uses_of_clients(program, direct.unionByName(first.join(held, ["repo", "type"], "left_semi")).unionByName(second).distinct())


def apis_by_marked_parameter(program: Program) -> DataFrame:
    """(repo, method_id, id): as ``apis_by_parameter``, the client's maker found by the annotation that the provider bears."""
    own = program.hop(_url_methods(program).select("repo", F.col("id").alias("method_id")), "AST", key="method_id", to="mark_id")
    marks = program.of("ANNOTATION").select("repo", F.col("id").alias("mark_id"), "code")
    provider = own.join(marks, ["repo", "mark_id"]).where(~full_match(F.col("code"), "@(Inject|Provides|Singleton)")).select("repo", "method_id", "code").distinct()
    on_parameter = program.hop(marks, "AST", key="mark_id", to="p", back=True).join(program.of("PARAMETER").select("repo", F.col("id").alias("p")), ["repo", "p"], "left_semi")
    taker = program.hop(on_parameter.select("repo", F.col("code").alias("mark"), "p"), "AST", key="p", to="id", back=True).join(program.of("METHOD"), ["repo", "id"])
    made = F.when(F.col("name") == "<init>", F.regexp_extract("method_full_name", r"^(.*?)[.]<init", 1)).otherwise(F.regexp_extract("type_full_name", r"^[^(]*", 0))
    clients = taker.select("repo", "mark", made.alias("type")).join(provider.withColumnRenamed("code", "mark"), ["repo", "mark"]).select("repo", "method_id", "type").where("type <> ''").distinct()
    return _uses_of_clients(program, clients)


def apis_by_returning_method(program: Program) -> DataFrame:
    """(repo, method_id, id): marked API calls and the methods that return the type they are called on."""
    marked = program.tagged(program.calls(), "API_SINK_MARKED").withColumn("type", F.regexp_extract(F.regexp_extract("method_full_name", r"^[^:(]*", 0), r"^(.*)[.][^.]*$", 1)).where("type <> ''")
    makers = program.of("METHOD").select("repo", F.col("id").alias("method_id"), F.regexp_extract("type_full_name", r"^[^:(]*", 0).alias("type"))
    return marked.select("repo", "id", "type").join(makers, ["repo", "type"]).select("repo", "method_id", "id").distinct()


def apis_with_method_urls(program: Program, found: DataFrame, pattern: str, properties: DataFrame) -> DataFrame:
    """(repo, id, rule_id, api_url): API calls with the first address in the method that makes their client: a literal, or a property used there; else API."""
    inside = program.hop(found.select("repo", "method_id").distinct(), "CONTAINS", key="method_id", to="node_id")
    literal = program.of("LITERAL").where(full_match(fn.unquoted(F.col("code")), pattern)).select("repo", F.col("id").alias("node_id"), fn.unquoted(F.col("code")).alias("url"))
    used = graph.property_uses(program, properties.where(full_match(F.col("value"), pattern))).select("repo", "node_id", F.col("value").alias("url"))
    url = inside.join(literal.unionByName(used), ["repo", "node_id"]).groupBy("repo", "method_id").agg(F.min_by("url", "node_id").alias("url"))
    out = found.join(url, ["repo", "method_id"], "left")
    return out.select("repo", "id", F.when(F.col("url").isNull(), THIRD_PARTY).otherwise(F.concat_ws(".", F.lit(THIRD_PARTY), fn.service_domain(F.col("url")))).alias("rule_id"), F.coalesce("url", F.lit(API)).alias("api_url")).distinct()


def retrofit_apis(program: Program) -> DataFrame:
    """(repo, id, api_url): calls of the service class of ``create(X.class)`` with the address that ``baseUrl`` in its chain is given; null if that is no literal."""
    create = program.calls().where((F.col("name") == "create") & F.col("code").contains("class"))
    base = graph.climb(program, create, F.col("name") == "baseUrl", "RECEIVER_OF").where("found").select("repo", F.col("id").alias("create_id"), F.col("reached").alias("id"))
    last = program.arguments(base.select("repo", "id").distinct()).groupBy("repo", "id").agg(F.max_by(F.struct("arg_label", "arg_code"), "arg_argument_index").alias("a"))
    service = program.arguments(create).where(F.col("arg_name") == graph.FIELD_ACCESS[0]).groupBy("repo", F.col("id").alias("create_id")).agg(F.min(F.regexp_replace("arg_code", r"(\.class|::class\.java)$", "")).alias("service"))
    named = base.join(last, ["repo", "id"]).join(service, ["repo", "create_id"]).select("repo", "service", F.when(F.col("a.arg_label") == "LITERAL", fn.unquoted(F.col("a.arg_code"))).alias("api_url"))
    calls = program.calls().where("name <> 'getClass'").select("repo", "id", F.regexp_extract("method_full_name", r"([A-Za-z_$][\w$]*)[.][^.:(]*(?:[:(].*)?$", 1).alias("service"))
    return calls.join(named, ["repo", "service"]).select("repo", "id", "api_url").distinct()


def feign_apis(program: Program, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(sinks with rule_id and api_url, calls of clients without an address, which the API tagger takes on).

    A client's address is the ``url`` of its annotation; ``${a.b}`` stands for a_b. Clients by ``RequestLine`` have none.
    """
    marks = program.of("ANNOTATION").where("name = 'FeignClient'").select("repo", F.col("id").alias("mark_id"), F.regexp_extract("code", r'url\s*=\s*"([^"]*)"', 1).alias("url"))
    own = program.hop(marks, "AST", key="mark_id", to="type_id", back=True)
    lines = program.out(program.of("ANNOTATION").where("name = 'RequestLine'"), "AST", back=True).where("label = 'METHOD'")
    by_line = program.out(lines, "AST", back=True).where("label = 'TYPE_DECL'").select("repo", F.col("id").alias("type_id"))
    types = own.select("repo", "type_id", "url").unionByName(by_line.withColumn("url", F.lit(""))).groupBy("repo", "type_id").agg(F.max("url").alias("url"))
    methods = program.hop(types, "AST", key="type_id", to="method_id").join(program.of("METHOD").select("repo", F.col("id").alias("method_id")), ["repo", "method_id"], "left_semi")
    calls = program.hop(methods.select("repo", "url", "method_id"), "CALL", key="method_id", to="id", back=True).select("repo", "id", "url").distinct().join(program.calls().select("repo", "id", "file"), ["repo", "id"])
    with_url = calls.where("url <> ''")
    variable = F.col("url").startswith("${")
    url = F.when(variable, F.replace(F.regexp_replace("url", r"^\$\{|\}$", ""), F.lit("."), F.lit("_"))).otherwise(F.col("url"))
    known = variable | full_match(F.col("url"), rule.pattern)
    if rule.id == INTERNAL:
        out = with_url.where(full_match(F.col("url"), rule.pattern)).select("repo", "id", "file", F.lit(rule.id).alias("rule_id"), F.col("url").alias("api_url"))
    else:
        out = with_url.select("repo", "id", "file", F.when(known, F.concat_ws(".", F.lit(rule.id), fn.url_host(url))).otherwise(F.lit(rule.id)).alias("rule_id"), F.when(known, url).otherwise(F.lit(API)).alias("api_url"))
    return out, calls.where("url = ''").select("repo", "id", "file")


# Classes, annotations, feeders


def of_extending_classes(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """Calls of classes that extend a match of a rule's first pattern (two levels), whose operation its second pattern names."""
    return _class_calls(program, [(r, graph.inherits_closure(program, r.patterns[0]).select("repo", "type_full_name")) for r in rules])


def of_annotated_classes(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """As ``of_extending_classes``, of classes annotated by a match and of those that extend them."""
    parts = []
    for r in rules:
        one = graph.types_annotated(program, r.patterns[0]).select("repo", "type_full_name")
        up = program.of("TYPE_DECL").select("repo", F.col("type_full_name").alias("child"), F.explode("inherits").alias("type_full_name"))
        parts.append((r, one.unionByName(up.join(one, ["repo", "type_full_name"], "left_semi").select("repo", F.col("child").alias("type_full_name"))).distinct()))
    return _class_calls(program, parts)


def _class_calls(program: Program, parts: list[tuple[Rule, DataFrame]]) -> DataFrame:
    calls = program.calls().withColumns({"type_full_name_of": F.regexp_extract("method_full_name", r"^(.*?)[.:][^.:]*(?:[:(].*)?$", 1), "_operation": F.regexp_extract("method_full_name", r"[.:]([^.:(]*)(?:[:(].*)?$", 1)})
    out = None
    for r, types in parts:
        own = types.select("repo", F.col("type_full_name").alias("type_full_name_of"))
        found = calls.where(full_match(F.col("_operation"), r.patterns[1])).join(own, ["repo", "type_full_name_of"], "left_semi").withColumn("rule_id", F.lit(r.id))
        out = found if out is None else out.unionByName(found)
    return out.select("repo", "id", "file", "rule_id").distinct()


def of_model_classes(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """Ruby: calls whose first argument is a class of a models file, by operation; writes compare names without case and underscores; scopes by the name that a class gives them."""
    args = program.arguments(program.calls()).groupBy("repo", "id").agg(F.min_by(F.struct("arg_label", "arg_name", "arg_code"), "arg_argument_index").alias("a"))
    calls = program.calls().join(args, ["repo", "id"]).where("a.arg_label = 'IDENTIFIER'").withColumn("on", F.col("a.arg_name"))
    out = []
    for r in rules:
        types = program.of("TYPE_DECL").where(full_match(F.col("file"), r.patterns[0]))
        names = types.select("repo", F.col("name").alias("on")).distinct()
        if r.id.endswith(".Write"):
            low = names.select("repo", F.lower("on").alias("_low")).distinct()
            found = calls.where(full_match(F.col("name"), r.patterns[1])).withColumn("_low", F.lower(F.replace("on", F.lit("_"), F.lit("")))).join(low, ["repo", "_low"], "left_semi")
        elif r.id.endswith(".Read"):
            found = calls.where(full_match(F.col("name"), r.patterns[1])).join(names, ["repo", "on"], "left_semi")
        else:
            given = program.arguments(program.calls().where(F.col("name") == "scope").join(types.select("repo", "file").distinct(), ["repo", "file"], "left_semi")).where("arg_label = 'LITERAL'")
            scopes = given.select("repo", F.regexp_replace("arg_code", "^:", "").alias("name")).distinct()
            found = calls.join(scopes, ["repo", "name"], "left_semi").join(names, ["repo", "on"], "left_semi")
        out.append(found.select("repo", "id", "file", F.lit(r.id).alias("rule_id")))
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first.distinct()


def _sink(rule_id: str, name: str, domain: str, on: str, operation: str, two: str = "storages", language: str = "unknown") -> Rule:
    return Rule(rule_id, (on, operation), name=name, domains=(domain,) if domain else (), cat_one="sinks", cat_two=two, language=language)


# Rules that come with the engine. The first pattern is a class, annotation, file or call, the second an operation.
_JPA = "org[.]springframework[.]data[.]repository[.]PagingAndSortingRepository|org[.]springframework[.]data[.]repository[.]CrudRepository|org[.]springframework[.]data[.]jpa[.]repository[.]support[.]SimpleJpaRepository|org[.]springframework[.]data[.]jpa[.]repository[.]JpaRepository|.*ReactiveCrudRepository.*"
_MONGO = "(?i)(org[.]springframework[.]data[.]mongodb[.]repository[.](MongoRepository|support[.]SimpleMongoRepository))"
_MORPHIA = "(?i)(.*[.]morphia[.]dao[.]BasicDAO.*)"
_SQLITE = "(?i)(android[.]database[.]sqlite[.]SQLiteOpenHelper)"
_ALCHEMY = "sqlalchemy/.*/declarative.py:<module>.declarative_base.<returnValue>"
JAVA_CLASSES = (
    _sink("Sinks.Database.JPA.Read", "JPA Repository(Read)", "springframework.org", _JPA, "(find|get).*", language="java"),
    _sink("Sinks.Database.JPA.Write", "JPA Repository(Write)", "springframework.org", _JPA, "(save|delete).*", language="java"),
    _sink("Storages.MongoDB.SpringFramework.Read", "MongoDB(Read)", "mongodb.com", _MONGO, "(?i)(find|count|exists).*", language="java"),
    _sink("Storages.MongoDB.SpringFramework.Write", "MongoDB(Write)", "mongodb.com", _MONGO, "(?i)(insert|save|delete).*", language="java"),
    _sink("Storages.MongoDB.Morphia.BasicDao.Read", "MongoDB(Read)", "mongodb.com", _MORPHIA, "(?i)(count|createQuery|exists|find|get).*", language="java"),
    _sink("Storages.MongoDB.Morphia.BasicDao.Write", "MongoDB(Write)", "mongodb.com", _MORPHIA, "(?i)(delete|save|update).*", language="java"),
    _sink("Storages.Android.SQLite.SQLiteOpenHelper.Read", "SQLite(Read)", "sqlite.com", _SQLITE, "(query|rawQuery).*", language="java"),
    _sink("Storages.Android.SQLite.SQLiteOpenHelper.Write", "SQLite(Write)", "sqlite.com", _SQLITE, "(delete|update|replace|insert|execSQL|execPerConnectionSQL|compileStatement).*", language="java"),
)
PYTHON_CLASSES = (
    _sink("Storages.Framework.Tortoise.Read", "Tortoise(Read)", "", "(?i)tortoise/models.py:<module>.Model", "(filter|all|first)", language="python"),
    _sink("Storages.Framework.Tortoise.Write", "Tortoise(Write)", "", "(?i)tortoise/models.py:<module>.Model", "(create|get_or_create)", language="python"),
    _sink("Storages.Framework.DjangoDB.Write", "DjangoDB(Write)", "", "(?i)django/db/models.py:<module>.Model", "(save|create)", language="python"),
    _sink("Storages.Framework.DjangoDB.Read", "DjangoDB(Read)", "", "(?i)django/db/models.py:<module>.Model", "(filter|get)", language="python"),
    _sink("Storages.Framework.SQLAlchemy.Read", "SQLAlchemy(Read)", "", _ALCHEMY, "(all|get|one|one_or_none|query)", language="python"),
    _sink("Storages.Framework.SQLAlchemy.Write", "SQLAlchemy(Write)", "", _ALCHEMY, "(add_columns|gen_columns|create_all)", language="python"),
)
RUBY_CLASSES = (
    _sink("Sink.DataBase.ROR.Read", "Ruby on Rails Repository(Read)", "", ".*/models/.*", "(find.*|where|select)", language="ruby"),
    _sink("Sink.DataBase.ROR.Write", "Ruby on Rails Repository(Write)", "", ".*/models/.*", "save|update.*", language="ruby"),
    _sink("Sink.DataBase.ROR.ReadAndWrite", "Ruby on Rails Repository(ReadAndWrite)", "", ".*/models/.*", "", language="ruby"),
)
RUBY_LEAKAGES = tuple(_sink(f"Sink.Leakages.Log.{k}", f"Log {k}", "", "log.*", k.lower(), "leakages", "ruby") for k in ("Info", "Error", "Debug"))
KOTLIN_ANNOTATED = (
    _sink("Sinks.Database.Persistence.Room.Read", "Android Persistence Room(Read)", "android.com", "Dao", "(?i)(find|get|select|search|all|load).*", language="kotlin"),
    _sink("Sinks.Database.Persistence.Room.Write", "Android Persistence Room(Write)", "android.com", "Dao", "(?i)(save|delete|insert|update).*", language="kotlin"),
)
GO_COLLECTION = Rule("", (), cat_one="collections", cat_two="default", language="go")
FLINK_PRODUCER = Rule("ThirdParties.ApacheFlink.Custom.Producer", ("addSink",), name="Apache Flink Producer", domains=("flink.apache.org",), cat_one="sinks", cat_two="third_parties", language="java")
AIRFLOW_CUSTOM = Rule("Airflow.Custom.Operator", ("AirflowOperator",), name="Airflow", cat_one="sinks", cat_two="third_parties", language="python", is_generated=True)


def inherit_sinks(program: Program, language: str) -> DataFrame:
    """The sinks of a language's storage classes by the rules that come with the engine."""
    if language == "ruby":
        return of_model_classes(program, RUBY_CLASSES)
    if language == "kotlin":
        return of_annotated_classes(program, KOTLIN_ANNOTATED).unionByName(of_extending_classes(program, JAVA_CLASSES))
    return of_extending_classes(program, {"java": JAVA_CLASSES, "python": PYTHON_CLASSES}[language])


def leakages_by_receiver(program: Program, rules: Sequence[Rule] = RUBY_LEAKAGES) -> DataFrame:
    """Calls named by a rule's second pattern whose first argument is a call that the first pattern names."""
    first = program.arguments(program.calls()).groupBy("repo", "id").agg(F.min_by(F.struct("arg_label", "arg_name"), "arg_argument_index").alias("a"))
    calls = program.calls().join(first, ["repo", "id"]).where("a.arg_label = 'CALL'")
    return tagging.match_rows(calls, [(r.id, full_match(F.col("name"), r.patterns[1]) & full_match(F.col("a.arg_name"), r.patterns[0])) for r in rules]).select("repo", "id", "file", "rule_id")


def shared_logs(program: Program, third_party: str = "ThirdParties.SDK.Sentry", logs: str = "Leakages.Log.(Error|Exception)") -> DataFrame:
    """In repositories with a sink of the third party, error and exception logs are sinks of it too."""
    ids = program.tags.where("name = 'id'")
    there = program.tagged(program.calls(), "id", third_party).select("repo").distinct()
    hit = ids.where(full_match(F.col("value"), logs)).select("repo", F.col("node_id").alias("id")).distinct()
    return program.calls().join(hit, ["repo", "id"], "left_semi").join(there, "repo", "left_semi").select("repo", "id", "file", F.lit(third_party).alias("rule_id"))


def consumers(program: Program, jms: str = "Messaging.Service.JMS.Consumer", kafka: str = "Messaging.Queue.Kafka.Consumer") -> DataFrame:
    """Methods that take messages: ``onMessage`` of JMS listeners, and methods annotated as listeners."""
    listener = program.of("TYPE_DECL").where(F.array_contains("inherits", "javax.jms.MessageListener"))
    on_message = program.out(listener, "AST").where("label = 'METHOD' and name = 'onMessage'").select("repo", "id", "file", F.lit(jms).alias("rule_id"))
    for mark_name, rule in (("JmsListener", jms), ("KafkaListener", kafka)):
        own = program.out(program.of("ANNOTATION").where(F.col("name") == mark_name), "AST", back=True).where("label = 'METHOD'")
        on_message = on_message.unionByName(own.select("repo", "id", "file", F.lit(rule).alias("rule_id")))
    return on_message.distinct()


def operators(program: Program, rules: Sequence[Rule]) -> DataFrame:
    """Airflow: calls named by an operator rule, and calls named like a class whose first parent is a base operator."""
    own = [r for r in rules if "ThirdParties.Operator" in r.id]
    named = tagging.match_rows(program.of("CALL"), [(r.id, full_match(F.col("name"), r.pattern)) for r in own]).select("repo", "id", "file", "rule_id")
    custom = program.of("TYPE_DECL").where(full_match(F.try_element_at("inherits", F.lit(1)), ".*BaseOperator.*") & (F.col("name") != "")).select("repo", "name").distinct()
    return named.unionByName(program.of("CALL").join(custom, ["repo", "name"], "left_semi").select("repo", "id", "file", F.lit(AIRFLOW_CUSTOM.id).alias("rule_id")))


# Buckets and databases

BUCKET = r"(?!(^xn--|.+-s3alias$))^[a-z0-9][a-z0-9-]{1,61}[a-z0-9]$"  # fixed value: names of buckets
S3 = "Storages.AmazonS3"
DETAILS = "repo string, rule_id string, db_name string, db_vendor string, db_location string, db_operation string, config_file string"


def _bucket_details(found: DataFrame, operation: Column) -> DataFrame:
    bucket = F.regexp_replace(fn.unquoted(F.col("code")), r"^s3a:\/\/", "")
    rows = found.withColumn("db_name", bucket).where(full_match(bucket, BUCKET))
    return rows.select("repo", "rule_id", "db_name", F.lit("Amazon S3").alias("db_vendor"), F.lit("amazon.com").alias("db_location"), operation.alias("db_operation"), F.lit("").alias("config_file")).distinct()


def java_buckets(program: Program, depth: int = 4) -> DataFrame:
    """Database details of buckets: the literal of a ``bucket("...")`` call at most ``depth`` parents above a tagged call."""
    front = program.tagged(program.calls(), "id", f"{S3}.Read").select("repo", "id", F.lit(f"{S3}.Read").alias("rule_id")).unionByName(program.tagged(program.calls(), "id", f"{S3}.Write").select("repo", "id", F.lit(f"{S3}.Write").alias("rule_id")))
    up = front.withColumnRenamed("id", "at")
    seen = up
    for _ in range(depth):
        up = program.hop(up, "AST", key="at", to="up", back=True).select("repo", "rule_id", F.col("up").alias("at"))
        seen = seen.unionByName(up)
    calls = seen.distinct().join(program.calls().where("name = 'bucket'").select("repo", F.col("id").alias("at")), ["repo", "at"], "left_semi")
    args = program.arguments(calls.select("repo", F.col("at").alias("id")).distinct()).where("arg_argument_index = 1 and arg_label = 'LITERAL'").select("repo", F.col("id").alias("at"), F.col("arg_code").alias("code"))
    return _bucket_details(calls.join(args, ["repo", "at"]), F.element_at(F.split("rule_id", r"\."), -1))


def python_buckets(program: Program) -> DataFrame:
    """Database details of buckets: what is assigned to variables named like a bucket, or given to ``Bucket``, in tagged calls."""
    tagged = program.tagged(program.calls(), "id", f"{S3}.ReadAndWrite")
    args = program.arguments(tagged).where("arg_label = 'IDENTIFIER'").join(tagged.select("repo", "id", F.col("name").alias("call")), ["repo", "id"])
    named = args.where(F.col("arg_name").contains("bucket") | ((F.col("call") == "Bucket") & ~F.col("arg_code").contains("tmp"))).select("repo", F.col("arg_name").alias("variable")).distinct()
    given = program.arguments(program.operators(graph.ASSIGNMENT))
    left = given.where("arg_argument_index = 1 and arg_label = 'IDENTIFIER'").select("repo", "id", F.col("arg_name").alias("variable"))
    right = given.where("arg_argument_index = 2 and arg_label = 'LITERAL'").select("repo", "id", F.col("arg_code").alias("code"))
    found = left.join(right, ["repo", "id"]).join(named, ["repo", "variable"], "left_semi").withColumn("rule_id", F.lit(f"{S3}.ReadAndWrite"))
    return _bucket_details(found, F.lit("Read/Write"))


# Operations and rules of each family of connection strings.
_SPRING = (("Write/Read", "Storages.SpringFramework.Jdbc"), ("Write", "Storages.SpringFramework.Jdbc.Write"), ("Read", "Storages.SpringFramework.Jdbc.Read"), ("Read", "Sinks.Database.JPA.Read"), ("Write", "Sinks.Database.JPA.Write"))
_NEO4J = (("Write/Read", "Storages.Neo4jGraphDatabase"), ("Read", "Storages.Neo4jGraphDatabase.Read"), ("Write", "Storages.Neo4jGraphDatabase.Write"))
DATABASE_RULES = {
    "dynamodb": (("Write", "Storages.AmazonDynamoDB.Write"), ("Read", "Storages.AmazonDynamoDB.Write")),
    "postgresql": (("Write", "Storages.Postgres.ReadAndWrite"), ("Read", "Storages.Postgres.Read")),
    "mongodb": (("Write", "Storages.MongoDB.Write"), ("Read", "Storages.MongoDB.Read")),
    "h2": _SPRING,
    "oracle": _SPRING,
    "jdbc": (*_SPRING, ("Write/Read", "Storages.SpringFramework.Jooq")),
    "spring_mongodb": (("Write", "Storages.MongoDB.SpringFramework.Write"), ("Read", "Storages.MongoDB.SpringFramework.Read")),
    "neo4j": _NEO4J,
    "spring_neo4j": _NEO4J,
}


def _at(text: Column, cut: str, k: int) -> Column:
    """The k-th part (from 0; negative from the end), or null."""
    return F.try_element_at(F.split(text, cut), F.lit(k + 1 if k >= 0 else k))


def database_family(name: Column, value: Column, language: str) -> Column:
    """The family of a property's connection string, or null."""
    if language in ("java", "kotlin"):
        return (
            F.when(value.contains("jdbc:h2"), "h2")
            .when(value.contains("jdbc:oracle"), "oracle")
            .when(value.contains("jdbc:"), "jdbc")
            .when(value.contains("mongodb"), "spring_mongodb")
            .when(name.contains("neo4j.host") & full_match(value, r"(localhost|[^{]*\..*\.[^}]*)"), "neo4j")
            .when(name.contains("neo4j.driver.uri"), "spring_neo4j")
        )
    return F.when(value.contains("dynamodb"), "dynamodb").when(value.contains("postgres:"), "postgresql").when(value.contains("mongo"), "mongodb")


def connection(family: Column, value: Column) -> Column:
    """(vendor, location, name) of a connection string; null fields where it does not have the family's parts."""
    s = lambda vendor, location, name: F.struct(vendor.alias("db_vendor"), location.alias("db_location"), name.alias("db_name"))
    colon = lambda k: _at(value, ":", k)
    slash = lambda k: _at(value, "/", k)
    last = slash(-1)
    plain = _at(last, r"\?", 0)
    hosted = _at(_at(value, "@", -1), "/", 0)
    mem = colon(2) == "mem"
    place = full_match(colon(2), "file|tcp")
    parts = F.size(F.split(value, ":"))
    nothing = F.lit("")
    by_host = s(colon(1), slash(2), _at(slash(3), r"\?", 0))
    return (
        F.when(family == "dynamodb", s(F.lit("dynamodb"), _at(value, r"\.", 1), last))
        .when(family == "postgresql", s(F.lit("postgresql"), hosted, last))
        .when(family == "mongodb", s(F.lit("mongodb"), hosted, plain))
        .when(family == "spring_mongodb", s(_at(colon(0), r"\+", 0), slash(2), _at(slash(3), r"\?", 0)))
        .when(
            family == "h2",
            F.when(parts == 3, s(colon(1), colon(2), plain))
            .when(mem, s(colon(1), F.lit("In-memory"), colon(3)))
            .when(place, s(colon(1), F.concat(colon(2), F.lit(":"), _at(colon(3), ";", 0)), _at(plain, ";", 0)))
            .otherwise(s(colon(1), nothing, nothing)),
        )
        .when(family == "oracle", s(colon(1), F.concat(_at(colon(3), "@", 1), F.lit(":"), _at(colon(4), "/", 0)), F.when(parts == 5, _at(colon(4), "/", 1)).otherwise(colon(5))))
        .when(family == "jdbc", by_host)
        .when(family == "neo4j", s(F.lit("bolt"), value, F.lit("Neo4j Graph Database")))
        .when(family == "spring_neo4j", s(colon(0), slash(2), F.lit("Neo4j Graph Database")))
    )


def database_details(properties: DataFrame, language: str, strict_parity: bool = False) -> DataFrame:
    """One row of database details for each rule: the one of the highest priority, then of the first file and value.

    With ``strict_parity`` the first one stays, whatever its priority; a write rule of DynamoDB then stands for reads too, as ever.
    """
    family = database_family(F.col("name"), F.col("value"), language)
    found = properties.where("name <> '' and value <> ''").withColumn("family", family).where("family is not null").withColumn("c", connection(F.col("family"), F.col("value")))
    found = found.where("c.db_vendor is not null and c.db_location is not null and c.db_name is not null")
    pairs = F.create_map(*[x for k, rules in DATABASE_RULES.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(o).alias("op"), F.lit(r).alias("rule")) for o, r in rules]))])
    each = found.select("repo", "id", "file", "value", "c", F.posexplode(F.element_at(pairs, F.col("family"))).alias("ord", "r"))
    rank = fn.config_priority(F.col("value"), F.col("file"))
    first = F.struct("id", "ord")
    best = F.struct((-rank).alias("rank"), "id", "ord")
    row = F.min_by(F.struct("c.*", F.col("r.op").alias("db_operation"), F.col("file").alias("config_file")), first if strict_parity else best)
    return each.groupBy("repo", F.col("r.rule").alias("rule_id")).agg(row.alias("d")).select("repo", "rule_id", "d.db_name", "d.db_vendor", "d.db_location", "d.db_operation", "d.config_file")


def merge_details(details: DataFrame) -> DataFrame:
    """Details of one rule from several readers: each once, and the tables of their schemas as one list."""
    return details.groupBy("repo", "rule_id", "db_name", "db_vendor", "db_location", "db_operation", "config_file").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tables", F.array().cast("array<string>")))))).alias("tables"))


def detail_tags(sinks: DataFrame, details: DataFrame) -> DataFrame:
    """The database of each sink's rule as tags of the sink."""
    own = sinks.select("repo", "id", "rule_id").join(details, ["repo", "rule_id"])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("dbName", "db_name"), ("dbVendor", "db_vendor"), ("dbLocation", "db_location"), ("dbOperation", "db_operation"))])
    return own.select("repo", F.col("id").alias("node_id"), F.explode(pairs).alias("t")).select("repo", "node_id", "t.name", "t.value").distinct()


# Dependencies and modules


def dependency_tags(dependencies: DataFrame, info: DataFrame) -> DataFrame:
    """Dependency nodes (repo, id, name, file) with the rule of the information of that name and file; the first node of each."""
    first = dependencies.groupBy("repo", "name", "file").agg(F.min("id").alias("id"))
    return first.join(info.select("repo", "name", "file", "rule_id").distinct(), ["repo", "name", "file"]).select("repo", "id", "file", "rule_id")


# What a category of rules is called among libraries.
CATEGORIES = {"third_parties": "Know Third Party", "storages": "Storage", "leakages": "Leakage", "collection": "Collection", "web_client": "Web Client", "utility": "Utility"}
UNKNOWN_LIBRARY = "Unknown"


def dependency_categories(modules: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Module dependencies (group_id, artifact_id) with each rule that ``group:artifact`` matches, and the category; unknown without one."""
    name = F.concat_ws(":", "group_id", "artifact_id")
    found = tagging.match_rows(modules.select("group_id", "artifact_id").distinct(), [(r.id, full_match(name, r.pattern)) for r in rules])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.id, CATEGORIES.get(r.cat_two, UNKNOWN_LIBRARY))]) if rules else F.create_map().cast("map<string,string>")
    rows = found.withColumn("category", F.try_element_at(kinds, F.col("rule_id")))
    return modules.join(rows, ["group_id", "artifact_id"], "left").withColumn("category", F.coalesce("category", F.lit(UNKNOWN_LIBRARY)))


def module_family(modules: DataFrame) -> DataFrame:
    """(repo, child, parent): modules and the module that their parent names."""
    p = modules.select("repo", F.col("artifact_id").alias("parent_artifact_id"), F.col("group_id").alias("parent_group_id"), F.col("file").alias("parent"))
    return modules.join(p, ["repo", "parent_group_id", "parent_artifact_id"]).select("repo", F.col("file").alias("child"), "parent")


# Calls that Rails has built in.
RAILS_MODELS = frozenset(
    "accepts_nested_attributes_for after_commit after_find after_initialize after_save attr_accessible attr_protected before_commit before_destroy before_save belong_to belongs_to concerns counter_cache default_scope dependent enum "
    "has_and_belongs_to_many has_many has_one has_paper_trail has_secure_password pluck polymorphic scope serialize touch transaction validates validates_format_of validates_length_of validates_numericality_of validates_uniqueness_of validates_presence_of".split()
)
RAILS_CONTROLLERS = frozenset(("before_action", "respond_to", "respond_with", "render", "redirect_to"))


def rails_full_names(program: Program, prefix: str = "RubyOnRailsBuiltIn") -> DataFrame:
    """Calls with a full name: in models and controllers, those that Rails has built in."""
    in_models = F.col("file").contains("/models/") & F.col("name").isin(sorted(RAILS_MODELS))
    in_controllers = F.col("file").contains("/controllers/") & F.col("name").isin(sorted(RAILS_CONTROLLERS))
    return program.of("CALL").withColumn("method_full_name", F.when(in_models | in_controllers, F.concat_ws(".", F.lit(prefix), "name")).otherwise(F.col("method_full_name")))


def package_full_names(calls: DataFrame, packages: DataFrame) -> DataFrame:
    """Calls with the package method (package, method) of their name where it has none of its own; the first package by name."""
    first = packages.groupBy(F.col("method").alias("name")).agg(F.min("package").alias("_package"))
    full = F.coalesce(F.col("method_full_name"), F.lit(""))
    joined = calls.join(first, "name", "left")
    return joined.withColumn("method_full_name", F.when(full.isin("", "<unknownFullName>") & F.col("_package").isNotNull(), F.concat_ws(".", "_package", "name")).otherwise(F.col("method_full_name"))).select(*calls.columns)


def synced_sinks(sinks: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Sinks of a data sync (actual_destination_name, schedule_paused) that are not paused, by destination."""
    return tagging.match_rows(sinks.where("not schedule_paused"), [(r.id, full_match(F.col("actual_destination_name"), r.pattern)) for r in rules])


# Streams of Flink programs

FLINK_SINK = "addSink"
FLINK_PARENT = ".*(Sink|SinkFunction|RichSinkFunction)(<.*>)?"


def copy_tags(program: Program, pairs: DataFrame) -> DataFrame:
    """All tags of ``from_id`` for ``to_id``."""
    return pairs.select("repo", F.col("from_id").alias("node_id"), "to_id").join(program.tags, ["repo", "node_id"]).select("repo", F.col("to_id").alias("node_id"), "name", "value").distinct()


def _method_of(program: Program, nodes: DataFrame, key: str) -> DataFrame:
    return program.hop(nodes, "CONTAINS", key=key, to="method_id", back=True)


def flink_connectors(program: Program, rule_ids: str = "") -> DataFrame:
    """Calls tagged as sinks, only those of the configured connector rules if there are any."""
    calls = program.tagged(program.calls(), "catLevelOne", "sinks")
    if not rule_ids:
        return calls
    own = program.tags.where((F.col("name") == "id") & full_match(F.col("value"), rule_ids)).select("repo", F.col("node_id").alias("id")).distinct()
    return calls.join(own, ["repo", "id"], "left_semi")


def _flink_sinks(program: Program) -> DataFrame:
    return _method_of(program, program.calls().where(F.col("name") == FLINK_SINK).select("repo", F.col("id").alias("to_id")), "to_id")


def flink_default(program: Program, rule_ids: str = "") -> DataFrame:
    """Tags of built-in connectors for the sinks of the same method."""
    own = _method_of(program, flink_connectors(program, rule_ids).select("repo", F.col("id").alias("from_id")), "from_id")
    return copy_tags(program, own.join(_flink_sinks(program), ["repo", "method_id"]))


def _flows_between(program: Program, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    found = reach_by_calls(program, sources.select("repo", "id"), sinks.select("repo", "id"))
    return found.select("repo", F.col("source").alias("from_id"), F.col("sink").alias("to_id")).distinct()


def flink_default_by_flow(program: Program, rule_ids: str = "") -> DataFrame:
    """Tags of built-in connectors for the sinks that they flow to."""
    sinks = program.calls().where(F.col("name") == FLINK_SINK)
    return copy_tags(program, _flows_between(program, flink_connectors(program, rule_ids), sinks))


def flink_user_defined(program: Program) -> DataFrame:
    """Tags of the sinks inside classes that extend a Flink sink, for the sinks of methods that make one; else for the local, which is marked."""
    types = program.of("TYPE_DECL").where(F.exists("inherits", lambda x: x.rlike(rf"\A(?:{FLINK_PARENT})\z"))).select("repo", F.col("id").alias("type_id"), "type_full_name")
    methods = program.hop(types, "AST", key="type_id", to="method_id")
    inner = program.hop(methods.select("repo", "type_full_name", "method_id"), "CONTAINS", key="method_id", to="id")
    sinks = program.tagged(program.untagged(inner, "catLevelTwo", "leakages"), "catLevelOne", "sinks")
    ids = program.tags.where("name = 'id'").select("repo", F.col("node_id").alias("id"), F.col("value").alias("rule_id"))
    first = sinks.join(ids, ["repo", "id"]).groupBy("repo", "type_full_name", "rule_id").agg(F.min("id").alias("from_id"))
    local = program.of("LOCAL").where("name <> 'this'").select("repo", F.col("id").alias("local_id"), F.regexp_replace("type_full_name", "<.*>$", "").alias("type_full_name"))
    placed = _method_of(program, local, "local_id").join(_flink_sinks(program), ["repo", "method_id"], "left")
    known = first.select("repo", "type_full_name", "from_id").join(placed, ["repo", "type_full_name"])
    here = known.where("to_id is not null")
    away = known.join(here.select("repo", "type_full_name").distinct(), ["repo", "type_full_name"], "left_anti").withColumn("to_id", F.col("local_id"))
    return copy_tags(program, here.select("repo", "from_id", "to_id")).unionByName(copy_tags(program, away.select("repo", "from_id", "to_id"))).unionByName(mark(away, "FLINK_INITIALISATION_LOCAL_NODE", key="local_id"))


def flink_user_defined_by_flow(program: Program) -> DataFrame:
    """Tags of marked locals for the sinks that identifiers of them flow to."""
    local = program.tagged(program.of("LOCAL"), "FLINK_INITIALISATION_LOCAL_NODE").select("repo", F.col("id").alias("local_id"))
    uses = program.hop(local, "REF", key="local_id", to="id", back=True)
    found = _flows_between(program, uses, program.calls().where(F.col("name") == FLINK_SINK))
    return copy_tags(program, found.join(uses.select("repo", "local_id", F.col("id").alias("from_id")), ["repo", "from_id"]).select("repo", F.col("local_id").alias("from_id"), "to_id"))


def flink_untagged(program: Program) -> DataFrame:
    """Flink sinks without a rule, by the generic one."""
    return program.untagged(program.calls().where(F.col("name") == FLINK_SINK), "id").select("repo", "id", "file", F.lit(FLINK_PRODUCER.id).alias("rule_id"))


def flink(spark, program: Program, imports: DataFrame, rule_ids: str = "") -> Program:
    """The five steps in their order, over the repositories that import Flink."""
    from sluice.operators.sources import apply_rules

    repos = imports.where(full_match(F.col("name"), "org.apache.flink.*")).select("repo").distinct()
    own = replace(program, nodes=program.nodes.join(repos, "repo", "left_semi"))
    for step in (flink_user_defined, flink_user_defined_by_flow, lambda p: flink_default(p, rule_ids), lambda p: flink_default_by_flow(p, rule_ids)):
        own = own.with_tags(step(own)).kept()
    return replace(program, tags=own.with_tags(apply_rules(spark, flink_untagged(own), [FLINK_PRODUCER])).tags)


def graphql_names(code: Column) -> Column:
    """Field and variable names of a GraphQL text."""
    body = F.regexp_replace(F.regexp_replace(code, r"#[^\n]*", ""), r'"[^"]*"', "")
    words = F.regexp_extract_all(body, F.lit(r"[$]?[_A-Za-z][_0-9A-Za-z]*"), 0)
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^[$]", ""))
    return F.array_distinct(F.filter(bare, lambda w: ~w.isin("query", "mutation", "subscription", "fragment", "on", "gql", "graphql", "true", "false", "null", "input")))
