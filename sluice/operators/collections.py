"""Taggers of collection points: handlers of routes with their end points, forms, and app layouts.

A tagger of a language finds handlers: (repo, id of the method, url). What is common follows: the end point is the class's
address with the method's behind it, and a handler is a collection point if a parameter, local or literal of it matches a source,
or a parameter is of a derived source's type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import scalars as fn
from sluice.operators import graph, tagging
from sluice.operators.graph import Program
from sluice.operators.predicates import full_match
from sluice.operators.sources import OBJECT_TAGS
from sluice.operators.tagging import Rule

ENDPOINT = "COLLECTION_METHOD_ENDPOINT"


def _first(rows: DataFrame, url: str = "url") -> DataFrame:
    """One url a method: the least."""
    return rows.groupBy("repo", "id").agg(F.min(url).alias("url"))


def annotation_url(code: Column) -> Column:
    """The first quoted text of an annotation, or nothing."""
    return F.regexp_extract(code, r"""["']([^"']*)["']""", 1)


def annotated(program: Program, pattern: str, skip: str = "retrofit.*", slash: bool = False) -> tuple[DataFrame, DataFrame]:
    """(handlers, classes): (repo, id, url) of methods and of types with a matching annotation, not of a library that calls APIs.

    ``slash``: the quoted text as a path of one leading slash (PHP, C#).
    """
    marks = program.of("ANNOTATION").where(full_match(F.col("name"), pattern) & ~full_match(F.coalesce("method_full_name", F.lit("")), skip))
    url = annotation_url(F.col("code"))
    url = F.when(url == "", url).otherwise(F.concat(F.lit("/"), F.regexp_replace(url, "^/+", ""))) if slash else url
    ends = program.hop(marks.select("repo", F.col("id").alias("mark"), url.alias("url")), "AST", key="mark", to="id", back=True)
    of = lambda label: _first(ends.join(program.of(label).select("repo", "id"), ["repo", "id"], "left_semi"))
    return of("METHOD"), of("TYPE_DECL")


def end_points(program: Program, handlers: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(repo, id, end_point): the class's address, if it has one, with the method's behind it."""
    if classes is None:
        return handlers.select("repo", "id", F.col("url").alias("end_point"))
    up = program.hop(handlers, "AST", to="class_id", back=True).select("repo", "id", "class_id").join(classes.select("repo", F.col("id").alias("class_id"), F.col("url").alias("class_url")), ["repo", "class_id"])
    own = up.groupBy("repo", "id").agg(F.min("class_url").alias("class_url"))
    return handlers.join(own, ["repo", "id"], "left").select("repo", "id", F.concat(F.coalesce("class_url", F.lit("")), "url").alias("end_point"))


def ingress_urls(ends: DataFrame) -> DataFrame:
    return ends.select("repo", "end_point").distinct()


def direct_sources(program: Program, handlers: DataFrame, rules: Sequence[Rule], what: Sequence[str] = ("PARAMETER",), this: str = "this") -> DataFrame:
    """(repo, id, node_id, rule_id): handlers and the parameters (by name), locals (by code) and literals (quoted; of ``get*`` calls in Python) that match a source."""
    out = None
    for label in what:
        if label == "PARAMETER":
            nodes, test, edge = program.of(label).where(F.col("code") != this), lambda r: full_match(F.col("name"), r.pattern), "AST"
        elif label == "LOCAL":
            nodes, test, edge = program.of(label), lambda r: full_match(F.col("code"), r.pattern), "CONTAINS"
        else:
            nodes, test, edge = program.of("LITERAL").where(~F.col("code").rlike(r"\s")), lambda r: full_match(F.col("code"), f"[\"':]?({r.pattern})[\"']?"), "CONTAINS"
            if label == "GET_LITERAL":
                args = program.arguments(program.calls().where(F.col("name").startswith("get"))).where("arg_label = 'LITERAL'").select("repo", F.col("arg_id").alias("id")).distinct()
                nodes = nodes.join(args, ["repo", "id"], "left_semi")
        hit = tagging.match_rows(nodes, [(r.id, test(r)) for r in rules]).select("repo", F.col("id").alias("node_id"), "rule_id")
        found = program.hop(handlers.select("repo", "id"), edge, to="node_id").join(hit, ["repo", "node_id"]).select("repo", "id", "node_id", "rule_id")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def derived_sources(program: Program, handlers: DataFrame) -> DataFrame:
    """(repo, id, node_id): handlers and their parameters of a type that some identifier is a derived source of."""
    names = list(OBJECT_TAGS.values())
    known = program.tags.where(F.col("name").isin(names)).select("repo", F.col("node_id").alias("id")).distinct()
    types = program.of("IDENTIFIER").join(known, ["repo", "id"], "left_semi").select("repo", "type_full_name").distinct()
    params = program.of("PARAMETER").join(types, ["repo", "type_full_name"], "left_semi").select("repo", F.col("id").alias("node_id"))
    return program.hop(handlers.select("repo", "id"), "AST", to="node_id").join(params, ["repo", "node_id"]).select("repo", "id", "node_id")


def points(program: Program, handlers: DataFrame, rule: Rule, sources: Sequence[Rule], classes: DataFrame | None = None, what: Sequence[str] = ("PARAMETER",), this: str = "this", derived: bool = True) -> tuple[DataFrame, DataFrame]:
    """(collection points with file, rule_id and end_point; tags): what all languages have in common.

    Matching nodes are tagged with the source's id, collection points with their end point.
    """
    direct = direct_sources(program, handlers, sources, what, this)
    hit = direct.select("repo", "id")
    tags = direct.select("repo", "node_id", F.lit("id").alias("name"), F.col("rule_id").alias("value"))
    if derived:
        of_type = derived_sources(program, handlers)
        hit = hit.unionByName(of_type.select("repo", "id"))
        family = program.tags.where(F.col("name").startswith("derived_by_"))
        tags = tags.unionByName(of_type.join(family, ["repo", "node_id"]).select("repo", "node_id", "name", "value"))
    ends = end_points(program, handlers, classes).join(hit.distinct(), ["repo", "id"], "left_semi")
    out = program.of("METHOD").select("repo", "id", "file").join(ends, ["repo", "id"]).withColumn("rule_id", F.lit(rule.id))
    return out, tags.unionByName(out.select("repo", F.col("id").alias("node_id"), F.lit(ENDPOINT).alias("name"), F.col("end_point").alias("value"))).distinct()


# Handlers by language


def _methods(program: Program, *columns: str) -> DataFrame:
    return program.of("METHOD").select("repo", F.col("id").alias("method_id"), "name", *columns)


def _argument(program: Program, calls: DataFrame, k: int) -> DataFrame:
    """repo, id, and the k-th argument as ``a{k}_id``, ``_label``, ``_code``."""
    pick = [F.col(f"arg_{c}").alias(f"a{k}_{c}") for c in ("id", "label", "code")]
    return program.arguments(calls).where(F.col("arg_argument_index") == k).select("repo", "id", *pick)


def _by_reference(program: Program, calls: DataFrame, url: Column) -> DataFrame:
    """Handlers that a call takes as method references, with the url of the call."""
    refs = program.arguments(calls).where("arg_label = 'METHOD_REF'").select("repo", F.col("id").alias("call"), F.col("arg_code").alias("ref"))
    full = program.nodes.where("label = 'METHOD_REF'").select("repo", F.col("code").alias("ref"), "method_full_name").distinct()
    urls = calls.select("repo", F.col("id").alias("call"), url.alias("url"))
    return _first(refs.join(full, ["repo", "ref"]).join(urls, ["repo", "call"]).join(program.of("METHOD").select("repo", "method_full_name", "id"), ["repo", "method_full_name"]).select("repo", "id", "url"))


def java_routes(program: Program, pattern: str) -> DataFrame:
    """Handlers of routes that are registered by a call (its full name matches): the named method of the file, else of the named class."""
    calls = program.calls().where(full_match(F.col("method_full_name"), pattern))
    last = program.arguments(calls).groupBy("repo", "id").agg(F.max_by("arg_code", "arg_argument_index").alias("target"))
    named = calls.select("repo", "id", "file", annotation_url(F.col("code")).alias("url")).join(last, ["repo", "id"])
    parts = named.withColumns({"name": F.regexp_extract("target", r"(?:::|->\s*\w*\.?|\.)?(\w+)\s*(?:\(.*)?$", 1), "class": F.regexp_extract("target", r"(\w+)(?:::|\.)\w+", 1)})
    methods = _methods(program, "file", "method_full_name")
    here = parts.join(methods, ["repo", "file", "name"]).select("repo", F.col("id").alias("call"), F.col("method_id").alias("id"), "url")
    away = parts.where(F.col("class") != "").drop("file").join(methods.withColumn("class", F.regexp_extract("method_full_name", r"(\w+)[$]?\.\w+(?:[:(].*)?$", 1)).drop("file"), ["repo", "class", "name"]).select("repo", F.col("id").alias("call"), F.col("method_id").alias("id"), "url")
    rest = away.join(here.select("repo", "call").distinct(), ["repo", "call"], "left_anti")
    return _first(here.unionByName(rest).select("repo", "id", "url"))


EXPRESS = "(?i)(?:get|post|put|patch|delete|all|use)"


def javascript_routes(program: Program, client: str = r"(?i)(?:express|router|app|fastify|koa).*") -> DataFrame:
    """Handlers of express-like calls with a path first: functions given to the call, by reference or by name in a file."""
    calls = program.calls().where(full_match(F.col("name"), EXPRESS) & (full_match(F.coalesce("method_full_name", F.lit("")), client) | F.col("code").rlike(r"^(?:app|router|server)\.")))
    path = _argument(program, calls, 1).where(F.col("a1_code").rlike(r"""^["'`]/""")).select("repo", "id", fn.unquoted(F.col("a1_code")).alias("url"))
    own = calls.join(path, ["repo", "id"])
    by_ref = _by_reference(program, own, F.col("url"))
    names = program.arguments(own).where("arg_label in ('IDENTIFIER', 'CALL') and arg_argument_index > 1").select("repo", "id", F.regexp_extract("arg_code", r"(\w+)$", 1).alias("name"))
    by_name = own.select("repo", "id", "url").join(names, ["repo", "id"]).join(_methods(program), ["repo", "name"]).select("repo", F.col("method_id").alias("id"), "url")
    return _first(by_ref.unionByName(by_name))


def form_literals(program: Program) -> DataFrame:
    """(repo, id, name): literals that a form's register call names an input by."""
    args = program.arguments(program.calls().where(F.col("name").isin("register", "Controller", "useField"))).where("arg_label = 'LITERAL' and arg_argument_index = 1")
    return args.select("repo", F.col("arg_id").alias("id"), fn.unquoted(F.col("arg_code")).alias("name")).distinct()


URL_TEXT = r""".*(\"|')(\/.*?)(\"|').*"""


def python_routes(program: Program) -> DataFrame:
    """Handlers by decorator (an assignment that calls a route with a path and the function) and by Django's url and path."""
    decorated = program.of("CALL").where(full_match(F.col("code"), URL_TEXT, True))
    by_decorator = _by_reference(program, decorated, F.regexp_extract("code", URL_TEXT, 2))
    django = program.calls().where(full_match(F.col("method_full_name"), "django.*[.](url|path)"))
    literal = program.arguments(django).where("arg_label = 'LITERAL'").groupBy("repo", "id").agg(F.min_by("arg_code", "arg_argument_index").alias("url"))
    return _first(by_decorator.unionByName(_by_reference(program, django.join(literal, ["repo", "id"]), F.col("url"))))


def cherrypy_routes(program: Program) -> DataFrame:
    """Handlers of a dispatcher's ``connect``: the method that ``action=`` names, at the route's path."""
    calls = program.calls().where("name = 'connect'").select("repo", "id", "file", F.regexp_extract("code", r"""action\s*=\s*["'](\w+)["']""", 1).alias("name"), F.regexp_extract("code", r"""route\s*=\s*["']([^"']+)["']|connect\([^,]*,\s*["']([^"']+)["']""", 0).alias("_route"))
    url = F.regexp_extract("_route", r"""["']([^"']+)["']$""", 1)
    return _first(calls.where("name <> ''").withColumn("url", url).join(_methods(program), ["repo", "name"]).select("repo", F.col("method_id").alias("id"), "url"))


ROUTES_RB, ROUTES_GO = ".*routes.rb", ".*(routes|routers).go"
CRUD = "show|update|new|create|destroy|index"


def _controller(file: Column) -> Column:
    return F.regexp_extract(file, r"/([^/]+)_controller\.rb$", 1)


def ruby_routes(program: Program) -> DataFrame:
    """Handlers of ``resources :x`` (six methods of x_controller.rb) and of REST calls ``to: "x#method"``."""
    routes = program.calls().where(full_match(F.col("file"), ROUTES_RB))
    one = program.arguments(routes.where("name = 'resources'")).where("arg_label = 'LITERAL'").groupBy("repo", "id").agg(F.count("*").alias("n"), F.min(F.regexp_replace(F.trim("arg_code"), "^:", "")).alias("controller")).where("n = 1")
    methods = _methods(program, "file").withColumn("controller", _controller(F.col("file")))
    crud = one.select("repo", "controller").join(methods.where(full_match(F.col("name"), CRUD)), ["repo", "controller"]).select("repo", F.col("method_id").alias("id"), F.concat_ws(" -> ", "controller", "name").alias("url"))
    rest = routes.where(full_match(F.col("name"), "get|post|put|patch|delete"))
    to = rest.select("repo", annotation_url(F.col("code")).alias("url"), F.regexp_extract("code", r"""to:\s*["']([^"'#]+)#([^"'#]+)""", 1).alias("controller"), F.regexp_extract("code", r"""to:\s*["']([^"'#]+)#([^"'#]+)""", 2).alias("name"))
    named = to.where("controller <> ''").join(methods, ["repo", "controller", "name"]).select("repo", F.col("method_id").alias("id"), "url")
    return _first(crud.unionByName(named))


def go_routes(program: Program) -> DataFrame:
    """Handlers of ``HandleFunc(path, f).Methods("GET")`` and of REST calls in route files."""
    typed = program.calls().where("name = 'Methods'")
    verbs = program.arguments(typed).where(F.col("arg_code").rlike("(?i)(Get|Post|Put|Patch|Delete)")).select("repo", "id").distinct()
    handle = program.arguments(typed.join(verbs, ["repo", "id"], "left_semi")).where("arg_label = 'CALL' and arg_name = 'HandleFunc'").select("repo", F.col("arg_id").alias("id")).distinct()
    rest = program.calls().where(full_match(F.col("name"), "(?i)(Get|Post|Put|Patch|Delete)") & full_match(F.col("file"), ROUTES_GO)).select("repo", "id")
    calls = program.calls().join(handle.unionByName(rest).distinct(), ["repo", "id"], "left_semi")
    both = _argument(program, calls, 1).join(_argument(program, calls, 2), ["repo", "id"]).withColumn("name", F.element_at(F.split("a2_code", r"\."), -1))
    return _first(both.where("a1_code <> ''").join(_methods(program), ["repo", "name"]).select("repo", F.col("method_id").alias("id"), F.col("a1_code").alias("url")))


def php_config_routes(program: Program, properties: DataFrame) -> DataFrame:
    """Handlers of routes in YAML (``name.path`` and ``name.controller`` or ``name.defaults._controller``): Class::method, or the class's ``__invoke``."""
    p = properties.where(F.col("file").rlike(r"(?i)routes?.*\.ya?ml$"))
    key = F.regexp_extract("name", r"^(.*)\.(path|controller|defaults\._controller)$", 1)
    pick = lambda pattern: F.max(F.when(F.col("name").rlike(pattern), F.col("value")))
    routes = p.withColumn("route", key).where("route <> ''").groupBy("repo", "file", "route").agg(pick(r"\.path$").alias("url"), pick(r"controller$").alias("controller"))
    own = routes.where("url is not null and controller is not null").select("repo", "url", F.regexp_extract("controller", r"([^\\:]+)(?:::\w+)?$", 1).alias("class"), F.when(F.col("controller").contains("::"), F.regexp_extract("controller", r"::(\w+)$", 1)).otherwise("__invoke").alias("name"))
    methods = _methods(program, "method_full_name").withColumn("class", F.regexp_extract("method_full_name", r"([^\\.>-]+)(?:->|\.|::)\w+$", 1))
    return _first(own.join(methods, ["repo", "class", "name"]).select("repo", F.col("method_id").alias("id"), "url"))


def php_routes(program: Program, pattern: str = r"(?i)Slim.*(get|post|put|patch|delete|map)$") -> DataFrame:
    """Handlers of a router's calls: the ``handle`` method of the class given last, or the closure."""
    calls = program.calls().where(full_match(F.coalesce("method_full_name", F.lit("")), pattern))
    last = program.arguments(calls).groupBy("repo", "id").agg(F.max_by("arg_code", "arg_argument_index").alias("target"))
    own = calls.select("repo", "id", annotation_url(F.col("code")).alias("url")).join(last, ["repo", "id"]).withColumn("class", F.regexp_extract("target", r"([^\\]+)::class$", 1))
    methods = _methods(program, "method_full_name").where("name = 'handle'").withColumn("class", F.regexp_extract("method_full_name", r"([^\\.>-]+)(?:->|\.|::)handle$", 1))
    by_class = own.where(F.col("class") != "").join(methods, ["repo", "class"]).select("repo", F.col("method_id").alias("id"), "url")
    return _first(by_class.unionByName(_by_reference(program, own, F.col("url"))))


def csharp_controllers(program: Program, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(handlers, classes): annotated methods of classes named or extending a controller, and the routes of these, ``[controller]`` put in."""
    types = program.of("TYPE_DECL").where(full_match(F.col("type_full_name"), ".*Controller") | F.exists("inherits", lambda x: x.rlike(r".*Controller(Base)?$")))
    handlers, classes = annotated(program, pattern, slash=True)
    own = program.hop(types.select("repo", F.col("id").alias("type_id")), "AST", key="type_id", to="id").select("repo", "id").distinct()
    named = classes.join(types.select("repo", "id", F.regexp_replace("name", "Controller$", "").alias("short")), ["repo", "id"])
    return handlers.join(own, ["repo", "id"], "left_semi"), named.select("repo", "id", F.replace("url", F.lit("[controller]"), F.col("short")).alias("url"))


# Forms, layouts, repository items

OPEN = ("jsxOpenElement", "HTMLOpenElement")
WHOLE = ("jsxElement", "HTMLElement")


def web_forms(dom: DataFrame, rules: Sequence[Rule], sources: Sequence[Rule]) -> DataFrame:
    """(dom columns, collection_id, source_id, role): input elements that name a source by name, id, label or value.

    The open element is the collection, the whole one a source itself.
    """
    own = dom.where(F.col("name").isin(*OPEN, *WHOLE))
    fields = tagging.match_rows(own, [(r.id, full_match(F.col("code"), r.pattern)) for r in rules]).withColumnRenamed("rule_id", "collection_id")
    named = lambda r: full_match(F.col("code"), f".*(?:name|id|label|value)=(?:\\{{|t){{0,2}}(?:\"|'|`|\\{{)({r.pattern})(?:\"|'|`|\\}}).*")
    return tagging.match_rows(fields, [(r.id, named(r)) for r in sources]).withColumnRenamed("rule_id", "source_id").withColumn("role", F.when(F.col("name").isin(*OPEN), "collection").otherwise("source"))


def layout_points(program: Program, layouts: DataFrame, rule: Rule) -> DataFrame:
    """(repo, id, file, rule_id, source): field identifiers of an input of a layout, beside ``binding`` or ``R.id``; the first of a name in a file."""
    names = layouts.where(full_match(F.col("name"), rule.pattern)).select("repo", F.col("name").alias("field")).distinct()
    access = program.field_accesses().where(F.col("code").rlike(r"(binding|R\.id)")).join(names, ["repo", "field"], "left_semi")
    first = access.groupBy("repo", "file", "field").agg(F.min("id").alias("id"))
    return first.select("repo", "id", "file", F.lit(rule.id).alias("rule_id"), F.col("field").alias("source"))


def repository_items(program: Program, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(items: repo, file_id, item, files; tags of every tagged node that an item's file reaches in at most ``depth`` calls)."""
    files = program.of("FILE").where((F.col("name").rlike("_controller[.]rb$") | (F.col("name").contains("/graphql/") & F.col("name").contains("/mutations/"))) & ~F.col("name").startswith("/"))
    item = F.regexp_replace(F.regexp_replace(F.regexp_replace(fn.item_name(F.col("name")), r"\.rb$", ""), "_controller$", ""), "_mutation$", "")
    own = files.select("repo", F.col("id").alias("file_id"), item.alias("item"), F.col("name").alias("file"))
    methods = program.of("METHOD").select("repo", "id", "file").join(own, ["repo", "file"])
    reached = graph.called_within(program, methods.select("repo", "id"), depth).join(methods.select("repo", "id", "item", "file_id"), ["repo", "id"]).select("repo", "item", "file_id", F.col("reached").alias("method_id")).distinct()
    inner = program.hop(reached, "CONTAINS", key="method_id", to="node_id").select("repo", "item", "file_id", "node_id")
    here = program.nodes.select("repo", F.col("id").alias("node_id"), "file").join(own.drop("file_id"), ["repo", "file"]).join(own.select("repo", "item", "file_id"), ["repo", "item"]).select("repo", "item", "file_id", "node_id")
    every = inner.unionByName(here).distinct()
    tagged = every.join(program.tags.select("repo", "node_id").distinct(), ["repo", "node_id"], "left_semi")
    places = every.join(program.nodes.select("repo", F.col("id").alias("node_id"), "file"), ["repo", "node_id"]).groupBy("repo", "file_id", "item").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return places, tagged.select("repo", "node_id", F.lit("monolithRepoItem").alias("name"), F.col("item").alias("value")).distinct()
