"""All queries of the engine by name, each with its SQL.

The tables stand in for a scanned program: consecutive events of a user are flow edges, with sign-ups as sources and
purchases as sinks; foreign keys are graph edges; the columns of all tables are a schema to tag; texts hold literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import scalars as fn
from sluice.operators import _stage, flows, policy, predicates, sources, tagging
from sluice.operators.tagging import Rule
from sluice.sources import files, properties, sql_text, templates
from sluice.streaming import tagging as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SENSITIVE = [
    Rule("Data.Name", (r"(?i).*name.*",), name="Name", category="Identity", cat_two="personal", sensitivity="high", is_sensitive=True),
    Rule("Data.Balance", (r"(?i).*acctbal.*", r"(?i).*price.*"), name="Balance", category="Financial", cat_two="financial", sensitivity="medium"),
    Rule("Data.Key", (r"(?i).*key", r"(?i).*_id"), name="Key", category="Identity", cat_two="identifier", sensitivity="low"),
    Rule("Data.Text", (r"(?i)text", r"(?i)html"), name="Text", category="Content", cat_two="content", sensitivity="medium"),
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_COLUMNS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{t}.' || column_name AS column_name FROM (DESCRIBE {t})" for t in TABLES)
_RULES = ", ".join(f"('{r.id}', '{r.pattern}')" for r in SENSITIVE)
_TAGGED = f"WITH cols AS ({_COLUMNS}), rules(source_id, re) AS (VALUES {_RULES}), tagged AS (SELECT table_name, column_name, source_id FROM cols JOIN rules ON len(list_filter(string_split_regex(column_name, '[ .]'), lambda t: regexp_full_match(t, re))) > 0) "
TEXT_RULES = [Rule("Text.Licence", (r"(?i).*licen[sc]e.*",)), Rule("Text.Rights", (r"All rights reserved\.",)), Rule("Text.Mail", (r".*[\w.]+@[\w.]+.*",))]
_TEXT_RULES = ", ".join(f"('{r.id}', '{r.pattern}')" for r in TEXT_RULES)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of all tables, as their files declare them, with the table's name before."""
    rows = [(t, f"{t}.{c}") for t in TABLES for c in _table(spark, sf_dir, t).columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.columns_by_token(_columns(spark, sf_dir), SENSITIVE).withColumnRenamed("rule_id", "source_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(f"{_TAGGED} SELECT table_name, column_name, source_id FROM tagged")
def sql_column_tags(spark, sf_dir):
    return _tagged(spark, sf_dir)


@query(f"{_TAGGED} SELECT source_id, count(DISTINCT table_name) AS n_tables, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tables FROM tagged GROUP BY source_id HAVING count(DISTINCT table_name) > 1")
def pii_multi_table(spark, sf_dir):
    return policy.in_several_tables(_tagged(spark, sf_dir))


@query(
    f"{_TAGGED}, v AS (SELECT DISTINCT table_name, CASE source_id WHEN 'Data.Name' THEN 'identity' WHEN 'Data.Balance' THEN 'financial' WHEN 'Data.Text' THEN 'content' END AS v FROM tagged) "
    "SELECT table_name, string_agg(v, ',' ORDER BY v) AS categories, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY table_name HAVING count(*) > 1"
)
def pii_mixed_category(spark, sf_dir):
    return policy.mixed_values(_tagged(spark, sf_dir), {"Data.Name": "identity", "Data.Balance": "financial", "Data.Text": "content"}, "categories")


@query(
    f"{_TAGGED}, v AS (SELECT DISTINCT table_name, CASE source_id WHEN 'Data.Name' THEN '30' WHEN 'Data.Balance' THEN '365' WHEN 'Data.Key' THEN '30' END AS v FROM tagged) "
    "SELECT table_name, string_agg(v, ',' ORDER BY v) AS days, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY table_name HAVING count(*) > 1"
)
def pii_retention_conflict(spark, sf_dir):
    return policy.mixed_values(_tagged(spark, sf_dir), {"Data.Name": "30", "Data.Balance": "365", "Data.Key": "30"}, "days")


@query(f"{_TAGGED} SELECT 'Data.' || split_part(source_id, '.', 2) AS source_id, count(*) AS n, count(DISTINCT table_name) AS n_tables FROM tagged GROUP BY 1")
def tag_counts_by_category(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("table_name").alias("n_tables"))


@query(f"WITH rules(rule_id, re) AS (VALUES {_TEXT_RULES}), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, rule_id, count(*) AS n FROM lines JOIN rules ON regexp_full_match(line, re) GROUP BY ALL")
def rule_match_lines_full(spark, sf_dir):
    tests = [(r.id, predicates.full_match(F.col("line"), r.pattern)) for r in TEXT_RULES]
    return tagging.match_rows(_lines(spark, sf_dir), tests).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


@query(f"WITH rules(rule_id, re) AS (VALUES {_TEXT_RULES}) SELECT doc_id, rule_id FROM documents JOIN rules ON regexp_matches(text, re)")
def rule_match_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tagging.match_rows(docs, [(r.id, predicates.partial_match(F.col("text"), r.pattern)) for r in TEXT_RULES]).select("doc_id", "rule_id")


@query("SELECT doc_id, source FROM documents WHERE NOT regexp_full_match(source, 'src1.*') AND NOT regexp_full_match(source, '.*[05]')")
def exclude_files_anti(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.where(predicates.allowed_file(F.col("source"), ["src1.*", ".*[05]", "("])).select("doc_id", "source")


@query(
    "WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), "
    "ded AS (SELECT DISTINCT source AS file, line AS name, CASE WHEN doc_id % 2 = 0 THEN line_no END AS line_no, 'Declared.' || (doc_id % 7) AS rule_id FROM lines WHERE doc_id % 10 = 0 AND length(line) BETWEEN 3 AND 60) "
    "SELECT l.doc_id, l.line_no::INT AS line, d.rule_id FROM lines l JOIN ded d ON l.source = d.file AND l.line = d.name AND (d.line_no IS NULL OR d.line_no = l.line_no)"
)
def ded_exact_match(spark, sf_dir):
    nodes = _lines(spark, sf_dir).select("doc_id", F.col("source").alias("file"), F.col("line").alias("name"), F.col("line_no").alias("line"))
    some = nodes.where((F.col("doc_id") % 10 == 0) & F.length("name").between(3, 60))
    declared = some.select("file", "name", F.when(F.col("doc_id") % 2 == 0, F.col("line")).alias("line"), F.concat(F.lit("Declared."), F.col("doc_id") % 7).alias("rule_id")).distinct()
    return predicates.exact_declaration(nodes, declared).select("doc_id", "line", "rule_id")


_RULE_ROWS = [("A", "first", ["a1", "a2"], False, 1), ("A", "outer", ["a3"], True, 2), ("B", "only", ["b1"], False, 3), ("B", "more", ["b2", "b1"], False, 4), ("C", "ext", ["c1"], True, 5)]
_RULE_SQL = "WITH rules(id, name, patterns, is_external, ord) AS (VALUES " + ", ".join(f"('{i}', '{n}', {p}, {str(e).lower()}, {o})" for i, n, p, e, o in _RULE_ROWS) + ") "


def _rule_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULE_ROWS, "id string, name string, patterns array<string>, is_external boolean, ord int")


@query(_RULE_SQL + "SELECT id, first(name ORDER BY is_external DESC, ord) AS name, array_to_string(flatten(list(patterns ORDER BY is_external DESC, ord)), ',') AS patterns FROM rules GROUP BY id")
def merge_rule_patterns(spark, sf_dir):
    return tagging.merge_rules(_rule_rows(spark)).withColumn("patterns", F.array_join("patterns", ","))


@query(_RULE_SQL + "SELECT id, arg_min(name, (NOT is_external)::INT * 100 + ord) AS name, arg_min(is_external, (NOT is_external)::INT * 100 + ord) AS is_external FROM rules GROUP BY id")
def distinct_rules_first(spark, sf_dir):
    return tagging.first_rules(_rule_rows(spark))


@query("WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') END AS url FROM pages) SELECT page_id, replace(regexp_extract(url, '^(?:https?://)?([^/?#:]+)', 1), 'www.', '') AS host FROM u")
def page_domain(spark, sf_dir):
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", ""))  # an address needs no scheme
    return _table(spark, sf_dir, "pages").select("page_id", fn.url_host(url).alias("host"))


@query("SELECT page_id, len(regexp_extract_all(html, '<script'))::INT AS n_scripts, len(regexp_extract_all(html, '<a '))::INT AS n_links FROM pages")
def page_script_count(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<script")).alias("n_scripts"), F.regexp_count("html", F.lit("<a ")).alias("n_links"))


@query("SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.k') AS value FROM events")
def props_flatten(spark, sf_dir):
    pairs = F.explode(F.from_json("props", "map<string,string>")).alias("name", "value")
    return _table(spark, sf_dir, "events").select("event_id", pairs)


_PLACES = "SELECT page_id, split_part(url, '/', 3) AS host, CASE page_id % 5 WHEN 0 THEN 'jdbc:x.prod.amazonaws.com/' || page_id WHEN 1 THEN 'db.azure.com' WHEN 2 THEN '10.0.0.' || (page_id % 250) || ':5432' ELSE url END AS url, CASE WHEN page_id % 11 = 0 THEN 'conf/app-prod.yml' ELSE 'conf/app.yml' END AS file FROM pages"


@query(
    f"WITH p AS ({_PLACES}), r AS (SELECT *, CASE WHEN regexp_full_match(file, '.*(prd|prod).*\\.(properties|yaml|yml|xml|conf)') THEN 4 WHEN regexp_full_match(url, '.*(prd|prod).*(amazonaws\\.com|orcalecloud\\.com|azure\\.com|mongodb\\.net).*') THEN 3 "
    "WHEN regexp_full_match(url, '.*(amazonaws\\.com|orcalecloud\\.com|azure\\.com|mongodb\\.net).*') THEN 2 WHEN regexp_full_match(url, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}:[0-9]{1,4}(:[0-9]{1,4})?') THEN 1 ELSE 0 END AS rank FROM p) "
    "SELECT host, arg_max(url, (rank, -page_id)) AS url, max(rank) AS rank FROM r GROUP BY host"
)
def config_priority_pick(spark, sf_dir):
    p = spark.sql(_PLACES.replace("FROM pages", "FROM {pages}"), pages=_table(spark, sf_dir, "pages"))
    return p.withColumn("rank", fn.config_priority(F.col("url"), F.col("file"))).groupBy("host").agg(F.max_by("url", F.struct("rank", -F.col("page_id"))).alias("url"), F.max("rank").alias("rank"))


@query(
    "SELECT 'nation' AS label, n_regionkey::BIGINT AS src, n_nationkey::BIGINT AS dst FROM nation UNION ALL SELECT 'customer', c_nationkey, c_custkey FROM customer UNION ALL SELECT 'orders', o_custkey, o_orderkey FROM orders UNION ALL SELECT 'supplier', s_nationkey, s_suppkey FROM supplier"
)
def fk_graph_edges(spark, sf_dir):
    edge = lambda t, a, b: _table(spark, sf_dir, t).select(F.lit(t).alias("label"), F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"))
    return edge("nation", "n_regionkey", "n_nationkey").unionByName(edge("customer", "c_nationkey", "c_custkey")).unionByName(edge("orders", "o_custkey", "o_orderkey")).unionByName(edge("supplier", "s_nationkey", "s_suppkey"))


_EDGES = "SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"
_FLOWS = (
    f"WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE dst IS NOT NULL), r(source, path, n) AS (SELECT event_id, [event_id], 0 FROM events WHERE event_type = 'signup' "
    "UNION ALL SELECT source, list_append(path, dst), n + 1 FROM r JOIN e ON src = path[-1] WHERE n < 4 AND NOT list_contains(path, dst)), "
    "f AS (SELECT source, path[-1] AS sink, path, array_to_string(path, '-') AS path_id FROM r WHERE n > 0 AND path[-1] IN (SELECT event_id FROM events WHERE event_type = 'purchase')), "
    "u AS (SELECT f.*, s.user_id FROM f JOIN events s ON s.event_id = f.source) "
)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("dst")).where("dst is not null")


def _nodes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias("id"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flows.reach(_edges(spark, sf_dir), _nodes(spark, sf_dir, "signup"), _nodes(spark, sf_dir, "purchase"), 4)
    users = _table(spark, sf_dir, "events").select(F.col("event_id").alias("source"), "user_id")
    return _stage.keep(found.join(users, "source").withColumn("path_id", flows.path_id(F.col("path"))), "flows")  # its readers have one table, not a plan each


@query(f"SELECT * FROM ({_EDGES}) WHERE dst IS NOT NULL")
def event_flow_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(_FLOWS + "SELECT source, sink, path_id, len(path)::INT AS path_len FROM f")
def flow_paths_bounded(spark, sf_dir):
    return _flows(spark, sf_dir).select("source", "sink", "path_id", F.size("path").alias("path_len"))


@query(_FLOWS + ", s AS (SELECT DISTINCT user_id, path[-i:] AS path FROM u, range(2, 5) t(i) WHERE i < len(path)) SELECT user_id, source, sink, path_id FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id AND s.path = u.path)")
def flow_suffix_dedup(spark, sf_dir):
    return flows.suffix_dedup(_flows(spark, sf_dir), ["user_id"]).select("user_id", "source", "sink", "path_id")


@query(_FLOWS + "SELECT user_id, sink, path_id FROM u QUALIFY row_number() OVER (PARTITION BY user_id, sink ORDER BY len(path), path_id) = 1")
def flow_shortest_per_location(spark, sf_dir):
    return flows.shortest(_flows(spark, sf_dir), ["user_id", "sink"]).select("user_id", "sink", "path_id")


@query(_FLOWS + "SELECT user_id, path_id FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY len(path), path_id) <= 2")
def flow_topk_per_pair(spark, sf_dir):
    return flows.top_paths(_flows(spark, sf_dir), ["user_id"], 2).select("user_id", "path_id")


@query(_FLOWS + "SELECT user_id, path_id FROM u QUALIFY len(path) <= 3 OR (min(len(path)) OVER (PARTITION BY user_id) > 3 AND row_number() OVER (PARTITION BY user_id ORDER BY len(path), path_id) = 1)")
def flow_element_limit(spark, sf_dir):
    return flows.element_limit(_flows(spark, sf_dir), ["user_id"], 3).select("user_id", "path_id")


@query(_FLOWS + ", p AS (SELECT user_id, source, sink, string_agg(DISTINCT path_id, '|' ORDER BY path_id) AS paths FROM u GROUP BY ALL) SELECT user_id, source, string_agg(sink || ':' || paths, ';' ORDER BY sink) AS sinks FROM p GROUP BY ALL")
def flow_by_type_nested(spark, sf_dir):
    nested = flows.by_pair(_flows(spark, sf_dir), "user_id")
    text = F.transform("sinks", lambda s: F.concat(s["sink"].cast("string"), F.lit(":"), F.array_join(s["paths"], "|")))
    return nested.select("user_id", "source", F.array_join(text, ";").alias("sinks"))


@query(
    _FLOWS
    + ", x AS (SELECT path_id, unnest(path) AS id FROM f), t AS (SELECT DISTINCT path_id, event_type AS kind FROM x JOIN events ON event_id = id) SELECT a.kind AS kind, string_agg(DISTINCT b.kind, ',' ORDER BY b.kind) AS others FROM t a JOIN t b ON a.path_id = b.path_id AND a.kind <> b.kind GROUP BY a.kind"
)
def file_cooccurrence(spark, sf_dir):
    kinds = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    elements = _flows(spark, sf_dir).select("path_id", F.explode("path").alias("id")).join(kinds, "id")
    return flows.co_occurrence(elements, "path_id", "kind").withColumn("others", F.array_join("others", ","))


@query(
    _FLOWS
    + ", s AS (SELECT DISTINCT user_id, path[-i:] AS path FROM u, range(2, 5) t(i) WHERE i < len(path)) SELECT path_id, CASE WHEN len(path) <= 3 THEN 'YES' ELSE '--' END AS limited, "
    "CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id AND s.path = u.path) THEN '--' ELSE 'YES' END AS deduplicated FROM u"
)
def stage_matrix(spark, sf_dir):
    base = _flows(spark, sf_dir)
    return flows.stage_matrix(base, {"limited": base.where(F.size("path") <= 3), "deduplicated": flows.suffix_dedup(base, ["user_id"])}, ["path_id"])


_POLICIES = [policy.Policy("P1", sources=("user[0-4].*",), sinks=("sink[02468]",)), policy.Policy("P2", sinks=("sink.*",), sensitivity="high", domains=("a.example",)), policy.Policy("P3", allowed_domains=("b.example",))]
_NAMED = "SELECT 'user' || (user_id % 10) AS source_id, 'sink' || (sink % 10) AS sink_id, path_id, CASE WHEN user_id % 2 = 0 THEN 'high' ELSE 'low' END AS sensitivity, [CASE WHEN sink % 3 = 0 THEN 'a.example' ELSE 'b.example' END] AS domains FROM u"


def _named_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir).select(
        F.concat(F.lit("user"), F.col("user_id") % 10).alias("source_id"),
        F.concat(F.lit("sink"), F.col("sink") % 10).alias("sink_id"),
        "path_id",
        F.when(F.col("user_id") % 2 == 0, "high").otherwise("low").alias("source_sensitivity"),
        F.array(F.when(F.col("sink") % 3 == 0, "a.example").otherwise("b.example")).alias("sink_domains"),
    )


@query(
    _FLOWS
    + f", n AS ({_NAMED}), v AS (SELECT 'P1' AS policy_id, * FROM n WHERE regexp_full_match(source_id, 'user[0-4].*') AND regexp_full_match(sink_id, 'sink[02468]') "
    "UNION ALL SELECT 'P2', * FROM n WHERE sensitivity = 'high' AND list_contains(domains, 'a.example') UNION ALL SELECT 'P3', * FROM n WHERE NOT list_contains(domains, 'b.example')) "
    "SELECT policy_id, source_id, sink_id, string_agg(DISTINCT path_id, ',' ORDER BY path_id) AS paths FROM v GROUP BY ALL"
)
def policy_flow_violations(spark, sf_dir):
    return policy.flow_violations(_named_flows(spark, sf_dir), _POLICIES).withColumn("paths", F.array_join("paths", ","))


@query(_FLOWS + f", n AS ({_NAMED}) SELECT source_id, sink_id, count(DISTINCT path_id) AS n FROM n WHERE list_has_any(domains, ['a.example', 'c.example']) GROUP BY ALL")
def policy_domain_filter(spark, sf_dir):
    found = policy.flow_violations(_named_flows(spark, sf_dir), [policy.Policy("P", domains=("a.example", "c.example"))])
    return found.select("source_id", "sink_id", F.size("paths").cast("long").alias("n"))


@query("SELECT DISTINCT source AS repo, regexp_full_match(source, 'src1.*') AS denied, NOT regexp_full_match(source, 'src[0-4]') AS not_allowed, true AS always FROM documents")
def policy_repo_filter(spark, sf_dir):
    repo = F.col("repo")
    repos = _table(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()
    make = lambda action, *r: policy.applies(policy.Policy("", action, repositories=r), repo)
    return repos.select("repo", make("deny", "src1.*").alias("denied"), make("allow", "src[0-4]").alias("not_allowed"), make(None).alias("always"))


_POINTS = "SELECT page_id, url AS end_point, 'Data.' || (page_id % 3) AS source_id, CASE WHEN page_id % 4 = 0 THEN 'Collections.Webforms' ELSE 'Collections.Rest' END AS collection_id FROM pages"


@query(
    f"WITH c AS ({_POINTS}) SELECT 'forms' AS policy_id, page_id, source_id FROM c WHERE collection_id = 'Collections.Webforms' AND regexp_matches(end_point, '/(en|de)/') AND source_id IN ('Data.0', 'Data.1') "
    "UNION ALL SELECT 'rest', page_id, source_id FROM c WHERE collection_id <> 'Collections.Webforms'"
)
def collection_violations(spark, sf_dir):
    points = spark.sql(_POINTS.replace("FROM pages", "FROM {pages}"), pages=_table(spark, sf_dir, "pages"))
    own = [policy.Policy("forms", sources=("Data[.][01]",), sinks=(), collection_type="form", end_point="/(en|de)/"), policy.Policy("rest", sources=("None",), sinks=(), collection_type="rest")]
    return policy.collection_violations(points, own).select("policy_id", "page_id", "source_id")


@query("SELECT DISTINCT array_to_string(string_split(replace(p_name, ' ', '.'), '.')[1:2], '.') AS prefix FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def probable_sinks(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    rest = predicates.anti(part, part.where("p_size > 48").select("p_brand"), "p_brand")
    return rest.select(fn.method_prefix(F.replace("p_name", F.lit(" "), F.lit(".")), 2).alias("prefix")).distinct()


@query(_FLOWS + "SELECT event_id AS id FROM events WHERE event_type = 'purchase' AND event_id NOT IN (SELECT sink FROM f)")
def unresolved_sinks(spark, sf_dir):
    return predicates.anti(_nodes(spark, sf_dir, "purchase"), _flows(spark, sf_dir).select(F.col("sink").alias("id")), "id")


@query("SELECT lang AS signature, string_agg(DISTINCT t, ' ' ORDER BY t) AS flow FROM (SELECT lang, unnest([(doc_id % 5) || '->' || (doc_id % 3), '0->0']) AS t FROM documents) GROUP BY lang")
def semantic_merge(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return tagging.merge_semantics(d.select(F.col("lang").alias("signature"), F.concat(F.col("doc_id") % 5, F.lit("->"), F.col("doc_id") % 3, F.lit(" 0->0")).alias("flow")))


@query("SELECT event_id AS id FROM events WHERE regexp_matches(event_type, '(error|view)') AND EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase')")
def log_share_sinks(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    gate = events.where("event_type = 'purchase'").limit(1).select(F.lit(1).alias("_one"))
    logs = events.where(predicates.partial_match(F.col("event_type"), "(error|view)")).withColumn("_one", F.lit(1))
    return predicates.semi(logs, F.broadcast(gate), "_one").select(F.col("event_id").alias("id"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '(#|localhost|\\.xsd)')")
def egress_urls(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").where(predicates.partial_match(u, "^https?://") & ~predicates.partial_match(u, r"(#|localhost|\.xsd)")).select("page_id", "url")


@query("SELECT split_part(url, '.', -1) AS ext, count(*) AS n, sum(strlen(html))::BIGINT AS size FROM pages GROUP BY 1")
def extension_sizes(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(F.element_at(F.split("url", r"\."), -1).alias("ext")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).cast("long").alias("size"))


@query("SELECT doc_id, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS sample, sha256(text) AS digest FROM documents")
def text_samples(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", fn.truncate(t, 20).alias("sample"), fn.sha256(t, strict_parity=False).alias("digest"))


@query(
    "SELECT c_custkey, count(*) AS n_orders, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' GROUP BY c_custkey"
)
def graph_hops(spark, sf_dir):
    at = _table(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").cast("long").alias("id"))
    for t, a, b in (("nation", "n_regionkey", "n_nationkey"), ("customer", "c_nationkey", "c_custkey")):
        at = flows.hop(at, _table(spark, sf_dir, t).select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"))).select(F.col("dst").alias("id"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return orders.join(at, "id", "left_semi").groupBy(F.col("id").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM conversations WHERE regexp_matches(text, '(?i)the')) AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn > 6)")
def semi_and_anti(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    own = predicates.semi(c.where("role = 'user'"), c.where(predicates.partial_match(F.col("text"), "(?i)the")).select("conv_id"), "conv_id")
    return predicates.anti(own, c.where("turn > 6").select("conv_id"), "conv_id").select("conv_id", "turn", "role")


@query(
    "WITH d AS (SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) SELECT doc_id, 'SELECT' AS kind, source AS table_name, lang AS column_name, 2 AS line, 0 AS ord FROM d "
    "UNION ALL SELECT doc_id, 'SELECT', source, 'n_chars', 3, 1 FROM d UNION ALL SELECT doc_id, 'CREATE', source, lang, 6, 0 FROM d"
)
def sql_text_columns(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.format_string("-- two\nselect count(%1$s),\nn_chars from a.%2$s;\n\ncreate table if not exists %2$s (\n  %1$s int, primary key (%1$s));\ndrop table %2$s;", "lang", "source").alias("content"), "lang", "source")
    found = sql_text.columns(d.where("lang is not null and source is not null").select("doc_id", "content"))
    return found.select("doc_id", "kind", "table_name", "column_name", "line", "ord")


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value, -1 AS line FROM events WHERE props IS NOT NULL")
def json_properties(spark, sf_dir):
    return properties.read(_table(spark, sf_dir, "events").select("event_id", F.col("props").alias("content")), ".json")


@query(
    "WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS n FROM pages) "
    "SELECT page_id, split_part(line, '=', 1) AS name, arg_max(substr(line, strpos(line, '=') + 1), n) AS value, -1 AS line FROM l WHERE trim(line, ' ') <> '' AND NOT starts_with(line, '#') AND contains(line, '=') GROUP BY page_id, split_part(line, '=', 1)"
)
def dotenv_properties(spark, sf_dir):
    return properties.read(_table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")), ".env")


@query("SELECT page_id, len(regexp_extract_all(html, '<p[\\s>]')) AS n_paragraphs, len(regexp_extract_all(html, '<p[\\s>]')) * 3 AS n_rows FROM pages WHERE regexp_matches(html, '<p[\\s>]')")
def page_elements(spark, sf_dir):
    nodes = templates.nodes(_table(spark, sf_dir, "pages").select("page_id", "html"))
    own = nodes.where((F.col("name") != templates.ATTRIBUTE) & F.col("code").rlike("^(<p |</p>)"))
    return own.groupBy("page_id").agg(F.count_if(F.col("name") == templates.ELEMENT).alias("n_paragraphs"), F.count("*").alias("n_rows"))


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file"), F.octet_length("html").cast("long").alias("size"))


@query("SELECT page_id, url AS file FROM pages QUALIFY count(*) OVER (PARTITION BY regexp_replace(url, '/[^/]*$', '')) <= 3")
def directory_count_limit(spark, sf_dir):
    return files.within_directory_count(_page_files(spark, sf_dir), 3)[0].select("page_id", "file")


@query("SELECT page_id, strlen(html) // 1024 AS kb FROM pages WHERE strlen(html) // 1024 > 2")
def size_limit_skipped(spark, sf_dir):
    return files.within_size(_page_files(spark, sf_dir), 2)[1].select("page_id", F.floor(F.col("size") / 1024).alias("kb"))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type AS rule_id, count(*) AS n FROM events GROUP BY ALL")
def event_window_counts(spark, sf_dir):
    return streaming.tag_counts(_table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("rule_id")), "ts").select("start", "rule_id", "n")
