"""A repository as a whole: its language, source files, imports, dependencies, and what git and the machine say of it."""

from __future__ import annotations

import json
import os
import platform
import re
import shutil
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.predicates import full_match
from sluice.sources import files
from sluice.sources._rows import parsed

# Source files of each language.
EXTENSIONS = {
    "java": (".java",),
    "javascript": (".js", ".jsx", ".ts", ".tsx", ".mjs", ".vue"),
    "python": (".py",),
    "ruby": (".rb",),
    "go": (".go",),
    "kotlin": (".kt",),
    "php": (".php",),
    "csharp": (".cs",),
    "c": (".c", ".h", ".cc", ".cpp", ".hpp"),
}


def language_of(file: Column) -> Column:
    """The language of a file by its ending, or null."""
    end = F.lower(F.regexp_extract(file, r"\.[^./]+$", 0))
    pairs = F.create_map(*[F.lit(x) for lang, own in EXTENSIONS.items() for e in own for x in (e, lang)])
    return F.try_element_at(pairs, end)


def languages(listing: DataFrame) -> DataFrame:
    """(repo, language): the language of most source files of a repository, the first by name of a tie; ``default`` without any."""
    counts = listing.select("repo", language_of(F.col("file")).alias("language")).where("language is not null").groupBy("repo", "language").agg(F.count("*").alias("n"))
    best = counts.groupBy("repo").agg(F.min_by("language", F.struct((-F.col("n")).alias("n"), "language")).alias("language"))
    return listing.select("repo").distinct().join(best, "repo", "left").select("repo", F.coalesce("language", F.lit("default")).alias("language"))


def source_files(spark: SparkSession, root: str, language: str, exclusions: tuple[str, ...] = ()) -> DataFrame:
    return files.by_extension(spark, root, EXTENSIONS[language], exclusions)


def extension_totals(listing: DataFrame) -> DataFrame:
    """(extension, n, size), the most files first."""
    return listing.groupBy(F.regexp_extract("file", r"\.[^./]+$", 0).alias("extension")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy(F.desc("n"), "extension")


# Imports

IMPORT = "name string, alias string, line int"
_IMPORTS = {
    "java": re.compile(r"^import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;?"),
    "kotlin": re.compile(r"^import\s+(?P<name>[\w.*]+)(?:\s+as\s+(?P<alias>\w+))?"),
    "python": re.compile(r"^(?:import\s+(?P<name>[\w.]+)(?:\s+as\s+(?P<alias>\w+))?|from\s+(?P<from>[\w.]+)\s+import\s+(?P<what>[\w*]+)(?:\s+as\s+(?P<as>\w+))?)"),
    "javascript": re.compile(r"""^(?:import\s+(?:(?:\*\s+as\s+)?(?P<alias>\w+)(?:\s*,\s*\{[^}]*\})?\s+from\s+|\{[^}]*\}\s+from\s+)?["'](?P<name>[^"']+)["']|(?:const|let|var)\s+(?P<as>[\w{}\s,]+?)\s*=\s*require\(["'](?P<from>[^"']+)["']\))"""),
    "go": re.compile(r"""^(?:import\s+)?(?P<alias>[\w.]+\s+)?"(?P<name>[^"]+)"$"""),
    "ruby": re.compile(r"""^(?:require|require_relative|load)\s+["'](?P<name>[^"']+)["']"""),
    "csharp": re.compile(r"^using\s+(?:(?P<alias>\w+)\s*=\s*)?(?P<name>[\w.]+)\s*;"),
    "php": re.compile(r"^use\s+(?P<name>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;"),
    "c": re.compile(r"""^#include\s+["<](?P<name>[^">]+)[">]"""),
}
_AROUND = re.compile(r"^(?:package\b.*|import\s*\(|\)|[\"'].*[\"'];?|<\?php|namespace\b.*|#!.*|//.*|#(?!include).*|;)$")


def import_rows(text: str, language: str) -> Iterator[tuple[str, str, int]]:
    """name, alias and line of the imports at the head of a source text, up to the first line that is neither an import nor a comment nor blank."""
    pattern, inside = _IMPORTS[language], False
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if inside:
            if "*/" not in line:
                continue
            line, inside = line.split("*/", 1)[1].strip(), False
        line = re.sub(r"/\*.*?\*/", "", line).strip()
        if line.startswith("/*"):
            inside = True
            continue
        if m := pattern.match(line):
            g = m.groupdict()
            base = g.get("name") or g.get("from")
            what = g.get("what")
            name = f"{base}.{what}" if what and what != "*" else base
            last = re.split(r"[./\\]", name.rstrip("/"))[-1]
            yield name, (g.get("alias") or g.get("as") or (last if language != "java" else last)).strip(), n
        elif line and not _AROUND.match(line):
            return


def imports(sources: DataFrame, language: str) -> DataFrame:
    """Imports of source files (any columns and ``content``)."""
    return parsed(sources, "content", lambda t: import_rows(t, language), IMPORT)


# Dependencies


def dependency_info(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, rule_id, version): what a dependency file in JSON says of each dependency and the rule it falls under."""
    schema = "groupId string, name string, version string, ruleId string, filePath string, ruleName string, ruleDomain string"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    full = F.when(F.coalesce("groupId", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", "groupId", "name"))
    return rows.select(full.alias("name"), F.col("filePath").alias("file"), F.col("ruleId").alias("rule_id"), "version", F.col("ruleName").alias("rule_name"), F.col("ruleDomain").alias("rule_domain")).where("name is not null")


def dependency_nodes(info: DataFrame, repo: str) -> DataFrame:
    """Dependencies as nodes (repo, id, label, name, version, file); ids by a hash of name, version and file."""
    return info.select(F.lit(repo).alias("repo"), F.xxhash64("name", "version", "file").alias("id"), F.lit("DEPENDENCY").alias("label"), "name", "version", "file").distinct()


def package_names(manifests: DataFrame) -> DataFrame:
    """(repo, name): dependencies that package.json, composer.json and Gemfile texts name."""
    base = F.regexp_extract("file", "[^/]+$", 0)
    keys = lambda field: F.map_keys(F.from_json(F.get_json_object("content", f"$.{field}"), "map<string,string>"))
    gems = F.transform(F.filter(F.split("content", "\n"), lambda x: x.startswith("gem")), lambda x: F.regexp_replace(F.trim(F.split(F.trim(F.regexp_replace(x, "^gem", "")), ",")[0]), "^['\"]|['\"]$", ""))
    names = F.when(base == "package.json", keys("dependencies")).when(base == "composer.json", keys("require")).when(base == "Gemfile", gems)
    return manifests.select("repo", F.explode(names).alias("name")).where("name <> ''").distinct()


# Modules

MODULE = "kind string, group_id string, artifact_id string, version string, parent_group_id string, parent_artifact_id string, line int"
_GRADLE = re.compile(r"""^\s*(?:implementation|api|compile|compileOnly|runtimeOnly|testImplementation|annotationProcessor|kapt)\s*\(?\s*["']([^:"']+):([^:"']+)(?::([^"']+))?["']""", re.M)


def pom_rows(text: str) -> Iterator[tuple]:
    """The module of a pom.xml and its dependencies; ``${name}`` by the file's own properties, a group or version that is missing by the parent's."""
    from sluice.sources.xml import element_rows

    found = {p: (t, n) for _, p, _, t, n in element_rows(text)}
    if not found:
        return
    root = "/project[1]"
    held = {p.rsplit("/", 1)[1].split("[")[0]: t for p, (t, _) in found.items() if p.startswith(f"{root}/properties[1]/")}
    get = lambda p: re.sub(r"\$\{([^}]+)\}", lambda m: held.get(m[1], m[0]), found.get(p, ("", 0))[0])
    up = [get(f"{root}/parent[1]/{k}[1]") for k in ("groupId", "artifactId", "version")]
    yield "module", get(f"{root}/groupId[1]") or up[0], get(f"{root}/artifactId[1]"), get(f"{root}/version[1]") or up[2], up[0], up[1], found[root][1] if root in found else 1
    for p, (_, n) in found.items():
        if re.search(r"/dependencies\[1\]/dependency\[\d+\]$", p):
            yield "dependency", get(f"{p}/groupId[1]"), get(f"{p}/artifactId[1]"), get(f"{p}/version[1]"), "", "", n


def gradle_rows(text: str) -> Iterator[tuple]:
    group = re.search(r"""^\s*group\s*=?\s*["']([^"']+)["']""", text, re.M)
    version = re.search(r"""^\s*version\s*=?\s*["']([^"']+)["']""", text, re.M)
    name = re.search(r"""^\s*(?:archivesBaseName|rootProject\.name|artifactId)\s*=?\s*["']([^"']+)["']""", text, re.M)
    yield "module", group[1] if group else "", name[1] if name else "", version[1] if version else "", "", "", 1
    for m in _GRADLE.finditer(text):
        yield "dependency", m[1], m[2], m[3] or "", "", "", text.count("\n", 0, m.start()) + 1


def modules(builds: DataFrame) -> DataFrame:
    """Modules and dependencies of pom.xml and build.gradle files (repo, file, content)."""
    pom, gradle = F.col("file").endswith("pom.xml"), F.col("file").rlike(r"build\.gradle(\.kts)?$")
    return parsed(builds.where(pom), "content", pom_rows, MODULE).unionByName(parsed(builds.where(gradle), "content", gradle_rows, MODULE))


def module_dependencies(found: DataFrame) -> DataFrame:
    """(repo, file, module, dependency): the edges from each module to its dependencies, and whether the dependency is of the module's group."""
    m = found.where("kind = 'module'").select("repo", "file", F.col("group_id").alias("module_group"), F.concat_ws(":", "group_id", "artifact_id").alias("module"))
    d = found.where("kind = 'dependency'").select("repo", "file", "group_id", "artifact_id", F.concat_ws(":", "group_id", "artifact_id").alias("dependency"))
    return m.join(d, ["repo", "file"]).withColumn("internal", F.col("module_group") == F.col("group_id"))


# What git and the machine say


def git_metadata(folder: str) -> dict[str, str]:
    """branch, commitId and remoteUrl from the files under ``.git``; what is not there is missing."""
    root, out = Path(folder, ".git"), {}
    try:
        head = (root / "HEAD").read_text().strip()
        if head.startswith("ref:"):
            out["branch"] = head.split("refs/heads/", 1)[-1]
        last = (root / "logs" / "HEAD").read_text().strip().split("\n")[-1].split(" ")
        if len(last) > 1:
            out["commitId"] = last[1]
    except OSError:
        pass
    try:
        m = re.search(r"^\s*url\s*=\s*(.+)$", (root / "config").read_text(), re.M)
        if m:
            out["remoteUrl"] = re.sub(r"//[^/@]*@", "//", m[1].strip())
    except OSError:
        pass
    return out


def system_info() -> dict[str, str]:
    disk = shutil.disk_usage("/")
    return {"os": platform.system(), "arch": platform.machine(), "cpus": str(os.cpu_count()), "python": platform.python_version(), "disk_total": str(disk.total), "disk_free": str(disk.free)}


# Projects of data tools

DBT = "model string, column_name string, database string, schema_name string, kind string"


def dbt_rows(text: str) -> Iterator[tuple]:
    """model and column of a dbt schema file, models and sources alike; database and schema where the file says them."""
    import yaml

    try:
        raw = yaml.safe_load(re.sub(r"\{\{.*?\}\}", "x", text, flags=re.S))
    except yaml.YAMLError:
        return
    if not isinstance(raw, dict):
        return
    rows = lambda x, k: [y for y in (x.get(k) or []) if isinstance(y, dict)] if isinstance(x, dict) and isinstance(x.get(k), list) else []
    for m in rows(raw, "models"):
        for c in rows(m, "columns") or [{}]:
            yield str(m.get("name", "")), str(c.get("name", "")), "", str((m.get("config") or {}).get("schema", "")), "model"
    for s in rows(raw, "sources"):
        for t in rows(s, "tables"):
            for c in rows(t, "columns") or [{}]:
                yield str(t.get("name", "")), str(c.get("name", "")), str(s.get("database", "")), str(s.get("schema", s.get("name", ""))), "source"


DBT_RULE = "Storages.DBT.{0}.Write"


def dbt_project(spark: SparkSession, project: str, profiles: str) -> dict[str, str]:
    """name, vendor, location, database and schema of a dbt project by its profile's target; the generated sink's id. Missing parts are empty."""
    import yaml

    p, q = yaml.safe_load(project) or {}, yaml.safe_load(profiles) or {}
    own = q.get(p.get("profile", p.get("name"))) or {}
    outputs = own.get("outputs") or {}
    target = outputs.get(own.get("target")) or next(iter(outputs.values()), {})
    get = lambda *names: next((str(target[n]) for n in names if target.get(n) is not None), "")
    vendor = get("type")
    return {"name": str(p.get("name", "")), "vendor": vendor, "location": get("host", "account", "server", "project"), "database": get("dbname", "database", "catalog", "project"), "schema": get("schema", "dataset"), "rule_id": DBT_RULE.format(vendor or "Unknown")}


def dbt_schema(found: DataFrame, project: dict[str, str]) -> DataFrame:
    """One row a repository: the database with its tables and their columns, nested."""
    cols = found.where("model <> ''").groupBy("repo", "model").agg(F.array_sort(F.collect_set(F.nullif(F.col("column_name"), F.lit("")))).alias("columns"))
    tables = cols.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(F.col("model").alias("name"), "columns"))).alias("tables"))
    lit = F.lit
    return tables.select("repo", lit(project["rule_id"]).alias("rule_id"), lit(project["database"]).alias("db_name"), lit(project["vendor"]).alias("db_vendor"), lit(project["location"]).alias("db_location"), lit("Write").alias("db_operation"), F.struct(lit(project["schema"]).alias("name"), "tables").alias("schema"))


SYNC = "model string, actual_destination_name string, schedule_paused boolean, kind string, query string"


def sync_rows(text: str) -> Iterator[tuple]:
    """Models (with their query) and sinks of a data sync in YAML; the destination as the manifest names it is left to ``synced``."""
    import yaml

    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError:
        return
    if not isinstance(raw, dict):
        return
    if raw.get("rawSql") or raw.get("sql"):
        yield str(raw.get("slug", raw.get("name", ""))), "", False, "model", str(raw.get("rawSql") or raw.get("sql"))
    for s in raw.get("syncs") or ([raw] if raw.get("destination") and raw.get("model") else []):
        if isinstance(s, dict) and s.get("model") and s.get("destination"):
            yield str(s["model"]), str(s["destination"]), bool(s.get("schedulePaused", False)), "sync", ""
    if isinstance(raw.get("destinations"), dict):
        for slug, d in raw["destinations"].items():
            yield str(slug), str(d.get("type", d.get("name", slug)) if isinstance(d, dict) else d), False, "destination", ""


def synced(found: DataFrame) -> DataFrame:
    """(repo, file, model, actual_destination_name, schedule_paused): syncs with the destination that the manifest gives their slug."""
    d = found.where("kind = 'destination'").groupBy("repo", F.col("model").alias("slug")).agg(F.min("actual_destination_name").alias("named"))
    s = found.where("kind = 'sync'").withColumnRenamed("actual_destination_name", "slug")
    return s.join(d, ["repo", "slug"], "left").select("repo", "file", "model", F.coalesce("named", "slug").alias("actual_destination_name"), "schedule_paused")


def read_syncs(yamls: DataFrame) -> DataFrame:
    return parsed(yamls, "content", sync_rows, SYNC)


def read_dbt(yamls: DataFrame) -> DataFrame:
    return parsed(yamls.where(full_match(F.col("file"), r".*\.ya?ml")), "content", dbt_rows, DBT)


def json_rules(text: str) -> list[tuple[str, str, str, str]]:
    """(id, name, domain, pattern) of rules in a JSON list."""
    return [(x["id"], x["name"], x["domain"], x["pattern"]) for x in json.loads(text)]
