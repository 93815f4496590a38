"""Commands: ``validate RULES`` prints what is wrong with a rules folder; ``scan`` runs a language's profile over stored tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sluice.exporters import audit as audit_sheets
from sluice.exporters import document
from sluice.operators import semantics
from sluice.operators.graph import Program
from sluice.plans import profiles
from sluice.sources import rules


def validate(spark: SparkSession, folder: str) -> int:
    """The number of problems, each printed with its file."""
    found = rules.check(spark, folder)
    for file, problem in found:
        print(f"{file}: {problem}")
    print(f"{len(found)} problems" if found else "all rules are valid")
    return len(found)


OPTIONAL = {"properties": "properties", "imports": "imports", "sql_columns": "sql_columns", "dom": "dom", "syncs": "syncs", "layouts": "layouts", "elements": "elements", "dependencies": "dependencies", "dependency_info": "dependency_info", "modules": "modules"}


def scan(spark: SparkSession, tables: str, folder: str, language: str, out: str, own_rules: str | None = None, audit: bool = False) -> None:
    """Scan the tables under ``tables`` (Parquet: nodes, edges, tags, and those of ``OPTIONAL`` that there are) and write the document under ``out``."""
    read = lambda name: spark.read.parquet(f"{tables}/{name}.parquet")
    inner = rules.load(spark, folder, {language})
    catalogue = rules.merge(rules.load(spark, own_rules, {language}, external=True), inner) if own_rules else inner
    there = {f: read(name) for f, name in OPTIONAL.items() if _exists(spark, f"{tables}/{name}.parquet")}
    done = profiles.scan(profiles.Context(spark, Program(read("nodes"), read("edges"), read("tags")), catalogue, language, **there))
    sections = profiles.sections(done)
    document.write(document.document(done.program.nodes.select("repo").distinct(), sections), out)
    for row in document.summary(sections).orderBy("section", "repo").limit(SUMMARY_ROWS).collect():
        print(f"{row.repo}: {row.n} {row.section}")
    if done.semantics is not None:
        document.write_semantics(semantics.text_lines(done.semantics), f"{out}/semantics")
    if audit:
        audit_sheets.workbook(profiles.sheets(done), f"{out}/audit")


SUMMARY_ROWS = 200  # printed; the document has all


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sluice", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("validate").add_argument("rules")
    own = commands.add_parser("scan")
    for name in ("tables", "rules", "language", "out"):
        own.add_argument(name)
    own.add_argument("--own-rules")
    own.add_argument("--audit", action="store_true")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("sluice").getOrCreate()
    if a.command == "validate":
        return 1 if validate(spark, a.rules) else 0
    scan(spark, a.tables, a.rules, a.language, a.out, a.own_rules, a.audit)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
