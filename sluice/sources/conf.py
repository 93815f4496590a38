"""HOCON files that include and refer to each other, resolved over all files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators._stage import keep
from sluice.sources._rows import parsed
from sluice.sources.xml import INCLUDE, hocon_pieces

HOLE = r"\$\{(\??[^}]*)\}"


def included(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file, origin, depth): the files that each file takes keys from, itself at depth nought. Files that include each other end."""
    folder = F.regexp_replace("file", "[^/]*$", "")
    named = rows.where(F.col("name") == INCLUDE).select("repo", "file", F.explode(F.array(F.concat(folder, "value"), F.concat(folder, "value", F.lit(".conf")))).alias("to"))
    step = keep(named.join(files.select("repo", F.col("file").alias("to")), ["repo", "to"]).distinct(), "includes")
    new = keep(files.select("repo", "file", F.col("file").alias("origin"), F.lit(0).alias("depth")).distinct(), "included")
    every = new
    while not new.isEmpty():
        came = new.join(step.withColumnRenamed("file", "origin"), ["repo", "origin"]).select("repo", "file", F.col("to").alias("origin"), (F.col("depth") + 1).alias("depth")).distinct()
        new = keep(came.join(every, ["repo", "file", "origin"], "left_anti"), "included")
        every = every.unionByName(new)
    return every


def resolved(files: DataFrame) -> DataFrame:
    """(repo, file, name, value, line, problem) of HOCON files (repo, file, content).

    A file's own keys win over those it includes, the nearest include over farther ones, by name among equals. References are put in as what they refer to is known,
    in rounds, until nothing changes; an optional one to no key is empty, another stays as it is. ``problem`` is ``missing`` where a key without a value
    is referred to, over other keys or not, and ``cycle`` where what is left refers to itself in a circle.
    """
    rows = keep(parsed(files.select("repo", "file", "content"), "content", hocon_pieces, "name string, value string, line int"), "conf")
    taken = included(rows, files).join(rows.where(F.col("name") != INCLUDE).withColumnRenamed("file", "origin"), ["repo", "origin"])
    own = taken.groupBy("repo", "file", "name").agg(F.min_by(F.struct("value", "line"), F.struct("depth", "origin")).alias("v")).select("repo", "file", "name", "v.value", "v.line")
    own = keep(own, "conf")
    holes = lambda df: df.select("repo", "file", "name", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(HOLE), F.lit(1)))).alias("hole")).withColumn("to", F.trim(F.regexp_replace("hole", r"^\?", "")))
    key = ["repo", "file"]
    while True:
        open_ = own.where(F.col("value").rlike(HOLE))
        targets = own.select("repo", "file", F.col("name").alias("to"), F.col("value").alias("put"))
        found = holes(open_).join(targets, [*key, "to"], "left")
        ready = found.where((F.col("put").isNotNull() & ~F.coalesce(F.col("put").rlike(HOLE), F.lit(False))) | (F.col("put").isNull() & F.col("hole").startswith("?")))
        puts = ready.groupBy("repo", "file", "name").agg(F.collect_list(F.struct(F.concat(F.lit("${"), "hole", F.lit("}")).alias("hole"), F.coalesce("put", F.lit("")).alias("put"))).alias("_puts"))
        step = own.join(puts, [*key, "name"], "left")
        filled = F.aggregate("_puts", F.col("value"), lambda v, p: F.replace(v, p["hole"], p["put"]))
        step = keep(step.select("repo", "file", "name", F.when(F.col("_puts").isNotNull(), filled).otherwise(F.col("value")).alias("value"), "line", F.col("_puts").isNotNull().alias("_moved")), "conf")
        own = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    left = keep(holes(own).select("repo", "file", "name", "to"), "open")
    new = keep(left.join(own.select("repo", "file", F.col("name").alias("to")), [*key, "to"], "left_anti").select("repo", "file", "name").distinct(), "missing")
    missing = new
    while not new.isEmpty():
        came = left.join(new.withColumnRenamed("name", "to"), [*key, "to"], "left_semi").select("repo", "file", "name").distinct()
        new = keep(came.join(missing, [*key, "name"], "left_anti"), "missing")
        missing = missing.unionByName(new)
    circle = left.select("repo", "file", "name").distinct().join(missing, [*key, "name"], "left_anti").withColumn("problem", F.lit("cycle"))
    return own.join(circle.unionByName(missing.withColumn("problem", F.lit("missing"))), [*key, "name"], "left")
