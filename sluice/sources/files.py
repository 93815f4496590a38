"""Files of a scanned repository, and the limits on property files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.operators import predicates

FILE = "file string, size long, content binary"


def directory(file: Column) -> Column:
    return F.regexp_replace(file, "/[^/]*$", "")


def by_extension(spark: SparkSession, root: str, extensions: Sequence[str], exclusions: Sequence[str] = ()) -> DataFrame:
    """file, size, content of all files under ``root`` that end so, less those that an exclusion matches. Content is read only if it is used."""
    glob = "*{" + ",".join(extensions) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rows = found.select(F.col("path").alias("file"), F.col("length").alias("size"), "content")
    return rows.where(predicates.allowed_file(F.col("file"), list(exclusions))) if exclusions else rows


def by_name(spark: SparkSession, root: str, names: Sequence[str], exclusions: Sequence[str] = ()) -> DataFrame:
    """As ``by_extension``, of files that bear one of the names; each file once."""
    return by_extension(spark, root, names, exclusions).where(F.regexp_extract("file", "[^/]*$", 0).isin(*names))


def text_of(files: DataFrame) -> DataFrame:
    return files.withColumn("content", F.decode("content", "UTF-8"))


def within_size(files: DataFrame, limit_kb: int | None) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): files of more than ``limit_kb`` whole KB are skipped; null: no limit."""
    large = F.floor(F.col("size") / 1024) > F.lit(limit_kb) if limit_kb is not None else F.lit(False)
    return files.where(~large), files.where(large)


def within_directory_count(files: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): directories of more than ``limit`` files are skipped whole; null: no limit.

    Counts are aggregated before the exchange; a large directory is never one task's group.
    """
    if limit is None:
        return files, files.limit(0)
    large = files.groupBy(directory(F.col("file")).alias("_dir")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_dir")
    on = directory(files["file"]) == large["_dir"]
    return files.join(large, on, "left_anti"), files.join(large, on, "left_semi")


def numbered(files: DataFrame) -> DataFrame:
    """The files of each directory in the order of their names, from 0."""
    return files.withColumn("ord", F.row_number().over(Window.partitionBy(directory(F.col("file"))).orderBy("file")) - 1)
