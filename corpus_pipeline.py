"""A training-corpus pipeline: each stage works on what the one before it kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import _spark
from sluice.llm.op2_sentencepiece import round_trip
from sluice.llm.op3_lines import dedup_lines
from sluice.llm.op4_simhash import near_dedup
from sluice.llm.op6_decontamination import decontaminated
from sluice.llm.op8_language import accepted


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the string-kernel model knows."""
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines aligned with an earlier document's, n_chars to match; documents of which no words are left go."""
    out = dedup_lines(docs)
    shorter = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~F.col("emptied")).withColumn("n_chars", shorter).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return near_dedup(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminated(docs, _spark.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, how many, and whether they decode to the text."""
    out = round_trip(docs)
    return out.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("tokenize", tokenize),
]

#: Patience alignment, fingerprints, edit distances and trained models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _spark.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
