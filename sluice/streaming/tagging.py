"""Rule matching and policy counts over streams: an extension, as the engine's own scans are batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.predicates import full_match
from sluice.operators.tagging import Rule, valid


def tag_stream(nodes: DataFrame, column: str, rules: Sequence[Rule]) -> DataFrame:
    """The nodes with the ids of the rules that match them. Each row is matched by itself: no join, no state."""
    hits = [F.when(full_match(F.col(column), r.pattern), F.lit(r.id)) for r in valid(list(rules))]
    return nodes.withColumn("rule_id", F.explode(F.array_compact(F.array(*hits).cast("array<string>"))))


def tag_counts(tagged: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tagged nodes by rule and window of event time; rows later than ``late`` are left out, and state is dropped with them."""
    rows = tagged.withColumn("_at", F.col(time)).withWatermark("_at", late)
    counts = rows.groupBy(F.window("_at", window).alias("_w"), "rule_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "rule_id", "n")
