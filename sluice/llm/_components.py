"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import _spark


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each end of ``edges`` (a, b) reaches.

    Every round a node takes the least label among its own, its neighbours' and its label's label; paths so shrink about
    by half each round. Each round is written to the shared folder; the work stops when no label changes.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("peer")).union(edges.select("b", "a")).where("node <> peer").distinct()
    both = _spark.materialise(both, "edges")
    labels = _spark.materialise(both.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("peer"), F.col("root").alias("near")), "peer").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = _spark.materialise(step.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")), "labels")
        changed = step.where("root <> old").limit(1).count()
        _spark.discard(labels)
        labels = step.select("node", "root")
        if not changed:
            _spark.discard(both)
            return labels
    raise RuntimeError(f"components: labels still change after {max_rounds} rounds")
