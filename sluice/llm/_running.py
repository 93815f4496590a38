"""Running totals over a sorted table of any size: no group is one task's, however long it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import _spark


def running(rows: DataFrame, group: str | None, order: list[Column | str], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with a column run_<v> for each long v: its sum, or exclusive or, over the rows of the group up to this one.

    Rows are dealt by ranges of (group, order), which must order them wholly, so a long group lies in many tasks. Each task adds up its own
    rows; what a group had before a task's first row comes from a table of two rows a task (its first and its last group), which
    is small whatever the data, and is broadcast. ``group`` is a long column without nulls, or None for one running total.
    """
    values, n = [*sums, *xors], _spark.partitions(rows.sparkSession)
    key = group or "_g"
    rows = rows if group else rows.withColumn("_g", F.lit(0).cast("long"))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"run_{v}", T.LongType()) for v in values), T.StructField("_part", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("_head", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, first, last = TaskContext.get().partitionId(), 0, None, None
        carry = np.zeros(len(values), np.int64)
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            g = b.column(names.index(key)).to_numpy(zero_copy_only=False)
            first = g[0] if first is None else first
            new = np.empty(m, bool)
            new[0], new[1:] = last is not None and g[0] != last, g[1:] != g[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(m), -1))  # -1: goes on from the batch before
            out = []
            for k, v in enumerate(values):
                x = b.column(names.index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(x) if v in sums else np.bitwise_xor.accumulate(x)
                before = np.where(start > 0, total[np.maximum(start - 1, 0)], 0)
                since = np.where(start < 0, carry[k], 0)
                total = total - before + since if v in sums else total ^ before ^ since
                carry[k] = total[-1]
                out.append(pa.array(total))
            last = g[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *out, pa.array(np.full(m, part, np.int64)), pa.array(np.arange(row, row + m)), pa.array(g == first)], [f.name for f in schema])
            row += m

    keys = ([group] if group else []) + order
    done = _spark.materialise(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "running")
    each = F.struct(F.col(key).alias("g"), *(F.col(f"run_{v}") for v in values))
    ends = done.groupBy("_part").agg(F.max_by(each, F.when(F.col("_head"), F.col("_row"))).alias("f"), F.max_by(each, "_row").alias("l"))
    ends = ends.select("_part", F.explode(F.array(F.struct(F.lit(True).alias("_first"), "f.*"), F.struct(F.lit(False).alias("_first"), "l.*"))).alias("e"), (F.col("f.g") == F.col("l.g")).alias("_same")).where("e._first or not _same")
    earlier = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", "e.*")
    carried = ends.select("_part", "_first", *((F.sum if v in sums else F.bit_xor)(f"run_{v}").over(earlier).alias(f"_c_{v}") for v in values)).where("_first").drop("_first")
    out = done.join(F.broadcast(carried.withColumn("_head", F.lit(True))), ["_part", "_head"], "left")
    own = {v: F.coalesce(F.col(f"_c_{v}"), F.lit(0)) for v in values}
    return out.select(*(c for c in names if c != "_g"), *((F.col(f"run_{v}") + own[v] if v in sums else F.col(f"run_{v}").bitwiseXOR(own[v])).alias(f"run_{v}") for v in values))
