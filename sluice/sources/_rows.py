"""Rows from texts: one pass of a parser over a column, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 64  # texts between two outgoing batches


def parsed(df: DataFrame, text: str, parser: Callable[[str], Iterable[tuple]], fields: str) -> DataFrame:
    """Each row of ``df`` less ``text``, once for every tuple that ``parser`` finds in the text, with the tuple as ``fields``.

    A null text has no rows; fields replace columns of the same name.
    """
    added = df.sparkSession.createDataFrame([], fields).schema
    keys = [c for c in df.columns if c != text and c not in added.names]
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema
    for f in added:
        schema = schema.add(f)
    arrow = to_arrow_schema(schema)
    kinds = [arrow.field(n).type for n in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                found = [(k, row) for k, t in enumerate(b.column(len(keys)).to_pylist()) for row in parser(t)]
                own = pa.array([k for k, _ in found], pa.int32())
                cols = [pa.array([r[i] for _, r in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(own) for i in range(len(keys))), *cols], [*keys, *added.names])

    return rows.mapInArrow(run, schema)
