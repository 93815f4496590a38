"""Session helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where the session names none, one of our own, but on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/sluice-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as no column of ``taken`` has."""
    known = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in known:
            n = f"_{n}"
        known.add(n.lower())
        out.append(n)
    return out


HOT_KEYS, HOT_ROWS = 100_000, 1000


def first_holders(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys that several doc_ids hold, less those of the first holder, with first_id.

    First holders come from an aggregate that is combined before its exchange. Keys that hold a hundred-thousandth of
    all rows or more are at most ``HOT_KEYS``: they are broadcast, so that no task gets all rows of one key.
    """
    stats = materialise(rows.groupBy(key).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "holders")
    limit = max((stats.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS + 1, HOT_ROWS)
    hot = stats.where(F.col("n") >= limit).select(key, F.col("first_id").alias("_hot"))
    tagged = rows.join(F.broadcast(hot), key, "left")
    rest = tagged.where("_hot is null").drop("_hot").join(stats.where(F.col("n") < limit).select(key, "first_id"), key)
    return tagged.where("_hot is not null").withColumnRenamed("_hot", "first_id").unionByName(rest).where("doc_id <> first_id")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
