"""Streams on a file source: matching, late rows, and state that outlives a restart."""

import datetime as dt

from sluice.operators.tagging import Rule
from sluice.streaming import tagging

RULES = [Rule("Mail", ("(?i).*mail",)), Rule("Name", (".*name",))]
SCHEMA = "at timestamp, name string"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def feed(spark, folder, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def counts(spark, tmp_path, name="out"):
    rows = spark.read.schema("start timestamp, end timestamp, rule_id string, n long").parquet(str(tmp_path / name)).collect()
    return sorted((r.start, r.rule_id, r.n) for r in rows)


def run(spark, tmp_path):
    """Everything that is there, a file at a time, from where the checkpoint has it."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = tagging.tag_counts(tagging.tag_stream(rows, "name", RULES), "at", "10 minutes", "1 hour")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_stream_tags_like_a_batch(spark, tmp_path):
    feed(spark, tmp_path / "in", (at(9), "Email"), (at(9), "firstname"), (at(9), "other"))
    rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = tagging.tag_stream(rows, "name", RULES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = tagging.tag_stream(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), "name", RULES)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect())) and want.count() == 2


def test_a_late_row_is_left_out(spark, tmp_path):
    feed(spark, tmp_path / "in", (at(9, 1), "mail"), (at(9, 2), "mail"))
    run(spark, tmp_path)
    feed(spark, tmp_path / "in", (at(12), "mail"))  # the watermark goes to eleven
    run(spark, tmp_path)
    feed(spark, tmp_path / "in", (at(9, 3), "mail"), (at(11, 30), "mail"))
    run(spark, tmp_path)
    feed(spark, tmp_path / "in", (at(15), "mail"))
    run(spark, tmp_path)
    run(spark, tmp_path)
    assert counts(spark, tmp_path) == [(at(9), "Mail", 2), (at(11, 30), "Mail", 1), (at(12), "Mail", 1)]


def test_an_open_window_outlives_a_restart(spark, tmp_path):
    feed(spark, tmp_path / "in", (at(9, 1), "mail"), (at(9, 1), "surname"))
    run(spark, tmp_path)  # ends, with nine o'clock still open
    assert counts(spark, tmp_path) == []
    feed(spark, tmp_path / "in", (at(9, 9), "mail"), (at(9, 11), "mail"))
    run(spark, tmp_path)
    feed(spark, tmp_path / "in", (at(13), "x mail"))
    run(spark, tmp_path)
    run(spark, tmp_path)
    assert counts(spark, tmp_path) == [(at(9), "Mail", 2), (at(9), "Name", 1), (at(9, 10), "Mail", 1)]
