import duckdb
import pytest

import __spark_entry__ as e
from sluice.plans import catalogue, flow_queries, language_queries, program_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(catalogue.ORACLES[name]).fetchdf()
    assert cols == sorted(want.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(cols).collect())
    rows = db.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert got == sorted(repr(tuple(map(plain, r))) for r in rows)


def test_entry(spark):
    assert e.entry(spark).count() > 0
