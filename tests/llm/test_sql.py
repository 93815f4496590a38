"""The corpus queries that SQL can express, against it."""

import zlib

import duckdb
import pytest

from sluice.llm import sql
from sluice.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_jaccard", "op13_spelling"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, want))


def test_crc_in_sql():
    texts = ["", "7", "-12", "3:étage", "ÿ" * 40]
    got = duckdb.execute(f"WITH {sql._CRC_TABLE} SELECT {sql._crc32('x')} FROM (SELECT unnest(?) AS x), crc", [texts]).fetchall()
    assert [r[0] for r in got] == [zlib.crc32(x.encode()) for x in texts]
