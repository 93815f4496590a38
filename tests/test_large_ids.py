"""Queries whose keys reach beyond the gaps between the offsets of node ids, as those of large tables do, against their SQL."""

import duckdb
import pytest

from sluice.operators import calls
from sluice.plans import catalogue, flow_queries, ids, program_queries  # noqa: F401
from tests.test_queries import SF

KEYS = {"customer": {"c_custkey": 10**6}, "orders": {"o_orderkey": 10**7, "o_custkey": 10**6}}


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Three copies of customers and orders, each a gap beyond the one before."""
    folder, db = tmp_path_factory.mktemp("far"), duckdb.connect()
    for t in ("customer", "orders", "part", "events"):
        shift = ", ".join(f"{c} + i * {gap} AS {c}" for c, gap in KEYS.get(t, {}).items())
        own = f"SELECT t.* REPLACE ({shift}) FROM '{SF}/{t}.parquet' t, range(3) r(i)" if shift else f"FROM '{SF}/{t}.parquet'"
        db.sql(f"COPY ({own}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["flow_overlap_filter", "export_dataflows", "flow_store", "recovered_types", "reaching_definitions"])
def test_ids_of_two_kinds_never_meet(spark, far, name):
    db = duckdb.connect()
    for t in ("customer", "orders", "part", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{far}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, far)
    want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_spread_ids_are_summed_again(spark):
    assert ids.spread("SELECT 20000000 + k + 1, 1000000 + k, k % 100") == "SELECT 20000000000000 + k + 1, 1000000000000 + k, k % 100"
    rows = spark.range(1).selectExpr("explode(array(20 * bigint(1000000000000) + 54000000, bigint(71000000000000) - 1, bigint(3))) AS id")
    assert [r.id for r in rows.select(ids.summed(rows.id).alias("id")).collect()] == [74000000, 70999999, 3]


def test_paths_by_calls_of_nodes_apart(spark, far, monkeypatch):
    """The SQL as it stands goes from node to node of one number and does not end here, so it is run with the offsets spread. Nothing counts as small."""
    monkeypatch.setattr(calls, "FEW_ROWS", 0)
    monkeypatch.setattr(calls, "FEW_BYTES", 0)
    db = duckdb.connect()
    for t in ("customer", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{far}/{t}.parquet'")
    plain = lambda i: (i + ids.SPAN // 2) // ids.SPAN * (ids.STEP - ids.SPAN) + i
    want = sorted((plain(a), plain(b), "-".join(str(plain(int(x))) for x in path.split("-"))) for a, b, path in db.sql(f"SELECT source, sink, path_id FROM ({ids.spread(catalogue.ORACLES['flow_paths_by_calls'])})").fetchall())
    assert want and sorted(map(tuple, catalogue.QUERIES["flow_paths_by_calls"](spark, far).select("source", "sink", "path_id").collect())) == want
