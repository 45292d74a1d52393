import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df, r = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    got = sorted(tuple(plain(x[c]) for c in cols) for x in df.collect())
    assert got == sorted(tuple(plain(x[r.columns.index(c)]) for c in cols) for x in r.fetchall())


def test_rows_only_queries(spark):
    assert all(r["ok"] and not r["omits"] for r in QUERIES["mask_roundtrip_ok"](spark, SF).collect())
    assert all(r["whole"] for r in QUERIES["stream_overlap_merge"](spark, SF).collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
