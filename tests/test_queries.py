"""Every query with SQL gives the same rows as that SQL on the smallest tables; the others run."""

from __future__ import annotations

import duckdb
import pytest

import catalog
from tools.check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLES:
        assert got[1]
        return
    cur = con.execute(catalog.ORACLES[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
