"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from glasshouse.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(rows, names, cols):
    return sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows_of([tuple(r) for r in df.collect()], df.columns, cols)
    if name not in ORACLES:
        assert got or name in ("v2_banner",)
        return
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == rows_of(res.fetchall(), names, cols)


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)
