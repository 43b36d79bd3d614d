"""The opN queries against their SQL, and the rows that each must return."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from glasshouse.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.select(cols).collect()) if name in ORACLES else df.collect()
    table, key = {"op5": ("pages", "page_id"), "op13": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    if name.startswith("op11"):  # the documents that changes concern, if they are present on any day
        ids = {r[0] for r in df.select(key).collect()} & {i - i % 10 for i in ids}
    assert {r[key] for r in df.select(key).collect()} == ids
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        res = con.execute(ORACLES[name])
        names = [d[0] for d in res.description]
        assert got == sorted(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())
