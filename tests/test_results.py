"""The result table in files: what is rewritten, what is read, and what two writers see."""

import glob

import pytest
from pyspark.sql import functions as F

from glasshouse.sources.results import ResultTable

SCHEMA = "run_id string, protocol_version string, domain_url string, variable_name string, value string, computed_at long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def files(root):
    return set(glob.glob(f"{root}/data/**/*.parquet", recursive=True))


def as_set(df):
    return {(r.run_id, r.domain_url, r.variable_name, r.value) for r in df.collect()}


def scanned(spark, store, wanted):
    """Rows that the file scan of a lookup puts out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # one plan from scan to result
    try:
        df = store.lookup(wanted)
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_only_touched_runs_are_rewritten(spark, tmp_path):
    store = ResultTable(spark, str(tmp_path))
    assert store.read() is None and store.lookup({"run_id": "a"}) is None
    assert store.upsert(rows(spark, [])) == [] and store.version() == 0
    assert store.upsert(rows(spark, [("a", "p", "h1", "v", "1", 1), ("b", "p", "h1", "v", "1", 1), (None, "p", "h1", "v", "0", 1)])) == ['{"run_id":"a"}', '{"run_id":"b"}', "{}"]
    before, live = files(tmp_path), store.runs()
    assert store.upsert(rows(spark, [("b", "p", "h1", "v", "2", 2), ("b", "p", "h2", "v", "3", 2), ("b", "p", "h2", "v", "4", 3), ("b", "p", "h1", "v", "old", 0)])) == ['{"run_id":"b"}']
    assert before < files(tmp_path)  # nothing that was there has been touched
    assert {r for r in live if store.runs()[r] != live[r]} == {'{"run_id":"b"}'}
    assert as_set(store.read()) == {("a", "h1", "v", "1"), ("b", "h1", "v", "2"), ("b", "h2", "v", "4"), (None, "h1", "v", "0")}
    assert as_set(store.read(1)) == {("a", "h1", "v", "1"), ("b", "h1", "v", "1"), (None, "h1", "v", "0")}  # the version before is still whole
    assert store.vacuum() == 1 and as_set(store.lookup({"run_id": "b", "nonsense": "x", "domain_url": ""})) == {("b", "h1", "v", "2"), ("b", "h2", "v", "4")}


def test_two_writers(spark, tmp_path, monkeypatch):
    store = ResultTable(spark, str(tmp_path))
    store.upsert(rows(spark, [("a", "p", "h", "v", "1", 1)]))
    late = ResultTable(spark, str(tmp_path))
    monkeypatch.setattr(late, "version", lambda: 1)
    store.upsert(rows(spark, [("a", "p", "h", "v", "2", 2)]))
    with pytest.raises(RuntimeError):
        late.upsert(rows(spark, [("a", "p", "h2", "v", "3", 3)]))
    assert as_set(store.read()) == {("a", "h", "v", "2")}


def test_lookups_skip_data(spark, tmp_path):
    store = ResultTable(spark, str(tmp_path))
    data = spark.range(40_000).select(
        F.concat(F.lit("r"), F.col("id") % 4).alias("run_id"), F.lit("p").alias("protocol_version"), F.concat(F.lit("h"), F.col("id") * 7919 % 40_000 * 2).alias("domain_url"),
        F.concat(F.lit("v"), F.floor(F.col("id") / 10_000)).alias("variable_name"), F.lit("true").alias("value"), F.col("id").alias("computed_at"),
    )
    store.upsert(data)
    one = store.lookup({"run_id": "r1"})
    assert len({f.split("/part=")[1].split("/")[0] for f in one.inputFiles()}) == 1 and one.count() == 10_000
    for column, value in (("domain_url", "h14"), ("variable_name", "v2")):
        assert f"EqualTo({column},{value})" in store.lookup({column: value})._jdf.queryExecution().toString()
    assert scanned(spark, store, {"domain_url": "h15"}) == 0  # within the range of the hosts, so only the Bloom filter can tell
    assert scanned(spark, store, {"domain_url": "h14"}) > 0
