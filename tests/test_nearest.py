"""Nearest marks against a plain search, over stretches, and match places against Python's."""

import random
import re

from pyspark.sql import functions as F

from glasshouse.operators import nearest


def test_against_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 16)
    rng = random.Random(2)
    points = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(400)]), i) for i in range(500)] + [("a", 7, 1000)] * 3
    anchors = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 400, 9)]), "clash") for _ in range(60)] * 2
    df = nearest.nearest(spark.createDataFrame(points, "site string, at long, before_ int"), spark.createDataFrame(anchors, "site string, at long, before_ string"))
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = []
    for site, at, i in points:
        mine = [a for s, a, _ in anchors if s is not None and s == site and a is not None and at is not None]
        before, after = max((a for a in mine if a <= at), default=None), min((a for a in mine if a >= at), default=None)
        want.append((site, at, i, before, after, min((abs(a - at) for a in mine), default=None)))
    assert got == sorted(want, key=repr)


def test_hot_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 1000)
    rows = spark.range(200_000).select(F.lit("hot").alias("site"), F.col("id").alias("at"))
    found = nearest.nearest(rows, rows.where("at % 7000 = 3"))
    assert found.agg(F.max("distance"), F.count(F.lit(1)), F.count("before")).first()[:] == (200_000 - 1 - 196_003, 200_000, 199_997)


def test_starts(spark):
    texts = ["", "abab", "xaby", "éabéab", "no", None, "ab" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", nearest.starts(F.col("t"), "ab").alias("s"))
    assert {r.i: r.s for r in df.collect()} == {i: None if t is None else [m.start() for m in re.finditer("ab", t)] for i, t in enumerate(texts)}


def test_texts_are_split_once(spark):
    """Not again for every match: the split stands outside of what runs for each."""
    from glasshouse.operators.nearest import starts

    df = spark.createDataFrame([("a-bb--c",), ("",), ("--",), (None,)], "t string").select(starts(F.col("t"), "-").alias("at"))
    assert [r["at"] for r in df.collect()] == [[1, 4, 5], [], [0, 1], None]
    assert not re.search(r"lambdafunction\(.*split\(", df._jdf.queryExecution().optimizedPlan().toString())
