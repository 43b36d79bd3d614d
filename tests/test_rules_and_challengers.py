"""Public suffix rules with wildcards and exceptions, challengers on unseen folds, sequence digests."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasshouse.functions.urls import public_suffixes
from glasshouse.operators import train
from glasshouse.sources.evidence import sequence_digest

RULES = "com\n*.ck\n!www.ck\nuk\nco.uk\nac.uk\nbr\ncom.br\n*.kawasaki.jp\n!city.kawasaki.jp\njp\nkobe.jp\n*.compute.example.com\nB.br".split("\n")
# domain: suffix, registrable
CASES = {
    "example.com": ("com", "example.com"), "a.b.example.com": ("com", "example.com"), "com": ("com", None), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "foo.ck": ("foo.ck", None),
    "bar.foo.ck": ("foo.ck", "bar.foo.ck"), "ck": ("ck", None), "x.co.uk": ("co.uk", "x.co.uk"), "y.x.co.uk": ("co.uk", "x.co.uk"), "x.uk": ("uk", "x.uk"), "unlisted.zz": ("zz", "unlisted.zz"), "zz": ("zz", None),
    "city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "a.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "a.b.kawasaki.jp": ("b.kawasaki.jp", "a.b.kawasaki.jp"), "kawasaki.jp": ("jp", "kawasaki.jp"),
    "i.eu.compute.example.com": ("eu.compute.example.com", "i.eu.compute.example.com"), "x.b.br": ("b.br", "x.b.br"), "": (None, None), None: (None, None),
}


def test_suffix_rules(spark):
    rows = spark.createDataFrame([(d, "clash") for d in CASES] * 2, "domain string, rule string")
    got = public_suffixes(rows, "domain", spark.createDataFrame([(r,) for r in RULES], "rule string")).collect()
    assert len(got) == 2 * len(CASES)
    assert {r.domain: (r.suffix, r.registrable) for r in got} == CASES


def test_challengers_are_scored_on_folds_they_have_not_seen(spark):
    rng = np.random.default_rng(4)
    data = [(int(i % 2), int(a), int(b), bool(rng.random() < (0.85 if a and b else 0.2))) for i, (a, b) in enumerate(rng.integers(0, 2, (400, 2)))] + [(2, 1, 1, True)]
    rows = spark.createDataFrame(data, "fold int, a int, b int, y boolean")
    got = train.challenge(rows, ["a", "b"], "y", "fold", rounds=15).collect()
    assert len(got) == 3 * len(data)
    for model in ("penalised", "ridge", "boosted"):
        right = np.mean([(r.predicted == "true") == r.actual for r in got if r.model == model])
        assert right > 0.75
    # the ridge of fold 0 by Newton's method on the other folds
    x = np.array([[1, a, b] for f, a, b, _ in data if f != 0], float)
    y = np.array([t for f, *_, t in data if f != 0], float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        pen = np.array([0, 1.0, 1.0])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (p - y) + pen * w)
    ridge = {r.probability for r in got if r.model == "ridge" and r.fold == 0}
    want = {float(1 / (1 + np.exp(-np.array([1, a, b]) @ w))) for a in (0, 1) for b in (0, 1)}
    assert sorted(ridge) == pytest.approx(sorted(want), abs=2e-3)


def test_one_class_outside_of_a_fold(spark):
    rows = spark.createDataFrame([(0, 1, True), (0, 0, False), (1, 1, True)], "fold int, a int, y boolean")
    got = {(r.fold, r.model): r.probability for r in train.challenge(rows, ["a"], "y", "fold", rounds=2).where("fold = 0").collect()}
    assert set(got.values()) == {1.0}


def test_sequence_digest(spark):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "é"), (2, 0, "")], "k int, o int, t string")
    got = {r.k: r.d for r in rows.groupBy("k").agg(sequence_digest(F.col("t"), F.col("o")).alias("d")).collect()}
    assert got == {1: hashlib.sha256("é\0b\0".encode()).hexdigest(), 2: hashlib.sha256(b"\0").hexdigest()}
