"""Exact quantiles against numpy: hot groups, ties, narrowing over several rounds."""

import random

import numpy as np
import pytest

from glasshouse.operators.quantiles import exact_quantiles

QS = [0.0, 0.05, 0.5, 0.9, 0.998, 1.0]


def check(spark, rows, few):
    df = spark.createDataFrame(rows, "lang string, p double, n string")
    got = {(r.lang, r.q): (r.n, r.quantile) for r in exact_quantiles(df, ["lang"], "p", QS, few=few).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        vs = [r[1] for r in rows if r[0] == g and r[1] is not None]
        want |= {(g, i): (len(vs), float(np.quantile(vs, q))) for i, q in enumerate(QS) if vs}
    assert got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(v, rel=1e-12, abs=1e-300), k


@pytest.mark.parametrize("few", [10_000, 40])
def test_groups_of_all_sizes(spark, few):
    rng = random.Random(few)
    rows = [("hot", 10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]), "x") for _ in range(6000)]
    rows += [("ties", rng.choice([0.5, 0.5, 0.5, 0.25, rng.random()]), "") for _ in range(5000)] + [("one value", 7.0, "")] * 3000
    rows += [(None, rng.random(), "") for _ in range(300)] + [("single", -1.5, ""), ("nothing", None, ""), ("two", 1.0, ""), ("two", 2.0, ""), ("two", None, "")]
    check(spark, rows, few)


def test_last_of_a_run_of_ties(spark):
    rows = [("g", 1.0, "")] * 900 + [("g", 2.0 + i, "") for i in range(901)]
    check(spark, rows, 20)


def test_no_groups_and_empty(spark):
    df = spark.range(1000).selectExpr("double(id) AS p")
    assert [(r.q, r.n, r.quantile) for r in exact_quantiles(df, [], "p", [0.25], few=50).collect()] == [(0, 1000, 249.75)]
    assert exact_quantiles(df.limit(0), [], "p", [0.5]).collect() == []
    with pytest.raises(ValueError):
        exact_quantiles(df, [], "p", [1.5])


def test_coverage_is_found_once(spark):
    """However many rounds the quantiles take."""
    from glasshouse.operators.train import coverage_quantiles

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(0, 12_000, 1, 2).selectExpr("id / 11999 AS coverage").mapInArrow(counted, "coverage double")
    r = coverage_quantiles(rows).first()
    assert [round(r[c], 9) for c in ("p05", "p25", "median", "p75", "mean")] == [0.05, 0.25, 0.5, 0.75, 0.5]
    assert seen.value == 12_000
