"""Golden values published with the measured corpus, and analytic properties."""

import math

import numpy as np
import pytest

from glasshouse.functions import numeric as N

# Published patterns of F1 to F8 (rows, positives).
PATTERNS = """- 84 6;8 31 11;178 14 14;378 12 11;278 12 12;78 6 4;17 3 3;14578 3 3;1378 3 3;2678 2 2;1678 2 2;38 2 2;2378 2 2;1278 2 2;4578 2 1;3678 2 2;37 2 2;28 2 2;47 2 1;18 2 2;2467 1 1;167 1 1
12578 1 1;2478 1 1;478 1 1;27 1 1;68 1 0;1 1 1;7 1 0;1467 1 1;168 1 1;13578 1 1;23678 1 1;15678 1 1;578 1 1;1578 1 1;358 1 1""".replace("\n", ";")
# Published coefficients, profile intervals and p-values of the intercept and F1 to F8.
FIT = [
    (-2.4133975117600195, -3.2375942310872605, -1.7342496710056776, 1.3372229863418468e-17), (4.496324086347602, 2.147905333548518, 9.525921331880392, 5.496633301000042e-06),
    (3.586165601360079, 1.2492066315689978, 8.588387967848446, 0.0007951058509761297), (2.5094884774408435, 0.8018431227654941, 4.877912731782325, 0.0030210971194862242),
    (0.6254989633267973, -1.655010926378079, 2.953883277629399, 0.5836713801104045), (-0.44014105005106224, -2.646238466754231, 2.1655926058102497, 0.7086201502099425),
    (-1.1655843372003176, -4.329583379360703, 2.119678606716734, 0.47992346291194576), (1.2272371662772121, -0.18012947001603313, 2.644559293325868, 0.08599323579847111),
    (1.7914867591311867, 0.8427643274845371, 2.7952782087387544, 0.00021208336660389815),
]


def published():
    x, yes, n = [], [], []
    for row in PATTERNS.split(";"):
        name, count, pos = row.split()
        x.append([int(str(i) in name) for i in range(1, 9)])
        n.append(int(count))
        yes.append(int(pos))
    return np.array(x), np.array(yes), np.array(n)


def test_published_fit():
    x, yes, n = published()
    assert (n.sum(), yes.sum(), len(n)) == (207, 102, 37)
    beta, _, _ = N.firth(x, yes, n)
    assert np.allclose(beta, [f[0] for f in FIT], atol=1e-6)


@pytest.mark.parametrize("term", [0, 1, 7, 8])
def test_published_intervals(term):
    x, yes, n = published()
    low, high = N.profile_interval(x, yes, n, term)
    assert low == pytest.approx(FIT[term][1], abs=2e-4) and high == pytest.approx(FIT[term][2], abs=2e-4)
    assert N.likelihood_ratio(x, yes, n, term)[1] == pytest.approx(FIT[term][3], rel=1e-4)


@pytest.mark.parametrize("a,b,c,d", [(20, 10, 15, 25), (12, 8, 30, 40), (7, 3, 5, 9), (15, 0, 10, 20)])
def test_two_by_two_is_half_cell_correction(a, b, c, d):
    beta, _, _ = N.firth(np.array([[1], [0]]), np.array([a, c]), np.array([a + b, c + d]))
    assert beta[1] == pytest.approx(math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))), abs=1e-6)


def test_separation_is_finite():
    x = np.arange(40)[:, None] / 40
    beta, _, _ = N.firth(x, (np.arange(40) >= 20).astype(float), np.ones(40))
    assert np.isfinite(beta).all()


def test_small_golden_values():
    assert N.mcnemar_exact(313, 503) == pytest.approx(3.0157e-11, rel=1e-4)
    assert N.mcnemar_exact(108, 47) == pytest.approx(1.0593e-6, rel=1e-4)
    assert N.mcnemar_exact(17, 61) == pytest.approx(5.6637e-7, rel=1e-4)
    assert N.wilson(30, 357) == pytest.approx((0.0594957, 0.1174281), abs=1e-7)
    assert N.wilson(6, 84) == pytest.approx((0.0331458, 0.1471957), abs=1e-7)
    assert N.wilson(0, 0) == (0.0, 1.0)
    assert N.mcc(158, 302, 280, 3456) == pytest.approx(0.2743864, abs=1e-7)
    assert N.mcc(42, 2, 60, 103) == pytest.approx(0.4799, abs=1e-4)
    assert N.sample_size(0.05) == 385 and N.kappa({})["kappa"] is None
    assert N.kappa({(1, 1): 20, (0, 0): 15, (1, 0): 5, (0, 1): 10})["kappa"] == pytest.approx(0.4)


def test_bins_and_bootstraps():
    rng = np.random.default_rng(1)
    p = rng.random(500)
    bins = N.adaptive_bins(p, (rng.random(500) < p).astype(int))
    assert sum(b["n"] for b in bins) == 500 and min(b["n"] for b in bins) >= 20
    low, high = N.bootstrap_kappa([(1, 1)] * 30 + [(0, 0)] * 30 + [(1, 0)] * 5, 200)
    assert low < 0.85 < high
    c = np.array([[10, 2, 3, 40, 5, 5, 8, 37]] * 12)
    r = N.clustered_bootstrap(c, 100)
    assert r["low"] == pytest.approx(r["difference"]) and N.adopt(r["low"]) == "complex" and N.adopt(-0.1) == "simple"
    assert N.corrected_interval(np.array([0.8, 0.9, 0.85, 0.8]), 4, 1, 0.25)[0] == pytest.approx(0.8375)
    assert len(N.fit_table(np.array([[1], [0]]), np.array([20, 15]), np.array([30, 40]), ["x"])) == 2
    assert N.two_proportions(10, 50, 10, 50)["p"] == 1.0


def test_grouped_bins_are_the_bins_of_all_rows():
    rng = np.random.default_rng(5)
    for size in (7, 60, 900):
        p = np.round(rng.random(size) ** 3, 2)
        y = (rng.random(size) < p).astype(int)
        scores = [(float(v), int((p == v).sum()), int(y[p == v].sum())) for v in np.unique(p)]
        flat_p = np.concatenate([np.full(n, v) for v, n, _ in scores])
        flat_y = np.concatenate([np.r_[np.ones(k), np.zeros(n - k)] for _, n, k in scores])
        want, got = N.adaptive_bins(flat_p, flat_y), N.grouped_bins(scores)
        assert [b["n"] for b in got] == [b["n"] for b in want]
        for a, b in zip(got, want):
            assert all(abs(a[k] - b[k]) < 1e-9 for k in ("mean_p", "rate", "low", "high")) and a["compatible"] == b["compatible"]
