"""Statistics on small tables, on the driver: penalised logistic regression, exact tests, intervals, binning.

Inputs are aggregated in Spark first (patterns with counts), so their size does not follow the data.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

Z95 = 1.959963984540054


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def _penalised(x: np.ndarray, yes: np.ndarray, n: np.ndarray, beta: np.ndarray, free: np.ndarray) -> float:
    """Log-likelihood of grouped data plus half the log determinant of the information of the free terms."""
    eta = x @ beta
    ll = float(yes @ -np.logaddexp(0, -eta) + (n - yes) @ -np.logaddexp(0, eta))
    p = 1 / (1 + np.exp(-eta))
    info = (x * (n * p * (1 - p))[:, None]).T @ x
    sign, logdet = np.linalg.slogdet(info)
    return ll + 0.5 * logdet if sign > 0 else -np.inf


def firth(features: np.ndarray, yes: np.ndarray, n: np.ndarray, fixed: dict[int, float] | None = None, rounds: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression with Jeffreys' prior on patterns: features (k, m), positives and counts of each pattern.

    Returns the coefficients (intercept first), the penalised log-likelihood and the covariance.  Finite under separation.  `fixed` holds coefficients at values."""
    x, yes, n = _design(np.asarray(features, float)), np.asarray(yes, float), np.asarray(n, float)
    fixed = fixed or {}
    beta = np.zeros(x.shape[1])
    for k, v in fixed.items():
        beta[k] = v
    free = np.array([k not in fixed for k in range(x.shape[1])])
    now = _penalised(x, yes, n, beta, free)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ beta)))
        w = n * p * (1 - p)
        inverse = np.linalg.pinv((x * w[:, None]).T @ x)
        hat = w * np.einsum("ij,jk,ik->i", x, inverse, x) / np.maximum(n, 1e-300)
        # hat is per observation of a pattern; the score adds n * hat * (1/2 - p)
        score = x.T @ (yes - n * p + n * hat * (0.5 - p))
        part = (x[:, free] * w[:, None]).T @ x[:, free]
        step = np.zeros_like(beta)
        step[free] = np.linalg.pinv(part) @ score[free]
        largest = np.abs(step).max(initial=0)
        if largest > 5:
            step *= 5 / largest
        new = _penalised(x, yes, n, beta + step, free)
        halvings = 0
        while new < now - 1e-12 and halvings < 30:
            step, halvings = step / 2, halvings + 1
            new = _penalised(x, yes, n, beta + step, free)
        beta, now = beta + step, new
        if np.abs(score[free]).max(initial=0) < tol or np.abs(step).max(initial=0) < tol:
            break
    p = 1 / (1 + np.exp(-(x @ beta)))
    return beta, now, np.linalg.pinv((x * (n * p * (1 - p))[:, None]).T @ x)


def chi2_tail(x: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def profile_interval(features: np.ndarray, yes: np.ndarray, n: np.ndarray, term: int, level: float = 3.841458820694124, reach: float = 80.0) -> tuple[float, float]:
    """Profile likelihood interval of one coefficient, by steps of 0.5 and bisection; infinite beyond `reach`."""
    beta, top, _ = firth(features, yes, n)

    def drop(v: float) -> float:
        return 2 * (top - firth(features, yes, n, {term: v})[1]) - level

    out = []
    for side in (-1, 1):
        a, b = beta[term], beta[term] + side * 0.5
        while drop(b) < 0 and abs(b - beta[term]) < reach:
            a, b = b, b + side * 0.5
        if drop(b) < 0:
            out.append(side * math.inf)
            continue
        for _ in range(60):
            mid = (a + b) / 2
            a, b = (mid, b) if drop(mid) < 0 else (a, mid)
        out.append((a + b) / 2)
    return out[0], out[1]


def likelihood_ratio(features: np.ndarray, yes: np.ndarray, n: np.ndarray, term: int) -> tuple[float, float]:
    """Penalised likelihood ratio against the term at zero, and its p-value."""
    full = firth(features, yes, n)[1]
    stat = max(0.0, 2 * (full - firth(features, yes, n, {term: 0.0})[1]))
    return stat, chi2_tail(stat)


def fit_table(features: np.ndarray, yes: np.ndarray, n: np.ndarray, names: list[str]) -> list[dict]:
    """Coefficient, odds ratio, profile interval, ratio test, Wald error and asymmetry of every term."""
    beta, _, cov = firth(features, yes, n)
    rows = []
    for k, name in enumerate(["intercept", *names]):
        low, high = profile_interval(features, yes, n, k)
        stat, p = likelihood_ratio(features, yes, n, k)
        rows.append({"term": name, "beta": beta[k], "odds_ratio": math.exp(beta[k]), "low": low, "high": high, "identified": math.isfinite(low) and math.isfinite(high), "chi2": stat, "p": p, "se_wald": math.sqrt(cov[k, k]), "asymmetry": (high - beta[k]) / (beta[k] - low) if math.isfinite(low) and math.isfinite(high) else None})
    return rows


def mcnemar_exact(n01: int, n10: int) -> float:
    """Two-sided exact binomial p-value."""
    n, k = n01 + n10, min(n01, n10)
    if not n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def wilson(k: float, n: float, z: float = Z95) -> tuple[float, float]:
    """(0, 1) without observations."""
    if not n:
        return 0.0, 1.0
    p, d = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return max(0.0, centre - half), min(1.0, centre + half)


def two_proportions(a: int, n: int, b: int, m: int) -> dict:
    """Wilson intervals, difference and the p-value of the pooled z-test."""
    p, q, pool = a / n, b / m, (a + b) / (n + m)
    se = math.sqrt(pool * (1 - pool) * (1 / n + 1 / m))
    return {"difference": q - p, "p": math.erfc(abs((q - p) / se) / math.sqrt(2)) if se else 1.0, "first": wilson(a, n), "second": wilson(b, m)}


def sample_size(error: float, p: float = 0.5, z: float = 1.96) -> int:
    return math.ceil(z * z * p * (1 - p) / error**2 - 1e-9)


def corrected_interval(scores: np.ndarray, k: int, reps: int, test_share: float) -> tuple[float, float, float]:
    """Mean of repeated cross-validation with the corrected resampled variance (Nadeau and Bengio), plus and minus 1.96 errors."""
    scores = np.asarray(scores, float)
    var = (1 / (k * reps) + test_share / (1 - test_share)) * scores.var(ddof=1)
    mean, half = float(scores.mean()), 1.96 * math.sqrt(var)
    return mean, mean - half, mean + half


def adaptive_bins(p: np.ndarray, y: np.ndarray, least: int = 20, widest: float = 0.2) -> list[dict]:
    """Reliability bins in order of probability: a bin closes when it has `least` rows and the next would make it wider than `widest` or it is full."""
    order = np.argsort(p, kind="stable")
    p, y = np.asarray(p, float)[order], np.asarray(y, float)[order]
    bins, start = [], 0
    for i in range(1, len(p) + 1):
        if i == len(p) or i - start >= least and (p[i] - p[start] > widest or i - start >= 2 * least):
            if i == len(p) and bins and i - start < least:
                start = bins.pop()["start"]
            bins.append({"start": start, "n": i - start, "mean_p": float(p[start:i].mean()), "rate": float(y[start:i].mean())})
            start = i
    for b in bins:
        b["low"], b["high"] = wilson(b["rate"] * b["n"], b["n"])
        b["compatible"] = b["low"] <= b["mean_p"] <= b["high"]
    return bins


def grouped_bins(scores: list[tuple[float, int, int]], least: int = 20, widest: float = 0.2) -> list[dict]:
    """adaptive_bins() of distinct scores in order, each with its rows and positives, without a list of rows; among rows of one score the positives come first."""
    bins: list[dict] = []
    now = {"n": 0, "yes": 0, "sum": 0.0, "first": 0.0}

    def close() -> None:
        nonlocal now
        bins.append(now)
        now = {"n": 0, "yes": 0, "sum": 0.0, "first": 0.0}

    for p, n, yes in scores:
        if now["n"] >= least and (p - now["first"] > widest or now["n"] >= 2 * least):
            close()
        while n:
            # a bin that one score fills closes at twice the least, so whole bins of it are taken at once
            take = min(n, 2 * least - now["n"])
            if not now["n"]:
                now["first"] = p
            positive = min(yes, take)
            now = {"n": now["n"] + take, "yes": now["yes"] + positive, "sum": now["sum"] + p * take, "first": now["first"]}
            n, yes = n - take, yes - positive
            if n:
                close()
    if now["n"]:
        if bins and now["n"] < least:
            before = bins.pop()
            now = {"n": before["n"] + now["n"], "yes": before["yes"] + now["yes"], "sum": before["sum"] + now["sum"], "first": before["first"]}
        close()
    out = []
    for b in bins:
        mean, rate = b["sum"] / b["n"], b["yes"] / b["n"]
        low, high = wilson(b["yes"], b["n"])
        out.append({"n": b["n"], "mean_p": mean, "rate": rate, "low": low, "high": high, "compatible": low <= mean <= high})
    return out


def kappa(pairs: dict[tuple, int]) -> dict:
    """Cohen's kappa of two raters with prevalence and bias indices and PABAK; None without observations."""
    n = sum(pairs.values())
    if not n:
        return {"n": 0, "agreement": None, "kappa": None, "pabak": None, "prevalence": None, "bias": None, "band": None}
    labels = sorted({x for p in pairs for x in p}, key=str)
    po = sum(c for (a, b), c in pairs.items() if a == b) / n
    pe = sum(sum(c for (a, _), c in pairs.items() if a == v) * sum(c for (_, b), c in pairs.items() if b == v) for v in labels) / n**2
    k = (po - pe) / (1 - pe) if pe < 1 else 1.0
    get = lambda a, b: pairs.get((a, b), 0)
    two = labels[-2:] if len(labels) >= 2 else labels * 2
    band = next(name for limit, name in ((0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"), (2, "almost perfect")) if k <= limit)
    return {"n": n, "agreement": po, "kappa": k, "pabak": 2 * po - 1, "prevalence": abs(get(two[0], two[0]) - get(two[1], two[1])) / n, "bias": abs(get(two[0], two[1]) - get(two[1], two[0])) / n, "band": band}


def mcc(tp: float, fp: float, fn: float, tn: float) -> float:
    d = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return (tp * tn - fp * fn) / math.sqrt(d) if d else 0.0


def clustered_bootstrap(clusters: np.ndarray, reps: int = 2000, seed: int = 7) -> dict:
    """Paired bootstrap of the difference of two predictors' MCC: clusters (m, 8) hold tp, fp, fn, tn of each, drawn with replacement."""
    rng = np.random.default_rng(seed)
    m = len(clusters)
    diff = []
    for _ in range(reps):
        t = rng.multinomial(m, np.full(m, 1 / m)) @ clusters
        diff.append(mcc(*t[:4]) - mcc(*t[4:]))
    low, high = np.percentile(diff, [2.5, 97.5])
    t = clusters.sum(0)
    return {"difference": mcc(*t[:4]) - mcc(*t[4:]), "low": float(low), "high": float(high)}


def bootstrap_cells(cells: dict[tuple, int], reps: int = 5000, seed: int = 7) -> tuple[float, float]:
    """Percentile interval of kappa from the counts of each pair of labels: a resample is one multinomial draw."""
    rng = np.random.default_rng(seed)
    kinds, n = sorted(cells, key=str), sum(cells.values())
    draws = rng.multinomial(n, np.array([cells[k] for k in kinds]) / max(1, n), size=reps)
    values = [kappa(dict(zip(kinds, map(int, d), strict=True)))["kappa"] for d in draws]
    low, high = np.percentile([v for v in values if v is not None], [2.5, 97.5])
    return float(low), float(high)


def bootstrap_kappa(pairs: list[tuple], reps: int = 5000, seed: int = 7) -> tuple[float, float]:
    """Percentile interval of kappa; pairs of labels, one a unit."""
    return bootstrap_cells(dict(Counter(pairs)), reps, seed)


def adopt(low: float) -> str:
    """The more complex model only if the interval of its gain is above zero."""
    return "complex" if low > 0 else "simple"
