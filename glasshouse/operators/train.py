"""Fitting models: pattern counts for the solver, sparse text models, threshold grids, challengers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasshouse.functions import numeric
from glasshouse.operators.linear import fit
from glasshouse.operators.quantiles import exact_quantiles
from glasshouse.operators.score import sigmoid
from glasshouse.operators.selection import group_folds
from glasshouse.plans.registry import scratch


def patterns(rows: DataFrame, features: list[str], y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature patterns with positives and counts: at most 2**features rows reach the driver."""
    got = rows.groupBy(*features).agg(F.sum(F.col(y).cast("long")).alias("yes"), F.count(F.lit(1)).alias("n")).orderBy(*features).collect()
    return np.array([[r[f] for f in features] for r in got], float), np.array([r.yes for r in got], float), np.array([r.n for r in got], float)


def fit_channel(rows: DataFrame, features: list[str], y: str) -> list[dict]:
    return numeric.fit_table(*patterns(rows, features, y), features)


def fit_text(docs: DataFrame, key: str, y: str, c: float = 1.0, min_df: int = 3, most: int = 3, tol: float = 1e-4) -> tuple[DataFrame, float]:
    """Vocabulary with idf and coefficients, as a table, and the intercept of an L2 logistic regression on TF-IDF rows."""
    rows = docs.select(key, "text", F.col(y).alias("y"), F.array(F.lit(True)).alias("train"))
    found = fit(docs.sparkSession, rows, key, [(0, c)], 1, min_df, most, tol)
    return found.coefficients().select("term", "df", F.col("idf")[0].alias("idf"), F.col("coef")[0].alias("coef")), found.intercepts()[0]


def challenge(rows: DataFrame, features: list[str], y: str, fold: str, c: float = 1.0, rounds: int = 200, depth: int = 3, rate: float = 0.1) -> DataFrame:
    """The rows' fold, y as `actual`, model, probability and `predicted`: each row scored by a penalised fit, a ridge and boosted trees without its fold.

    Features are 0 or 1, so a fold's models are fitted on its feature patterns with their counts (at most two for each set of features), however many rows there are;
    every row is scored by its pattern.  A fold whose other rows have one class only gets that class's share from every model."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = rows.sparkSession
    names = [f"f{i}" for i in range(len(features))]
    counted = rows.groupBy(F.col(fold).cast("int").alias("fold"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)]).agg(F.sum(F.col(y).cast("long")).alias("yes"), F.count(F.lit(1)).alias("n")).collect()  # patterns of a fold
    scores: list[tuple] = []
    for k in sorted({r.fold for r in counted}):
        others = [r for r in counted if r.fold != k]
        points = sorted({tuple(r[n] for n in names) for r in counted})
        known = [(float(label), float(w), *(r[n] for n in names)) for r in others for label, w in ((1, r.yes), (0, r.n - r.yes)) if w]
        if len({x[0] for x in known}) < 2:
            share = sum(x[0] * x[1] for x in known) / max(1.0, sum(x[1] for x in known))
            scores += [(k, m, *p, share) for m in ("penalised", "ridge", "boosted") for p in points]
            continue
        x, ones, n = np.array([[r[f] for f in names] for r in others]), np.array([float(r.yes) for r in others]), np.array([float(r.n) for r in others])
        fit_ = numeric.firth(x, ones, n)[0]
        scores += [(k, "penalised", *p, float(1 / (1 + np.exp(-(fit_[0] + np.dot(fit_[1:], p)))))) for p in points]
        data = VectorAssembler(inputCols=names, outputCol="features")
        train = data.transform(spark.createDataFrame(known, "label double, w double, " + ", ".join(f"{f} double" for f in names)).coalesce(1))
        ask = data.transform(spark.createDataFrame(points, ", ".join(f"{f} double" for f in names)).coalesce(1))
        total = sum(w for _, w, *_ in known)
        for name, model in (("ridge", LogisticRegression(regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, weightCol="w")), ("boosted", GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, weightCol="w", seed=1))):
            found = model.fit(train).transform(ask).select(*names, vector_to_array("probability")[1].alias("p")).collect()
            scores += [(k, name, *(r[f] for f in names), float(r.p)) for r in found]
    table = spark.createDataFrame(scores, "fold int, model string, " + ", ".join(f"{f} double" for f in names) + ", probability double")
    asked = rows.select(F.col(fold).cast("int").alias("fold"), F.col(y).alias("actual"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)])
    return asked.join(F.broadcast(table), ["fold", *names]).select("fold", "actual", "model", "probability", F.when(F.col("probability") >= 0.5, "true").otherwise("false").alias("predicted"))


def threshold_grid(scored: DataFrame, group: str, p: str, y: str, quantiles: list[float]) -> DataFrame:
    """MCC of every threshold (an exact quantile of the group's scores); a short grid per group, not a pair per row."""
    cuts = exact_quantiles(scored, [group], p, quantiles).select(group, "q", F.col("quantile").alias("threshold"))
    counts = scored.join(cuts, group).groupBy(group, "q", "threshold").agg(
        F.count_if((F.col(p) >= F.col("threshold")) & (F.col(y) == 1)).alias("tp"), F.count_if((F.col(p) >= F.col("threshold")) & (F.col(y) == 0)).alias("fp"),
        F.count_if((F.col(p) < F.col("threshold")) & (F.col(y) == 1)).alias("fn"), F.count_if((F.col(p) < F.col("threshold")) & (F.col(y) == 0)).alias("tn"),
    )
    from glasshouse.operators.evaluate import balanced

    return balanced(counts)


def best_threshold(grid: DataFrame, group: str) -> DataFrame:
    """The threshold with the largest MCC; ties: the first quantile."""
    return grid.groupBy(group).agg(F.max_by(F.struct("threshold", "mcc"), F.struct("mcc", -F.col("q"))).alias("b")).select(group, "b.*")


def out_of_fold(docs: DataFrame, document: str, key: str, y: str, folds: int = 5, c: float = 1.0, tol: float = 1e-3) -> DataFrame:
    """key, fold, probability: every document scored by a model fitted without its fold; the models of all folds are one fit.
    With as many folds as documents it leaves one out at a time."""
    folded = group_folds(docs.select(key, "text", document, F.col(y).alias("y")), document, folds, 1)
    rows = folded.select(key, "text", "y", F.array(*[F.col("outer") != f for f in range(folds)]).alias("train"))
    found = fit(docs.sparkSession, rows, key, [(f, c) for f in range(folds)], folds, tol=tol)
    own = found.margins().join(folded.select(key, F.col("outer").alias("model")), [key, "model"])
    return own.select(key, F.col("model").alias("fold"), sigmoid(F.col("margin")).alias("probability"))


def coverage_quantiles(covered: DataFrame) -> DataFrame:
    """The coverage of each document is written once, as every round of the quantiles and the mean read it."""
    spark, path = covered.sparkSession, scratch(covered.sparkSession, "coverage")
    covered.select("coverage").write.parquet(path)
    covered = spark.read.parquet(path)
    q = exact_quantiles(covered, [], "coverage", [0.05, 0.25, 0.5, 0.75])
    wide = q.agg(*[F.max(F.when(F.col("q") == i, F.col("quantile"))).alias(n) for i, n in enumerate(("p05", "p25", "median", "p75"))])
    return wide.crossJoin(covered.agg(F.avg("coverage").alias("mean")))  # one row each


def absence_threshold(rows: DataFrame, p: str, y: str, recall: float) -> DataFrame:
    """The threshold below which `recall` of the negatives fall (linear quantile)."""
    return exact_quantiles(rows.where(F.col(y) == 0), [], p, [recall]).agg(F.max("quantile").alias("threshold"))  # null without negatives


def alignment(vectors: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Rows on one side only: must both be 0."""
    a, b = vectors.select(key).withColumn("v", F.lit(1)), corpus.select(key).withColumn("c", F.lit(1))
    return a.join(b, key, "full").agg(F.count_if(F.col("v").isNull()).alias("without_vector"), F.count_if(F.col("c").isNull()).alias("without_text"))
