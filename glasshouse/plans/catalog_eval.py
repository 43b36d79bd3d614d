"""Queries of evaluation, calibration, sampling and models, over labels, documents, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glasshouse.functions import numeric as N
from glasshouse.operators import evaluate as E
from glasshouse.operators import sampling as G
from glasshouse.operators import score as S
from glasshouse.operators import train as M
from glasshouse.operators.quantiles import exact_quantiles
from glasshouse.operators.selection import nested
from glasshouse.plans.registry import Catalog, scratch, table

CATALOG = Catalog()
query = CATALOG.query

# a prediction for each labelled document: by a threshold on its length, with states that leave some out
_PRED = """pred AS (SELECT l.doc_id, d.source, d.lang, CASE WHEN l.doc_id % 13 = 0 THEN 'nao_coletado' WHEN l.doc_id % 17 = 0 THEN 'nao_aplicavel' WHEN d.n_chars > 1200 THEN 'true' ELSE 'false' END AS predicted, l.quality = 1 AS actual,
    l.quality, l.toxic, (d.n_chars * 37 % 1000) / 1000.0 AS p FROM labels l JOIN documents d USING (doc_id))"""


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    k = F.col("doc_id")
    state = F.when(k % 13 == 0, "nao_coletado").when(k % 17 == 0, "nao_aplicavel").when(F.col("n_chars") > 1200, "true").otherwise("false")
    return d.select("doc_id", "source", "lang", state.alias("predicted"), (F.col("quality") == 1).alias("actual"), "quality", "toxic", ((F.col("n_chars") * 37 % 1000) / 1000).alias("p"))


_CONF = "SELECT count(*) FILTER (WHERE predicted = 'true' AND actual) AS tp, count(*) FILTER (WHERE predicted = 'true' AND NOT actual) AS fp, count(*) FILTER (WHERE predicted = 'false' AND actual) AS fn, count(*) FILTER (WHERE predicted = 'false' AND NOT actual) AS tn, count(*) FILTER (WHERE predicted NOT IN ('true', 'false')) AS excluded FROM pred"


@query("a1_confusion_states", f"WITH {_PRED} {_CONF}")
def a1(spark, sf):
    return E.confusion(_pred(spark, sf))


@query("a1_excluded_reasons", f"WITH {_PRED} SELECT predicted AS reason, count(*) AS n FROM pred WHERE predicted NOT IN ('true', 'false') GROUP BY predicted")
def a1_reasons(spark, sf):
    return E.excluded_reasons(_pred(spark, sf))


@query(
    "a2_metrics",
    f"""WITH {_PRED}, c AS ({_CONF}), n AS (SELECT *, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM c), k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM n)
    SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa FROM k""",
)
def a2(spark, sf):
    m = E.metrics(E.confusion(_pred(spark, sf)))
    return m.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "kappa")])


@query(
    "a3_balanced_metrics",
    f"""WITH {_PRED}, c AS ({_CONF.replace('SELECT ', 'SELECT source, ', 1)} GROUP BY source), d AS (SELECT source, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn FROM c),
    m AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS sens, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS spec, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END AS f0, (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) AS q FROM d)
    SELECT source, round((sens + spec) / 2, 6) AS balanced_accuracy, round((f1 + f0) / 2, 6) AS macro_f1, round(CASE WHEN q > 0 THEN (tp * tn - fp * fn) / sqrt(q) ELSE 0 END, 6) AS mcc FROM m""",
)
def a3(spark, sf):
    b = E.balanced(E.confusion(_pred(spark, sf), by=["source"]))
    return b.select("source", *[F.round(c, 6).alias(c) for c in ("balanced_accuracy", "macro_f1", "mcc")])


@query("a4_triage_metrics", f"WITH {_PRED}, c AS ({_CONF}) SELECT round((tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS flag_rate, round(tn / CAST(tn + fn AS DOUBLE), 6) AS absence_precision, round((tp + fp) / CAST(tp AS DOUBLE), 6) AS nnr FROM c")
def a4(spark, sf):
    return E.triage_metrics(E.confusion(_pred(spark, sf))).select(*[F.round(c, 6).alias(c) for c in ("flag_rate", "absence_precision", "nnr")])


@query("a5_average_precision", f"WITH {_PRED}, r AS (SELECT actual, row_number() OVER (ORDER BY p DESC, doc_id) AS n, sum(actual::INT) OVER (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING) AS hits FROM pred) SELECT round(sum(hits / n) / count(*), 6) AS average_precision FROM r WHERE actual")
def a5(spark, sf):
    return E.average_precision(_pred(spark, sf), "p", "actual", "doc_id").select(F.round("average_precision", 6).alias("average_precision"))


_PAIRS = f"{_PRED}, pairs AS (SELECT quality AS a, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS b FROM pred)"


@query("a6_cohen_kappa", f"WITH {_PAIRS}, t AS (SELECT count(*) AS n, CAST(sum((a = b)::INT) AS DOUBLE) / count(*) AS po FROM pairs), e AS (SELECT sum(x.n * y.n) AS c FROM (SELECT a, count(*) AS n FROM pairs GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM pairs GROUP BY b) y ON x.a = y.b) SELECT n, round(po, 6) AS agreement, round((po - c / CAST(n * n AS DOUBLE)) / (1 - c / CAST(n * n AS DOUBLE)), 6) AS kappa, round(2 * po - 1, 6) AS pabak FROM t, e")
def a6(spark, sf):
    rows = _pred(spark, sf)
    one = rows.select("doc_id", F.col("quality").alias("label"))
    two = rows.select("doc_id", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("label"))
    k = E.cohen_kappa(E.rater_pairs(one, two, ["doc_id"]))
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "kappa", "pabak")])


_Z = repr(N.Z95)


def _wilson_sql(k: str, n: str, sign: str) -> str:
    return f"(({k} / {n} + {_Z} * {_Z} / (2 * {n})) {sign} {_Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {_Z} * {_Z} / (4 * {n} * {n}))) / (1 + {_Z} * {_Z} / {n})"


@query("a7_wilson", f"WITH {_PRED}, g AS (SELECT source, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM pred GROUP BY source) SELECT source, round(greatest({_wilson_sql('k', 'n', '-')}, 0), 6) AS low, round(least({_wilson_sql('k', 'n', '+')}, 1), 6) AS high FROM g")
def a7(spark, sf):
    g = _pred(spark, sf).groupBy("source").agg(F.sum("quality").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return g.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("a8_brier_murphy", f"WITH {_PRED}, g AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n, avg(p) AS mp, avg(quality) AS my, sum((p - quality) ** 2) AS sq, sum(quality) AS yes FROM pred GROUP BY lang), t AS (SELECT sum(n) AS n, sum(sq) AS sq, sum(yes) AS yes, sum(n * (mp - my) ** 2) AS rel, sum(n * my * my) AS m2 FROM g) SELECT round(sq / n, 6) AS brier, round(rel / n, 6) AS reliability, round(m2 / n - (yes / n) ** 2, 6) AS resolution, round(yes / n * (1 - yes / n), 6) AS uncertainty FROM t")
def a8(spark, sf):
    b = E.brier(_pred(spark, sf), "p", "quality", "lang")
    return b.select(*[F.round(c, 6).alias(c) for c in ("brier", "reliability", "resolution", "uncertainty")])


@query("a9_reliability_bins", None)
def a9(spark, sf):
    rows = _pred(spark, sf).groupBy(F.round("p", 2).alias("p")).agg(F.sum("quality").alias("yes"), F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    out = N.grouped_bins([(float(r.p), r.n, r.yes) for r in rows])  # a hundred distinct scores at most
    return spark.createDataFrame([(i, b["n"], float(b["mean_p"]), float(b["rate"]), float(b["low"]), float(b["high"]), bool(b["compatible"])) for i, b in enumerate(out)], "bin long, n long, mean_p double, rate double, low double, high double, compatible boolean")


_FEATS = "f AS (SELECT doc_id, quality = 1 AS y, CAST(doc_id % 2 = 0 AS INT) AS f1, CAST(toxic = 1 AS INT) AS f2, CAST(p > 0.5 AS INT) AS f3, p FROM pred)"


def _features(spark, sf) -> DataFrame:
    return _pred(spark, sf).select("doc_id", F.col("actual").alias("y"), (F.col("doc_id") % 2 == 0).cast("int").alias("f1"), (F.col("toxic") == 1).cast("int").alias("f2"), (F.col("p") > 0.5).cast("int").alias("f3"), "p")


@query("a10_calibration_pattern", f"WITH {_PRED}, {_FEATS} SELECT CASE WHEN f1 + f2 + f3 = 0 THEN '(nenhum)' ELSE CASE WHEN f1 = 1 THEN 'f1' ELSE '' END || CASE WHEN f2 = 1 THEN 'f2' ELSE '' END || CASE WHEN f3 = 1 THEN 'f3' ELSE '' END END AS pattern, count(*) AS n, CAST(sum(y::INT) AS BIGINT) AS positives, round(avg(p), 6) AS predicted FROM f GROUP BY 1")
def a10(spark, sf):
    return E.pattern_calibration(_features(spark, sf), ["f1", "f2", "f3"], "p", "y").select("pattern", "n", "positives", F.round("predicted", 6).alias("predicted"))


@query("a11_intermediate_region", f"WITH {_PRED} SELECT count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(quality), 6) AS rate FROM pred WHERE p BETWEEN 0.2 AND 0.8")
def a11(spark, sf):
    return _pred(spark, sf).where("p BETWEEN 0.2 AND 0.8").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("quality"), 6).alias("rate"))


@query("a12_lift", f"WITH {_PRED}, {_FEATS}, u AS (SELECT y, feature, v FROM (SELECT y, f1, f2, f3 FROM f) UNPIVOT (v FOR feature IN (f1, f2, f3))) SELECT feature, round(avg(v) FILTER (WHERE y), 6) AS in_positives, round(avg(v) FILTER (WHERE NOT y), 6) AS in_negatives FROM u GROUP BY feature")
def a12(spark, sf):
    return E.lift(_features(spark, sf), ["f1", "f2", "f3"], "y").select("feature", F.round("in_positives", 6).alias("in_positives"), F.round("in_negatives", 6).alias("in_negatives"))


@query("a13_form_alignment", f"WITH {_PRED}, {_FEATS} SELECT f1, f2, count(*) AS n, count(*) FILTER (WHERE y AND f3 = 0) AS lost, count(*) FILTER (WHERE y) AS positives FROM f GROUP BY f1, f2")
def a13(spark, sf):
    return _features(spark, sf).groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") & (F.col("f3") == 0)).alias("lost"), F.count_if("y").alias("positives"))


@query("a14_set_recall", f"WITH {_PRED}, a AS (SELECT doc_id FROM pred WHERE predicted = 'true'), b AS (SELECT doc_id FROM pred WHERE actual) SELECT count(*) FILTER (WHERE a.doc_id = b.doc_id) AS both, count(a.doc_id) AS found, count(b.doc_id) AS truth FROM a FULL JOIN b USING (doc_id)".replace("FILTER (WHERE a.doc_id = b.doc_id)", "FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL)"))
def a14(spark, sf):
    p = _pred(spark, sf)
    return E.set_recall(p.where("predicted = 'true'"), p.where("actual"), ["doc_id"]).select("both", "found", "truth")


@query("a16_retrospective", "SELECT event_type, count(*) AS captures, count(DISTINCT user_id) AS sites, count(*) FILTER (WHERE value > 50) AS affected FROM events GROUP BY event_type")
def a16(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("captures"), F.count_distinct("user_id").alias("sites"), F.count_if(F.col("value") > 50).alias("affected"))


@query("a17_cross_tab", f"WITH {_PRED} SELECT lang, count(*) FILTER (WHERE predicted = 'true') AS \"true\", count(*) FILTER (WHERE predicted = 'false') AS \"false\" FROM pred GROUP BY lang")
def a17(spark, sf):
    t = _pred(spark, sf).groupBy("lang").pivot("predicted", ["true", "false"]).agg(F.count(F.lit(1)))
    return t.select("lang", F.coalesce("true", F.lit(0)).alias("true"), F.coalesce("false", F.lit(0)).alias("false"))


@query("a18_signal_density", "SELECT doc_id, CASE WHEN n_chars % 50 > 0 THEN round((doc_id % 7) / CAST(n_chars % 50 AS DOUBLE), 6) END AS density FROM documents")
def a18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.density(F.col("doc_id") % 7, F.col("n_chars") % 50).alias("density"))


@query("a19_stratum_rollup", f"WITH {_PRED} SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE predicted = 'true') / CAST(nullif(count(*) FILTER (WHERE predicted IN ('true', 'false')), 0) AS DOUBLE), 6) AS predicted FROM pred GROUP BY ROLLUP (lang)")
def a19(spark, sf):
    return E.prevalence(_pred(spark, sf).select("lang", "predicted"), "lang", ["predicted"]).select("lang", "n", F.round("predicted", 6).alias("predicted"))


@query("a20_two_proportions", None)
def a20(spark, sf):
    r = _pred(spark, sf).agg(F.sum(F.when(F.col("lang") == "en", F.col("quality"))).alias("a"), F.count_if(F.col("lang") == "en").alias("n"), F.sum(F.when(F.col("lang") != "en", F.col("quality"))).alias("b"), F.count_if(F.col("lang") != "en").alias("m")).first()
    t = N.two_proportions(r.a or 0, r.n, r.b or 0, r.m)
    return spark.createDataFrame([(t["difference"], t["p"], *t["first"], *t["second"])], "difference double, p double, low_1 double, high_1 double, low_2 double, high_2 double")


@query("a20_proportion_intervals", f"WITH {_PRED}, g AS (SELECT lang = 'en' AS first, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM pred GROUP BY 1) SELECT first, round(k / n, 6) AS share, round(greatest({_wilson_sql('k', 'n', '-')}, 0), 6) AS low, round(least({_wilson_sql('k', 'n', '+')}, 1), 6) AS high FROM g")
def a20_intervals(spark, sf):
    g = _pred(spark, sf).groupBy((F.col("lang") == "en").alias("first")).agg(F.sum("quality").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return g.select("first", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("a21_sample_size", f"WITH {_PRED}, s AS (SELECT source, count(*) AS n, avg(actual::INT) AS p FROM pred GROUP BY source) SELECT source, n, CAST(ceil(1.96 * 1.96 * p * (1 - p) / (0.05 * 0.05) - 0.000000001) AS BIGINT) AS needed, CAST(ceil(1.96 * 1.96 * 0.25 / (0.05 * 0.05) - 0.000000001) AS BIGINT) AS at_most, round(1.96 * sqrt(p * (1 - p) / n) * 100, 6) AS error_pct FROM s")
def a21(spark, sf):
    """Rows to label in each source for an error of 5 points, by its own share and by the worst; and the error of the rows there are."""
    s = _pred(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("actual").cast("int")).alias("p"))
    p = F.col("p")
    return s.select("source", "n", E.sample_size(0.05, p).alias("needed"), E.sample_size(0.05).alias("at_most"), F.round(E.margin(p, F.col("n")) * 100, 6).alias("error_pct"))


# --- windows, thresholds, resampling ---


@query("w7_majority_class", f"WITH {_PRED}, c AS (SELECT source, predicted, count(*) AS n FROM pred GROUP BY ALL) SELECT source, arg_min(predicted, (-n, predicted)) AS majority FROM c GROUP BY source".replace("arg_min(predicted, (-n, predicted))", "list(predicted ORDER BY n DESC, predicted)[1]"))
def w7(spark, sf):
    c = _pred(spark, sf).groupBy("source", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("source").agg(F.min_by("predicted", F.struct(-F.col("n"), F.col("predicted"))).alias("majority"))


@query("w8_best_feature", f"WITH {_PRED}, {_FEATS}, u AS (SELECT y, feature, v FROM (SELECT y, f1, f2, f3 FROM f) UNPIVOT (v FOR feature IN (f1, f2, f3))), b AS (SELECT feature, (avg(v) FILTER (WHERE y) + avg(1 - v) FILTER (WHERE NOT y)) / 2 AS ba FROM u GROUP BY feature) SELECT feature, round(ba, 6) AS balanced_accuracy FROM b ORDER BY ba DESC, feature LIMIT 1")
def w8(spark, sf):
    r = E.lift(_features(spark, sf), ["f1", "f2", "f3"], "y").withColumn("ba", (F.col("in_positives") + 1 - F.col("in_negatives")) / 2)
    return r.orderBy(F.desc("ba"), "feature").limit(1).select("feature", F.round("ba", 6).alias("balanced_accuracy"))


@query("w9_quantile_thresholds", f"WITH {_PRED} SELECT lang, round(quantile_cont(p, 0.5), 6) AS q50, round(quantile_cont(p, 0.9), 6) AS q90, round(quantile_cont(p, 0.998), 6) AS q998 FROM pred GROUP BY lang")
def w9(spark, sf):
    q = exact_quantiles(_pred(spark, sf), ["lang"], "p", [0.5, 0.9, 0.998])
    return q.groupBy("lang").agg(*[F.round(F.max(F.when(F.col("q") == i, F.col("quantile"))), 6).alias(n) for i, n in enumerate(("q50", "q90", "q998"))])


@query("w10_set_operations", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_documents, (SELECT count(*) FROM (SELECT lang FROM documents UNION SELECT source FROM documents)) AS names")
def w10(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    both = n(d.select("doc_id").intersect(lab.select("doc_id")), "both")
    only = n(d.select("doc_id").exceptAll(lab.select("doc_id")), "only_documents")
    return both.crossJoin(only).crossJoin(n(d.select("lang").union(d.select("source")).distinct(), "names"))  # one row each


@query("i1_stratified_sample", "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ((c_custkey % 2147483648) * 2654435761 % 2147483648 * 1103515245 + 42 * 12345 + c_custkey % 2147483648) % 2147483648, c_custkey) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM r WHERE n <= 20")
def i1(spark, sf):
    return G.stratified(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", 20).select("c_custkey", "c_mktsegment")


@query("i2_expansion_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_custkey FROM orders) WHERE n = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def i2(spark, sf):
    first = G.one_per_domain(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey")
    return G.minus_used(first, [table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")], "c_custkey").select("o_orderkey")


@query("i3_live_sample", "SELECT c_custkey FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) WHERE n <= 25")
def i3(spark, sf):
    used = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    left = G.minus_used(table(spark, sf, "customer").where("c_mktsegment != 'BUILDING'"), [used], "c_custkey")
    return left.orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey")


@query("i14_length_baseline", f"WITH {_PRED}, t AS (SELECT unnest([200, 600, 1200, 2400]) AS cut), c AS (SELECT cut, CAST(count(*) FILTER (WHERE n > cut AND actual) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE n > cut AND NOT actual) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE n <= cut AND actual) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE n <= cut AND NOT actual) AS DOUBLE) AS tn FROM (SELECT p.*, d.n_chars AS n FROM pred p JOIN documents d USING (doc_id)), t GROUP BY cut) SELECT cut, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM c")
def i14(spark, sf):
    rows = _pred(spark, sf).select("doc_id", "actual").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    long = rows.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in (200, 600, 1200, 2400)])))
    marked = long.select("cut", F.when(F.col("n_chars") > F.col("cut"), "true").otherwise("false").alias("predicted"), "actual")
    return E.balanced(E.confusion(marked, by=["cut"])).select("cut", F.round("mcc", 6).alias("mcc"))


@query("m5_model_by_name", "SELECT doc_id, round(1 / (1 + exp(-(-0.5 + 1.25 * (doc_id % 2) - 0.75 * (doc_id % 3)))), 9) AS p FROM documents")
def m5(spark, sf):
    p = S.channel_probability({"b": F.col("doc_id") % 3, "a": F.col("doc_id") % 2}, {"intercept": -0.5, "a": 1.25, "b": -0.75})
    return table(spark, sf, "documents").select("doc_id", F.round(p, 9).alias("p"))


@query("i4_quota_sample", None)
def i4(spark, sf):
    rows = _pred(spark, sf).select("doc_id", (F.col("toxic") == 1).alias("is_toxic"), (F.col("quality") == 1).alias("is_good"), (F.col("lang") == "es").alias("is_es"))
    return G.quotas(rows, "doc_id", {"is_toxic": 5, "is_good": 10, "is_es": 5}).select("doc_id", "quota")


@query("i5_stratified_folds", "WITH m AS (SELECT doc_id, quality, rep, (((doc_id % 2147483648) * 2654435761 % 2147483648 * 1103515245 + 42 * 12345 + doc_id % 2147483648) % 2147483648 + rep * 7919 * (doc_id % 1009 + 1)) % 2147483648 AS h FROM labels, range(0, 3) t(rep)) SELECT doc_id, CAST(rep AS INTEGER) AS rep, CAST((row_number() OVER (PARTITION BY rep, quality ORDER BY h, doc_id) - 1) % 5 AS INTEGER) AS fold FROM m")
def i5(spark, sf):
    return G.folds(table(spark, sf, "labels"), "doc_id", ["quality"], 5, 3).select("doc_id", "rep", "fold")


_FOLDS = "f AS (SELECT doc_id % 5 AS fold, avg((predicted = 'true') = actual) AS score FROM (SELECT doc_id, predicted, actual FROM pred) GROUP BY 1)".replace("avg((predicted = 'true') = actual)", "avg(((predicted = 'true') = actual)::INT)")


@query("i6_corrected_variance", f"WITH {_PRED}, {_FOLDS} SELECT round(avg(score), 6) AS mean, round(sqrt((1.0 / 5 + 0.25) * var_samp(score)) * 1.96, 6) AS half FROM f")
def i6(spark, sf):
    f = _pred(spark, sf).groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg(((F.col("predicted") == "true") == F.col("actual")).cast("int")).alias("score"))
    return f.agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.sqrt(F.lit(1 / 5 + 0.25) * F.var_samp("score")) * 1.96, 6).alias("half"))


@query(
    "i11_ladder_choice",
    f"""WITH {_PRED}, f AS (SELECT doc_id % 5 AS fold, avg(((p > 0.5) = actual)::INT) - avg(((predicted = 'true') = actual)::INT) AS gain FROM pred GROUP BY 1), m AS (SELECT avg(gain) AS gain, sqrt((1.0 / 5 + 0.25) * var_samp(gain)) * 1.96 AS half FROM f)
    SELECT round(gain, 6) AS gain, round(gain - half, 6) AS low, CASE WHEN gain - half > 0 THEN 'complex' ELSE 'simple' END AS adopted FROM m""",
)
def i11(spark, sf):
    """The more complex of two predictors only if the corrected interval of its gain over the folds is above zero."""
    right = lambda c: F.avg((c == F.col("actual")).cast("int"))
    f = _pred(spark, sf).groupBy((F.col("doc_id") % 5).alias("fold")).agg((right(F.col("p") > 0.5) - right(F.col("predicted") == "true")).alias("gain"))
    m = f.agg(F.avg("gain").alias("gain"), (F.sqrt(F.lit(1 / 5 + 0.25) * F.var_samp("gain")) * 1.96).alias("half"))
    low = F.col("gain") - F.col("half")
    return m.select(F.round("gain", 6).alias("gain"), F.round(low, 6).alias("low"), F.when(low > 0, "complex").otherwise("simple").alias("adopted"))


@query("i7_absence_recall_threshold", f"WITH {_PRED} SELECT round(quantile_cont(p, 0.9), 6) AS threshold FROM pred WHERE quality = 0")
def i7(spark, sf):
    return M.absence_threshold(_pred(spark, sf), "p", "quality", 0.9).select(F.round("threshold", 6).alias("threshold"))


@query("i8_mcnemar_counts", f"WITH {_PRED}, c AS (SELECT (predicted = 'true') = actual AS a, (p > 0.5) = actual AS b FROM pred) SELECT count(*) FILTER (WHERE NOT a AND b) AS n01, count(*) FILTER (WHERE a AND NOT b) AS n10 FROM c")
def i8(spark, sf):
    a, b = (F.col("predicted") == "true") == F.col("actual"), (F.col("p") > 0.5) == F.col("actual")
    return _pred(spark, sf).agg(F.count_if(~a & b).alias("n01"), F.count_if(a & ~b).alias("n10"))


@query(
    "i8_mcnemar_exact",
    f"""WITH {_PRED}, c AS (SELECT (predicted = 'true') = actual AS a, (p > 0.5) = actual AS b FROM pred), n AS (SELECT count(*) FILTER (WHERE NOT a AND b) AS n01, count(*) FILTER (WHERE a AND NOT b) AS n10 FROM c),
    k AS (SELECT n01, n10, CAST(n01 + n10 AS DOUBLE) AS n, unnest(range(0, least(n01, n10) + 1)) AS i FROM n)
    SELECT n01, n10, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p FROM k GROUP BY n01, n10""",
)
def i8_p(spark, sf):
    r = i8(spark, sf).first()
    return spark.createDataFrame([(r.n01, r.n10, round(N.mcnemar_exact(r.n01, r.n10), 6))], "n01 long, n10 long, p double")


@query("i9_bootstrap_kappa", None)
def i9(spark, sf):
    rows = _pred(spark, sf)
    pairs = rows.groupBy("quality", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("b")).count().collect()  # four rows at most
    cells = {(r.quality, r.b): r["count"] for r in pairs}
    low, high = N.bootstrap_cells(cells, 500)
    return spark.createDataFrame([(N.kappa(cells)["kappa"], low, high)], "kappa double, low double, high double")


@query("i10_clustered_bootstrap", None)
def i10(spark, sf):
    """The difference of two predictors' MCC with documents of a source drawn together, as weighted sums in Spark."""
    y = F.col("actual")

    def four(p, tag: str):
        return [F.count_if(p & y).alias(f"tp{tag}"), F.count_if(p & ~y).alias(f"fp{tag}"), F.count_if(~p & y).alias(f"fn{tag}"), F.count_if(~p & ~y).alias(f"tn{tag}")]

    per = _pred(spark, sf).groupBy("source").agg(*four(F.col("predicted") == "true", "1"), *four(F.col("p") > 0.5, "2"))
    drawn = G.bootstrap_weights(per, "source", 200)
    sums = drawn.groupBy("rep").agg(*[F.sum(F.col(c) * F.col("weight")).cast("double").alias(c) for c in per.columns if c != "source"])
    one = E.balanced(sums.select("rep", *[F.col(f"{c}1").alias(c) for c in ("tp", "fp", "fn", "tn")])).select("rep", F.col("mcc").alias("a"))
    two = E.balanced(sums.select("rep", *[F.col(f"{c}2").alias(c) for c in ("tp", "fp", "fn", "tn")])).select("rep", F.col("mcc").alias("b"))
    return one.join(two, "rep").agg(F.percentile(F.col("b") - F.col("a"), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))


@query("i15_baselines", f"WITH {_PRED}, {_FEATS}, u AS (SELECT y, feature, v FROM (SELECT y, f1, f2, f3, 0 AS none, 1 AS every FROM f) UNPIVOT (v FOR feature IN (f1, f2, f3, none, every))) SELECT feature, count(*) FILTER (WHERE v = 1 AND y) AS tp, count(*) FILTER (WHERE v = 1 AND NOT y) AS fp, count(*) FILTER (WHERE v = 0 AND y) AS fn, count(*) FILTER (WHERE v = 0 AND NOT y) AS tn FROM u GROUP BY feature")
def i15(spark, sf):
    f = _features(spark, sf).withColumn("none", F.lit(0)).withColumn("every", F.lit(1))
    long = f.unpivot(["y"], ["f1", "f2", "f3", "none", "every"], "feature", "v").select("feature", F.when(F.col("v") == 1, "true").otherwise("false").alias("predicted"), F.col("y").alias("actual"))
    return E.confusion(long, by=["feature"]).select("feature", "tp", "fp", "fn", "tn")


# --- models ---


@query("m4_sigmoid", "SELECT doc_id, round(1 / (1 + exp(-((doc_id % 41) - 20.0))), 9) AS p FROM documents")
def m4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(S.sigmoid((F.col("doc_id") % 41 - 20).cast("double")), 9).alias("p"))


_HEAD = [round(((i * 37) % 17 - 8) / 10, 1) for i in range(64)]


@query("m6_dense_head", f"SELECT vec_id, round(1 / (1 + exp(-(list_dot_product(CAST(embedding AS DOUBLE[]), {_HEAD}::DOUBLE[]) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 0.1))), 6) AS p FROM embeddings")
def m6(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.dense_probability(F.col("embedding"), _HEAD, 0.1), 6).alias("p"))


_DOT = f"list_dot_product(CAST(embedding AS DOUBLE[]), {_HEAD}::DOUBLE[]) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))"


@query("m19_artefacts", f"SELECT 'channel' AS kind, doc_id AS id, round(1 / (1 + exp(-(-0.5 + 1.25 * (doc_id % 2) - 0.75 * (doc_id % 3)))), 6) AS p FROM documents UNION ALL SELECT 'dense', vec_id, round(1 / (1 + exp(-({_DOT} + 0.1))), 6) FROM embeddings")
def m19(spark, sf):
    """The channel's and a dense model, written with their identity, read again by it and applied."""
    places = {k: scratch(spark, f"m19-{k}") for k in ("channel", "dense")}
    one = S.write_channel(spark, {"intercept": -0.5, "a": 1.25, "b": -0.75}, {"version": "1"}, places["channel"])
    two = S.write_dense(spark, _HEAD, 0.1, 0.5, "transfer", {"version": "1"}, places["dense"])
    coefficients, _ = S.read_channel(spark, places["channel"], one, "1")
    head, meta = S.read_dense(spark, places["dense"], "transfer", two, "1")
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    p = S.channel_probability({"a": F.col("doc_id") % 2, "b": F.col("doc_id") % 3}, coefficients)
    q = S.dense_probability(F.col("embedding"), head, meta["intercept"])
    return docs.select(F.lit("channel").alias("kind"), F.col("doc_id").alias("id"), F.round(p, 6).alias("p")).unionByName(vectors.select(F.lit("dense").alias("kind"), F.col("vec_id").alias("id"), F.round(q, 6).alias("p")))


@query(
    "v12_dense_variable",
    f"""WITH s AS (SELECT d.source AS site, vec_id AS pos, 1 / (1 + exp(-({_DOT} + 0.1))) AS p FROM embeddings JOIN documents d ON vec_id = doc_id), g AS (SELECT site, bool_or(p >= 0.7) AS value, max(p) AS confidence, count(*) FILTER (WHERE p >= 0.7) AS flagged, count(*) AS n FROM s GROUP BY site),
    best AS (SELECT site, list(pos ORDER BY p DESC, pos) AS b FROM s WHERE p >= 0.7 GROUP BY site)
    SELECT site, value, round(confidence, 6) AS confidence, flagged, n, coalesce(b[1:10], []) AS best FROM g LEFT JOIN best USING (site)""",
)
def v12(spark, sf):
    """The verdict of a dense head for each source, from the vectors of its documents."""
    path = scratch(spark, "v12")
    S.write_dense(spark, _HEAD, 0.1, 0.7, "transfer", {"version": "1"}, path)
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("site"))
    vectors = table(spark, sf, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select("site", F.col("vec_id").alias("pos"), F.lit("").alias("text"), "embedding")
    sites = vectors.select("site").distinct().withColumn("removed_pages", F.lit(0))
    found = S.dense_variable(vectors, sites, path, "transfer")
    best = F.transform("sentencas", lambda x: x["posicao"])
    return found.select("site", "value", F.round("confidence", 6).alias("confidence"), F.col("n_sentencas_sinalizadas").alias("flagged"), F.col("n_segmentos_avaliados").alias("n"), best.alias("best"))


@query("m8_penalised_fit", None)
def m8(spark, sf):
    rows = M.fit_channel(_features(spark, sf), ["f1", "f2", "f3"], "y")
    return spark.createDataFrame([(r["term"], float(r["beta"]), float(r["low"]), float(r["high"]), float(r["chi2"]), float(r["p"]), float(r["se_wald"])) for r in rows], "term string, beta double, low double, high double, chi2 double, p double, se_wald double")


@query("m13_challengers", None)
def m13(spark, sf):
    """The penalised fit, a ridge and boosted trees on the same features, each scored on the folds it did not see."""
    rows = _features(spark, sf).withColumn("fold", (F.col("doc_id") % 2).cast("int")).withColumn("f1", (F.col("doc_id") % 5 == 0).cast("int"))
    scored = M.challenge(rows, ["f1", "f2", "f3"], "y", "fold", rounds=10)
    return E.balanced(E.confusion(scored, by=["model"])).select("model", "tp", "fp", "fn", "tn", F.round("balanced_accuracy", 4).alias("balanced_accuracy"), F.round("mcc", 4).alias("mcc"))


_GRID = f"{_PRED}, t AS (SELECT lang, unnest([quantile_cont(p, 0.5), quantile_cont(p, 0.7), quantile_cont(p, 0.9)]) AS threshold, unnest([0, 1, 2]) AS q FROM pred GROUP BY lang), c AS (SELECT lang, q, threshold, count(*) FILTER (WHERE p >= threshold AND quality = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND quality = 0) AS fp, count(*) FILTER (WHERE p < threshold AND quality = 1) AS fn, count(*) FILTER (WHERE p < threshold AND quality = 0) AS tn FROM pred JOIN t USING (lang) GROUP BY ALL)"


@query("m16_threshold_grid", f"WITH {_GRID} SELECT lang, q, round(threshold, 6) AS threshold, tp, fp, fn, tn FROM c")
def m16(spark, sf):
    g = M.threshold_grid(_pred(spark, sf), "lang", "p", "quality", [0.5, 0.7, 0.9])
    return g.select("lang", "q", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn")


@query("i12_reduced_model", None)
def i12(spark, sf):
    """The full set of features against the set without one, by the penalised likelihood ratio."""
    names = ["f1", "f2", "f3"]
    found = M.patterns(_features(spark, sf), names, "y")
    rows = [(n, *map(float, N.likelihood_ratio(*found, k))) for k, n in enumerate(names, 1)]
    return spark.createDataFrame(rows, "without string, statistic double, p double")


def _labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id").select("doc_id", "source", "text", "quality")


@query("m15_text_coefficients", None)
def m15(spark, sf):
    """The text model of all labelled documents: a table of coefficients, the intercept as the term null."""
    vocabulary, intercept = M.fit_text(_labelled(spark, sf), "doc_id", "quality", 1.0)
    one = spark.createDataFrame([(None, None, None, intercept)], "term string, df long, idf double, coef double")
    return vocabulary.unionByName(one).select("term", "df", F.round("idf", 6).alias("idf"), F.round("coef", 3).alias("coef"))


@query("m16_nested_selection", None)
def m16_nested(spark, sf):
    """Penalty and threshold of each outer fold of sources, chosen inside, with the Matthews coefficient outside."""
    choice, _ = nested(spark, _labelled(spark, sf), "doc_id", "source", "quality", penalties=[0.1, 1.0, 10.0, 100.0], outer=3)
    return choice.select("fold", "c", F.round("threshold", 3).alias("threshold"), F.round("inner_mcc", 4).alias("inner_mcc"), "tp", "fp", "fn", "tn", F.round("mcc", 4).alias("mcc"))


@query("m17_out_of_fold", None)
def m17(spark, sf):
    """Every labelled text scored by a model that was fitted without its source."""
    return M.out_of_fold(_labelled(spark, sf), "source", "doc_id", "quality", folds=3).select("doc_id", "fold", F.round("probability", 3).alias("probability"))


@query("m21_alignment", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS without_text")
def m21(spark, sf):
    return M.alignment(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), table(spark, sf, "documents"), "doc_id")


@query("x2_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def x2(spark, sf):
    from glasshouse.streaming.upserts import windowed_counts

    return windowed_counts(table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 2).alias("total"))


@query("w5_latest_two", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 2")
def w5(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf, "orders").withColumn("n", n).where("n <= 2").select("o_custkey", "o_orderkey")
