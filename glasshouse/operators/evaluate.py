"""Evaluation as aggregates: confusion, agreement, calibration, prevalence, triage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasshouse.functions.numeric import Z95


def confusion(rows: DataFrame, predicted: str = "predicted", actual: str = "actual", by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn over states true and false; other states only count as excluded."""
    p, y = F.col(predicted), F.col(actual)
    return rows.groupBy(*(by or [])).agg(
        F.count_if((p == "true") & y).alias("tp"), F.count_if((p == "true") & ~y).alias("fp"), F.count_if((p == "false") & y).alias("fn"), F.count_if((p == "false") & ~y).alias("tn"),
        F.count_if(~F.coalesce(p, F.lit("null")).isin("true", "false")).alias("excluded"),
    )


def excluded_reasons(rows: DataFrame, predicted: str = "predicted") -> DataFrame:
    p = F.coalesce(F.col(predicted), F.lit("valor_nulo"))
    return rows.where(~p.isin("true", "false")).groupBy(p.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def metrics(c: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and kappa; null where undefined."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    po = F.try_divide(F.col("tp") + F.col("tn"), n)
    pe = F.try_divide((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn")), n * n)
    return c.select(
        "*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"),
    )


def _or0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def balanced(c: DataFrame) -> DataFrame:
    """Balanced accuracy, macro-F1, MCC, sensitivity, specificity, precision; 0 where undefined."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    sens, spec = _or0(F.try_divide(tp, tp + fn)), _or0(F.try_divide(tn, tn + fp))
    one, zero = _or0(F.try_divide(2 * tp, 2 * tp + fp + fn)), _or0(F.try_divide(2 * tn, 2 * tn + fp + fn))
    return c.select(
        "*", ((sens + spec) / 2).alias("balanced_accuracy"), ((one + zero) / 2).alias("macro_f1"), _or0(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).alias("mcc"),
        sens.alias("sensitivity"), spec.alias("specificity"), _or0(F.try_divide(tp, tp + fp)).alias("precision"),
    )


def triage_metrics(c: DataFrame) -> DataFrame:
    """Share flagged, precision of an absence, and rows to read for one hit."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select("*", F.try_divide(F.col("tp") + F.col("fp"), n).alias("flag_rate"), F.try_divide("tn", F.col("tn") + F.col("fn")).alias("absence_precision"), F.try_divide(F.col("tp") + F.col("fp"), "tp").alias("nnr"))


def global_rank(rows: DataFrame, score: str, key: str, counted: str, buckets: int = 64) -> DataFrame:
    """Adds n, the place by descending score and then key, and hits, the running count of `counted`.

    Places are taken within buckets of scores and moved by the sizes of the buckets before, so no task sorts all rows."""
    cuts = sorted(set(rows.approxQuantile(score, [i / buckets for i in range(1, buckets)], 0.005)))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col(score))) if cuts else F.lit(0)  # the first holds the highest scores
    part = rows.withColumn("_bucket", bucket)
    w = Window.partitionBy("_bucket").orderBy(F.desc(score), key)
    placed = part.withColumn("n", F.row_number().over(w)).withColumn("hits", F.sum(F.col(counted).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = part.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(counted).cast("int")).alias("_h"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over `buckets` rows
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_h"))
    moved = placed.join(F.broadcast(offsets), "_bucket")  # `buckets` rows at most
    return moved.withColumn("n", F.col("n") + F.col("_n")).withColumn("hits", F.col("hits") + F.col("_h")).drop("_bucket", "_n", "_h")


def average_precision(rows: DataFrame, score: str, actual: str, key: str) -> DataFrame:
    """By rank; ties by the key."""
    ranked = global_rank(rows.select(score, actual, key), score, key, actual)
    return ranked.where(F.col(actual)).agg((F.sum(F.col("hits") / F.col("n")) / F.count(F.lit(1))).alias("average_precision"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """(0, 1) without observations."""
    p, d = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(centre - half, F.lit(0.0))), F.when(n == 0, 1.0).otherwise(F.least(centre + half, F.lit(1.0)))


def sample_size(error: float, p: Column | float = 0.5, z: float = 1.96) -> Column:
    """Rows to draw for an error of `error` at a share of p; 0.5 is the worst case."""
    p = p if isinstance(p, Column) else F.lit(p)
    return F.ceil(z * z * p * (1 - p) / (error * error) - 1e-9)


def margin(p: Column, n: Column, z: float = 1.96) -> Column:
    """Half the width of the interval of a share of p among n rows."""
    return z * F.sqrt(p * (1 - p) / n)


def brier(rows: DataFrame, p: str, y: str, group: str) -> DataFrame:
    """Brier score with Murphy's parts over groups of equal treatment: reliability, resolution, uncertainty, residual."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"), F.sum(F.pow(F.col(p) - F.col(y).cast("double"), 2)).alias("sq"), F.sum(F.col(y).cast("double")).alias("yes"))
    t = g.agg(F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("yes").alias("yes"), F.sum(F.col("n") * F.pow(F.col("mp") - F.col("my"), 2)).alias("rel"), F.sum(F.col("n") * F.col("my") * F.col("my")).alias("m2"))
    base = F.col("yes") / F.col("n")
    return t.select(
        (F.col("sq") / F.col("n")).alias("brier"), (F.col("rel") / F.col("n")).alias("reliability"), (F.col("m2") / F.col("n") - base * base).alias("resolution"), (base * (1 - base)).alias("uncertainty"),
        (F.col("sq") / F.col("n") - (F.col("rel") / F.col("n") - (F.col("m2") / F.col("n") - base * base) + base * (1 - base))).alias("residual"),
    )


def pattern_calibration(rows: DataFrame, features: list[str], p: str, y: str) -> DataFrame:
    """Rows, positives, predicted and observed rate and Wilson interval of each pattern of features."""
    name = F.concat_ws("", *[F.when(F.col(f) == 1, F.lit(f)) for f in features])
    g = rows.groupBy(F.when(name == "", "(nenhum)").otherwise(name).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("positives"), F.avg(p).alias("predicted"))
    low, high = wilson(F.col("positives").cast("double"), F.col("n"))
    return g.select("*", (F.col("positives") / F.col("n")).alias("observed"), low.alias("low"), high.alias("high"))


def lift(rows: DataFrame, features: list[str], y: str) -> DataFrame:
    """Prevalence of each feature in both classes, and their ratio (null for none in the negatives)."""
    long = rows.select(y, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select(y, "x.*")
    g = long.groupBy("feature").agg(F.avg(F.when(F.col(y), F.col("v"))).alias("in_positives"), F.avg(F.when(~F.col(y), F.col("v"))).alias("in_negatives"))
    return g.withColumn("lift", F.try_divide("in_positives", "in_negatives"))


def set_recall(found: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Recall and precision of one set of keys against another."""
    a, b = found.select(*key).distinct().withColumn("f", F.lit(1)), truth.select(*key).distinct().withColumn("t", F.lit(1))
    return a.join(b, key, "full").agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("both"), F.count("f").alias("found"), F.count("t").alias("truth")).select("*", F.try_divide("both", "truth").alias("recall"), F.try_divide("both", "found").alias("precision"))


def rater_pairs(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Counts of label pairs of two raters: at most the square of the labels."""
    return a.select(*key, F.col("label").alias("a")).join(b.select(*key, F.col("label").alias("b")), key).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """Agreement, expected agreement, kappa and PABAK; null without rows."""
    total = pairs.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = pairs.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    cols = pairs.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, "label").agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    po, pe = F.try_divide("same", "total"), F.try_divide(F.coalesce("chance", F.lit(0)), F.col("total") * F.col("total"))
    return total.crossJoin(chance).select(F.coalesce("total", F.lit(0)).alias("n"), po.alias("agreement"), pe.alias("expected"), F.try_divide(po - pe, 1 - pe).alias("kappa"), (2 * po - 1).alias("pabak"))  # one row by one row


def density(flagged: Column, evaluated: Column) -> Column:
    return F.when(evaluated > 0, F.round(flagged / evaluated, 6))


def repetition(rows: DataFrame, site: str, text: str) -> DataFrame:
    """Adds how often a text occurs and on how many sites, and whether repeats are within or between sites."""
    g = rows.groupBy(text).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(site).alias("n_sites"))
    bucket = F.when(F.col("n_rows") == 1, "unique").when(F.col("n_sites") == 1, "within_site").when(F.col("n_rows") == F.col("n_sites"), "between_sites").otherwise("both")
    return g.withColumn("bucket", bucket)


def prevalence(wide: DataFrame, stratum: str, variables: list[str]) -> DataFrame:
    """Share of true among true and false, by stratum and in all (ROLLUP)."""
    rate = [F.try_divide(F.count_if(F.col(v) == "true"), F.count_if(F.col(v).isin("true", "false"))).alias(v) for v in variables]
    return wide.rollup(stratum).agg(F.count(F.lit(1)).alias("n"), *rate)


def multiset_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Shared words with repetition over the larger side; a and b (key, word)."""
    x = a.groupBy(key, "word").agg(F.count(F.lit(1)).alias("na"))
    y = b.groupBy(key, "word").agg(F.count(F.lit(1)).alias("nb"))
    g = x.join(y, [key, "word"], "full").groupBy(key).agg(F.sum(F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("shared"), F.coalesce(F.sum("na"), F.lit(0)).alias("na"), F.coalesce(F.sum("nb"), F.lit(0)).alias("nb"))
    return g.withColumn("overlap", F.col("shared") / F.greatest("na", "nb"))


def divergent_marks(rows: DataFrame, text: Column, label: str, least: int = 25) -> DataFrame:
    """Texts that were marked in more than one way."""
    long = F.filter(F.array(text), lambda t: F.char_length(t) >= least)  # exploded, the text is found once and not again for the condition
    return rows.select(F.explode(long).alias("t"), label).groupBy("t").agg(F.count_distinct(label).alias("labels"), F.count(F.lit(1)).alias("n")).where("labels > 1")


def overlap_labels(segments: DataFrame, evidence: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Segments (key, idx, begin, end) that an evidence interval (key, e_begin, e_end) covers by `share` of the shorter one; the intervals of a key come to its segments in one join, and segments are read once."""

    def covers(e):
        common = F.least(F.col("end"), e["e_end"]) - F.greatest(F.col("begin"), e["e_begin"])
        return (common > 0) & (common >= share * F.least(F.col("end") - F.col("begin"), e["e_end"] - e["e_begin"]))

    given = evidence.where("e_begin IS NOT NULL AND e_end IS NOT NULL").groupBy(key).agg(F.collect_set(F.struct("e_begin", "e_end")).alias("_evidence"))
    return segments.join(given, key, "left").withColumn("label", F.coalesce(F.exists("_evidence", covers).cast("int"), F.lit(0))).drop("_evidence")


def consolidate(rows: DataFrame, key: list[str], label: str = "label", order: str = "idx") -> DataFrame:
    """Repeated texts of a site: positive beats unlabelled beats the first."""
    return rows.groupBy(*key).agg(
        F.when(F.max(F.when(F.col(label) == 1, 1)).isNotNull(), 1).when(F.count_if(F.col(label).isNull()) > 0, F.lit(None).cast("int")).otherwise(F.min_by(label, order)).alias(label), F.min(order).alias(order), F.count(F.lit(1)).alias("n")
    )
