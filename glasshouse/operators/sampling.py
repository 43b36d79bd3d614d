"""Samples and folds that are the same on every run: places come from a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 2**31


def draw(key: Column, seed: int) -> Column:
    """A pseudo-random whole number from a whole-number key, by integer arithmetic that any engine repeats."""
    return F.pmod((key % MODULUS) * 2654435761 % MODULUS * 1103515245 + F.lit(seed) * 12345 + (key % MODULUS), F.lit(MODULUS))


def stratified(rows: DataFrame, stratum: str, key: str, sizes: dict[str, int] | int, seed: int = 42) -> DataFrame:
    """Simple random samples without replacement within strata; short strata are given whole, with shortfall."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(F.col(key), seed), key))
    if isinstance(sizes, int):
        want = F.lit(sizes)
    else:
        want = F.lit(0)
        for s, n in sizes.items():
            want = F.when(F.col(stratum) == s, n).otherwise(want)
    picked = rows.withColumn("place", place).withColumn("wanted", want).where(F.col("place") <= F.col("wanted"))
    return picked


def shortfall(sample: DataFrame, stratum: str) -> DataFrame:
    return sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("wanted")).withColumn("short", F.col("n") < F.col("wanted"))


def one_per_domain(rows: DataFrame, domain: str, rank: str) -> DataFrame:
    """The best-ranked host of each registrable domain."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(domain).orderBy(rank))).where("_n = 1").drop("_n")


def minus_used(rows: DataFrame, used: list[DataFrame], domain: str) -> DataFrame:
    for u in used:
        rows = rows.join(u.select(domain), domain, "left_anti")
    return rows


def quotas(rows: DataFrame, key: str, flags: dict[str, int], seed: int = 42) -> DataFrame:
    """A quota for each flag, the rarest first, no row twice: one anti join a flag."""
    counts = rows.agg(*[F.count_if(f).alias(f) for f in flags]).first()
    out, left = None, rows
    for f in sorted(flags, key=lambda x: (counts[x], x)):
        part = left.where(f).orderBy(draw(F.col(key), seed), key).limit(flags[f]).withColumn("quota", F.lit(f))
        out = part if out is None else out.unionByName(part)
        left = left.join(part.select(key), key, "left_anti")
    return out


def folds(rows: DataFrame, key: str, strata: list[str], k: int = 5, reps: int = 20, seed: int = 42) -> DataFrame:
    """Repeated stratified folds: every row, for each repetition, with its fold."""
    many = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    mixed = F.pmod(draw(F.col(key), seed) + F.col("rep") * 7919 * (F.col(key) % 1009 + 1), F.lit(MODULUS))
    return many.withColumn("fold", (F.row_number().over(Window.partitionBy("rep", *strata).orderBy(mixed, key)) - 1) % k)


def bootstrap_weights(rows: DataFrame, key: str, reps: int, seed: int = 42) -> DataFrame:
    """Poisson(1) weights of every cluster in every repetition, from hashes, so that a resample is one aggregation."""
    many = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    u = (F.pmod(F.xxhash64(F.col(key), F.col("rep"), F.lit(seed)), F.lit(MODULUS)) + F.lit(0.5)) / MODULUS
    w = F.lit(0)
    for bound in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119):
        w = w + (u > bound).cast("int")
    return many.withColumn("weight", w)
