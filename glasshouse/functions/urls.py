"""Hosts, suffixes and page keys as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host of a URL or bare domain; www stays."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?([^/?#:]*)", 1)


def base_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """Path of a URL, "/" if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def page_key(url: Column) -> Column:
    """Identity of a page: host without www, lower-case path without a trailing slash."""
    return F.concat(base_host(url), F.regexp_replace(F.lower(path(url)), "/+$", ""))


def has_suffix(domain: Column, suffixes: list[str]) -> Column:
    """Ends in any of the suffixes; no suffixes: always."""
    return reduce(lambda a, s: a | domain.endswith(s), suffixes[1:], domain.endswith(suffixes[0])) if suffixes else F.lit(True)


def same_domain(a: Column, b: Column) -> Column:
    """Equal, or one below the other."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def below_any(a: Column, domains: list[str]) -> Column:
    return reduce(lambda c, d: c | (a == d) | a.endswith("." + d), domains, F.lit(False))


def with_public_suffix(rows: DataFrame, domain: str, suffixes: DataFrame) -> DataFrame:
    """Adds tld: the longest listed suffix of the domain, or .unknown.  suffixes(suffix) is a short list, joined on the tails of each domain."""
    names = rows.select(F.col(domain).alias("_d")).distinct().withColumn("_t", F.explode(tails_of("_d")))
    best = names.join(suffixes, names._t == suffixes.suffix).groupBy("_d").agg(F.max_by("suffix", F.length("suffix")).alias("_s"))
    return rows.join(best, rows[domain] == best._d, "left").withColumn("tld", F.coalesce(F.concat(F.lit("."), F.col("_s")), F.lit(".unknown"))).drop("_d", "_s")


def public_suffixes(rows: DataFrame, domain: str, rules: DataFrame) -> DataFrame:
    """Adds suffix and registrable (the suffix and one label more; null for a suffix itself) by rules(rule): a name, `*.` and a name (any one label
    before it), or `!` and a name (the suffix is what follows its first label).

    An exception wins, else the longest rule; without one the last label is the suffix.  Every tail of a domain is looked up by an equi join, by itself and by
    what follows its first label.  Rules count in lower case; a null or empty domain has neither."""
    rule = F.lower(F.trim("rule"))
    kinds = rules.select(F.regexp_replace(rule, r"^(!|\*\.)", "").alias("name"), F.when(rule.startswith("!"), "!").when(rule.startswith("*."), "*").otherwise("").alias("kind")).where("name != ''").distinct()
    names = rows.select(F.col(domain).alias("_d")).where(F.col(domain) != "").distinct().withColumn("_l", F.split(F.lower("_d"), "[.]"))
    tails = names.select("_d", "_l", F.posexplode(F.transform("_l", lambda _, i: F.array_join(F.slice("_l", i + 1, F.size("_l")), "."))).alias("_i", "_t"))
    asked = tails.select("_d", (F.size("_l") - F.col("_i")).alias("_n"), F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("_t").alias("at")), F.struct(F.lit(False).alias("own"), F.regexp_replace("_t", r"^[^.]*[.]?", "").alias("at")))).alias("_a"))
    hit = asked.select("_d", "_n", "_a.*").join(kinds, F.col("at") == F.col("name")).where("(own AND kind != '*') OR (NOT own AND kind = '*')")
    best = hit.groupBy("_d").agg(F.max(F.when(F.col("kind") == "!", F.col("_n") - 1)).alias("_e"), F.max("_n").alias("_n")).select("_d", F.coalesce("_e", "_n").alias("_n"))
    found = names.join(best, "_d", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    tail = lambda n: F.array_join(F.slice("_l", F.size("_l") - n + 1, n), ".")
    longer = F.when(F.size("_l") > F.col("_n"), tail(F.least(F.col("_n") + 1, F.size("_l"))))
    return rows.join(found.select("_d", tail(F.col("_n")).alias("suffix"), longer.alias("registrable")), rows[domain] == F.col("_d"), "left").drop("_d")


def tails_of(name: str) -> Column:
    """All proper tails of a dotted name: a.b.c gives b.c and c."""
    return F.expr(f"transform(sequence(1, greatest(size(split({name}, '[.]')) - 1, 1)), i -> array_join(slice(split({name}, '[.]'), i + 1, 100), '.'))")
