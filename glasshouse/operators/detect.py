"""Variables measured on a site's pages: fetch signals, policy, channel for data subjects, cookie banner, requirement rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from glasshouse.functions import lexicon as L
from glasshouse.functions.html import anchors_of, banner_elements, visible_of
from glasshouse.functions.text import normalise
from glasshouse.functions.urls import below_any, same_domain
from glasshouse.operators.links import blocked, lookup
from glasshouse.operators.nearest import nearest


def any_of(text: Column, patterns: list[str], flags: str = "(?iuU)") -> Column:
    return reduce(lambda a, p: a | text.rlike(flags + p), patterns[1:], text.rlike(flags + patterns[0])) if patterns else F.lit(False)


def count_words(text: Column, words: list[str]) -> Column:
    """How many of the words occur, as plain parts of the lower-cased text."""
    return reduce(lambda a, w: a + F.contains(text, F.lit(w)).cast("int"), words, F.lit(0))


# --- fetch signals and the chain of fetchers ---


def signals(root: Column, selection: Column | None = None, cookies: Column | None = None, actions: Column | None = None, threshold: int = 1000, markers: list[str] = L.SHELL_MARKERS) -> dict[str, Column]:
    """The predicates by which a fetch is judged, as columns."""
    out = {
        "html_root_smaller_than_bytes": F.octet_length(F.coalesce(root, F.lit(""))) < threshold,
        "has_js_shell_markers": (F.coalesce(root, F.lit("")) != "") & any_of(root, markers, "(?is)"),
    }
    if selection is not None:
        out["subpage_selection_empty"] = F.coalesce(F.size(selection), F.lit(0)) <= 0
    if cookies is not None:
        out["cookies_pre_consent_zero"] = F.coalesce(F.size(F.element_at(cookies, "pre_consent")), F.lit(0)) <= 0
    if actions is not None:
        out["consent_actions_all_failed"] = (F.size(actions) > 0) & F.forall(actions, lambda a: ~F.coalesce(a["success"], F.lit(False)))
    return out


def robots_allows(status: Column, permitted: Column) -> Column:
    """200: as the file says; other 4xx, redirects that loop and network errors (null): allowed; 5xx: not."""
    return F.when(status == 200, permitted).when(status >= 500, False).otherwise(True)


def cookies(header: Column) -> Column:
    """A Set-Cookie header as name, value and attributes."""
    parts = F.transform(F.split(header, ";"), lambda x: F.trim(x))
    pair = F.element_at(parts, 1)
    rest = F.slice(parts, 2, 100)

    def value(name: str) -> Column:
        own = F.filter(rest, lambda x: F.lower(x).startswith(name + "="))
        return F.try_element_at(F.transform(own, lambda x: F.regexp_extract(x, "=(.*)$", 1)), F.lit(1))

    return F.struct(
        F.substring_index(pair, "=", 1).alias("name"), F.regexp_extract(pair, "=(.*)$", 1).alias("value"), value("domain").alias("domain"), F.coalesce(value("path"), F.lit("/")).alias("path"),
        F.exists(rest, lambda x: F.lower(x) == "httponly").alias("httpOnly"), F.exists(rest, lambda x: F.lower(x) == "secure").alias("secure"),
    )


def mask_cookie(value: Column) -> Column:
    """First 8 characters, length and the first 16 hex digits of the digest."""
    return F.struct(F.concat(F.substring(value, 1, 8), F.lit("...")).alias("value"), F.char_length(value).alias("value_len"), F.substring(F.sha2(value, 256), 1, 16).alias("value_hash"))


def replay_chain(attempts: DataFrame) -> DataFrame:
    """attempts(site, step, abort, escalate, ...) to the attempt that ended each site's chain: the first that aborts or does not escalate.

    Outcome: aborted (before escalation), accepted, or exhausted at the last step."""
    end = F.col("abort") | ~F.col("escalate")
    ended = attempts.groupBy("site").agg(F.min(F.when(end, F.col("step"))).alias("end_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n_steps"))
    rows = attempts.join(ended, "site").where(F.col("step") == F.coalesce("end_step", "last_step"))
    return rows.withColumn("outcome", F.when(F.col("end_step").isNull(), "exhausted").when(F.col("abort"), "aborted").otherwise("accepted")).drop("end_step", "last_step")


# Exception classes and their direct bases.
EXCEPTION_BASES = [("RobotsDisallowedError", "FetchError"), ("JsRequiredError", "FetchError"), ("NavigationFailedError", "FetchError"), ("FetchTimeoutError", "FetchError"), ("FetchError", "Exception")]


def exception_closure(bases: list[tuple[str, str]] = EXCEPTION_BASES) -> list[tuple[str, str]]:
    """Every class with itself and all its ancestors."""
    parent, out = dict(bases), []
    for c in {x for b in bases for x in b}:
        now = c
        while now is not None:
            out.append((c, now))
            now = parent.get(now)
    return sorted(out)


def backoff(attempt: Column, initial: float = 1.0, factor: float = 2.0, most: int = 3) -> Column:
    """Delay before the next try; none after the last."""
    return F.when(attempt < most, F.lit(initial) * F.pow(F.lit(factor), attempt)).otherwise(0.0)


def failure_reason(kind: Column) -> Column:
    return F.when(kind.contains("Robots"), "robots_proibe").when(kind.contains("Timeout"), "coleta_expirou").when(kind.isin("ImportError", "ModuleNotFoundError"), "ambiente_incompleto").otherwise("coleta_falhou")


def confidence(name: Column) -> Column:
    """A named confidence as a number; an unknown name is an error."""
    out = F.when(name == "high", L.CONFIDENCE["high"])
    for k, v in L.CONFIDENCE.items():
        out = out.when(name == k, v) if k != "high" else out
    return out.otherwise(F.raise_error(F.concat(F.lit("no such confidence: "), name)).cast("double"))


# --- privacy policy ---


def policy_like(url: Column, pattern: Column, path_pattern: str = L.POLICY_PATH, weak: list[str] = L.WEAK_POLICY_PATTERNS) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1).rlike("(?iu)" + path_pattern) | ~F.coalesce(pattern, F.lit(weak[0])).isin(*weak)


def policy(
    sites: DataFrame, selection: DataFrame, pages: DataFrame, challenged: DataFrame | None = None, keywords: list[str] = L.POLICY_KEYWORDS, min_bytes: int = L.MIN_PAGE_BYTES, min_words: int = L.MIN_KEYWORDS,
    path_pattern: str = L.POLICY_PATH,
) -> DataFrame:
    """sites(site, root_bytes), selection(site, pos, url, matched_pattern), pages(site, page_key, seq, body) to a verdict for each site.

    The best candidate decides: content with min_words words or more (0.95), else a PDF that looks like a policy, else light content behind a policy-like link (0.65)."""
    like = policy_like(F.col("url"), F.col("matched_pattern"), path_pattern)
    pdf = F.lower(F.regexp_extract("url", r"^([^?#]*)", 1)).endswith(".pdf")
    bodies = pages.select("site", "page_key", "seq", "body").where(F.octet_length("body") >= min_bytes)
    found = lookup(selection.where(~pdf), pages).join(bodies, ["site", "page_key", "seq"])
    words = found.select("site", "url", "pos", "matched_pattern", count_words(F.lower("body"), keywords).alias("words"))
    level = F.when(F.col("words") >= min_words, 3).when((F.col("words") >= 1) & like, 1)
    ranked = words.select("site", "url", "pos", level.alias("level")).unionByName(selection.where(pdf & like).select("site", "url", "pos", F.lit(2).alias("level"))).where("level IS NOT NULL")
    best = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("level"), "pos"))).where("_n = 1").drop("_n", "pos")
    rows = sites.join(best, "site", "left")
    if challenged is not None:
        rows = rows.join(blocked(selection, challenged).select("site").distinct().withColumn("hidden", F.lit(True)), "site", "left")
    else:
        rows = rows.withColumn("hidden", F.lit(None).cast("boolean"))
    yes = F.col("level").isNotNull()
    method = F.when(F.col("level") == 3, "subpage_selection+content_qualified").when(F.col("level") == 2, "subpage_selection+pdf_policy_link").when(F.col("level") == 1, "subpage_selection+content_light_policy_link")
    return rows.select(
        "site", F.when(yes, "true").when(F.col("hidden"), "nao_coletado").otherwise("false").alias("state"),
        F.when(F.col("level") == 3, 0.95).when(yes, 0.65).when(F.col("hidden"), 0.0).when(F.col("root_bytes") > 0, 0.95).otherwise(0.0).alias("confidence"), method.alias("method"), "url",
    )


# --- channel for data subjects: rule ---


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + L.EMAIL), 1), F.lower))


def rule_channel(
    pages: DataFrame, qualified: DataFrame, prefixes: list[str] = L.RULE_EMAIL_PREFIXES, providers: list[str] = L.RULE_PROVIDERS, keywords: list[str] = L.CHANNEL_KEYWORDS, min_bytes: int = L.MIN_PAGE_BYTES
) -> DataFrame:
    """pages(site, page_key, body) and qualified(site, body): the pages of channel and officer candidates."""
    user, domain = F.substring_index("email", "@", 1), F.substring_index("email", "@", -1)
    hit = reduce(lambda a, p: a | user.startswith(p), prefixes, F.lit(False)) & ~below_any(domain, providers)
    mail = pages.select("site", F.explode(emails(F.col("body"))).alias("email")).where(hit).groupBy("site").agg(F.min("email").alias("email"))
    page = qualified.where((F.octet_length("body") >= min_bytes) & (count_words(F.lower("body"), keywords) > 0)).select("site").distinct().withColumn("page", F.lit(True))
    root = pages.groupBy("site").agg(F.max(F.when(F.col("page_key") == "/", F.octet_length("body"))).alias("root_bytes"))
    empty = F.coalesce("root_bytes", F.lit(0)) == 0
    return root.join(mail, "site", "left").join(page, "site", "left").select(
        "site", F.when(~empty & (F.col("email").isNotNull() | F.col("page").isNotNull()), "true").otherwise("false").alias("state"), F.when(empty, 0.0).otherwise(0.95).alias("confidence"), "email"
    )


def email_form(prefixed: Column, same: Column, anchored: Column) -> Column:
    """The codebook's form of an address."""
    return F.when(prefixed & same, "email_lgpd_controlador").when(~same, "email_grupo_controlador").when(~prefixed & anchored, "email_generico_rotulado").otherwise("(ambiguo - decidir manualmente)")


# --- channel: features and model ---


def near(a: list[int], b: list[int], width: int) -> bool:
    """Does any place of a lie within `width` of one of b (b sorted)?"""
    for x in a:
        i = bisect_left(b, x - width)
        if i < len(b) and b[i] <= x + width:
            return True
    return False


def channel_features(page: str, url: str, categories: set[str], pdf: str = "", width: int = L.CHANNEL_WINDOW) -> dict[str, int]:
    """F1 to F8 of a site's pages, joined in order.  Distances are between match starts."""
    vis = f"{visible_of(page)} {pdf or ''}"
    own = re.sub(r"^www\.", "", re.sub(r"^[a-z][a-z0-9+.\-]*://", "", (url or "").lower()).split("/")[0].split(":")[0])
    found = dict.fromkeys(m.group(1).lower() for text in (vis, page) for m in re.finditer(L.EMAIL, text, re.I))
    below = lambda d, x: d == x or d.endswith("." + x)
    found = [e for e in found if not any(below(e.split("@")[1], p) for p in L.MODEL_PROVIDERS)]
    lead = [e for e in found if e.startswith(tuple(L.MODEL_EMAIL_PREFIXES))]
    mine = lambda e: below(e.split("@")[1], own) or below(own, e.split("@")[1])
    rest = sorted(e for e in found if e not in lead)[: L.CHANNEL_GENERIC_LIMIT]
    anchor = re.compile(f"{L.ANCHOR_OFFICER}|{L.ANCHOR_RIGHTS}", re.I)
    places = [m.start() for m in anchor.finditer(vis)]
    part = page[: L.CHANNEL_HTML_LIMIT]
    low = vis.lower()
    generic = [m.start() for m in re.finditer("|".join(map(re.escape, rest)), low)] if rest else []
    rights = re.compile(L.ANCHOR_RIGHTS, re.I)
    return {
        "F1": int(any(map(mine, lead))), "F2": int(any(not mine(e) for e in lead)), "F3": int(near(generic, places, width)),
        "F4": int(bool(categories & {"canal_titular", "encarregado"}) and any(w in low for w in L.CHANNEL_KEYWORDS) and len(page) >= L.MIN_PAGE_BYTES),
        "F5": int(near([m.start() for m in re.finditer(r"<form\b", part, re.I)], [m.start() for m in anchor.finditer(part)], width) or any(rights.search(a.text) and not a.href.lower().startswith(("mailto:", "tel:")) for a in anchors_of(part))),
        "F6": int(near([m.start() for m in re.finditer(L.PHONE, vis, re.I)], places, width)), "F7": int(bool(re.search(L.ANCHOR_OFFICER, vis, re.I))), "F8": int(bool(rights.search(vis))),
    }


@F.pandas_udf(StructType([StructField(f"F{i}", IntegerType()) for i in range(1, 9)]))
def channel_features_udf(page: pd.Series, url: pd.Series, categories: pd.Series, pdf: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([channel_features(p or "", u or "", set(c if c is not None else []), t or "") for p, u, c, t in zip(page, url, categories, pdf, strict=True)], columns=[f"F{i}" for i in range(1, 9)])


def joined_pages(pages: DataFrame) -> DataFrame:
    """pages(site, page_key, body): the root first, then the others by key, joined by line ends."""
    part = F.struct((F.col("page_key") != "/").alias("later"), "page_key", "body")
    return pages.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["body"]), "\n").alias("page"))


def within(points: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """points(site, at) that lie within `width` of one of anchors(site, at)."""
    return nearest(points, anchors).where(F.col("distance") <= width).select(*points.columns)


# --- cookie banner ---


def banner_verdict(page: str, consent: bool = False, containers: list[str] = L.BANNER_CONTAINERS, words: list[str] = L.BANNER_WORDS) -> tuple[bool, float, str]:
    if not page:
        return False, 0.0, "empty"
    seen = [e for e in banner_elements(page, containers, L.BANNER_VENDORS) if not e["hidden"]]
    if any(e["vendor"] for e in seen):
        return True, 0.95, "vendor"
    if consent:
        return True, 0.95, "consent_action"
    lexicon = [re.compile(w, re.I) for w in words]
    if any(e["container"] and any(w.search(e["text"]) for w in lexicon) for e in seen):
        return True, 0.65, "container_lexicon"
    if any(x in page.lower() for x in L.BANNER_LOADERS):
        return True, 0.35, "loader"
    return False, 0.95, "none"


@F.pandas_udf(StructType([StructField("present", BooleanType()), StructField("confidence", DoubleType()), StructField("method", StringType())]))
def banner(page: pd.Series, consent: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([banner_verdict(p or "", bool(c)) for p, c in zip(page, consent, strict=True)], columns=["present", "confidence", "method"])


# --- requirement rules ---


def requirement(text: Column, variable: str, rules: dict = L.REQUIREMENT_RULES) -> Column:
    """Does the normalised text meet a requirement's patterns and none of its exclusions?"""
    plain, rule = normalise(text), rules[variable]
    yes = any_of(plain, rule["yes"], "(?U)")
    return (yes & ~any_of(plain, rule["no"], "(?U)")) if rule["no"] else yes


def email_relation(domain: Column, site: Column) -> Column:
    return F.when(same_domain(domain, site), "own").otherwise("other")
