"""Links of a page: candidates by category, PDF documents, page keys, lookups and anti-bot marks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasshouse.functions import lexicon as L
from glasshouse.functions.html import anchors_of, steps
from glasshouse.functions.urls import page_key, path

_FIELDS = ["text", "label", "title", "href", "url"]


def check_config(categories: dict[str, list[str]], blockers: list[str]) -> None:
    for pattern in [*(p for ps in categories.values() for p in ps), *blockers]:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"bad pattern {pattern!r}: {e}") from e


def anchors(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with `anchors`: the page's links in order, with their text, label, title, reference and absolute URL (null if there is none)."""
    schema = ", ".join(f"{f}: string" for f in _FIELDS)
    return pages.select("page_id", "url", "html").mapInArrow(anchor_rows, f"page_id long, url string, anchors array<struct<{schema}>>")


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of page_id, url and html to page_id, url and anchors, in pieces, so that memory does not follow the batch's size."""
    kind = pa.list_(pa.struct([(f, pa.string()) for f in _FIELDS]))
    for batch in batches:
        for at, n in steps(batch.column("html")):
            part = batch.slice(at, n)
            found = [[{**{f: getattr(a, f) for f in _FIELDS[:-1]}, "url": _joined(u or "", a.href)} for a in anchors_of(h or "")] for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(found, kind)], names=["page_id", "url", "anchors"])


def _joined(base: str, href: str | None) -> str | None:
    try:
        return urljoin(base, href) if href else None
    except ValueError:
        return None


def _netloc(url: Column) -> Column:
    """Host and port in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")


def _matched(anchor: Column, base: Column, categories: dict[str, list[str]], blockers: list[str], same_host: frozenset[str]) -> Column:
    """The categories that an anchor matches, in order, each with the first source and pattern that show it."""
    sources = [("text", anchor["text"]), ("aria-label", anchor["label"]), ("title", anchor["title"]), ("href", anchor["href"])]
    usable = F.lower(anchor["url"]).rlike("^https?://")
    for b in blockers:
        usable = usable & ~anchor["url"].rlike(f"(?iU){b}")
    there, own = _netloc(anchor["url"]), _netloc(base)
    near = (there == own) | there.endswith(F.concat(F.lit("."), own))
    snippet = F.substring(F.when(F.coalesce(anchor["text"], F.lit("")) != "", anchor["text"]).otherwise(anchor["href"]), 1, 120)

    def shown(category: str) -> Column:
        first = F.coalesce(*[F.when(v.rlike(f"(?iU){p}"), F.struct(F.lit(p).alias("pattern"), F.lit(n).alias("source"))) for n, v in sources for p in categories[category]])
        fits = usable & near if category in same_host else usable
        return F.when(fits & first.isNotNull(), F.struct(F.lit(category).alias("category"), anchor["url"].alias("url"), first["pattern"].alias("pattern"), first["source"].alias("source"), snippet.alias("snippet")))

    return F.array_compact(F.array(*[shown(c) for c in categories]))


_KEPT = "array<struct<category: string, pos: int, url: string, pattern: string, source: string, snippet: string>>"


def _capped_matches(matches: Column, per_category: int, total: int) -> Column:
    """Matches in order, folded under both caps: `per_category` URLs in a category, `total` distinct URLs in all; a URL counts once a category."""

    def step(state: Column, m: Column) -> Column:
        mine = F.filter(state["kept"], lambda k: k["category"] == m["category"])
        takes = (F.size(state["urls"]) < total) & (F.size(mine) < per_category) & ~F.exists(mine, lambda k: k["url"] == m["url"])
        one = F.struct(m["category"].alias("category"), F.size(mine).alias("pos"), *[m[c].alias(c) for c in ("url", "pattern", "source", "snippet")])
        return F.when(takes, F.struct(F.concat(state["kept"], F.array(one)).alias("kept"), F.array_union(state["urls"], F.array(m["url"])).alias("urls"))).otherwise(state)

    begin = F.struct(F.array().cast(_KEPT).alias("kept"), F.array().cast("array<string>").alias("urls"))
    return F.aggregate(matches, begin, step, lambda s: s["kept"])


def select_candidates(
    rows: DataFrame, categories: dict[str, list[str]], blockers: list[str], per_category: int = 2, total: int = 6, same_host: frozenset[str] = frozenset(), via: str | None = None
) -> DataFrame:
    """rows(page_id, url, anchors array) to candidates.  A page is one row, so nothing is shuffled; patterns and caps are JVM-side.

    Once `total` distinct URLs are taken nothing more is, within an anchor either.  Null fields match nothing."""
    check_config(categories, blockers)
    matches = F.flatten(F.transform("anchors", lambda a: _matched(a, F.col("url"), categories, blockers, same_host)))
    kept = rows.withColumn("_matches", matches).select("page_id", F.explode(_capped_matches(F.col("_matches"), per_category, total)).alias("k"))
    return kept.select("page_id", "k.category", "k.pos", "k.url", F.col("k.pattern").alias("matched_pattern"), F.col("k.source").alias("matched_against"), "k.snippet", F.lit(via).cast("string").alias("discovered_via"))


def candidates(pages: DataFrame, categories: dict[str, list[str]] = L.LINK_CATEGORIES, blockers: list[str] = L.PATH_BLOCKERS, via: str | None = None, **caps) -> DataFrame:
    """pages(page_id, url, html) to their candidates; only the parser of the markup is Python."""
    return select_candidates(anchors(pages), categories, blockers, via=via, **caps)


def second_level(pages: DataFrame) -> DataFrame:
    """Pages reached through another category, searched for the target categories only, on the same host, three at most."""
    target = {c: L.LINK_CATEGORIES[c] for c in L.SECOND_LEVEL_CATEGORIES}
    return candidates(pages, target, via="acesso_informacao_gov", total=3, same_host=frozenset(target))


def clean_href(href: Column) -> Column:
    """Backslashes to slashes; repeated leading slashes to one; doubled ones after the scheme gone."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(href), F.lit("\\"), F.lit("/")), r"^/{2,}(?=[^/]*/?$)|^/{3,}", "/"), r"(?<!:)/{2,}", "/")


def pdf_from_selection(selection: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Candidate URLs that are PDF files, in four categories, first occurrences in order."""
    wanted = categories or ["politica_privacidade", "encarregado", "canal_titular", "termos_uso"]
    rows = selection.where(F.col("category").isin(wanted) & F.lower(F.regexp_extract("url", r"^([^?#]*)", 1)).endswith(".pdf"))
    return first_of(rows, ["page_id", "url"], "pos")


def pdf_from_pages(links: DataFrame, most: int = 8) -> DataFrame:
    """links(page_id, seq, url, text): PDF links about privacy that are no reference material and no third party's; `most` a page."""
    file = F.lower(F.regexp_extract("url", r"^([^?#]*)", 1))
    about = F.concat_ws(" ", "url", "text")
    rows = links.where(file.endswith(".pdf") & about.rlike(L.PDF_PRIVACY) & ~about.rlike(L.PDF_REFERENCE) & ~F.col("url").rlike(L.PDF_THIRD_PARTY) & F.lower("url").rlike("^https?://"))
    return capped(first_of(rows, ["page_id", "url"], "seq"), ["page_id"], "seq", most)


def pdf_union(selected: DataFrame, found: DataFrame, most: int = 8) -> DataFrame:
    """Both sources, selected ones first, without repeats, the first `most` of each page."""
    both = selected.select("page_id", "url", F.lit(0).alias("part"), F.col("pos").alias("seq")).unionByName(found.select("page_id", "url", F.lit(1).alias("part"), "seq"))
    rows = both.withColumn("order", F.struct("part", "seq"))
    return capped(first_of(rows, ["page_id", "url"], "order"), ["page_id"], "order", most).select("page_id", "url", "part", "seq")


def first_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def capped(rows: DataFrame, key: list[str], order: str, most: int) -> DataFrame:
    """The first rows of each key: a feature of the selection, not a way around skew (Spark limits each group before the shuffle)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def link_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Links by pattern, JVM-side: key, seq, href, text."""
    pattern = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    found = F.regexp_extract_all("html", F.lit(pattern), 0)
    rows = pages.select(key, "url", F.posexplode(found).alias("seq", "a"))
    return rows.select(key, "url", "seq", F.regexp_extract("a", pattern, 1).alias("href"), F.trim(F.regexp_replace(F.regexp_extract("a", pattern, 2), "<[^>]*>", " ")).alias("text"))


def absolute(href: Column, base: Column) -> Column:
    """A cleaned reference against the page's URL (scheme, host, root and sibling references)."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def page_keys(pages: DataFrame) -> DataFrame:
    """Key under which a fetched page is kept: its path; the root of a sub-page by its category; a taken key by a suffix."""
    key = F.when(path(F.col("url")) == "/", F.concat(F.lit("/__sub_"), F.col("category"))).otherwise(path(F.col("url")))
    rows = pages.withColumn("page_key", key)
    n = F.row_number().over(Window.partitionBy("site", "page_key").orderBy("seq"))
    return rows.withColumn("page_key", F.when(n > 1, F.concat(F.lit("/__tramp_"), (n - 1).cast("string"), "page_key")).otherwise(F.col("page_key")))


def _tails(key: str) -> Column:
    """The tails of a path at its slashes, the path itself among them, "/" not."""
    places = F.filter(F.sequence(F.lit(1), F.char_length(key)), lambda i: F.substring(F.col(key), i, F.lit(1)) == "/")
    return F.filter(F.transform(places, lambda i: F.substring(F.col(key), i, F.char_length(key))), lambda t: t != "/")


def lookup(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """wanted(site, url) to the page that holds it; pages(site, page_key, seq), keys with a slash in front or whole URLs.

    The key itself first, then its path, then, with the first seq, a key that ends the path or that the path ends.  Both endings start at a slash, so they are equi
    joins on tails: of the path with keys, and of keys (an index with the first page of each tail) with the path.  Work follows the tails of paths, not the pairs of a site."""
    page = F.struct("seq", "page_key")
    by_key = pages.groupBy("site", "page_key").agg(F.min(page).alias("page")).select("site", F.col("page_key").alias("key"), "page")
    index = pages.where("page_key != '/'").select("site", "seq", "page_key", F.explode(_tails("page_key")).alias("key")).groupBy("site", "key").agg(F.min(page).alias("page"))
    asked = wanted.select("site", "url").distinct().withColumn("own", path(F.col("url")))
    tails = asked.withColumn("key", F.explode(_tails("own")))
    found = [
        asked.withColumn("key", F.col("url")).join(by_key, ["site", "key"]).withColumn("rank", F.lit(0)),
        asked.withColumn("key", F.col("own")).join(by_key, ["site", "key"]).withColumn("rank", F.lit(1)),
        tails.join(by_key, ["site", "key"]).withColumn("rank", F.lit(2)),
        asked.withColumn("key", F.col("own")).where("own != '/'").join(index, ["site", "key"]).withColumn("rank", F.lit(2)),
    ]
    best = reduce(DataFrame.unionByName, found).groupBy("site", "url").agg(F.min(F.struct("rank", "page")).alias("b"))
    return wanted.join(best.select("site", "url", "b.rank", "b.page.*"), ["site", "url"])


# --- anti-bot challenges ---


def challenges(headers: DataFrame, marks: list[tuple[str, str | None]] = L.CHALLENGE_MARKS) -> DataFrame:
    """headers(site, url, name, value) to the pages that a challenge blocked, with the marks that show it."""
    name, value = F.lower("name"), F.lower("value")
    hit = F.array_compact(F.array(*[F.when((name == n) & (F.contains(value, F.lit(v)) if v else F.lit(True)), F.lit(n)) for n, v in marks]))
    return headers.withColumn("mark", F.explode(hit)).groupBy("site", page_key(F.col("url")).alias("page_key")).agg(F.sort_array(F.collect_set("mark")).alias("marks"))


def exploded_headers(evidence: DataFrame) -> DataFrame:
    """headers MAP<url, MAP<name, value>> to rows."""
    return evidence.select("site", F.explode("headers").alias("url", "h")).select("site", "url", F.explode("h").alias("name", "value"))


def blocked(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.withColumn("page_key", page_key(F.col("url"))).join(found, ["site", "page_key"], "left_semi")


def not_blocked(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.withColumn("page_key", page_key(F.col("url"))).join(found, ["site", "page_key"], "left_anti")

