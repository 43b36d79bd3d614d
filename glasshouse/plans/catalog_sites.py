"""Queries of sources, fetch, store, custody, links and detection, over pages and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glasshouse.functions import lexicon as L
from glasshouse.functions import urls as U
from glasshouse.operators import detect as D
from glasshouse.operators import links as K
from glasshouse.operators import render as R
from glasshouse.operators import store as S
from glasshouse.operators.nearest import near_marks
from glasshouse.plans.registry import Catalog, scratch, table
from glasshouse.sources import custody as C
from glasshouse.sources import evidence as V
from glasshouse.sources import lists as I

CATALOG = Catalog()
query = CATALOG.query

_HOST = "regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\\-]*:)?(?://)?([^/?#:]*)', 1)"
_PATH = "CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) END"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", "html")


def _ranks(spark, sf) -> DataFrame:
    return _pages(spark, sf).select((F.col("page_id") + 1).cast("string").alias("rank"), U.host(F.col("url")).alias("domain"))


# --- sources ---


@query("s2_rank_list", f"SELECT 'https://' || d AS url, CASE WHEN d LIKE '%.example.com' THEN '.example.com' ELSE '.example.net' END AS tld, 'tranco' AS source_name, CAST(page_id + 1 AS INTEGER) AS rank FROM (SELECT page_id, {_HOST} AS d FROM pages) WHERE d LIKE '%.com' OR d LIKE '%.net'")
def s2(spark, sf):
    return I.ranked_domains(_ranks(spark, sf), [".com", ".net"]).select("url", "tld", "source_name", "rank")


@query("s3_suffix_filter", f"SELECT page_id FROM pages WHERE {_HOST} LIKE '%.org' OR {_HOST} LIKE '%.net'")
def s3(spark, sf):
    return _pages(spark, sf).where(U.has_suffix(U.host(F.col("url")), [".org", ".net"])).select("page_id")


@query("s6_public_suffix", f"SELECT page_id + 1 AS rank, CASE WHEN d LIKE '%.example.com' THEN '.example.com' WHEN d LIKE '%.example.net' THEN '.example.net' WHEN d LIKE '%.example.org' THEN '.example.org' ELSE '.unknown' END AS tld FROM (SELECT page_id, {_HOST} AS d FROM pages)")
def s6(spark, sf):
    listed = spark.createDataFrame([(s,) for s in L.PUBLIC_SUFFIXES], "suffix string")
    return U.with_public_suffix(_ranks(spark, sf), "domain", listed).select(F.col("rank").cast("long").alias("rank"), "tld")


_RULES = ["com", "net", "org", "*.example.com", "example.net", "!therha.example.com", "!thther.example.com"]


@query("s6_public_suffix_rules", f"""WITH h AS (SELECT DISTINCT {_HOST} AS d FROM pages), r AS (SELECT unnest({_RULES}) AS rule),
    t AS (SELECT d, unnest(range(0, len(string_split(d, '.')))) AS k, string_split(d, '.') AS ls FROM h),
    m AS (SELECT d, k, len(ls) - k AS n, left(rule, 1) = '!' AS except_ FROM t JOIN r ON rule = array_to_string(ls[k + 1:], '.') OR rule = '!' || array_to_string(ls[k + 1:], '.') OR (len(ls) - k > 1 AND rule = '*.' || array_to_string(ls[k + 2:], '.'))),
    b AS (SELECT d, CASE WHEN bool_or(except_) THEN max(CASE WHEN except_ THEN n - 1 END) ELSE max(n) END AS n FROM m GROUP BY d),
    f AS (SELECT h.d, string_split(h.d, '.') AS ls, coalesce(n, 1) AS n FROM h LEFT JOIN b USING (d))
    SELECT d AS domain, array_to_string(ls[len(ls) - n + 1:], '.') AS suffix, CASE WHEN len(ls) > n THEN array_to_string(ls[len(ls) - n:], '.') END AS registrable FROM f""")
def s6_rules(spark, sf):
    """Suffix and registrable domain of every host under rules with wildcards and exceptions."""
    hosts = _pages(spark, sf).select(U.host(F.col("url")).alias("domain")).distinct()
    return U.public_suffixes(hosts, "domain", spark.createDataFrame([(r,) for r in _RULES], "rule string")).select("domain", "suffix", "registrable")


@query("s7_listed_hosts", f"SELECT 'https://' || h AS url, arg_min(lang, page_id) AS stratum, min(page_id) AS seq FROM (SELECT page_id, {_HOST} AS h, regexp_extract(url, '//[^/]+/([a-z]+)/', 1) AS lang FROM pages) WHERE contains(h, '.') GROUP BY h")
def s7(spark, sf):
    rows = I.listed_hosts(_pages(spark, sf), F.col("url"), F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1), F.col("page_id"))
    return rows.select("url", "stratum", "seq")


@query("s8_normalise_host", f"SELECT page_id, {_HOST} AS host, regexp_replace({_HOST}, '^www\\.', '') AS base FROM pages")
def s8(spark, sf):
    return _pages(spark, sf).select("page_id", U.host(F.col("url")).alias("host"), U.base_host(F.col("url")).alias("base"))


# events as results of two runs: the halves of the month
_RESULTS = """results AS (SELECT CASE WHEN day(ts) <= 15 THEN 'r1' ELSE 'r2' END AS run_id, 'p1' AS protocol_version, 'https://u' || user_id || '.example.com' AS domain_url, event_type AS variable_name,
    CASE WHEN CAST(floor(value) AS BIGINT) % 4 = 0 THEN 'true' WHEN CAST(floor(value) AS BIGINT) % 4 = 1 THEN 'false' WHEN CAST(floor(value) AS BIGINT) % 4 = 2 THEN '"nao_aplicavel"' ELSE '"nao_coletado"' END AS value, ts AS computed_at, event_id FROM events)"""
_LATEST = f"{_RESULTS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, domain_url, variable_name ORDER BY computed_at DESC, event_id DESC) AS n FROM results) WHERE n = 1)"


def _results(spark, sf) -> DataFrame:
    kind = F.floor("value").cast("long") % 4
    return table(spark, sf, "events").select(
        F.when(F.dayofmonth("ts") <= 15, "r1").otherwise("r2").alias("run_id"), F.lit("p1").alias("protocol_version"), F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("domain_url"),
        F.col("event_type").alias("variable_name"), F.when(kind == 0, "true").when(kind == 1, "false").when(kind == 2, '"nao_aplicavel"').otherwise('"nao_coletado"').alias("value"),
        (F.col("value") % 1).alias("confidence"), F.to_json(F.struct((F.col("event_id") % 5 == 0).alias("extrapolacao"), (F.col("event_id") % 40).alias("n_segmentos_avaliados"), (F.col("event_id") % 7).alias("n_sentencas_sinalizadas"))).alias("audit_trail_json"),
        F.lit("1.0").alias("plugin_version"), F.struct("ts", "event_id").alias("computed_at"), "event_id",
    )


def _latest(spark, sf) -> DataFrame:
    rows = _results(spark, sf)
    return S.upsert(rows.where("false"), rows)


@query("s10_cohort_value", f"WITH {_LATEST} SELECT DISTINCT domain_url FROM latest WHERE run_id = 'r2' AND variable_name = 'click' AND value = 'true'")
def s10(spark, sf):
    return S.cohort_value(_latest(spark, sf).where("run_id = 'r2'"), "click", "true")


@query("s11_cohort_flag", f"WITH {_LATEST} SELECT DISTINCT domain_url FROM latest WHERE run_id = 'r1' AND variable_name = 'view' AND event_id % 5 = 0")
def s11(spark, sf):
    return S.cohort_flag(_latest(spark, sf).where("run_id = 'r1'"), "view")


@query("s12_cohort_missing", f"WITH {_LATEST} SELECT DISTINCT domain_url FROM latest WHERE run_id = 'r1' AND domain_url NOT IN (SELECT domain_url FROM latest WHERE run_id = 'r1' AND variable_name = 'purchase' AND event_id % 3 = 0)")
def s12(spark, sf):
    run = _latest(spark, sf).where("run_id = 'r1'")
    return S.cohort_missing(run.withColumn("variable_name", F.when((F.col("variable_name") != "purchase") | (F.col("event_id") % 3 == 0), F.col("variable_name")).otherwise("other")), "purchase")


@query("s13_run_change", f"WITH {_LATEST} SELECT a.domain_url, a.variable_name, a.value AS value_before, b.value AS value_after FROM latest a JOIN latest b USING (domain_url, variable_name) WHERE a.run_id = 'r1' AND b.run_id = 'r2' AND a.value <> b.value")
def s13(spark, sf):
    rows = _latest(spark, sf)
    return S.changes(rows.where("run_id = 'r1'"), rows.where("run_id = 'r2'"))


_RUNS = "runs AS (SELECT user_id AS run_id, min(ts) AS started_at, max(CASE WHEN event_type = 'purchase' THEN ts END) AS completed_at, count(*) AS sample_size FROM events GROUP BY user_id)"


@query("s14_finished_runs", f"WITH {_RUNS} SELECT run_id, sample_size FROM runs WHERE completed_at IS NOT NULL ORDER BY started_at DESC, run_id DESC LIMIT 2")
def s14(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.lit("p1").alias("protocol_version"), "ts", "event_type")
    runs = e.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("completed_at"), F.count(F.lit(1)).alias("sample_size"))
    return S.finished(runs).select("run_id", "sample_size")


@query("s15_equal_text", f"WITH {_RESULTS} SELECT event_id, trim(value, '\"') = 'nao_aplicavel' AS same FROM results")
def s15(spark, sf):
    return _results(spark, sf).select("event_id", S.equal_text(F.col("value"), F.lit(" NAO_APLICAVEL ")).alias("same"))


@query("s16_union_sources", "SELECT 'a' AS part, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT * FROM pages LIMIT 30) UNION ALL SELECT 'b', count(*), count(DISTINCT page_id) FROM pages")
def s16(spark, sf):
    p = _pages(spark, sf)
    return I.union_sources([(p.withColumn("part", F.lit("a")), 30), (p.withColumn("part", F.lit("b")), None)]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("s19_json_lines", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 0")
def s19(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k % 3 = 0")


@query("s21_package_sections", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, 'SUBPAGINA' AS kind, CAST(turn AS VARCHAR) AS name, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM conversations")
def s21(spark, sf):
    line = F.concat(F.lit("[SUBPAGINA "), F.col("turn").cast("string"), F.lit("]\n"), F.col("text"), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))
    package = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "").alias("text"))
    return V.package_sections(package).select("conv_id", "seq", "kind", "name", F.md5("body").alias("body"))


# --- fetch layer as data ---


@query("f2_robots_policy", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN event_id % 4 <> 0 WHEN event_id % 6 = 3 THEN false ELSE true END AS allowed FROM events")
def f2(spark, sf):
    k = F.col("event_id")
    status = F.when(k % 6 == 0, 200).when(k % 6 == 1, 404).when(k % 6 == 2, 301).when(k % 6 == 3, 503)
    return table(spark, sf, "events").select("event_id", D.robots_allows(status, k % 4 != 0).alias("allowed"))


@query("f3_set_cookie", "SELECT event_id, 'sid' || user_id AS name, CAST(event_id * 7919 AS VARCHAR) AS value, '/' || event_type AS path, true AS http_only, event_id % 2 = 0 AS secure FROM events")
def f3(spark, sf):
    e = table(spark, sf, "events")
    header = F.concat(F.lit("sid"), F.col("user_id").cast("string"), F.lit("="), (F.col("event_id") * 7919).cast("string"), F.lit("; Path=/"), F.col("event_type"), F.lit("; HttpOnly"), F.when(F.col("event_id") % 2 == 0, "; Secure").otherwise(""))
    c = D.cookies(header)
    return e.select("event_id", c["name"].alias("name"), c["value"].alias("value"), c["path"].alias("path"), c["httpOnly"].alias("http_only"), c["secure"].alias("secure"))


@query("f4_page_keys", f"WITH k AS (SELECT page_id, {_HOST} AS site, CASE WHEN page_id % 9 = 0 THEN '/__sub_x' ELSE '/' || regexp_extract(url, '//[^/]+/([a-z]+)/', 1) END AS k FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY site, k ORDER BY page_id) AS n FROM k) SELECT page_id, CASE WHEN n > 1 THEN '/__tramp_' || (n - 1) || k ELSE k END AS page_key FROM n")
def f4(spark, sf):
    site = U.host(F.col("url"))
    short = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("https://"), site)).otherwise(F.concat(F.lit("https://"), site, F.lit("/"), F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1)))
    rows = _pages(spark, sf).select("page_id", site.alias("site"), short.alias("url"), F.lit("x").alias("category"), F.col("page_id").alias("seq"))
    return K.page_keys(rows).select("page_id", "page_key")


@query("f6_mask_cookie", "SELECT doc_id, substring(text, 1, 8) || '...' AS value, length(text) AS value_len, substring(sha256(text), 1, 16) AS value_hash FROM documents")
def f6(spark, sf):
    m = D.mask_cookie(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", m["value"].alias("value"), m["value_len"].cast("long").alias("value_len"), m["value_hash"].alias("value_hash"))


_ATTEMPTS = "a AS (SELECT user_id AS site, event_id AS step, event_type = 'purchase' AS abort, event_type IN ('view', 'click') AS escalate FROM events), e AS (SELECT site, min(CASE WHEN abort OR NOT escalate THEN step END) AS end_step, max(step) AS last_step FROM a GROUP BY site)"


@query("f9_fallback_chain", f"WITH {_ATTEMPTS} SELECT site, step, CASE WHEN end_step IS NULL THEN 'exhausted' WHEN abort THEN 'aborted' ELSE 'accepted' END AS outcome FROM a JOIN e USING (site) WHERE step = coalesce(end_step, last_step)")
def f9(spark, sf):
    t = F.col("event_type")
    a = table(spark, sf, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("step"), (t == "purchase").alias("abort"), t.isin("view", "click").alias("escalate"))
    return D.replay_chain(a).select("site", "step", "outcome")


@query("f10_exception_match", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def f10(spark, sf):
    names = F.when(F.col("event_type") == "view", "JsRequiredError").when(F.col("event_type") == "click", "FetchTimeoutError").otherwise("ValueError")
    closure = spark.createDataFrame(D.exception_closure(), "cls string, base string").where("base = 'FetchError'")
    rows = table(spark, sf, "events").withColumn("cls", names).join(F.broadcast(closure), "cls", "left_semi")  # a handful of classes
    return rows.select("event_id", "event_type")


@query("f11_backoff", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 0.5 * pow(2, event_id % 5) ELSE 0 END AS delay FROM events")
def f11(spark, sf):
    return table(spark, sf, "events").select("event_id", D.backoff(F.col("event_id") % 5, 0.5, 2.0, 3).alias("delay"))


@query("f12_fetch_signals", "SELECT page_id, octet_length(encode(html)) < 1000 AS small, regexp_matches(html, '(?is)track\\(\\d*7\\)') AS shell FROM pages")
def f12(spark, sf):
    s = D.signals(F.col("html"), threshold=1000, markers=[r"track\(\d*7\)"])
    return _pages(spark, sf).select("page_id", s["html_root_smaller_than_bytes"].alias("small"), s["has_js_shell_markers"].alias("shell"))


@query("f13_failure_reason", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'robots_proibe' WHEN 'view' THEN 'coleta_expirou' ELSE 'coleta_falhou' END AS reason FROM events")
def f13(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "RobotsDisallowedError").when(F.col("event_type") == "view", "FetchTimeoutError").otherwise("FetchError")
    return table(spark, sf, "events").select("event_id", D.failure_reason(kind).alias("reason"))


# --- store and custody ---


@query("r4_manifest_audit", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 10 <> 0 AND doc_id % 17 <> 0) AS verified, count(*) FILTER (WHERE doc_id % 10 = 0) AS missing, count(*) FILTER (WHERE doc_id % 10 <> 0 AND doc_id % 17 = 0) AS corrupted, true AS chain_valid, false AS all_valid FROM documents")
def r4(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    manifest = d.select(name.alias("tar_filename"), F.sha2(F.col("text"), 256).alias("sha256"))
    files = V.with_digest(d.where("doc_id % 10 != 0").select(name.alias("tar_filename"), F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")))
    log = spark.range(3).select(F.col("id").alias("line_no"), F.lit("abc").alias("manifest_sha256"))
    return V.audit_manifest(manifest, files, log, "abc")


@query("r3_verified_only", "SELECT CAST(doc_id AS VARCHAR) AS tar_filename, sha256(text) AS sha256 FROM documents WHERE doc_id % 17 <> 0")
def r3(spark, sf):
    d = table(spark, sf, "documents")
    name = F.col("doc_id").cast("string")
    manifest = d.select(name.alias("tar_filename"), F.sha2(F.col("text"), 256).alias("sha256"))
    files = V.with_digest(d.select(name.alias("tar_filename"), F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))).drop("content")
    return V.verified_only(manifest, files).select("tar_filename", "sha256")


@query("r5_slug", "SELECT page_id, substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 1, 80) AS slug FROM pages")
def r5(spark, sf):
    return _pages(spark, sf).select("page_id", V.slug(F.col("url")).alias("slug"))


@query("r7_upsert_last_wins", f"WITH {_LATEST} SELECT run_id, domain_url, variable_name, value, event_id FROM latest")
def r7(spark, sf):
    rows = _results(spark, sf)
    return S.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")).select("run_id", "domain_url", "variable_name", "value", "event_id")


@query("r8_result_filter", f"WITH {_LATEST} SELECT domain_url, value, event_id FROM latest WHERE run_id = 'r1' AND variable_name = 'view'")
def r8(spark, sf):
    return S.query(_latest(spark, sf), {"run_id": "r1", "variable_name": "view", "nonsense": "x"}).select("domain_url", "value", "event_id")


@query("r6_scoped_store", f"WITH {_LATEST} SELECT run_id, domain_url, variable_name, value, event_id FROM latest WHERE variable_name = 'view'")
def r6(spark, sf):
    """Three writes of a table in files, the last of one run only, and a lookup by variable."""
    from glasshouse.plans.registry import scratch
    from glasshouse.sources.results import ResultTable

    rows, store = _results(spark, sf), ResultTable(spark, scratch(spark, "results"))
    store.upsert(rows.where("event_id % 2 = 0"))
    store.upsert(rows.where("event_id % 2 = 1 AND run_id = 'r1'"))
    store.upsert(rows.where("event_id % 2 = 1 AND run_id = 'r2'"))
    return store.lookup({"variable_name": "view"}).select("run_id", "domain_url", "variable_name", "value", "event_id")


@query("r9_runs", "SELECT user_id AS run_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(CASE WHEN event_type = 'purchase' THEN ts END), '%Y-%m-%d %H:%M:%S') AS completed, CAST(max(event_id) AS BIGINT) AS sample_size FROM events GROUP BY user_id")
def r9(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.lit("p").alias("protocol_version"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("completed_at"), F.col("event_id").alias("sample_size"), F.lit(0).alias("errors_count"))
    return S.runs(e).select("run_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed"), "sample_size")


@query("r10_json_value", f"WITH {_RESULTS} SELECT event_id, trim(value, '\"') AS plain, value AS again FROM results")
def r10(spark, sf):
    v = F.col("value")
    return _results(spark, sf).select("event_id", S.decoded(v).alias("plain"), S.encoded(S.decoded(v)).alias("again"))


@query("r11_publish_manifest", "SELECT 'm' || (event_id % 3) AS file, count(*) AS n_lines FROM events GROUP BY 1")
def r11(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("file"), F.col("props").alias("line"), F.col("event_id").alias("line_no"))
    return V.publishable(rows).select("file", "n_lines")


@query("r12_sequence_digest", "SELECT conv_id, sha256(unhex(string_agg(hex(encode(text)) || '00', '' ORDER BY turn))) AS digest FROM conversations GROUP BY conv_id")
def r12(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(V.sequence_digest(F.col("text"), F.col("turn")).alias("digest"))


@query("r13_directory_digest", "SELECT source AS dir, sha256(unhex(string_agg(hex(encode(CAST(doc_id AS VARCHAR))) || '00' || hex(encode(sha256(text))), '' ORDER BY CAST(doc_id AS VARCHAR)))) AS sha256 FROM documents GROUP BY source")
def r13(spark, sf):
    files = table(spark, sf, "documents").select(F.col("source").alias("dir"), F.col("doc_id").cast("string").alias("name"), F.sha2(F.col("text"), 256).alias("actual_sha256"))
    return V.directory_digest(files)


@query("r15_enrichment_pending", f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id FROM h WHERE host NOT IN (SELECT host FROM h WHERE page_id % 10 = 0)")
def r15(spark, sf):
    m = _pages(spark, sf).select("page_id", U.host(F.col("url")).alias("host"))
    return V.pending(m, m.where("page_id % 10 = 0")).select("page_id")


# --- links ---

_LINKS = r"""a AS (SELECT page_id, url, unnest(x) AS a, generate_subscripts(x, 1) - 1 AS seq FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>') AS x FROM pages)),
    l AS (SELECT page_id, url, seq, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href, trim(regexp_replace(regexp_extract(a, '(?is)>(.*?)</a>', 1), '<[^>]*>', ' ', 'g')) AS text FROM a)"""


@query("l0_link_rows", f"WITH {_LINKS} SELECT page_id, CAST(seq AS INTEGER) AS seq, href, text FROM l")
def l0(spark, sf):
    return K.link_rows(_pages(spark, sf)).select("page_id", "seq", "href", "text")


@query("l1_link_candidates", f"WITH {_LINKS}, c AS (SELECT page_id, seq, 'articles' AS category, href FROM l WHERE regexp_matches(text, '(?i)^the') UNION ALL SELECT page_id, seq, 'others', href FROM l WHERE regexp_matches(text, '(?i)tion')), d AS (SELECT *, row_number() OVER (PARTITION BY page_id, category, href ORDER BY seq) AS f FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY page_id, category ORDER BY seq) AS n FROM d WHERE f = 1) SELECT page_id, category, CAST(n - 1 AS INTEGER) AS pos, href FROM n WHERE n <= 2")
def l1(spark, sf):
    return _capped(spark, sf)


def _capped(spark, sf) -> DataFrame:
    """The same selection declaratively: one row a category and first place of a link, the first two of each."""
    rows = K.link_rows(_pages(spark, sf))
    cats = F.array_compact(F.array(F.when(F.col("text").rlike("(?i)^the"), "articles"), F.when(F.col("text").rlike("(?i)tion"), "others")))
    c = rows.select("page_id", "seq", "href", F.explode(cats).alias("category"))
    first = K.first_of(c, ["page_id", "category", "href"], "seq")
    n = F.row_number().over(Window.partitionBy("page_id", "category").orderBy("seq"))
    return first.withColumn("n", n).where("n <= 2").select("page_id", "category", (F.col("n") - 1).alias("pos"), "href")


def _selected(categories: dict[str, tuple[str, str]], blockers: str, per_category: int, total: int, via: str) -> str:
    """The selection as a fold over the matches of each page, in SQL; categories with their pattern and how SQL writes it."""
    cats = " UNION ALL ".join(
        f"SELECT page_id, seq, {i} AS c, '{c}' AS category, u, '{shown}' AS pattern, CASE WHEN regexp_matches(text, '(?i){p}') THEN 'text' ELSE 'href' END AS source, left(CASE WHEN text <> '' THEN text ELSE href END, 120) AS snippet FROM ok WHERE regexp_matches(text, '(?i){p}') OR regexp_matches(href, '(?i){p}')"
        for i, (c, (shown, p)) in enumerate(categories.items()))
    return f"""WITH RECURSIVE {_LINKS}, ok AS (SELECT *, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href AS u FROM l WHERE href <> ''),
    m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq, c) AS i FROM ({cats}) WHERE {blockers}),
    f AS (
        SELECT page_id, 0::BIGINT AS i, []::STRUCT(category VARCHAR, url VARCHAR)[] AS kept, NULL::VARCHAR AS category, NULL::INTEGER AS pos, NULL::VARCHAR AS url, NULL::VARCHAR AS pattern, NULL::VARCHAR AS source, NULL::VARCHAR AS snippet FROM (SELECT DISTINCT page_id FROM m)
        UNION ALL
        SELECT page_id, i, CASE WHEN takes THEN list_append(kept, {{'category': cat, 'url': u}}) ELSE kept END, CASE WHEN takes THEN cat END, n::INTEGER, u, pattern, source, snippet
        FROM (
            SELECT m.page_id, m.i, f.kept, m.category AS cat, m.u, m.pattern, m.source, m.snippet, len(list_filter(f.kept, lambda k: k.category = m.category)) AS n,
                len(list_distinct(list_transform(f.kept, lambda k: k.url))) < {total} AND len(list_filter(f.kept, lambda k: k.category = m.category)) < {per_category} AND len(list_filter(f.kept, lambda k: k.category = m.category AND k.url = m.u)) = 0 AS takes
            FROM f JOIN m ON m.page_id = f.page_id AND m.i = f.i + 1))
    SELECT page_id, category, pos, url, pattern AS matched_pattern, source AS matched_against, snippet, {via} AS discovered_via FROM f WHERE category IS NOT NULL"""


_UNBLOCKED = "NOT (" + " OR ".join(f"regexp_matches(u, '(?i){b}')" for b in L.PATH_BLOCKERS) + ")"


@query("l1_link_candidates_ordered", _selected({"articles": ("^the", "^the"), "others": ("tion", "tion")}, _UNBLOCKED, 2, 3, "NULL::VARCHAR"))
def l1_ordered(spark, sf):
    return K.candidates(_pages(spark, sf), {"articles": [r"^the"], "others": [r"tion"]}, L.PATH_BLOCKERS, per_category=2, total=3)


@query("l3_second_level", _selected({"others": (r"\w", r"[\p{L}\p{M}\p{N}_]")}, "true", 2, 3, "'menu'"))
def l3(spark, sf):
    """On the page's own host only, as every link of these pages is."""
    return K.candidates(_pages(spark, sf), {"others": [r"\w"]}, [], via="menu", total=3, same_host=frozenset({"others"}))


@query("l6_pdf_links", f"WITH {_LINKS}, u AS (SELECT page_id, seq, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href AS u, text FROM l WHERE regexp_matches(text, '(?i)^(the|of)') AND NOT regexp_matches(text, '(?i)tion')), d AS (SELECT *, row_number() OVER (PARTITION BY page_id, u ORDER BY seq) AS f FROM u), n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS n FROM d WHERE f = 1) SELECT page_id, u AS url FROM n WHERE n <= 2")
def l6(spark, sf):
    rows = K.link_rows(_pages(spark, sf)).select("page_id", "seq", K.absolute(K.clean_href(F.col("href")), F.col("url")).alias("url"), "text")
    ok = rows.where(F.col("text").rlike("(?i)^(the|of)") & ~F.col("text").rlike("(?i)tion"))
    return K.capped(K.first_of(ok, ["page_id", "url"], "seq"), ["page_id"], "seq", 2).select("page_id", "url")


_PDFS = f"{_LINKS}, sel AS (SELECT page_id, seq AS pos, 'https://s/' || page_id || '/' || (seq % 3) || '.pdf' AS u FROM l), s1 AS (SELECT page_id, u, min(pos) AS pos FROM sel GROUP BY ALL)"


def _selection(spark, sf) -> DataFrame:
    rows = K.link_rows(_pages(spark, sf))
    url = F.concat(F.lit("https://s/"), F.col("page_id").cast("string"), F.lit("/"), (F.col("seq") % 3).cast("string"), F.lit(".pdf"))
    return rows.select("page_id", F.lit("politica_privacidade").alias("category"), F.col("seq").alias("pos"), url.alias("url"))


@query("l5_pdf_selection", f"WITH {_PDFS} SELECT page_id, u AS url, CAST(pos AS INTEGER) AS pos FROM s1")
def l5(spark, sf):
    return K.pdf_from_selection(_selection(spark, sf)).select("page_id", "url", "pos")


@query("l8_pdf_union", f"WITH {_PDFS}, f AS (SELECT page_id, 'https://s/' || page_id || '/' || (seq % 4) || '.pdf' AS u, min(seq) AS seq FROM l GROUP BY 1, 2), b AS (SELECT page_id, u, 0 AS part, pos AS seq FROM s1 UNION ALL SELECT page_id, u, 1, seq FROM f), d AS (SELECT *, row_number() OVER (PARTITION BY page_id, u ORDER BY part, seq) AS n FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, seq) AS k FROM d WHERE n = 1) SELECT page_id, u AS url FROM o WHERE k <= 3")
def l8(spark, sf):
    url = F.concat(F.lit("https://s/"), F.col("page_id").cast("string"), F.lit("/"), (F.col("seq") % 4).cast("string"), F.lit(".pdf"))
    found = K.first_of(K.link_rows(_pages(spark, sf)).select("page_id", "seq", url.alias("url")), ["page_id", "url"], "seq")
    return K.pdf_union(K.pdf_from_selection(_selection(spark, sf)), found, 3).select("page_id", "url")


@query("l7_clean_href", "SELECT page_id, '/a/b/' || page_id AS href FROM pages")
def l7(spark, sf):
    bad = F.concat(F.lit("///a\\b\\\\"), F.col("page_id").cast("string"))
    return _pages(spark, sf).select("page_id", K.clean_href(bad).alias("href"))


@query("l10_header_marks", f"SELECT {_HOST} AS site, regexp_replace({_HOST}, '^www\\.', '') || regexp_replace(lower({_PATH}), '/+$', '') AS page_key, ['cf-mitigated'] AS marks FROM pages WHERE page_id % 6 = 0 GROUP BY ALL")
def l10(spark, sf):
    p = _pages(spark, sf).withColumn("h", F.create_map(F.lit("Server"), F.lit("cloudflare"), F.when(F.col("page_id") % 6 == 0, "CF-Mitigated").otherwise("x-datadome-cid"), F.lit("Challenge")))
    rows = K.exploded_headers(p.select(U.host(F.col("url")).alias("site"), F.create_map("url", "h").alias("headers")))
    return K.challenges(rows)


@query("l11_url_key", f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') || regexp_replace(lower({_PATH}), '/+$', '') AS page_key FROM pages")
def l11(spark, sf):
    return _pages(spark, sf).select("page_id", U.page_key(F.col("url")).alias("page_key"))


_KEYED = f"k AS (SELECT page_id, {_HOST} AS site, regexp_replace({_HOST}, '^www\\.', '') || regexp_replace(lower({_PATH}), '/+$', '') AS page_key FROM pages)"


@query("l12_blocked_semi_anti", f"WITH {_KEYED} SELECT page_id, page_key IN (SELECT page_key FROM k WHERE page_id % 6 = 0) AS blocked FROM k")
def l12(spark, sf):
    p = _pages(spark, sf).withColumn("site", U.host(F.col("url")))
    found = p.where("page_id % 6 = 0").select("site", U.page_key(F.col("url")).alias("page_key"))
    return K.blocked(p, found).select("page_id", F.lit(True).alias("blocked")).unionByName(K.not_blocked(p, found).select("page_id", F.lit(False).alias("blocked")))


_LAST = f"'/' || regexp_extract({_PATH}, '([^/]*)/*$', 1)"


@query("l13_suffix_lookup", f"""WITH k AS (SELECT page_id, {_HOST} AS site, {_PATH} AS p, {_LAST} AS w FROM pages), a AS (SELECT DISTINCT site, w FROM k),
    n AS (SELECT a.site, a.w AS wanted, b.page_id AS found, row_number() OVER (PARTITION BY a.site, a.w ORDER BY CASE WHEN b.p = a.w THEN 1 ELSE 2 END, b.page_id) AS n FROM a JOIN k b ON a.site = b.site AND (b.p = a.w OR (a.w <> '/' AND b.p <> '/' AND (ends_with(a.w, b.p) OR ends_with(b.p, a.w)))))
    SELECT site, wanted, found FROM n WHERE n = 1""")
def l13(spark, sf):
    """Every page is looked for by the last step of its path, among all pages of its site."""
    site, last = U.host(F.col("url")), F.concat(F.lit("/"), F.regexp_extract(U.path(F.col("url")), "([^/]*)/*$", 1))
    wanted = _pages(spark, sf).select(site.alias("site"), F.concat(F.lit("https://x"), last).alias("url")).distinct()
    pages = _pages(spark, sf).select(site.alias("site"), U.path(F.col("url")).alias("page_key"), F.col("page_id").alias("seq"))
    return K.lookup(wanted, pages).select("site", F.substring("url", F.lit(10), F.char_length("url")).alias("wanted"), F.col("seq").alias("found"))


@query("l15_same_domain", f"SELECT page_id, {_HOST} = 'therha.example.com' OR ends_with({_HOST}, '.example.com') AS below, NOT ({_HOST} LIKE '%.example.net') AS own FROM pages")
def l15(spark, sf):
    h = U.host(F.col("url"))
    return _pages(spark, sf).select("page_id", (U.same_domain(h, F.lit("example.com"))).alias("below"), (~U.below_any(h, ["example.net"])).alias("own"))


@query("l16_infrastructure_filter", f"SELECT page_id FROM pages WHERE NOT (contains({_HOST}, 'casino') OR regexp_matches(string_split({_HOST}, '.')[1], '^(m|blog)$'))")
def l16(spark, sf):
    return I.without_hosts(_pages(spark, sf).withColumn("h", U.host(F.col("url"))), "h", ["casino"], "^(m|blog)$").select("page_id")


@query("l17_public_administration", f"SELECT CASE WHEN regexp_matches(h, '\\.(gov|jus|mp|def|leg)\\.br$') THEN 'adm_publica' ELSE 'outros' END AS kind, count(*) AS n FROM (SELECT CASE WHEN page_id % 4 = 0 THEN replace({_HOST}, '.example.com', '.gov.br') ELSE {_HOST} END AS h FROM pages) GROUP BY 1")
def l17(spark, sf):
    h = F.when(F.col("page_id") % 4 == 0, F.replace(U.host(F.col("url")), F.lit(".example.com"), F.lit(".gov.br"))).otherwise(U.host(F.col("url")))
    return _pages(spark, sf).groupBy(I.public_administration(h).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- detection ---


@query("v2_banner", None)
def v2(spark, sf):
    b = D.banner(F.replace("html", F.lit('class="ad"'), F.lit('class="cookie-bar" id="consent"')), F.lit(False))
    return _pages(spark, sf).select("page_id", b.alias("b")).select("page_id", "b.*")


_SITES = f"p AS (SELECT page_id, {_HOST} AS site, html, {_PATH} AS page_key FROM pages)"


@query("v5_policy_ladder", f"""WITH {_SITES}, w AS (SELECT site, page_id, (contains(lower(html), 'tionble'))::INT + (contains(lower(html), 'thwh'))::INT + (contains(lower(html), 'oner'))::INT AS words FROM p WHERE octet_length(encode(html)) >= 500),
    r AS (SELECT site, page_id, CASE WHEN words >= 3 THEN 3 WHEN words >= 1 AND page_id % 3 = 0 THEN 1 END AS level FROM w), b AS (SELECT site, max(level) AS level FROM r GROUP BY site), s AS (SELECT DISTINCT site FROM p)
    SELECT site, CASE WHEN level IS NULL THEN 'false' ELSE 'true' END AS state, CASE WHEN level = 3 THEN 0.95 WHEN level = 1 THEN 0.65 ELSE 0.95 END AS confidence FROM s LEFT JOIN b USING (site)""")
def v5(spark, sf):
    p = _pages(spark, sf).select("page_id", U.host(F.col("url")).alias("site"), F.concat(F.lit("https://x/p"), F.col("page_id").cast("string")).alias("url"), F.col("html").alias("body"))
    pages = p.select("site", F.concat(F.lit("/p"), F.col("page_id").cast("string")).alias("page_key"), F.col("page_id").alias("seq"), "body")
    selection = p.select("site", F.col("page_id").alias("pos"), "url", F.when(F.col("page_id") % 3 == 0, "strong").otherwise(L.WEAK_POLICY_PATTERNS[0]).alias("matched_pattern"))
    sites = p.select("site").distinct().withColumn("root_bytes", F.lit(1))
    # exact keys only: a path that merely ends alike belongs to another page here
    exact = pages.join(selection.select("site", F.regexp_extract("url", "(/p[0-9]+)$", 1).alias("page_key")), ["site", "page_key"], "left_semi")
    return D.policy(sites, selection, exact, None, ["tionble", "thwh", "oner"]).select("site", "state", "confidence")


@query("v7_rule_channel", f"WITH {_SITES} SELECT site, CASE WHEN bool_or(regexp_matches(html, '(?i)[^a-z0-9._%+-](dpo|privacidade)[a-z0-9._%+-]*@[a-z0-9.-]+\\.(com|net|org)')) THEN 'true' ELSE 'false' END AS state FROM (SELECT site, html || CASE WHEN page_id % 12 = 0 THEN ' dpo@x.com ' WHEN page_id % 7 = 0 THEN ' ana@x.com ' ELSE '' END AS html FROM p) GROUP BY site")
def v7(spark, sf):
    extra = F.when(F.col("page_id") % 12 == 0, " dpo@x.com ").when(F.col("page_id") % 7 == 0, " ana@x.com ").otherwise("")
    pages = _pages(spark, sf).select(U.host(F.col("url")).alias("site"), F.lit("/").alias("page_key"), F.concat("html", extra).alias("body"))
    return D.rule_channel(pages, pages.where("false").select("site", "body"), prefixes=["dpo", "privacidade"]).select("site", "state")


@query("v8_channel_features", None)
def v8(spark, sf):
    page = F.concat("html", F.when(F.col("page_id") % 3 == 0, "<p>Encarregado: dpo@site.com.br, exerca seus direitos</p>").otherwise(""))
    f = D.channel_features_udf(page, F.lit("https://site.com.br"), F.array(F.lit("encarregado")), F.lit(""))
    return _pages(spark, sf).select("page_id", f.alias("f")).select("page_id", "f.*")


@query("v9_proximity_join", "SELECT a.event_id FROM events a WHERE a.event_type = 'view' AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND abs(b.event_id - a.event_id) <= 200)")
def v9(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("at"), "event_type")
    return D.within(e.where("event_type = 'view'").select("site", "at"), e.where("event_type = 'purchase'").select("site", "at"), 200).select(F.col("at").alias("event_id"))


_MARKS = {"form": r"(?i)<form\b", "address": r"[a-z0-9.]+@[a-z0-9.]+", "phone": r"\d\d[0-9 .-]*\d\d", "link": r"(?i)<a "}
_PLACES = " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, string_split_regex(html, '{p}') AS gaps, regexp_extract_all(html, '{p}') AS found FROM pages" for k, p in (_MARKS | {"": "(?i)tion"}).items())


@query("v9_nearest_marks", f"""WITH x AS ({_PLACES}), s AS (SELECT page_id, kind, unnest(range(1, len(found) + 1)) AS i, gaps, found FROM x),
    m AS (SELECT page_id, kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS at FROM s),
    d AS (SELECT p.page_id, p.kind, p.at, min(abs(a.at - p.at)) AS distance FROM m p LEFT JOIN m a ON a.page_id = p.page_id AND a.kind = '' WHERE p.kind <> '' GROUP BY ALL)
    SELECT page_id, kind, count(*) AS n, count(*) FILTER (WHERE distance <= 200) AS near, CAST(min(distance) AS BIGINT) AS distance FROM d GROUP BY page_id, kind""")
def v9_marks(spark, sf):
    """How near forms, addresses, phone numbers and links stand to a word of interest, in the markup of each page."""
    return near_marks(_pages(spark, sf), "page_id", "html", _MARKS, "(?i)tion", 200)


def _eta(names: list[str]) -> str:
    c = L.CHANNEL_COEFFICIENTS
    return f"({c['intercept']!r} + " + " + ".join(f"({c[f'F{i}']!r}) * {n}" for i, n in enumerate(names, 1)) + ")"


_BITS = [f"((doc_id // {2**i}) % 2)" for i in range(8)]


@query("v10_channel_score", f"SELECT doc_id, round(1 / (1 + exp(-({_eta(_BITS)}))), 9) AS p, 1 / (1 + exp(-({_eta(_BITS)}))) >= 0.5 AS present FROM documents")
def v10(spark, sf):
    from glasshouse.operators.score import channel_probability

    p = channel_probability({f"F{i + 1}": F.floor(F.col("doc_id") / 2**i) % 2 for i in range(8)})
    return table(spark, sf, "documents").select("doc_id", F.round(p, 9).alias("p"), (p >= 0.5).alias("present"))


@query("v14_confidence", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.65 WHEN 2 THEN 0.35 ELSE 0.0 END AS confidence FROM events")
def v14(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "unknown")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", D.confidence(name).cast("double").alias("confidence"))


@query("v15_email_form", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'email_lgpd_controlador' WHEN event_id % 3 <> 0 THEN 'email_grupo_controlador' WHEN event_id % 2 <> 0 AND event_id % 5 = 0 THEN 'email_generico_rotulado' ELSE '(ambiguo - decidir manualmente)' END AS form FROM events")
def v15(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", D.email_form(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("form"))


# --- dependencies, failed sites, outputs ---

_STATES = """base AS (SELECT doc_id AS site, 'quality' AS variable_name, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS state FROM labels WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'quality', 'nao_coletado' FROM labels WHERE doc_id % 7 = 0
    UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END FROM labels),
    resolved AS (SELECT b.site, b.variable_name, CASE WHEN b.variable_name = 'toxic' AND q.state = 'nao_coletado' THEN 'nao_coletado' WHEN b.variable_name = 'toxic' AND q.state <> 'true' THEN 'nao_aplicavel' ELSE b.state END AS state,
    CASE WHEN b.variable_name = 'toxic' AND q.state = 'nao_coletado' THEN 'dependencia_nao_coletada' WHEN b.variable_name = 'toxic' AND q.state <> 'true' THEN 'precondicao_nao_satisfeita' END AS reason
    FROM base b LEFT JOIN base q ON q.site = b.site AND q.variable_name = 'quality')"""


def _states(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels")
    value = lambda c: F.when(F.col(c) == 1, "true").otherwise("false")
    q = lab.select(F.col("doc_id").alias("site"), F.lit("quality").alias("variable_name"), F.when(F.col("doc_id") % 7 == 0, "nao_coletado").otherwise(value("quality")).alias("state"))
    t = lab.select(F.col("doc_id").alias("site"), F.lit("toxic").alias("variable_name"), value("toxic").alias("state"))
    rows = q.unionByName(t).withColumns({"confidence": F.lit(0.95), "reason": F.lit(None).cast("string")})
    return S.resolve(rows, spark.createDataFrame([("toxic", "quality")], "variable_name string, depends_on string"))


@query("v16_dependency_states", f"WITH {_STATES} SELECT site, variable_name, state, reason FROM resolved")
def v16(spark, sf):
    return _states(spark, sf).select("site", "variable_name", "state", "reason")


@query("v17_uncollected_fill", "SELECT d.doc_id AS site, v.variable_name, 'nao_coletado' AS state FROM documents d CROSS JOIN (VALUES ('quality'), ('toxic')) v(variable_name) LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def v17(spark, sf):
    found = table(spark, sf, "labels").select(F.col("doc_id").alias("site"), F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("variable_name"))
    return S.fill_uncollected(table(spark, sf, "documents").select(F.col("doc_id").alias("site")), ["quality", "toxic"], found).select("site", "variable_name", "state")


def _rendered(spark, sf) -> DataFrame:
    s = _states(spark, sf)
    return s.select(F.concat(F.lit("https://d"), F.col("site").cast("string"), F.lit(".com/")).alias("domain_url"), "variable_name", S.encoded(F.col("state")).alias("value"), "confidence", F.to_json(F.struct(F.col("reason").alias("motivo"))).alias("audit_trail_json"), F.lit("r").alias("run_id"), F.lit("p").alias("protocol_version"), F.lit("1").alias("plugin_version"), F.lit(0).alias("computed_at"))


@query("w1_triage_wide", f"""WITH {_STATES}, w AS (SELECT 'd' || site || '.com' AS dominio, max(CASE WHEN variable_name = 'quality' THEN state END) AS quality, max(CASE WHEN variable_name = 'toxic' THEN state END) AS toxic, max(reason) AS motivo,
    count(*) FILTER (WHERE state = 'false') AS n_sinais_ausentes, count(*) FILTER (WHERE state = 'nao_aplicavel') AS n_nao_aplicavel, count(*) FILTER (WHERE state = 'nao_coletado') AS n_nao_coletado FROM resolved GROUP BY site)
    SELECT *, CAST(row_number() OVER (ORDER BY CAST(n_nao_coletado > 0 AS INT), n_nao_aplicavel DESC, n_sinais_ausentes DESC, dominio) AS INTEGER) AS ordem FROM w""")
def w1(spark, sf):
    rows = R.wide_rows(_rendered(spark, sf), ["quality", "toxic"])
    return rows.select("dominio", "quality", "toxic", "motivo", *[F.col(c).cast("long").alias(c) for c in ("n_sinais_ausentes", "n_nao_aplicavel", "n_nao_coletado")], "ordem")


@query("o1_long_csv", "SELECT 'r1' AS run_id, event_id, CAST(event_id % 7 AS VARCHAR) AS flagged, CASE WHEN event_id % 40 > 0 THEN round((event_id % 7) / (event_id % 40), 6) END AS density FROM events WHERE day(ts) <= 15")
def o1(spark, sf):
    rows = _results(spark, sf).where("run_id = 'r1'").withColumn("domain_url", F.col("event_id").cast("string"))
    long = R.typed_rows(rows)
    return long.select("run_id", F.col("domain_url").cast("long").alias("event_id"), F.col("n_sentencas_sinalizadas").cast("string").alias("flagged"), F.col("densidade_sinalizacao").alias("density"))


@query("o3_evidence_sentences", "SELECT doc_id, 1 AS posicao, md5(text) AS digest FROM documents WHERE n_chars > 1000")
def o3(spark, sf):
    """Texts above a threshold are the flagged ones; the audit trail of the others has none."""
    d = table(spark, sf, "documents")
    audit = F.when(F.col("n_chars") > 1000, F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("posicao"), F.lit(0.5).alias("escore"), F.col("text").alias("texto"))).alias("sentencas"))))
    rows = d.select(F.col("doc_id").cast("string").alias("domain_url"), F.lit("v").alias("variable_name"), F.lit("r").alias("run_id"), audit.alias("audit_trail_json"))
    return R.evidence_rows(rows).select(F.col("domain_url").cast("long").alias("doc_id"), "posicao", F.md5("texto").alias("digest"))


@query("o5_nested_json", f"WITH {_STATES} SELECT 'd' || site || '.com' AS dominio, variable_name, state AS valor, reason AS motivo FROM resolved")
def o5(spark, sf):
    """The objects taken apart again."""
    nested = F.from_json("json", "map<string, struct<valor: string, confianca: double, motivo: string>>")
    return R.nested_rows(_rendered(spark, sf)).select("dominio", F.explode(nested).alias("variable_name", "v")).select("dominio", "variable_name", "v.valor", "v.motivo")


@query("o4_typed_parquet", f"WITH {_LATEST} SELECT run_id, domain_url, variable_name, trim(value, '\"') AS value, CAST(event_id % 7 AS BIGINT) AS n_sentencas_sinalizadas, CAST(event_id % 40 AS BIGINT) AS n_segmentos_avaliados, CASE WHEN event_id % 40 > 0 THEN round((event_id % 7) / (event_id % 40), 6) END AS densidade_sinalizacao FROM latest")
def o4(spark, sf):
    typed = R.typed_rows(_latest(spark, sf).withColumn("computed_at", F.col("computed_at.ts")))
    return typed.select("run_id", "domain_url", "variable_name", "value", "n_sentencas_sinalizadas", "n_segmentos_avaliados", "densidade_sinalizacao")


@query(
    "o6_render_outputs",
    f"""WITH {_STATES}, n AS (SELECT count(*) AS all_rows, count(DISTINCT site) AS sites FROM resolved)
    SELECT 'csv' AS output, all_rows AS n FROM n UNION ALL SELECT 'csv_largo', sites FROM n UNION ALL SELECT 'json', sites FROM n UNION ALL SELECT 'parquet', all_rows FROM n UNION ALL SELECT 'unknown', -1""",
)
def o6(spark, sf):
    """Every output is written and read again; one that is not known fails alone."""
    places = {n: scratch(spark, f"o6-{n}") for n in ("csv", "csv_largo", "json", "parquet")}
    done = R.render(_rendered(spark, sf), [{"name": n, "params": {"path": p, "variables": ["quality", "toxic"]}} for n, p in places.items()] + [{"name": "unknown"}])
    readers = {"csv": lambda p: spark.read.option("header", True).option("sep", ";").csv(p), "csv_largo": lambda p: spark.read.option("header", True).option("sep", ";").csv(p), "json": spark.read.text, "parquet": spark.read.parquet}
    counts = [readers[n](p).agg(F.lit(n).alias("output"), F.count(F.lit(1)).alias("n")) for n, p in places.items() if done[n] is None]
    failed = spark.createDataFrame([(n, -1) for n, e in done.items() if e is not None], "output string, n long")
    return reduce(DataFrame.unionByName, counts, failed)


@query("o2_wide_csv", f"""WITH {_STATES}, w AS (SELECT 'd' || site || '.com' AS dominio, max(CASE WHEN variable_name = 'quality' THEN state END) AS quality, max(CASE WHEN variable_name = 'toxic' THEN state END) AS toxic,
    count(*) FILTER (WHERE state = 'false') AS a, count(*) FILTER (WHERE state = 'nao_aplicavel') AS b, count(*) FILTER (WHERE state = 'nao_coletado') AS c FROM resolved GROUP BY site)
    SELECT dominio, quality, toxic, CAST(row_number() OVER (ORDER BY CAST(c > 0 AS INT), b DESC, a DESC, dominio) AS BIGINT) AS ordem FROM w""")
def o2(spark, sf):
    path = scratch(spark, "o2")
    R.write_wide(_rendered(spark, sf), {"path": path, "variables": ["quality", "toxic"]})
    return spark.read.option("header", True).option("sep", ";").csv(path).select("dominio", "quality", "toxic", F.col("ordem").cast("long").alias("ordem"))


@query("s20_archive_pages", "SELECT page_id, md5(html) AS digest FROM pages")
def s20(spark, sf):
    """Every page packed into an archive of its own and read back."""
    import io
    import tarfile

    import pandas as pd

    def packed(batches):
        for b in batches:
            out = []
            for key, page in zip(b["page_id"], b["html"], strict=True):
                data = (page or "").encode()
                buffer = io.BytesIO()
                with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
                    info = tarfile.TarInfo("pages/root.html")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                out.append((f"t{key}", buffer.getvalue()))
            yield pd.DataFrame(out, columns=["tar_filename", "content"])

    archives = _pages(spark, sf).select("page_id", "html").mapInPandas(packed, "tar_filename string, content binary")
    rows = V.archive_pages(archives)
    return rows.select(F.substring("tar_filename", F.lit(2), F.lit(30)).cast("long").alias("page_id"), F.md5("body").alias("digest"))


_SITE_DIGESTS = f"""
    SELECT h AS domain_url, sum(n)::BIGINT AS n_pages, sha256(string_agg(low, '' ORDER BY leaf)) AS sha256 FROM (
        SELECT h, page_id // {C.LEAF} AS leaf, count(*) AS n, sha256(string_agg(sha256(url) || sha256(coalesce(html, '')), '' ORDER BY page_id)) AS low
        FROM (SELECT page_id, url, html, {_HOST} AS h FROM pages) GROUP BY h, page_id // {C.LEAF}) GROUP BY h"""


def _put(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    rows = _pages(spark, sf).select(U.host(F.col("url")).alias("domain_url"), F.col("page_id").alias("seq"), F.col("url").alias("page_key"), F.col("html").alias("body"))
    return C.put(spark, rows, folder, "r1", "p1")


@query("r1_custody_put", _SITE_DIGESTS)
def r1(spark, sf):
    """Every page stored, and the entries of the manifest."""
    return _put(spark, sf, scratch(spark, "r1")).select("domain_url", "n_pages", "sha256")


@query("r2_custody_get", f"SELECT {_HOST} AS domain_url, page_id AS seq, md5(coalesce(html, '')) AS digest FROM pages")
def r2(spark, sf):
    """Every page stored, found by its entry, verified and read back."""
    folder = scratch(spark, "r2")
    return C.get(spark, folder, _put(spark, sf, folder)).select("domain_url", "seq", F.md5("body").alias("digest"))


@query("s5_cached_list", f"SELECT CAST(page_id + 1 AS INTEGER) AS rank, 'https://' || {_HOST} AS url FROM pages WHERE {_HOST} <> ''")
def s5(spark, sf):
    """The rank list of all pages, cached once and read back under its digest."""
    source, folder = scratch(spark, "s5-source"), scratch(spark, "s5")
    _ranks(spark, sf).coalesce(1).write.csv(source)
    lines = I.cached_lines(I.cache_list(spark, source, folder, "pages", 1_000_000))
    return I.ranked_domains(lines).select("rank", "url")


@query("w6_root_cause", "SELECT user_id AS site, coalesce(arg_min(event_type, event_id) FILTER (WHERE event_type <> 'view'), arg_min(event_type, event_id)) AS motivo FROM events GROUP BY user_id")
def w6(spark, sf):
    first = F.min(F.struct((F.col("event_type") == "view").alias("later"), "event_id", "event_type"))
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("site")).agg(first.alias("m")).select("site", F.col("m.event_type").alias("motivo"))


@query("v18_collision_guard", "SELECT event_type || '_' || user_id AS written, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def v18(spark, sf):
    rows = table(spark, sf, "events").select(F.concat("event_type", F.lit("_"), F.col("user_id").cast("string")).alias("written"))
    return rows.groupBy("written").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("o8_label_template", "SELECT 'd' || doc_id AS domain_url, '' AS quality, '' AS toxic, '' AS notes FROM labels")
def o8(spark, sf):
    return R.label_template(table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("domain_url")), ["quality", "toxic"])


@query("x1_streaming_upsert", f"WITH {_LATEST} SELECT run_id, domain_url, variable_name, value FROM latest")
def x1(spark, sf):
    """The upsert as a stream, run to its end over what there is."""
    from glasshouse.streaming.upserts import latest, read

    path, mark = scratch(spark, "x1-out"), scratch(spark, "x1-mark")
    key = ["run_id", "domain_url", "variable_name"]
    rows = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    kind = F.floor("value").cast("long") % 4
    stream = rows.select(
        F.when(F.dayofmonth("ts") <= 15, "r1").otherwise("r2").alias("run_id"), F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("domain_url"), F.col("event_type").alias("variable_name"),
        F.when(kind == 0, "true").when(kind == 1, "false").when(kind == 2, '"nao_aplicavel"').otherwise('"nao_coletado"').alias("value"), F.struct("ts", "event_id").alias("computed_at"),
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    latest(stream, key).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return read(spark, path, key).select(*key, "value")
