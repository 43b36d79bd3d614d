"""Queries of text preparation, over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glasshouse.functions import html as H
from glasshouse.functions import lexicon as L
from glasshouse.functions import text as T
from glasshouse.operators import citations as K
from glasshouse.operators import evaluate as E
from glasshouse.operators import score as S
from glasshouse.operators.terms import Texts
from glasshouse.plans.registry import Catalog, spread, table

CATALOG = Catalog()
query = CATALOG.query

# --- SQL shared by the oracles (RE2 has no lookaround, so contexts are captured, and rules whose context may touch run twice) ---

_DROP = "".join(f", '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'g')" for t in ("head", "script", "style", "noscript", "svg", "template"))
_PAGE = (
    "regexp_replace(" * 6 + "regexp_replace(html, '\\s+', ' ', 'g')" + _DROP
)
_BLOCKS = f"regexp_replace(regexp_replace(regexp_replace({_PAGE}, '(?s)<!--.*?-->', '', 'g'), '(?i)</?({T._BLOCK_TAGS})\\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _BLOCKS = f"replace({_BLOCKS}, '{_a}', '{_b}')"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


def _sentences(x: str) -> str:
    words = "|".join(sorted(L.ABBREVIATIONS, key=len, reverse=True))
    edge = r"(^|[^\p{L}\p{N}_])"
    for _ in range(2):
        x = f"regexp_replace({x}, '(?i){edge}({words})\\.', '\\1\\2' || chr(1), 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '{edge}([A-ZÀ-Ú])\\.', '\\1\\2' || chr(1), 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\d)\\.(\\d)', '\\1' || chr(1) || '\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([.!?;:])\\s+([A-ZÀ-Ú])', '\\1' || chr(10) || '\\2', 'g')"
    x = f"regexp_replace({x}, '[ ]+(\\d+(?:\\x01\\d+)*[).]\\s+[A-ZÀ-Ú])', chr(10) || '\\1', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '[ ]+({L.BRACKET_MARK}\\s)', chr(10) || '\\1', 'g')"
    return f"replace({x}, chr(1), '.')"


# Letters with marks of the test tables' languages, as SQL replaces them.
_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
_NORMALISED = f"length(lower(trim(regexp_replace(translate(text, '{_ACCENTED}', '{_PLAIN}'), '[\\s\\x{{00a0}}]+', ' ', 'g'))))"

_SEGMENTS = f"""
    blocks AS (SELECT page_id, url, list_filter(list_transform(string_split({_BLOCKS}, chr(10)), lambda x: {_clean('x')}), lambda x: x <> '') AS b FROM pages),
    parts AS (SELECT page_id, url, flatten(list_transform(b, lambda x: list_filter(list_transform(string_split({_sentences('x')}, chr(10)), lambda y: trim(y)), lambda y: y <> ''))) AS s FROM blocks),
    segments AS (SELECT page_id, url, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS idx FROM parts)
"""


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "pages").select("page_id", "url", "html"))


@query("t1_html_blocks", f"WITH {_SEGMENTS} SELECT page_id, CAST(len(b) AS INTEGER) AS n_blocks, md5(array_to_string(b, '|')) AS digest FROM blocks")
def t1(spark, sf):
    b = T.html_blocks(F.coalesce("html", F.lit("")))
    return _pages(spark, sf).select("page_id", F.size(b).alias("n_blocks"), F.md5(F.array_join(b, "|")).alias("digest"))


@query("t1_html_blocks_parser", None)
def t1_parser(spark, sf):
    return _pages(spark, sf).select("page_id", H.blocks("html").alias("b")).select("page_id", F.size("b").alias("n_blocks"), F.md5(F.array_join("b", "|")).alias("digest"))


@query("t2_clean", f"SELECT doc_id, md5({_clean('text')}) AS digest FROM documents")
def t2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("digest"))


@query("t3_normalise", f"SELECT doc_id, md5(lower(trim(regexp_replace(translate(text, '{_ACCENTED}', '{_PLAIN}'), '[\\s\\x{{00a0}}]+', ' ', 'g')))) AS digest FROM documents")
def t3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


_FOREIGN, _OWN = "the|of|and|to|that|is|it|on|for|with", "de|la|le|les|des|que|el|los|der|die|und|en"


def _hits(words: str) -> str:
    return f"len(string_split(regexp_replace(' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g') || ' ', ' ({words}) ', chr(1), 'g'), chr(1))) - 1"


@query("t4_language_ratio_filter", f"SELECT doc_id, {_hits(_FOREIGN)} AS foreign_hits, {_hits(_OWN)} AS own_hits, length(text) < 400 OR NOT ({_hits(_FOREIGN)} > 1.4 * ({_hits(_OWN)})) AS keep FROM documents")
def t4(spark, sf):
    d = table(spark, sf, "documents")
    foreign, own = T.language_hits(F.col("text"), _FOREIGN), T.language_hits(F.col("text"), _OWN)
    return d.select("doc_id", foreign.cast("long").alias("foreign_hits"), own.cast("long").alias("own_hits"), T.is_own_language(F.col("text"), foreign=_FOREIGN, own=_OWN).alias("keep"))


_LINES = "lines AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS idx FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))"


def _lines(spark, sf) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(lines).alias("idx", "text"))


@query("t5_drop_recurrent_lines", f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE n < 3 OR length(text) > 150) AS n_kept FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, text) AS n FROM lines) GROUP BY doc_id")
def t5(spark, sf):
    return T.recurrent_lines(_lines(spark, sf), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("keep").alias("n_kept"))


_MARK, _WHOLE = L.ITEM_MARK, L.ITEM_MARK.removeprefix("^")
_REBUILT = f"""stripped AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS idx FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents)),
    stay AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, text) AS n FROM stripped) WHERE n < {L.PAGE_REPEATS} OR length(text) > {L.MAX_RECURRENT}),
    flagged AS (SELECT *, regexp_matches(text, '{_MARK}') AS marked, regexp_matches(text, '[.!?;]\\s*$') AND NOT regexp_matches(text, '^(?:{_WHOLE})$') AS ends FROM stay),
    begun AS (SELECT *, marked OR coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY idx), false) AS begins FROM flagged),
    numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS part FROM begun),
    pieces AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY idx DESC) = 1 AS is_last FROM numbered),
    joined AS (SELECT doc_id, part, string_agg(CASE WHEN is_last THEN text WHEN text LIKE '%-' THEN text[:-2] ELSE text || ' ' END, '' ORDER BY idx) AS j FROM pieces GROUP BY doc_id, part),
    rebuilt AS (SELECT doc_id, part, t FROM (SELECT doc_id, part, {_clean('j')} AS t FROM joined) WHERE t <> '')"""


@query("t5_rebuild_lines", f"WITH {_REBUILT}, g AS (SELECT doc_id, count(*) AS n, string_agg(t, '|' ORDER BY part) AS s FROM rebuilt GROUP BY doc_id) SELECT DISTINCT doc_id, CAST(coalesce(g.n, 0) AS INTEGER) AS n_parts, md5(coalesce(s, '')) AS digest FROM stay LEFT JOIN g USING (doc_id)")
def t5_fold(spark, sf):
    from glasshouse.operators.lines import rebuild

    return rebuild(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.size("parts").alias("n_parts"), F.md5(F.array_join("parts", "|")).alias("digest"))


@query("t6_lines", f"WITH {_LINES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, length(text) AS n FROM lines")
def t6(spark, sf):
    return _lines(spark, sf).select("doc_id", "idx", F.char_length("text").cast("long").alias("n"))


@query("t7_sentences", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split({_sentences(_clean('text'))}, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS s FROM documents)")
def t7(spark, sf):
    s = T.sentences(T.clean(F.col("text")))
    return _docs(spark, sf).select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(
    "segment_useful_sentences",
    f"""WITH {_SEGMENTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY idx) AS n FROM segments)
    SELECT page_id, count(*) AS n_segments, count(*) FILTER (WHERE n = 1 AND length(text) >= 20) AS n_useful, CAST(coalesce(sum(length(text)) FILTER (WHERE n = 1 AND length(text) >= 20), 0) AS BIGINT) AS useful_chars
    FROM numbered GROUP BY page_id""",
)
def t8(spark, sf):
    segs = T.useful(T.segments(_pages(spark, sf), "page_id", "html"), "page_id")
    return segs.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count_if("is_useful").alias("n_useful"), F.coalesce(F.sum(F.when(F.col("is_useful"), F.char_length("text"))), F.lit(0)).cast("long").alias("useful_chars"))


@query("t9_contiguous_offsets", f"WITH {_SEGMENTS} SELECT page_id, CAST(idx AS INTEGER) AS idx, CAST(coalesce(sum({_NORMALISED} + 1) OVER (PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_at, {_NORMALISED} AS n FROM segments")
def t9(spark, sf):
    rows = T.offsets(T.segments(_pages(spark, sf), "page_id", "html"), "page_id")
    return rows.select("page_id", "idx", F.col("begin").cast("long").alias("begin_at"), (F.col("end") - F.col("begin")).cast("long").alias("n"))


_BODY = "array_to_string(b, ' ')"


@query(
    "t10_segment_pages",
    f"""WITH {_SEGMENTS}, kept AS (SELECT page_id, url, {_BODY} AS text FROM blocks), own AS (SELECT page_id, url FROM kept WHERE length(text) < 400 OR NOT ({_hits(_FOREIGN)} > 1.4 * ({_hits(_OWN)}))),
    {_REBUILT}, split AS (SELECT doc_id, list_filter(list_transform(string_split({_sentences('t')}, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS s FROM rebuilt),
    units AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS site, 'page' AS kind, text FROM segments JOIN own USING (page_id, url) UNION ALL SELECT source, 'pdf', unnest(s) FROM split JOIN documents USING (doc_id))
    SELECT site, kind, md5(text) AS text, count(*) AS n FROM units GROUP BY site, kind, text""",
)
def t10(spark, sf):
    """Pages in the own language and rebuilt documents (in place of the text layer of PDF files), as one list of units a site."""
    from glasshouse.operators.lines import rebuild

    pages, docs = _pages(spark, sf), table(spark, sf, "documents").select("doc_id", "text", "source")
    own = T.is_own_language(F.col("body"), foreign=_FOREIGN, own=_OWN)
    of_site = pages.where("page_id IS NOT NULL").withColumn("site", F.regexp_extract("url", "//([^/]+)", 1))
    of_pages = T.segments_of_sites(of_site, "site", "html", own)[0].withColumn("kind", F.lit("page"))
    of_docs = T.segments_of_parts(rebuild(docs, "doc_id"), "doc_id").join(docs.select("doc_id", F.col("source").alias("site")), "doc_id").withColumn("kind", F.lit("pdf"))
    units = of_pages.select("site", "kind", "text").unionByName(of_docs.select("site", "kind", "text"))
    return units.groupBy("site", "kind", F.md5("text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query("t11_visible_text", None)
def t11(spark, sf):
    return _pages(spark, sf).select("page_id", H.visible("html").alias("v")).select("page_id", F.char_length("v").alias("n_chars"), F.md5("v").alias("digest"))


@query("t12_safe_decode", """SELECT doc_id, doc_id % 3 <> 0 AS valid,
    md5(CASE WHEN doc_id % 3 = 0 THEN array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: chr(('0x' || h)::INTEGER)), '') || 'ÿ' ELSE text END) AS decoded FROM documents""")
def t12(spark, sf):
    """Every third text gets a byte that UTF-8 does not have, so it is read as Latin-1: one character a byte."""
    utf8 = F.encode("text", "UTF-8")
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(utf8, F.lit(bytearray(b"\xff")))).otherwise(utf8).alias("body"))
    return d.select("doc_id", F.call_function("is_valid_utf8", F.col("body")).alias("valid"), F.md5(T.safe_decode(F.col("body"), 1 << 30)).alias("decoded"))


@query("t13_match_context", "SELECT doc_id, regexp_extract(text, '[Tt]h[a-z]+tion') AS match, CAST(CASE WHEN regexp_extract(text, '[Tt]h[a-z]+tion') = '' THEN -1 ELSE instr(text, regexp_extract(text, '[Tt]h[a-z]+tion')) - 1 END AS INTEGER) AS position FROM documents")
def t13(spark, sf):
    m = T.match_with_context(F.col("text"), "[Tt]h[a-z]+tion")
    return table(spark, sf, "documents").select("doc_id", m["match"].alias("match"), m["position"].alias("position"))


_MAIL = L.PERSONAL_DATA["correio"]


@query("t14_mask_email", f"SELECT doc_id, regexp_replace(m, '^(.{{0,2}})[^@]*@(.*)$', '\\1***@\\2') AS masked FROM (SELECT doc_id, regexp_extract(text, '{_MAIL}') AS m FROM documents) WHERE m <> ''")
def t14(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", _MAIL, 0).alias("m")).where("m != ''")
    return d.select("doc_id", T.mask_email(F.col("m")).alias("masked"))


_TOKENS = "regexp_extract_all(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), '[^ ]{2,}')"
_GRAMS = f"""toks AS (SELECT doc_id, {_TOKENS} AS w FROM docs),
    grams AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term FROM toks)"""


def _docs(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("t15_ngrams", f"WITH docs AS (SELECT doc_id, text FROM documents), {_GRAMS} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 5")
def t15(spark, sf):
    return S.term_frequencies(_docs(spark, sf), "doc_id", least=5)


@query("t16_locate_excerpt", "SELECT d.doc_id, b.item_id, CASE WHEN instr(d.text, b.text) > 0 THEN instr(d.text, b.text) - 1 WHEN instr(d.text, substring(b.text, 1, 120)) > 0 THEN instr(d.text, substring(b.text, 1, 120)) - 1 WHEN instr(d.text, substring(b.text, 1, 80)) > 0 THEN instr(d.text, substring(b.text, 1, 80)) - 1 WHEN instr(d.text, substring(b.text, 1, 50)) > 0 THEN instr(d.text, substring(b.text, 1, 50)) - 1 END AS place FROM documents d JOIN benchmark b ON instr(d.text, substring(b.text, 1, 50)) > 0")
def t16(spark, sf):
    """The whole excerpt, else its first 120, 80 or 50 characters: what has any of these has the last."""
    d, b = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("excerpt"))
    hit = K.containing(d, "doc_id", "text", b.withColumn("part", F.substring("excerpt", 1, 50)), "item_id", "part")
    return hit.select("doc_id", "item_id", T.locate_excerpt(F.col("text"), F.col("excerpt")).cast("long").alias("place"))


_EVIDENCE = "ev AS (SELECT doc_id, 100 + 37 * (doc_id % 11) AS e_begin, 260 + 37 * (doc_id % 11) AS e_end FROM documents)"


@query(
    "t17_interval_overlap_label",
    f"""WITH {_LINES}, s AS (SELECT doc_id, idx, w, coalesce(sum(w + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT *, {_NORMALISED} AS w FROM lines) WHERE w > 0), {_EVIDENCE},
    o AS (SELECT s.doc_id, idx, least(b + w, e_end) - greatest(b, e_begin) AS c, least(w, e_end - e_begin) AS m FROM s JOIN ev USING (doc_id))
    SELECT doc_id, idx, CAST(c > 0 AND c >= 0.5 * m AS INTEGER) AS label FROM o""",
)
def t17(spark, sf):
    segs = T.offsets(_lines(spark, sf), "doc_id")
    ev = table(spark, sf, "documents").select("doc_id", (F.lit(100) + 37 * (F.col("doc_id") % 11)).alias("e_begin"), (F.lit(260) + 37 * (F.col("doc_id") % 11)).alias("e_end"))
    return E.overlap_labels(segs, ev, "doc_id").select("doc_id", "idx", "label")


@query(
    "t18_dedup_label_consolidation",
    f"""WITH {_LINES}, l AS (SELECT doc_id % 20 AS site, text, doc_id * 100000 + idx AS idx, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 0 END AS label FROM lines)
    SELECT site, text, CASE WHEN max(CASE WHEN label = 1 THEN 1 END) IS NOT NULL THEN 1 WHEN count(*) FILTER (WHERE label IS NULL) > 0 THEN NULL ELSE arg_min(label, idx) END AS label, count(*) AS n FROM l GROUP BY site, text HAVING count(*) > 1""",
)
def t18(spark, sf):
    k = F.col("doc_id")
    rows = _lines(spark, sf).select((k % 20).alias("site"), "text", (k * 100000 + F.col("idx")).alias("idx"), F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).alias("label"))
    return E.consolidate(rows, ["site", "text"]).where("n > 1").select("site", "text", "label", "n")


@query(
    "t19_multiset_overlap",
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), a AS (SELECT doc_id // 2 AS pair, word, count(*) AS n FROM w WHERE doc_id % 2 = 0 GROUP BY ALL),
    b AS (SELECT doc_id // 2 AS pair, word, count(*) AS n FROM w WHERE doc_id % 2 = 1 GROUP BY ALL)
    SELECT coalesce(a.pair, b.pair) AS pair, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS shared, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / greatest(coalesce(sum(a.n), 0), coalesce(sum(b.n), 0)), 6) AS overlap
    FROM a FULL JOIN b ON a.pair = b.pair AND a.word = b.word GROUP BY 1""",
)
def t19(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word")).withColumn("pair", F.floor(F.col("doc_id") / 2))
    return E.multiset_overlap(w.where("doc_id % 2 = 0"), w.where("doc_id % 2 = 1"), "pair").select("pair", "shared", F.round("overlap", 6).alias("overlap"))


@query(
    "t20_citation_anchor",
    """WITH c AS (SELECT item_id, text, length(text) AS n FROM benchmark), p AS (SELECT item_id, [substring(text, 1, 50), substring(text, greatest(n // 2 - 25 + 1, 1), 50), substring(text, greatest(n - 50 + 1, 1), 50)] AS parts FROM c)
    SELECT doc_id, item_id FROM documents d JOIN p ON contains(d.text, parts[1]) OR contains(d.text, parts[2]) OR contains(d.text, parts[3])""",
)
def t20(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    b = table(spark, sf, "benchmark").select("item_id", F.array(*T.citation_parts(F.col("text"))).alias("parts"))
    return K.containing(d, "doc_id", "text", b.select("item_id", F.explode("parts").alias("part")), "item_id", "part").select("doc_id", "item_id").distinct()


@query("t21_evidence_package", f"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html || ' x' || page_id || '@a.com y@b.org ', '{_MAIL}'))), ';') AS mails, CAST(len(regexp_extract_all(html, '(?i)<a\\b[^>]*href')) AS INTEGER) AS n_links, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS INTEGER) AS distinct_links FROM pages")
def t21(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    mails = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.concat("html", F.lit(" x"), F.col("page_id").cast("string"), F.lit("@a.com y@b.org ")), F.lit(_MAIL), 0))), ";")
    return _pages(spark, sf).select("page_id", mails.alias("mails"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*href"), 0)).alias("n_links"), F.size(F.array_distinct(links)).alias("distinct_links"))


_PII = {"correio": _MAIL, "cpf": L.PERSONAL_DATA["cpf"], "cnpj": L.PERSONAL_DATA["cnpj"], "telefone": r"\d{3}[- ]\d{3,4}[- ]\d{4}|\(\d{2,3}\) ?\d{3,5}-\d{4}"}


@query("t22_pii_scan", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (WHERE len(m) > 0) AS documents, CAST(coalesce(sum(len(m)), 0) AS BIGINT) AS matches FROM (SELECT regexp_extract_all(text, '{p}') AS m FROM documents)" for k, p in _PII.items()))
def t22(spark, sf):
    d = table(spark, sf, "documents")
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in _PII.items()])
    return d.select(F.explode(counts).alias("x")).groupBy("x.kind").agg(F.count_if(F.col("x.n") > 0).alias("documents"), F.coalesce(F.sum("x.n"), F.lit(0)).alias("matches"))


@query("t23_pii_redact", f"SELECT doc_id, md5(regexp_replace(text, '{_MAIL}', '[correio]', 'g')) AS digest, CAST(len(regexp_extract_all(regexp_replace(text, '{_MAIL}', '[correio]', 'g'), '{_MAIL}')) AS INTEGER) AS residual FROM documents WHERE regexp_matches(text, '{_MAIL}')")
def t23(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike(_MAIL))
    red = F.regexp_replace("text", _MAIL, "[correio]")
    return d.select("doc_id", F.md5(red).alias("digest"), F.regexp_count(red, F.lit(_MAIL)).alias("residual"))


@query(
    "t24_divergent_marks",
    f"""WITH {_LINES}, m AS (SELECT trim(regexp_replace(regexp_replace(lower(translate(text, '{_ACCENTED}', '{_PLAIN}')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS t, doc_id % 4 = 0 AS label FROM lines)
    SELECT t, count(DISTINCT label) AS labels, count(*) AS n FROM m WHERE length(t) >= 25 GROUP BY t HAVING count(DISTINCT label) > 1""",
)
def t24(spark, sf):
    rows = _lines(spark, sf).withColumn("label", F.col("doc_id") % 4 == 0)
    return E.divergent_marks(rows, T.normalise_ascii(F.col("text")), "label")


@query("t25_licence_citations", "SELECT d.doc_id, source FROM documents d JOIN labels l USING (doc_id) WHERE regexp_matches(text, '(?i)licen[sc]ed (under|by)|public license') AND quality = 1")
def t25(spark, sf):
    """Citations of a licence among the texts marked positive."""
    marked = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").where(F.col("text").rlike("(?i)licen[sc]ed (under|by)|public license")).join(marked, "doc_id").select("doc_id", "source")


@query("t26_foreign_sources", "SELECT source, count(*) FILTER (WHERE lang = 'es') AS n_es, count(*) AS n FROM documents GROUP BY source HAVING count(*) FILTER (WHERE lang = 'es') > 0 AND count(*) FILTER (WHERE lang = 'pt') = 0")
def t26(spark, sf):
    g = table(spark, sf, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "es").alias("n_es"), F.count_if(F.col("lang") == "pt").alias("n_pt"), F.count(F.lit(1)).alias("n"))
    return g.where("n_es > 0 AND n_pt = 0").select("source", "n_es", "n")


@query("t27_marked_corpus", "SELECT doc_id, variable, mark FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT (mark FOR variable IN (quality, toxic))")
def t27(spark, sf):
    return table(spark, sf, "labels").unpivot("doc_id", ["quality", "toxic"], "variable", "mark")


@query("t28_carry_marks", "SELECT d.doc_id, l.quality, l.doc_id IS NULL AS is_new FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT l.doc_id, l.quality, NULL FROM labels l ANTI JOIN documents d ON l.doc_id = d.doc_id")
def t28(spark, sf):
    d, m = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality")
    kept = d.join(m, "doc_id", "left").join(m.select("doc_id", F.lit(False).alias("old")), "doc_id", "left").select("doc_id", "quality", F.coalesce("old", F.lit(True)).alias("is_new"))
    return kept.unionByName(m.join(d, "doc_id", "left_anti").select("doc_id", "quality", F.lit(None).cast("boolean").alias("is_new")))


@query("t29_text_diff", "SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'gone' WHEN a.text = b.text THEN 'same' WHEN regexp_replace(a.text, '\\s', '', 'g') = regexp_replace(b.text, '\\s', '', 'g') THEN 'space' ELSE 'changed' END AS kind FROM documents a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, chr(10), ' ') WHEN doc_id % 7 = 0 THEN lower(text) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0) b USING (doc_id)")
def t29(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    b = d.where(k % 11 != 0).select("doc_id", F.when(k % 5 == 0, F.replace("text", F.lit("\n"), F.lit(" "))).when(k % 7 == 0, F.lower("text")).otherwise(F.col("text")).alias("other"))
    flat = lambda c: F.regexp_replace(c, r"\s", "")
    kind = F.when(F.col("other").isNull(), "gone").when(F.col("text") == F.col("other"), "same").when(flat("text") == flat("other"), "space").otherwise("changed")
    return d.join(b, "doc_id", "left").select("doc_id", kind.alias("kind"))


@query("t30_blind_sheet", "SELECT count(*) FILTER (WHERE trim(coalesce(lang, '')) <> '') AS lang, count(*) FILTER (WHERE trim(coalesce(source, '')) <> '') AS source FROM documents")
def t30(spark, sf):
    from glasshouse.operators.render import filled_cells

    return filled_cells(table(spark, sf, "documents"), ["lang", "source"])


# --- models on text ---

_VOCAB = f"WITH docs AS (SELECT doc_id, text FROM documents), {_GRAMS}, tf AS (SELECT doc_id, term, count(*) AS n FROM grams GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3), n AS (SELECT count(*) AS n FROM docs), vocab AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, n)"


@query("m14_fit_idf", f"{_VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab")
def m14(spark, sf):
    return S.fit_idf(_docs(spark, sf), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query("m7_model_round_trip", f"{_VOCAB} SELECT 'text' AS kind, count(*) AS terms, round(sum(idf), 3) AS idf, round(sum((length(term) % 7 - 3) / 10.0), 1) AS coef FROM vocab")
def m7(spark, sf):
    """A model written with its identity and read again by it."""
    from glasshouse.plans.registry import scratch

    path = scratch(spark, "m7")
    vocabulary = S.fit_idf(_docs(spark, sf), "doc_id").select("term", "idf", ((F.char_length("term") % 7).cast("double") / 10 - 0.3).alias("coef"))
    identity = S.write_model(vocabulary, {"kind": "text", "version": "1"}, path)
    again, meta = S.read_model(spark, path, identity, "text", "1")
    return again.agg(F.lit(meta["kind"]).alias("kind"), F.count(F.lit(1)).alias("terms"), F.round(F.sum("idf"), 3).alias("idf"), F.round(F.sum("coef"), 1).alias("coef"))


@query("m1_tfidf_norms", f"{_VOCAB}, w AS (SELECT doc_id, (1 + ln(n)) * idf AS w FROM tf JOIN vocab USING (term)) SELECT doc_id, count(*) AS n_terms, round(sqrt(sum(w * w)), 4) AS norm FROM w GROUP BY doc_id")
def m1(spark, sf):
    docs = Texts(_docs(spark, sf), ["doc_id"])
    return S.own_norms(docs).select("doc_id", "n_terms", F.round("norm", 4).alias("norm"))


_COEF = "(CAST(length(term) % 7 AS DOUBLE) - 3) / 10"


@query(
    "m2_ngram_score",
    f"{_VOCAB}, w AS (SELECT doc_id, (1 + ln(n)) * idf AS w, {_COEF} AS c FROM tf JOIN vocab USING (term)), s AS (SELECT doc_id, sum(w * c) / sqrt(sum(w * w)) AS dot FROM w GROUP BY doc_id) SELECT doc_id, round(1 / (1 + exp(-(coalesce(dot, 0) - 0.25))), 6) AS probability FROM docs LEFT JOIN s USING (doc_id)",
)
def m2(spark, sf):
    docs = Texts(_docs(spark, sf), ["doc_id"])
    vocabulary = S.fit_idf(docs, "doc_id").withColumn("coef", ((F.char_length("term") % 7).cast("double") - 3) / 10)
    return S.probabilities(docs, ["doc_id"], vocabulary, -0.25).select("doc_id", F.round("probability", 6).alias("probability"))


@query("m3_vocab_coverage", f"{_VOCAB} SELECT doc_id, round(sum(CASE WHEN v.term IS NULL THEN 0 ELSE n END) / sum(n), 6) AS coverage FROM tf LEFT JOIN vocab v USING (term) GROUP BY doc_id")
def m3(spark, sf):
    docs = Texts(_docs(spark, sf), ["doc_id"])
    return S.own_coverage(docs).select("doc_id", F.round("coverage", 6).alias("coverage"))


@query("m18_coverage_quantiles", f"{_VOCAB}, c AS (SELECT doc_id, sum(CASE WHEN v.term IS NULL THEN 0 ELSE n END) / sum(n) AS coverage FROM tf LEFT JOIN vocab v USING (term) GROUP BY doc_id) SELECT round(quantile_cont(coverage, 0.05), 6) AS p05, round(quantile_cont(coverage, 0.25), 6) AS p25, round(quantile_cont(coverage, 0.5), 6) AS median, round(quantile_cont(coverage, 0.75), 6) AS p75, round(avg(coverage), 6) AS mean FROM c")
def m18(spark, sf):
    from glasshouse.operators.train import coverage_quantiles

    docs = Texts(_docs(spark, sf), ["doc_id"])
    q = coverage_quantiles(S.own_coverage(docs))
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query("m20_truncation_report", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE len(string_split(text, ' ')) > 512) AS truncated, round(avg(len(string_split(text, ' '))), 6) AS mean_words FROM documents GROUP BY lang")
def m20(spark, sf):
    n = F.size(F.split("text", " "))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(n > 512).alias("truncated"), F.round(F.avg(n), 6).alias("mean_words"))


@query(
    "v11_text_variable",
    """WITH s AS (SELECT l.doc_id % 50 AS site, l.doc_id AS pos, (d.n_chars * 37 % 1000) / 1000.0 AS p FROM labels l JOIN documents d USING (doc_id)), sites AS (SELECT unnest(range(0, 55)) AS site),
    g AS (SELECT site, bool_or(p >= 0.9) AS value, max(p) AS confidence, count(*) FILTER (WHERE p >= 0.9) AS flagged, count(*) AS n FROM s GROUP BY site)
    SELECT site, coalesce(value, false) AS value, coalesce(confidence, 0) AS confidence, CASE WHEN value IS NULL THEN CASE WHEN site % 2 = 0 THEN 'politica_outro_idioma' ELSE 'sem_texto_avaliavel' END END AS motivo, coalesce(flagged, 0) AS flagged, coalesce(n, 0) AS n FROM sites LEFT JOIN g USING (site)""",
)
def v11(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    scored = d.select((F.col("doc_id") % 50).alias("site"), F.col("doc_id").alias("pos"), F.lit("").alias("text"), ((F.col("n_chars") * 37 % 1000) / 1000).alias("probability"))
    sites = spark.range(55).select(F.col("id").alias("site"), (1 - F.col("id") % 2).alias("removed_pages"))
    return S.text_variable(scored, sites, 0.9).select("site", "value", "confidence", "motivo", F.col("n_sentencas_sinalizadas").alias("flagged"), F.col("n_segmentos_avaliados").alias("n"))


@query(
    "w3_topn_sentences",
    "SELECT site, pos, n FROM (SELECT l.doc_id % 50 AS site, l.doc_id AS pos, row_number() OVER (PARTITION BY l.doc_id % 50 ORDER BY (d.n_chars * 37 % 1000) DESC, l.doc_id) AS n FROM labels l JOIN documents d USING (doc_id)) WHERE n <= 3",
)
def w3(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("doc_id") % 50).alias("site"), F.col("doc_id").alias("pos"), (F.col("n_chars") * 37 % 1000).alias("p"))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("p"), "pos"))).where("n <= 3").select("site", "pos", F.col("n").cast("long").alias("n"))


@query("a15_repetition_buckets", f"WITH {_LINES}, g AS (SELECT text, count(*) AS n, count(DISTINCT doc_id) AS s FROM lines GROUP BY text) SELECT CASE WHEN n = 1 THEN 'unique' WHEN s = 1 THEN 'within_site' WHEN n = s THEN 'between_sites' ELSE 'both' END AS bucket, count(*) AS texts, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY 1")
def a15(spark, sf):
    return E.repetition(_lines(spark, sf), "doc_id", "text").groupBy("bucket").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_rows").alias("n_rows"))


@query("v13_requirement_rules", "SELECT doc_id, regexp_matches(t, '(?:\\bof\\b|\\bfor\\b)[^.;]{0,70}(?:tion\\w*|ing)') AND NOT regexp_matches(t, 'the of the') AS met FROM (SELECT doc_id, lower(trim(regexp_replace(translate(text, '" + _ACCENTED + "', '" + _PLAIN + "'), '[\\s\\x{00a0}]+', ' ', 'g'))) AS t FROM documents)")
def v13(spark, sf):
    from glasshouse.operators.detect import requirement

    rules = {"x": {"yes": [r"(?:\bof\b|\bfor\b)[^.;]{0,70}(?:tion\w*|ing)"], "no": ["the of the"]}}
    return table(spark, sf, "documents").select("doc_id", requirement(F.col("text"), "x", rules).alias("met"))
