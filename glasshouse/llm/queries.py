"""The opN_<name> queries: thin bindings of the operators to the test tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.media import digests

    return digests(_read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.simhash import near_groups

    groups = near_groups(spark, _read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.substring_dedup import dedup_passages

    return dedup_passages(spark, _read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in directories by source and identifier; statements may stand in any line."""
    from glasshouse.llm.license_scan import document_files, scan

    found = scan(spark, document_files(_read(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "path", F.col("own").alias("own_license"), F.round("score", 6).alias("score"), "line", "license", "inherited_from", "distance")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.html_extract import main_text

    return main_text(_read(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.exact_dedup import exact_groups

    groups = exact_groups(spark, _read(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.langid import identify, train

    docs = _read(spark, sf_dir, "documents")
    return identify(spark, docs, train(spark, docs))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.suffix_dedup import remove_repeats

    return remove_repeats(spark, _read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from glasshouse.llm.packing import pack

    return pack(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from glasshouse.llm.bpe import digests

    return digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_dimension_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.history import ARRIVAL, document_changes, versions

    found = versions(document_changes(_read(spark, sf_dir, "documents")), ARRIVAL)
    return found.select(F.col("key").alias("doc_id"), "version", "valid_from", "valid_to", "value")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.line_dedup import digests

    return digests(spark, _read(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasshouse.llm.turns import damaged, repair

    return repair(spark, damaged(_read(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_media": op1_media,
    "op2_simhash": op2_simhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_html_extract": op5_html_extract,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
    "op11_dimension_history": op11_dimension_history,
    "op12_line_dedup": op12_line_dedup,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES = {
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
        least_id AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN least_id USING (k) WHERE m < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op6_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)
    """,
    "op11_dimension_history": """
        WITH h AS (
            SELECT doc_id, j, lang, ('0x' || substr(sha256(doc_id || ':' || j), 1, 12))::BIGINT AS h FROM documents, range(2) AS n(j)),
        changes AS (
            SELECT doc_id - doc_id % 10 AS d, doc_id, j, lang, h, h % 60 AS s, CASE WHEN h // 1000 % 10 < 2 THEN 'd' WHEN h // 1000 % 10 < 5 THEN 'c' ELSE 'u' END AS kind FROM h),
        days AS (SELECT d, day FROM (SELECT DISTINCT d FROM changes), range(80) AS r(day)),
        ranked AS (
            SELECT days.d, day, kind, lang, row_number() OVER (PARTITION BY days.d, day ORDER BY kind = 'c' DESC, CASE WHEN kind = 'c' THEN 0 ELSE s END DESC, h DESC, doc_id DESC, j DESC) AS place
            FROM days JOIN changes c ON c.d = days.d AND s <= day AND (kind <> 'c' OR day < s + 10)),
        present AS (SELECT d, day, lang FROM ranked WHERE place = 1 AND kind <> 'd'),
        marked AS (
            SELECT *, CASE WHEN lag(day) OVER w = day - 1 AND lag(lang) OVER w IS NOT DISTINCT FROM lang THEN 0 ELSE 1 END AS new
            FROM present WINDOW w AS (PARTITION BY d ORDER BY day)),
        runs AS (SELECT *, sum(new) OVER (PARTITION BY d ORDER BY day) AS version FROM marked)
        SELECT d AS doc_id, version::INTEGER AS version, min(day) AS valid_from, CASE WHEN max(day) < 79 THEN max(day) + 1 END AS valid_to, any_value(lang) AS value
        FROM runs GROUP BY d, version
    """,
    "op12_line_dedup": r"""
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM l),
        keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines),
        shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        stay AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM keyed LEFT JOIN shared USING (k) WHERE keeper IS NULL OR keeper = doc_id GROUP BY doc_id)
        SELECT doc_id, len(ls)::BIGINT AS n_lines, len(ls) - coalesce(n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM l LEFT JOIN stay USING (doc_id)
    """,
    "op13_turn_repair": r"""
        WITH RECURSIVE
        crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
        hashed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind
            FROM conversations, crc),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM hashed, range(2) AS twice(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role || ':' || text, role) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM damaged),
        turns AS (
            SELECT conv_id, i, turn, role, text, left(role, 1) AS c, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault
            FROM placed),
        puts(s, letters, price, st) AS (
            VALUES (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3), (0, 'I', 2, 2), (1, 'I', 2, 2), (2, 'I', 2, 3), (3, 'I', 2, 2), (0, 'II', 4, 3), (1, 'II', 4, 3), (2, 'II', 4, 2), (3, 'II', 4, 3)),
        kept(st, c, target) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        next(st, target) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
        best AS (
            SELECT DISTINCT conv_id, 0 AS i, 0 AS s, {'cost': 0, 'audit': ''} AS b FROM turns
            UNION ALL
            SELECT conv_id, i, s, min(b) FROM (
                SELECT b.conv_id, t.i::INTEGER AS i, e.s, {'cost': b.b.cost + p.price + e.price, 'audit': b.b.audit || p.letters || e.letter} AS b
                FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1 JOIN puts p ON p.s = b.s,
                LATERAL (
                    SELECT p.st AS s, 3 AS price, 'D' AS letter
                    UNION ALL SELECT target, CASE WHEN t.fault = 't' THEN 1 ELSE 0 END, 'K' FROM kept WHERE kept.st = p.st AND kept.c = t.c AND t.fault IN ('t', 'k')
                    UNION ALL SELECT target, CASE WHEN t.fault = 't' THEN 3 ELSE 2 END, 'R' FROM next WHERE next.st = p.st AND t.fault IN ('t', 'k')) AS e)
            GROUP BY conv_id, i, s),
        ended AS (
            SELECT b.conv_id, min({'cost': b.b.cost + p.price, 'audit': b.b.audit || p.letters}) AS b
            FROM best b JOIN (SELECT conv_id, max(i) AS n FROM turns GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.n = b.i JOIN puts p ON p.s = b.s
            WHERE p.st IN (0, 3) GROUP BY b.conv_id),
        letters AS (SELECT conv_id, unnest(string_split(b.audit, '')) AS e, generate_subscripts(string_split(b.audit, ''), 1) AS p FROM ended WHERE b.audit <> ''),
        aligned AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters),
        stands AS (
            SELECT a.conv_id, a.p, a.e, t.role, t.text, t.c, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.p) AS q
            FROM aligned a LEFT JOIN turns t ON a.e <> 'I' AND t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.i = a.i WHERE a.e <> 'D'),
        spoken AS (
            SELECT s.conv_id, s.q, CASE WHEN s.e = 'K' THEN s.role WHEN (s.q + h.head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN s.e = 'I' THEN '' ELSE s.text END AS line
            FROM stands s JOIN (SELECT conv_id, max(CASE WHEN q = 1 AND e = 'K' AND c = 's' THEN 1 ELSE 0 END) AS head FROM stands GROUP BY conv_id) h ON h.conv_id IS NOT DISTINCT FROM s.conv_id),
        repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY q) AS t FROM spoken GROUP BY conv_id),
        pairs AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM turns),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM pairs GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.b.cost, 0)::BIGINT AS cost, coalesce(e.b.audit, '') AS audit, sha256(coalesce(r.t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
