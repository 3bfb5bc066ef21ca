"""Queries over the text tables, one for each operator, with production parameters; SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, fingerprints, html_extraction, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, toxicity, url_filters, warc, whitening
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept", "boilerplate_words")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "expected_grade", "tail_probability", "kept", quality_classifier.held_out(F.col("doc_id")).alias("held_out"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")), "present")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_lm_scoring, op3_best_fit_packing, op4_toxicity, op5_html_extraction, op6_document_fingerprints, op7_quality_rules, op8_quality_classifier, op9_mixing, op10_minhash_near_dedup, op11_embedding_whitening, op12_warc, op13_conversation_repair)}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_INK = r"[^\x20\x09-\x0D]"


def _ways() -> str:
    """Rows of op13's SQL: place in the form, place after insertions, insertions and edit, the edit, price and lines of the insertions."""
    goes, rows = {"start": "user", "system": "user", "user": "assistant", "assistant": "user"}, []
    for place in goes:
        reached, before, lines = place, "", []
        for _ in range(3):
            rows += [f"('{place}', '{reached}', '{before}{edit}', '{edit}', {2 * len(before)}, [{', '.join(lines)}]::VARCHAR[])" for edit in "KRD"]
            reached, before = goes[reached], before + "I"
            lines = [*lines, f"'{reached}:'"]
    return ", ".join(rows)


ORACLE_SQL = {
    "op1_url_filters": rf"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
        ), split AS (
            SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut
        ), parts AS (
            SELECT page_id, coalesce({_LOWER.format('raw_host')}, '') AS host,
                   coalesce(regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*'), '') AS path
            FROM split
        ), ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
            END AS rule FROM parts
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op7_quality_rules": rf"""
        WITH lines AS (
            SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents
        ), filled AS (
            SELECT doc_id, source, text, line, array_to_string(regexp_extract_all({_LOWER.format('line')}, '{_WORD}'), ' ') AS normal,
                   len(regexp_extract_all(line, '{_WORD}')) AS words
            FROM lines WHERE len(regexp_extract_all(line, '{_WORD}')) > 0
        ), frequent AS (
            SELECT source, normal FROM (SELECT source, normal, count(DISTINCT text) AS n FROM filled GROUP BY source, normal) WHERE n > {quality_rules.LINE_DOCUMENTS}
        ), lost AS (
            SELECT doc_id, sum(words) AS lost FROM filled f JOIN frequent q ON f.source IS NOT DISTINCT FROM q.source AND f.normal = q.normal GROUP BY doc_id
        ), doubled AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM filled GROUP BY doc_id
        ), words AS (
            SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents
        ), runs AS (
            SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS run
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
        ), twice AS (
            SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
        ), repeated AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 5) AS r(k) GROUP BY doc_id
        ), counted AS (
            SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words,
                   coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
                   coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0)::BIGINT AS n_symbols,
                   coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                   coalesce(lost, 0)::BIGINT AS boilerplate_words
            FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN doubled USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id)
        )
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
               AND n_words - boilerplate_words >= {quality_rules.LEAST_WORDS} AND n_words - boilerplate_words >= {quality_rules.LEAST_SHARE} * n_words AS kept
        FROM counted
    """,
    "op9_mixing": rf"""
        WITH sized AS (
            SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents
        ), pieces AS (
            SELECT *, substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 2) AS salt,
                   length(bin(size)) * 4 + ((size >> greatest(length(bin(size)) - 3, 0)) & 3) AS class
            FROM sized
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, [5e0, 2e0, 1e0][(place - 1) % 3 + 1] AS weight, source_size / [5e0, 2e0, 1e0][(place - 1) % 3 + 1] AS ratio FROM sources
        ), units AS (
            SELECT *, (sum(source_size) OVER () - 3e0 * coalesce(sum(source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
            FROM weighed
        ), shared AS (
            SELECT source, source_size, least(weight * (SELECT arg_min(unit, (ratio, place)) FROM units WHERE 3e0 * ratio >= unit), 3e0 * source_size) AS target FROM units
        ), ranked AS (
            SELECT p.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate,
                   row_number() OVER (PARTITION BY p.source ORDER BY class, salt, size, doc_id) AS rank,
                   ('0x' || substr(md5('0/' || coalesce('=' || p.source, '')), 1, 8))::UBIGINT / 4294967296e0 AS u
            FROM pieces p JOIN shared s ON p.source IS NOT DISTINCT FROM s.source
        )
        SELECT doc_id, size, source_size, target, (size * (floor(rate * rank + u) - floor(rate * (rank - 1) + u))::BIGINT)::BIGINT AS taken FROM ranked
    """,
    "op10_minhash_near_dedup": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN 'short ' || array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM common JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)
        ), both_ways AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reach AS (
            SELECT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
        ), least AS (
            SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
    """,
    "op12_warc": """
        WITH sized AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM sized
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM firsts
    """,
    "op13_conversation_repair": rf"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
            FROM conversations
        ), dealt AS (
            SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
                          lambda crc, b: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 20 AS hit
            FROM keyed
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                   CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM dealt WHERE hit <> 0
        ), faults AS (
            SELECT *, left(role, 1) AS initial, row_number() OVER ordered AS n,
                   CASE WHEN NOT regexp_matches(text, '{_INK}') THEN 'blank' WHEN row_number() OVER same > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
            FROM damaged
            WINDOW ordered AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy), same AS (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy)
        ), pairs AS (
            SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM faults
        ), counted AS (
            SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM pairs GROUP BY conv_id
        ), ways(place, reached, word, edit, price, lines) AS (VALUES
            {_ways()}
        ), search AS (
            SELECT conv_id, 0::BIGINT AS n, 'start' AS place, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT * FROM (
                SELECT s.conv_id, s.n + 1,
                       CASE WHEN edit = 'D' THEN reached WHEN edit = 'K' AND initial = 's' THEN 'system' WHEN reached = 'user' THEN 'assistant' ELSE 'user' END AS next,
                       s.cost + price + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS total,
                       s.audit || word AS said,
                       list_concat(s.lines, w.lines, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN reached = 'user' THEN 'assistant:' ELSE 'user:' END || text] END)
                FROM search s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n + 1 JOIN ways w USING (place)
                WHERE edit = 'D' OR (coalesce(fault, '') NOT IN ('blank', 'duplicate')
                      AND (edit = 'R' OR (reached = 'user' AND initial = 'a') OR (reached <> 'user' AND initial = 'u') OR (reached = 'start' AND initial = 's')))
                QUALIFY row_number() OVER (PARTITION BY s.conv_id, next ORDER BY total, said) = 1)
        ), ended AS (
            SELECT s.conv_id, cost + price AS cost, audit || replace(word, 'D', '') AS audit, list_concat(s.lines, w.lines) AS lines
            FROM search s JOIN ways w USING (place) LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id
            WHERE s.n = coalesce(rows, 0) AND edit = 'D' AND reached IN ('start', 'assistant')
            QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + price, s.audit || replace(word, 'D', '')) = 1
        )
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
}
