"""SQL for the rows of operators 1 and 8."""

from __future__ import annotations

import string

from . import common

# Fixed value: the alphabet of base32.
BASE32 = string.ascii_uppercase + "234567"


def warc_zip_sql() -> str:
    """A SHA-1 has 160 bits: eight groups of five hexadecimal digits, each of them four base32 characters."""
    group = "('0x' || substr(h, 5 * (i // 4)::INTEGER + 1, 5))::BIGINT"
    base32 = f"array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + (({group} >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '')"
    return f"""
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
    SELECT *, max(page_id) OVER (PARTITION BY h, n) AS kept FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, {base32} AS payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < kept THEN kept END AS refers_to
FROM g
"""


def hyperminhash_sql(percent: int = 85) -> str:
    """All pairs that share a shingle, by an inverted index of the shingles themselves; components by reachability."""
    return rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{common.WORD}') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
    FROM d
), n AS (
    SELECT doc_id, len(g) AS n FROM s
), u AS (
    SELECT doc_id, unnest(g) AS x FROM s
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= {percent} * (p.n + q.n - m)
), ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT a AS doc_id, a AS r FROM ways UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON reached.r = ways.a
), least AS (
    SELECT doc_id, min(r) AS c FROM reached GROUP BY doc_id
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(c, n.doc_id) AS component_id, coalesce(c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN least ON n.doc_id = least.doc_id
"""
