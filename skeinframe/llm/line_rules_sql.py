"""SQL for the digest columns of operator 4, built from the same fixed values."""

from __future__ import annotations

from . import common, line_rules


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def line_rules_sql() -> str:
    """One row per row of ``documents``; lists are kept by row, so equal doc_ids stay apart."""
    word, symbols = common.WORD, f"[^{line_rules.SYMBOLS}]"
    return rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT r, doc_id, text, regexp_extract_all(text, '{word}') AS words,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: {{'line': x, 'own': regexp_extract_all(x, '{word}')}}), lambda s: len(s.own) > 0) AS lines
    FROM d
), windows AS (
    SELECT r, p, words[p:p + 4] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS p FROM w WHERE len(words) > 5)
), twice AS (
    SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS times FROM windows) WHERE times > 1
), repeats AS (
    SELECT r, count(DISTINCT p + k) AS n FROM (SELECT r, p, unnest(range(0, 5)) AS k FROM twice) GROUP BY r
), judged AS (
    SELECT w.r, w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '{symbols}', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(list_transform(lines, lambda s: s.line))) AS n_dup_lines,
        coalesce(repeats.n, 0) AS n_repeat_words,
        coalesce(list_sum(list_transform(list_filter(lines, lambda s:
            len(list_filter(s.own, lambda x: x IN ({_quoted(line_rules.BARS)}))) < 3
            AND length(regexp_replace(s.line, '{symbols}', '', 'g')) <= {line_rules.MAX_SYMBOLS}::DOUBLE * length(array_to_string(s.own, ''))
            AND len(list_filter(s.own, lambda x: right(x, 1) IN ({_quoted(line_rules.ENDINGS)}))) > 0
            AND NOT (len(s.own) <= 40 AND regexp_matches(s.line, '(?i){'|'.join(line_rules.BOILERPLATE).replace("'", "''")}'))
        ), lambda s: len(s.own))), 0) AS kept_words
    FROM w LEFT JOIN repeats ON w.r = repeats.r
), ruled AS (
    SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEATED} * n_words AS base_failed FROM judged
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND 1 - kept_words::DOUBLE / n_words <= {line_rules.MAX_LOST} AS kept
FROM ruled
"""
