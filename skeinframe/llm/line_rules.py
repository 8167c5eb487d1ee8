"""Operator 4: line-first cleaning.

Each line of a text is judged on its own: by punctuation (a sentence
must end in it, and it must not be made of symbols), as navigation (a menu of short entries
between bars or arrows) and as boilerplate (fixed phrases of site furniture).
Failing lines are removed. A document goes if the removed lines held more than
``MAX_LOST`` of its words, or if it fails the base rules on its whole text
(fewer than ``MIN_WORDS`` words, or over ``MAX_REPEATED`` percent of the words in
5-word windows that occur twice or more).

Each document is judged alone, in one pass: no shuffle.

Defined results: null text counts as empty (all counts 0, base_failed, not
kept); lines without a word are neither judged nor counted and stay; repeated rows get
repeated results; extra columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .bpe import _adding

MIN_WORDS, MAX_REPEATED, MAX_LOST, MAX_SYMBOLS = 10, 20, 0.5, 0.1
SYMBOLS = "#*$%&|<>"  # fixed value of the contract
# Chosen values: what a sentence may end with, what divides menu entries, phrases of site furniture in four languages.
ENDINGS = tuple(".!?…\"'”’»)]:;。！？")
BARS = ("|", "»", "›", "·", ">")
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled", "lorem ipsum", "privacy policy",
    "share on facebook", "sign up for our newsletter", "skip to content", "terms of service", "terms of use", "use of cookies",
    "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "zum inhalt springen", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "aller au contenu", "conditions d'utilisation",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "saltar al contenido", "términos de uso",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I)


def symbol_count(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def line_passes(line: str, words: list[str]) -> bool:
    """The three kinds of rules on one line that has a word."""
    if sum(words.count(b) for b in BARS) >= 3:  # navigation: entries between bars
        return False
    if symbol_count(line) > MAX_SYMBOLS * sum(map(len, words)):  # punctuation: symbols for letters
        return False
    if not any(w.endswith(ENDINGS) for w in words):  # punctuation: no sentence ends in it
        return False
    return not (len(words) <= 40 and _BOILERPLATE.search(line))


def judge(text: str | None) -> dict:
    """Counts, verdict and cleaned text of one document."""
    text = text or ""
    n_words = chars = dup = kept_words = 0
    kept_lines, seen, words = [], set(), []
    for line in text.split("\n"):
        own = common.words_of(line)
        if not own:
            kept_lines.append(line)
            continue
        words += own
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_passes(line, own):
            kept_words += len(own)
            kept_lines.append(line)
    n_words, chars = len(words), sum(map(len, words))
    repeated = 0
    if n_words >= 6:
        known = common.kept("words").setdefault("words", common.WordHashes())
        h = common.window_hashes(words, known)
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[back] > 1)
        if len(at):
            edge = np.zeros(n_words + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeated = int((np.cumsum(edge) > 0).sum())
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED * n_words
    lost = 1 - kept_words / n_words if n_words else 1.0
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbol_count(text), "n_dup_lines": dup, "n_repeat_words": repeated,
        "base_failed": failed, "lost_share": lost, "kept": not failed and lost <= MAX_LOST, "clean_text": "\n".join(kept_lines),
    }


_KINDS = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(),
    "base_failed": T.BooleanType(), "lost_share": T.DoubleType(), "kept": T.BooleanType(), "clean_text": T.StringType(),
}
_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def apply_rules(df: DataFrame, columns: list[str] | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the counts, base_failed, lost_share, kept and clean_text (or only ``columns`` of them)."""
    common.ship(df.sparkSession)
    chosen = columns or list(_KINDS)

    def pairs(texts):
        found = [judge(t) for t in texts]
        return [([x[c] for x in found], _ARROW[_KINDS[c].simpleString()]) for c in chosen]

    return _adding(df, text, [T.StructField(c, _KINDS[c]) for c in chosen], pairs, keep_text)
