"""Operator 10: token counts by rank-synchronous array merging.

Pre-tokens that aren't known yet are gathered over a batch and held as one
ragged numpy array (flat symbol ids plus sequence numbers). In each step every
sequence finds the lowest rank among its adjacent pairs and all sequences apply
their own lowest pair at once; sequences without a mergeable pair leave. What is
left of a sequence is its token count.

Special strings inside texts are handled as the tokenizers library does by
default: each occurrence is one token and splits the text around it.

Defined results: null counts as the empty text (0 bytes, 0 tokens); repeated
rows and ids give repeated results; extra columns pass through and added
columns replace columns of the same names.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .bpe import _adding

KEEP_PIECES, KEEP_CHARS = 500_000, 64
NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the rest count up from code point 256."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    own = {b: chr(b) for b in printable}
    rest = iter(range(256, 512))
    return [own[b] if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    """Counts of many pre-tokens at once."""

    def __init__(self, vocab: dict[str, int], merges: list):
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int64)
        self.v = np.int64(max(vocab.values()) + 1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left * self.v + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.v + right)[order], order.astype(np.int64), made
        # A merge that made a token always has a lower rank than one that uses it in a
        # trained vocabulary; then all occurrences of a sequence's lowest pair go at once.
        first_use = np.full(int(self.v), NO_RANK)
        np.minimum.at(first_use, left, np.arange(len(left)))
        np.minimum.at(first_use, right, np.arange(len(left)))
        self.together = bool((first_use[made] > np.arange(len(made))).all())

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = lengths.copy()
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), lengths)
        while len(ids) > 1:
            same = seq[1:] == seq[:-1]
            rank = np.where(same, self.rank(ids[:-1] * self.v + ids[1:]), NO_RANK)
            starts = np.flatnonzero(np.r_[True, ~same])
            low = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)  # a sequence's last slot is its end: no pair
            live = low < NO_RANK
            if not live.any():
                break
            which = np.cumsum(np.r_[True, ~same]) - 1
            hit = (rank == low[which[:-1]]) & (rank < NO_RANK)
            at = np.flatnonzero(hit)
            if self.together:
                # In a run of overlapping hits (a a a) take every second from its left end.
                head = np.r_[True, (at[1:] != at[:-1] + 1)]
                begin = np.maximum.accumulate(np.where(head, at, 0))
                at = at[(at - begin) % 2 == 0]
            else:
                at = at[np.r_[True, which[at[1:]] != which[at[:-1]]]]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            out -= np.bincount(seq[at], minlength=len(out))
            keep &= live[which]
            ids, seq = ids[keep], seq[keep]
        return out


class Counter:
    """Token counts of texts by one byte-level vocabulary in the tokenizers format."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("byte-level BPE without normalizer or prefix space only")
        self.merger = Merger(model["vocab"], model["merges"])
        added = [t["content"] for t in spec["added_tokens"]]
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their neighbours aren't supported")
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.find = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        extra, split = [], []
        for t in texts:
            t = t or ""
            if self.special is not None and self.special.search(t):
                parts = self.special.split(t)
                extra.append(len(parts) - 1)
                split.append([p for x in parts for p in self.find(x)])
            else:
                extra.append(0)
                split.append(self.find(t))
        known = self.known
        if len(known) > KEEP_PIECES:
            known.clear()
        new = list({p for pieces in split for p in pieces if p not in known})
        made = {}
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            made.update(zip(part, self.merger.counts([p.encode() for p in part]).tolist(), strict=True))
        known.update((p, c) for p, c in made.items() if len(p) <= KEEP_CHARS)
        long = {p: c for p, c in made.items() if len(p) > KEEP_CHARS}
        if not long:
            return [x + sum(map(known.__getitem__, pieces)) for x, pieces in zip(extra, split, strict=True)]
        return [x + sum(known[p] if p in known else long[p] for p in pieces) for x, pieces in zip(extra, split, strict=True)]


def _counter(raw: bytes, pattern: str) -> Counter:
    key = (hashlib.sha256(raw).digest(), pattern)
    held = common.kept("token counts")
    if key not in held:
        held.clear()
        held[key] = Counter(raw, pattern)
    return held[key]


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", limit: int = 1024, keep_text: bool = True) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text."""
    spark = df.sparkSession
    common.ship(spark)
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())  # one vocabulary file: a fixed size

    def pairs(texts):
        n = _counter(raw.value, pattern).count(texts)
        return [([len((t or "").encode()) for t in texts], pa.int64()), (n, pa.int64()), ([x > limit for x in n], pa.bool_())]

    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return _adding(df, text, new, pairs, keep_text)
