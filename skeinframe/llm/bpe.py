"""Operator 7: byte-level BPE encoding and decoding.

Every pre-token is merged with a segment tree over its byte positions. Leaf i
holds (rank of the pair that starts at i, i); an inner node holds the smaller
of its children, so the root is the leftmost pair of minimum rank. A merge
joins two live neighbours and updates at most three leaves, each in
logarithmic time: a pre-token of n bytes takes O(n log n), however long.

Merged pre-tokens of up to ``KEEP_CHARS`` characters are kept, since most repeat: when
``KEEP_PIECES`` are held, they become the older store, from which those that come again return.
Documents are independent: no shuffle, any executor can redo any split.

Defined results: null text encodes as the empty text (no ids, empty bytes);
repeated rows and ids give repeated results; extra columns pass through
``encode``; columns it adds replace columns of the same names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

KEEP_PIECES, KEEP_CHARS = 300_000, 64


def load_ranks(path: str) -> bytes:
    """The vocabulary file as it is: base64 token, blank, rank on each line."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def pair_ranks(ranks: dict[bytes, int]) -> list[int | None]:
    """Ranks of all pairs of bytes, by 256 * first + second."""
    return [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]


def merge_piece(piece: bytes, ranks: dict[bytes, int], pairs: list[int | None]) -> list[int]:
    """Ids of one pre-token, by leftmost minimum-rank merges on a segment tree."""
    n = len(piece)
    if n == 0:
        return []
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = 1 << (n - 2).bit_length() if n > 2 else 1  # leaves: the pairs that start at 0 to n - 2
    none, mask = 1 << 62, size - 1
    tree = [none] * (2 * size)
    get, i = ranks.get, 0
    for a, b in zip(piece, piece[1:], strict=False):
        r = pairs[a << 8 | b]
        if r is not None:
            tree[size + i] = r * size + i
        i += 1
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 2))  # start of the next live part
    before = list(range(-1, n))
    while tree[1] < none:
        i = tree[1] & mask
        j = after[i]
        k = after[j]
        after[i] = k
        # Leaf j is gone; leaf i, and that of the part before it, have a new right side. Each is put and
        # carried up with the smaller of itself and its sibling, as far as that changes a node.
        r = None
        if k < n:
            before[k] = i
            r = get(piece[i : after[k]])
            x, v = size + j, none
            tree[x] = v
            while x > 1:
                y = tree[x ^ 1]
                if y < v:
                    v = y
                x >>= 1
                if tree[x] == v:
                    break
                tree[x] = v
        x, v = size + i, none if r is None else r * size + i
        tree[x] = v
        while x > 1:
            y = tree[x ^ 1]
            if y < v:
                v = y
            x >>= 1
            if tree[x] == v:
                break
            tree[x] = v
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            x, v = size + h, none if r is None else r * size + h
            if tree[x] != v:
                tree[x] = v
                while x > 1:
                    y = tree[x ^ 1]
                    if y < v:
                        v = y
                    x >>= 1
                    if tree[x] == v:
                        break
                    tree[x] = v
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder over one vocabulary; a task's Python worker keeps it."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        self.ranks = parse_ranks(raw)
        self.pairs = pair_ranks(self.ranks)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.digits = {v: str(v) for v in self.tokens}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a pre-token that isn't in the newer store."""
        got = self.older.get(piece)
        if got is None:
            got = tuple(merge_piece(piece.encode(), self.ranks, self.pairs))
        if len(piece) <= KEEP_CHARS:
            if len(self.known) >= KEEP_PIECES:
                self.known, self.older = {}, self.known
            self.known[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.find(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    found[k] = self.known.get(pieces[k]) or self._piece(pieces[k])
        return list(chain.from_iterable(found))

    def joined(self, ids: list[int]) -> str:
        """Decimal ids joined by one blank."""
        return " ".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(raw: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(raw).digest(), pattern)
    held = common.kept("bpe")
    if key not in held:
        held.clear()
        held[key] = Codec(raw, pattern)
    return held[key]


def _adding(df: DataFrame, text: str, new: list[T.StructField], pairs, keep_text: bool = True) -> DataFrame:
    """Appends the columns ``new``, computed from ``text`` by ``pairs(list)``, which returns (values, type) for each."""
    names = {f.name.lower() for f in new} | ({text.lower()} if not keep_text else set())
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    source = df.select(*[df[f"`{f.name}`"] for f in kept], df[f"`{text}`"].alias("__text"))
    schema = T.StructType([*kept, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "__text"):
            made = pairs(batch.column("__text").to_pylist())
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(v, t) for v, t in made]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return source.mapInArrow(common.tidy(run), schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` (array<int>) of every whole text."""
    spark: SparkSession = df.sparkSession
    common.ship(spark)
    raw = spark.sparkContext.broadcast(load_ranks(vocabulary))  # one vocabulary file: a fixed size

    def pairs(texts):
        c = codec(raw.value, pattern)
        return [([c.encode(t) for t in texts], pa.list_(pa.int32()))]

    return _adding(df, text, [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))], pairs)


def encode_digest(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without the text and with n_tokens, ids_sha256 and, after decoding the ids, decoded_sha256."""
    spark: SparkSession = df.sparkSession
    common.ship(spark)
    raw = spark.sparkContext.broadcast(load_ranks(vocabulary))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def pairs(texts):
        c = codec(raw.value, pattern)
        n, ids_sha, decoded_sha = [], [], []
        for t in texts:
            ids = c.encode(t)
            n.append(len(ids))
            ids_sha.append(sha(c.joined(ids).encode()))
            decoded_sha.append(sha(c.decode(ids)))
        return [(n, pa.int64()), (ids_sha, pa.string()), (decoded_sha, pa.string())]

    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _adding(df, text, new, pairs, keep_text=False)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of its ids; null ids give empty bytes."""
    spark: SparkSession = df.sparkSession
    common.ship(spark)
    raw = spark.sparkContext.broadcast(load_ranks(vocabulary))
    kept = [f for f in df.schema.fields if f.name.lower() != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        c = codec(raw.value, "")
        for batch in batches:
            made = [c.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[f.name for f in schema.fields])

    return df.select(*[df[f"`{f.name}`"] for f in kept]).mapInArrow(common.tidy(run), schema)
