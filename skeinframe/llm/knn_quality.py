"""Operator 5: quality by nearest-neighbour voting in a latent-semantic space.

``fit`` takes at most ``MAX_LABELLED`` labelled documents (half of them of each
label where there are enough; those with the smallest hashes of their ids, so
the sample doesn't depend on the order or number of files), counts terms in hash
buckets on the executors, weights them by inverse document frequency, and keeps
the leading ``DIMENSIONS`` singular directions (seeded randomised SVD). The model
is the projection and the labelled vectors: its size is bounded by these three
parameters whatever the corpus, so it can be broadcast.

``score`` computes, block by block, the exact cosine of every document with
every labelled vector and lets the ``NEIGHBOURS`` nearest vote, weighted by
similarity. It is one pass without a shuffle.

Terms are words, their shapes (runs of letter case, digits and each other
character), and marks for repeated lines and repeated word triples; whole texts
count. doc_id, lang, source and labels are never inputs of a score.

Defined results: a text without words (null or empty too) has no vector and gets
the prior (the labelled share of label 1, or 0.5 without labels of one kind);
similarities count to ``DIGITS`` decimals and ties among neighbours go to the labelled
row that comes first by id hash, so repeated rows get equal scores whatever block
they are in; labels that are null are not learned from.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import _adding

BUCKETS, DIMENSIONS, NEIGHBOURS, MAX_LABELLED, BLOCK, DIGITS = 4096, 48, 15, 3000, 256, 6
_SHAPES = ((re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), "AA"), (re.compile(r"\d+"), "9"))


def _term(word: str, known: dict) -> tuple[int, int]:
    """Buckets of a word and of its shape."""
    got = known.get(word)
    if got is None:
        shape = word
        for pattern, by in _SHAPES:
            shape = pattern.sub(by, shape)
        got = (zlib.crc32(b"w" + word.lower().encode()) % BUCKETS, zlib.crc32(b"s" + shape.encode()) % BUCKETS)
        if len(known) > 200_000:
            known.clear()
        if len(word) <= 64:
            known[word] = got
    return got


def term_counts(text: str | None) -> dict[int, float]:
    words = common.words_of(text)
    out: dict[int, float] = {}
    known = common.kept("terms")
    for word, n in Counter(words).items():
        a, b = _term(word, known)
        out[a] = out.get(a, 0) + n
        out[b] = out.get(b, 0) + 2 * n
    lines = Counter(x for x in (text or "").split("\n") if x.strip())
    again = sum(n - 1 for n in lines.values())
    if again:
        out[zlib.crc32(b"repeated line") % BUCKETS] = 50.0 * again / sum(lines.values())
    if len(words) > 6:
        triples = len(words) - 2
        again = triples - len(set(zip(words, words[1:], words[2:], strict=False)))
        if again:
            out[zlib.crc32(b"repeated triple") % BUCKETS] = 50.0 * again / triples
    return out


def rows_of(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Term vectors of a block: log-damped counts times weights, unit length; zero without terms."""
    m = np.zeros((len(texts), BUCKETS), np.float32)
    for row, t in zip(m, texts, strict=True):
        c = term_counts(t)
        if c:
            row[np.fromiter(c.keys(), np.int64, len(c))] = np.log1p(np.fromiter(c.values(), np.float32, len(c)))
    return unit(m * weights)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def learnable(doc_id: Column) -> Column:
    """Rows that labels may be learned from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) != 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> dict:
    """The model: term weights, projection, labelled unit vectors, their labels, and the prior."""
    common.ship(docs.sparkSession)
    usable = labels.filter(learnable(F.col("doc_id")) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if len(shares) == 2 else 0.5
    per = {y: min(n, max(max_labelled // 2, max_labelled - shares.get(1 - y, 0))) for y, n in shares.items()}
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    # Each half is a bounded top-k by hash, so the broadcast side of the join has at most max_labelled rows.
    picked = None
    for y, n in sorted(per.items()):
        half = usable.filter(F.col("y") == y).dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(n)
        picked = half if picked is None else picked.unionByName(half)
    found = []
    if picked is not None:
        rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

        def run(batches):
            for batch in common.slices(batches, "text"):
                got = [term_counts(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([list(c) for c in got], pa.list_(pa.int32())), pa.array([list(c.values()) for c in got], pa.list_(pa.float32()))],
                    names=["doc_id", "y", "terms", "counts"],
                )

        vectors = rows.select("doc_id", "text", "y").mapInArrow(common.tidy(run), "doc_id long, y int, terms array<int>, counts array<float>")
        found = vectors.filter(F.size("terms") > 0).withColumn("o", order).orderBy("o", "doc_id").limit(max_labelled).collect()  # bounded by max_labelled rows of at most BUCKETS terms
    m = np.zeros((len(found), BUCKETS), np.float32)
    for row, r in zip(m, found, strict=True):
        row[np.array(r["terms"], np.int64)] = np.log1p(np.array(r["counts"], np.float32))
    weights = (np.log((1 + len(found)) / (1 + (m > 0).sum(0))) + 1).astype(np.float32)
    m = unit(m * weights)
    projection = latent(m, DIMENSIONS)
    return {"weights": weights, "projection": projection, "vectors": unit(m @ projection), "y": np.array([r["y"] for r in found], np.float32), "prior": prior}


def latent(m: np.ndarray, k: int) -> np.ndarray:
    """The leading k right singular directions (randomised SVD: seeded, four power steps)."""
    if not len(m):
        return np.zeros((BUCKETS, 1), np.float32)
    k = min(k, *m.shape)
    q = m.T @ np.random.default_rng(7).standard_normal((len(m), min(len(m), k + 10))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(q)
        q = m.T @ (m @ q)
    q, _ = np.linalg.qr(q)
    _, _, vt = np.linalg.svd(m @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt.T)[:, :k]).astype(np.float32)


def vote(model: dict, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of texts; exact cosines, one block of documents at a time."""
    out = np.full(len(texts), model["prior"])
    if not len(model["vectors"]):
        return out
    projection, vectors = model["projection"].astype(np.float64), model["vectors"].astype(np.float64)
    for at in range(0, len(texts), BLOCK):
        q = unit(rows_of(texts[at : at + BLOCK], model["weights"]).astype(np.float64) @ projection)
        sims = np.rint(q @ vectors.T * 10**DIGITS).astype(np.int64)
        k = min(neighbours, sims.shape[1])
        keys = sims * len(vectors) - np.arange(len(vectors))  # all different: by similarity, then place
        near = np.argpartition(-keys, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(keys, near, 1), axis=1), 1)
        w = np.maximum(np.take_along_axis(sims, near, 1), 0) / 10**DIGITS
        total = w.sum(1)
        share = np.divide((w * model["y"][near]).sum(1), total, out=np.full(len(w), model["prior"]), where=total > 0)
        out[at : at + BLOCK] = share
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: dict, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)."""
    spark = docs.sparkSession
    common.ship(spark)
    size = sum(v.nbytes for v in model.values() if isinstance(v, np.ndarray))
    if size > 64 << 20:
        raise ValueError(f"the model has {size} bytes; its parameters bound it to 64 MB")
    shared = spark.sparkContext.broadcast(model)

    def pairs(texts):
        s = vote(shared.value, texts)
        return [(s.tolist(), pa.float64()), ([int(x >= 0.5) for x in s], pa.int32())]

    return _adding(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], pairs, keep_text)
