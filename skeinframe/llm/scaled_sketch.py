"""Operator 2: threshold-scaled document fingerprints, in SQL functions only.

A document's sketch is every distinct hash of its 5-word shingles that lies
below a fixed share (1/``SCALE``) of the hash range. The same hashes survive in
every document, so sketches can be merged by union, and the overlap of two gives
unbiased containment and likeness even for very unequal lengths. A document of
fewer than five words has one shingle, its whole word sequence.

A sketch is (whole, hashes). Of a document with at most ``FEW`` shingles the share
is the whole range: it keeps them all, and ``whole`` says so. Two whole sketches are
compared exactly; a whole one and another are both cut to the common threshold
first, so that no hash counts that the other would not have kept. Then the same rule
holds for every pair: of both documents the hashes below one threshold.

All of it is row-local: one scan, no shuffle, no Python.

Defined results: null text counts as empty; a text without words has the empty
sketch (fingerprint ''); two sketches without a hash in the common range have likeness 1, one
with and one without 0; containment is 1 for a text without words and null where
the common range holds no hash of it; equal texts have equal fingerprints; repeated rows get repeated
results; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WIDTH, SCALE, FEW = 5, 2, 64


def words(text: Column) -> Column:
    """The words of a text (anything between the six white-space characters)."""
    blanks = F.translate(F.coalesce(text, F.lit("")), common.SPACES, " " * 6)
    return F.array_remove(F.split(blanks, " "), "")


def sketch(text: Column, scale: int = SCALE, width: int = WIDTH) -> Column:
    """(whole, hashes): the sorted distinct shingle hashes below 1/scale of the range, or all of at most ``FEW``."""
    # Word hashes once, then a shingle's hash from them: no strings are built per shingle.
    h = F.transform(words(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(width)]))
        return F.when(F.size(h) >= width, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # let() keeps each intermediate array evaluated once per row.
    return _let(_let(_let(h, shingles), F.array_distinct), lambda s: _sketch(F.size(s) <= FEW, s, scale))


def _sketch(whole: Column, hashes: Column, scale: int) -> Column:
    return F.struct(whole.alias("whole"), F.array_sort(F.when(whole, hashes).otherwise(_below(hashes, scale))).alias("hashes"))


def _below(hashes: Column, scale: int) -> Column:
    """The hashes below 1/scale of the range."""
    return F.filter(hashes, lambda x: x <= F.lit(-(1 << 63) + (1 << 64) // scale - 1))


def _common(a: Column, b: Column, scale: int) -> tuple[Column, Column]:
    """Hashes of both sketches in the range that both kept."""
    whole = a["whole"] & b["whole"]
    return tuple(F.when(whole | ~x["whole"], x["hashes"]).otherwise(_below(x["hashes"], scale)) for x in (a, b))


def _let(value: Column, body) -> Column:
    """``body`` applied to one evaluated ``value``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(s: Column) -> Column:
    """The sketch as text: its hashes in 16 hexadecimal digits each, in order; after a ``=`` if they are the whole set."""
    digits = F.array_join(F.transform(s["hashes"], lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.when(s["whole"] & (F.size(s["hashes"]) > 0), F.concat(F.lit("="), digits)).otherwise(digits)


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity of two sketches."""

    def share(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"])).cast("double")
        union = F.size(p["a"]) + F.size(p["b"]) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both / union)

    a, b = _common(a, b, scale)
    return _let(F.struct(a.alias("a"), b.alias("b")), share)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has too."""
    none = a["whole"] & (F.size(a["hashes"]) == 0)
    x, y = _common(a, b, scale)

    def share(p: Column) -> Column:
        return F.when(F.size(p["a"]) > 0, F.size(F.array_intersect(p["a"], p["b"])) / F.size(p["a"]).cast("double"))

    return F.when(none, F.lit(1.0)).otherwise(_let(F.struct(x.alias("a"), y.alias("b")), share))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents' shingles together, as if of one document."""
    whole = a["whole"] & b["whole"]
    return _let(F.array_union(a["hashes"], b["hashes"]), lambda s: _sketch(whole & (F.size(s) <= FEW), s, scale))


def with_next_text(docs: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``: that of the next row by ascending
    doc_id, after the last the first. Ranges of doc_id are windows of their own; the
    first row of each range also goes, as a ghost, to the end of the range before it,
    so no window holds more than one range. Equal doc_ids are ordered by text; null
    doc_ids come first."""
    splits = common.range_splits(docs, "doc_id", max(64, common.input_bytes(docs) // range_bytes))
    n = max(1, len(splits))
    at = common.range_of(F.col("doc_id"), splits)
    # A row is the first of its range if its id is the range's split.
    heads = F.element_at(F.lit(splits).cast("array<bigint>"), F.col("__at") + 1) == F.col("doc_id").cast("bigint") if splits else F.lit(False)
    heads = F.coalesce(heads, F.lit(False))
    # Where null ids exist they precede the first split, in range 0, and one of them is the first row of all.
    first_null = docs.filter(F.col("doc_id").isNull()).limit(1).count() > 0
    ghost_of_last = F.col("doc_id").isNull() if first_null else F.col("doc_id").eqNullSafe(F.lit(splits[0]) if splits else F.lit(None))
    spread = F.when(ghost_of_last, F.array(F.struct(F.col("__at").alias("r"), F.lit(0).alias("g")), F.struct(F.lit(n - 1).alias("r"), F.lit(1).alias("g"))))
    spread = spread.when(heads & (F.col("__at") > 0), F.array(F.struct(F.col("__at").alias("r"), F.lit(0).alias("g")), F.struct((F.col("__at") - 1).alias("r"), F.lit(1).alias("g"))))
    spread = spread.otherwise(F.array(F.struct(F.col("__at").alias("r"), F.lit(0).alias("g"))))
    rows = docs.select("doc_id", "text", at.alias("__at")).select("doc_id", "text", F.explode(spread).alias("s")).select("doc_id", "text", "s.r", "s.g")
    order = Window.partitionBy("r").orderBy("g", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return rows.withColumn("next_text", F.lead("text").over(order)).filter("g = 0").drop("r", "g")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/4) code points replaced by the first as many (or all) of ``following``."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    cut = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, scale: int = SCALE, text: str = "text") -> DataFrame:
    """``docs`` with ``sketch`` and ``fingerprint``."""
    return docs.withColumn("sketch", sketch(F.col(f"`{text}`"), scale)).withColumn("fingerprint", fingerprint(F.col("sketch")))
