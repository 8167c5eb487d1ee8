"""Operator 6: temperature mixing of sources, in DataFrame functions only.

Source i has token share p_i. Its weight is p_i^a over the sum of all p^a; the
exponent a is bisected in [0, 1] until the weights' entropy reaches the target or,
if that comes first, until the source that is repeated most reaches the
repetition limit. Each step of the search evaluates ``WAYS`` exponents at once
with one aggregation over the table of sources, so the number of sources isn't
bounded by the driver and a step returns a few rows.

The weights become budgets of tokens, and a budget is realised as a stream of
block permutations: a source's documents are dealt by seeded hash into blocks; each pass
has its own order of the blocks (a seeded affine permutation of their numbers) and, within a block, its own
hashed order of the documents. A source's stream is its whole passes, then one part pass that
stops at the budget. ``mix_key`` is a use's place in its source's stream, from 0 to 1: sorted by
it, each source runs through its passes block by block, and the sources are interleaved by
their weights all along.

Word counts and hashes of the rows are stored once. Only the block totals of the part pass are summed in
order per source (one row per ``BLOCK_TOKENS`` tokens) and then the documents of the one block where the budget
ends; the result is a place and a hash per source, by which each row decides for
itself. Texts are never shuffled and a source with a third of all rows is no
larger a task than others.

By default the total budget is the least that gives every source one whole
pass: nothing is dropped, and rarer sources are repeated.

Defined results: null sources are one source; null text has no tokens; a source
without any tokens keeps one pass of its rows; repeated rows share a hash and are taken together; an empty
table gives no rows; added columns replace columns of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .scaled_sketch import words

BLOCK_TOKENS, WAYS, STEPS, SEED, PRIME = 2_000_000, 33, 6, 20240301, 2_147_483_647
#: Defaults: the entropy to reach, as a share of what lies between the raw shares' entropy and the equal weights', and the most passes.
ENTROPY_SHARE, MAX_PASSES = 0.5, 4.0


def counted(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(source, hash, n): hash and words of every row; stored, so that texts are read once for them."""
    n, h = _row(source, text, key, seed)
    return common.stored(docs.select(F.col(f"`{source}`").alias("source"), h.alias("hash"), n.alias("n")), "source-rows")


def _row(source: str, text: str, key: str, seed: int):
    return F.size(words(F.col(f"`{text}`"))).cast("long"), F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"))


def shares(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, tokens): the stored table of token totals."""
    return _totals(docs.select(F.col(f"`{source}`").alias("source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("n")))


def _totals(rows: DataFrame) -> DataFrame:
    return common.stored(rows.groupBy("source").agg(F.sum("n").alias("tokens")), "source-tokens")


def _at(sources: DataFrame, total: int, exponents: list[float]) -> list[dict]:
    """Entropy and largest number of passes for each exponent: one aggregation."""
    p = F.col("tokens") / F.lit(float(total))
    grid = F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a")
    w = sources.filter("tokens > 0").select(F.log(p).alias("lp"), grid)
    # entropy of w = e/z, e = p^a: log z - a * sum(e * log p) / z; passes are relative to the source with the fewest, w/p = p^(a-1)/z.
    rows = w.groupBy("a").agg(
        F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"),
        F.sum(F.exp(F.col("a") * F.col("lp")) * F.col("lp")).alias("s"),
        F.max(F.exp((F.col("a") - 1) * F.col("lp"))).alias("most"),
        F.min(F.exp((F.col("a") - 1) * F.col("lp"))).alias("least"),
    )
    return [{"a": r["a"], "z": r["z"], "entropy": math.log(r["z"]) - r["a"] * r["s"] / r["z"], "passes": r["most"] / r["least"], "least": r["least"]} for r in sorted(rows.collect(), key=lambda r: r["a"])]


def exponent(sources: DataFrame, target_entropy: float | None = None, max_passes: float = MAX_PASSES) -> dict:
    """The largest exponent whose weights reach the target entropy, but not below the
    one where a source is repeated more than ``max_passes`` times the least repeated."""
    row = sources.agg(F.sum("tokens").alias("t"), F.count_if(F.col("tokens") > 0).alias("k")).first()
    total, k = row["t"] or 0, row["k"] or 0
    if k == 0:
        return {"a": 1.0, "z": 1.0, "least": 1.0, "entropy": 0.0, "passes": 1.0, "total": 0, "target": 0.0}
    ends = _at(sources, total, [0.0, 1.0])
    target = target_entropy if target_entropy is not None else ends[1]["entropy"] + ENTROPY_SHARE * (math.log(k) - ends[1]["entropy"])
    lo, hi = 0.0, 1.0  # entropy and passes both fall as the exponent grows
    best = ends[1]
    for _ in range(STEPS):
        grid = [lo + (hi - lo) * i / (WAYS - 1) for i in range(WAYS)]
        found = _at(sources, total, grid)
        fits = [x["entropy"] <= target + 1e-12 and x["passes"] >= 1 for x in found]
        allowed = [x["passes"] <= max_passes for x in found]
        # Wanted: the smallest exponent that neither overshoots the entropy nor the passes.
        i = next((i for i, (f, ok) in enumerate(zip(fits, allowed, strict=True)) if f and ok), len(found) - 1)
        best = found[i]
        lo, hi = (grid[i - 1], grid[i]) if i else (grid[0], grid[0])
        if hi <= lo:
            break
    return {**best, "total": total, "target": target}


def mixed(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_passes: float = MAX_PASSES, seed: int = SEED, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row per use: ``mix_pass`` (0-based), ``mix_passes`` (uses of the
    row), ``mix_weight`` (of its source), ``mix_tokens``, ``mix_block`` (its block in its source) and ``mix_key``
    (its place in the source's stream, 0 to 1)."""
    small = counted(docs, source, text, key, seed)
    totals = _totals(small)
    found = exponent(totals, target_entropy, max_passes)
    total = float(found["total"] or 1)
    p = F.col("tokens") / F.lit(total)
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(found["a"]) * F.log(p)) / F.lit(found["z"])).otherwise(F.lit(0.0))
    # The least budget with a whole pass of each source: the least repeated has w * T = its tokens.
    asked = float(budget) if budget is not None else total * found["z"] / found["least"]
    passes = F.when(F.col("tokens") > 0, F.greatest(F.col("w") * F.lit(asked) / F.col("tokens"), F.lit(0.0) if budget is not None else F.lit(1.0))).otherwise(F.lit(1.0))
    # A share of 1e-9 of a pass off a whole number is rounding of the exponent's search.
    whole = F.floor(F.col("passes") + F.lit(1e-9)).cast("int")
    rest = F.greatest(F.lit(0.0), (F.col("passes") - F.col("whole")) * F.col("tokens")).cast("long")
    plan = totals.withColumn("w", weight).withColumn("passes", passes).withColumn("whole", whole).withColumn("rest", rest)
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long"))
    plan = common.stored(plan.select(*[F.col(c).alias(f"__mix_{n}") for c, n in (("source", "source"), ("w", "w"), ("whole", "whole"), ("rest", "rest"), ("blocks", "blocks"), ("passes", "length"))]), "mix-plan")

    m = lambda name: F.col(f"__mix_{name}")
    block = F.pmod(F.xxhash64(F.lit(seed + 1), m("h")), m("blocks"))

    def turn(pass_):
        """Place of the row's block among the blocks of a pass: the factor is a prime above any number of blocks."""
        return F.pmod(m("block") * F.lit(PRIME) + F.pmod(F.xxhash64(F.lit(seed + 2), pass_), m("blocks")), m("blocks"))

    def inner(pass_):
        """Order of the row within its block in a pass, from 0 to 1."""
        return F.pmod(F.xxhash64(F.lit(seed + 3), pass_, m("h")), F.lit(1 << 52)) / float(1 << 52)

    # The part pass of each source ends at one block and, in that block, at one row: two small
    # tables give both, and then every row decides for itself.
    small = small.select(F.col("source").alias("__mix_of"), F.col("hash").alias("__mix_h"), F.col("n").alias("__mix_n"))
    part = small.join(plan.filter("__mix_rest > 0"), F.col("__mix_of").eqNullSafe(F.col("__mix_source"))).withColumn("__mix_block", block)
    part = part.select("__mix_source", "__mix_rest", "__mix_n", turn(m("whole")).alias("at"), inner(m("whole")).alias("u"))
    blocks = part.groupBy("__mix_source", "__mix_rest", "at").agg(F.sum("__mix_n").alias("bn"))
    upto = F.sum("bn").over(Window.partitionBy("__mix_source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumn("before", upto - F.col("bn")).filter("before < __mix_rest and before + bn >= __mix_rest")
    cuts = common.stored(blocks.select(F.col("__mix_source").alias("__mix_cut"), F.col("at").alias("__mix_end"), "before"), "mix-cuts")
    last = part.join(cuts, F.col("__mix_source").eqNullSafe(F.col("__mix_cut")) & (F.col("at") == F.col("__mix_end")))
    last = last.groupBy("__mix_source", "u", "before", "__mix_rest").agg(F.sum("__mix_n").alias("hn"))
    within = F.sum("hn").over(Window.partitionBy("__mix_source").orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("hn")
    ends = last.withColumn("pos", F.col("before") + within).filter("pos < __mix_rest").groupBy(F.col("__mix_source").alias("__mix_ended")).agg(F.max("u").alias("__mix_u"))
    full = plan.join(cuts.drop("before"), F.col("__mix_source").eqNullSafe(F.col("__mix_cut")), "left")
    full = common.stored(full.join(ends, F.col("__mix_source").eqNullSafe(F.col("__mix_ended")), "left").drop("__mix_ended", "__mix_cut"), "mix-plan")

    added = {"mix_pass", "mix_passes", "mix_weight", "mix_tokens", "mix_block", "mix_key"}
    names = [c for c in docs.columns if c.lower() not in added]
    n, h = _row(source, text, key, seed)
    # One row per source: Spark broadcasts the plan while its size allows and otherwise splits hot sources (AQE).
    rows = docs.withColumns({"__mix_n": n, "__mix_h": h, "__mix_of": F.col(f"`{source}`")}).join(full, F.col("__mix_of").eqNullSafe(F.col("__mix_source")), "left")
    rows = rows.withColumn("__mix_block", block)
    used = (turn(m("whole")) < m("end")) | ((turn(m("whole")) == m("end")) & (inner(m("whole")) <= m("u")))
    more = F.when((m("rest") > 0) & F.coalesce(used, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("__mix_uses", (m("whole") + more).cast("int")).filter("__mix_uses > 0")
    rows = rows.withColumn("__mix_pass", F.explode(F.sequence(F.lit(0), m("uses") - 1)))
    place = (m("pass") + (turn(m("pass")) + inner(m("pass"))) / m("blocks")) / F.greatest(m("length"), m("pass") + F.lit(1e-9))
    keep = [F.col(f"`{c}`") for c in names]
    return rows.select(
        *keep, m("pass").alias("mix_pass"), m("uses").alias("mix_passes"), m("w").alias("mix_weight"), m("n").alias("mix_tokens"),
        m("block").alias("mix_block"), F.least(place, F.lit(1.0)).alias("mix_key"),
    )
