"""Operator 8: near-duplicate groups by HyperMinHash registers, banded.

1. Sketch (one pass): the distinct 5-word shingles of a whole text as 64-bit
   hashes. The top bits of a hash choose one of ``REGISTERS`` buckets; a bucket
   stores its smallest remainder as leading-zero count and ``MANTISSA`` bits.
2. Equal shingle sets (same 128-bit digest) form a class; the row of its smallest
   doc_id stands for it. Thousands of copies become one node here.
3. ``BANDS`` bands of ``ROWS`` compressed registers are keys (an empty register first
   takes the value of a filled one, found by a fixed probe order); nodes that share a
   key are candidates. A pair at similarity 0.80 is missed with probability 3e-8, one
   at 0.85 with 7e-12.
4. Bound. A shingle that no other candidate has is in no intersection. With s other
   shingles of n, a partner has at most ``reach = s (1 + t) / t - n`` shingles, t the
   threshold. Candidates whose keys hold no partner within mutual reach leave. This is exact
   and takes two aggregations, by shingle and by node, with no pairs.
5. Candidates aren't all paired. In each key the node with the largest share of common
   shingles, nearest to what the others have in common, leads and is compared with the members
   within reach. Links are joined into components. A key is done when its members that have not
   led are all in one component. Otherwise members outside its largest component lead
   in rounds, up to ``LEADERS`` a key, then ``LEADERS`` squared and so on, until it is. Two members of different
   components within reach of each other are never left uncompared, so no link that
   matters is lost. Members of one component are compared no more.
6. A pair is first judged by the Jaccard estimate of its registers, corrected for chance
   collisions (dropped only below what a pair at the threshold reaches with a chance of ``MISS``,
   by the binomial tail), then confirmed on the full shingle sets. A leader's
   set travels once for each ``CHUNK`` of its pairs.
7. Components: alternating large-star and small-star steps over the links.

What stays dear: a family of m texts that all lie within reach of each other, yet are not
linked and have no common neighbour, needs about m^2 / 2 comparisons.

Hot keys and hot leaders: keys and shingles are counted with partial aggregation, then joined
from stored tables, so that AQE can split them. Every step's result is stored in the
shared folder; nothing of a size that grows with the corpus reaches the driver.

Defined results: a text without words (null or empty too) has no shingles, is
linked with nothing and is its own component; a null doc_id comes after all others, and a
component of null ids only has a null component_id; rows that repeat a doc_id each
take the component of their own text (classes are nodes, not ids); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REGISTERS, MANTISSA, WIDTH = 256, 10, 5
BANDS, ROWS = 44, 5
PROBES = 256
BROADCAST_ROWS = 2_000_000  # ids (8 bytes each) that may be broadcast; beyond, a shuffled join
LEADERS = 64
CHUNK = 256  # pairs that share one copy of their leader's set
#: Chance that two different minima give equal registers: sum over leading-zero counts of 4^-k, times 2^-MANTISSA.
COLLISION = 2.0**-MANTISSA / 3
MISS = 1e-12  # chance that the registers drop a pair at the threshold: less than that of the bands at 0.80 and 0.85
_ODD = common.mix64(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = common.mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of the lower-cased text."""
    if not text:
        return np.empty(0, np.uint64)
    known = common.kept("words").setdefault("words", common.WordHashes())
    return np.unique(common.window_hashes(common.words_of(common.lower_ascii(text)), known, WIDTH))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Compressed minima of the buckets; 0 marks an empty one. ``hashes`` is sorted."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        bits = REGISTERS.bit_length() - 1
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        first = np.r_[True, bucket[1:] != bucket[:-1]]
        low = (hashes[first] << np.uint64(bits)) >> np.uint64(bits)
        m, e = np.frexp(np.maximum(low, 1).astype(np.float64))
        zeros = np.clip(64 - bits - e, 0, 62)
        out[bucket[first]] = ((zeros + 1) << MANTISSA) | ((m * 2 - 1) * (1 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1)
    return out


def _probes() -> np.ndarray:
    """For each bucket the order in which it looks for a filled one, if it is empty itself."""
    k = np.arange(REGISTERS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(PROBES, dtype=np.uint64)
    return (common.mix64(k + np.uint64(77)) % np.uint64(REGISTERS)).astype(np.int64)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers in which each empty one has the value of the first filled one it looks at: then
    a band of any set, however small, agrees with about the fourth power of the similarity."""
    empty = np.flatnonzero(regs == 0)
    if not len(empty) or len(empty) == REGISTERS:
        return regs
    held = common.kept("words")
    table = held.get("probes")
    if table is None:
        table = held["probes"] = _probes()
    seen = regs[table[empty]]
    at = (seen != 0).argmax(1)
    out = regs.copy()
    got = seen[np.arange(len(empty)), at]
    out[empty] = np.where(got != 0, got, regs[np.flatnonzero(regs)[0]])
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key per band of compressed registers."""
    rows = filled(regs)[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return common.mix64((rows * _ODD).sum(1) ^ _BAND).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates corrected for chance collisions, registers in use) of rows of registers."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1) / np.maximum(used, 1)
    return np.clip((same - COLLISION) / (1 - COLLISION), 0, 1), used


def text_key(docs: DataFrame):
    """With the doc_id it tells rows apart: rows that repeat an id may have different texts."""
    return F.xxhash64(docs["text"].cast("string"))


def fewest_equal(percent: int) -> np.ndarray:
    """By registers in use: the fewest equal ones with which a pair is not dropped."""
    t = percent / 100
    tails = [np.cumsum([math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(n + 1)]) for n in range(REGISTERS + 1)]
    return np.array([int((tail <= MISS).sum()) for tail in tails])


def _digest(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


def sketches(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, tkey, n_shingles, s1, s2, keys) of every row; not stored. s1 and s2 are the digest of the
    shingle set. Sets too small to reach the threshold with any other set have no keys: only equal sets join them."""
    common.ship(docs.sparkSession)
    schema = "doc_id long, tkey long, n_shingles long, s1 long, s2 long, keys array<long>"

    def run(batches):
        for batch in common.slices(batches, "text"):
            n, ids, keys, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                ids.append(_digest(s))
                if 100 * len(s) >= percent * (len(s) + 1):
                    keys.append(band_keys(registers(s)))
                ends.append(len(keys) * BANDS)
            ids, n = np.stack(ids), np.array(n)
            values = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids[:, 0], mask=n == 0), pa.array(ids[:, 1], mask=n == 0), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tkey", "n_shingles", "s1", "s2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(docs).alias("tkey")).mapInArrow(common.tidy(run), schema)


def _shingles(docs: DataFrame, nodes: DataFrame, members: DataFrame, work: common.Tables) -> DataFrame:
    """(rid, n, regs, hashes) of every node in ``members``, read again from its text; stored."""
    ids = work.stored(members.select("rid").distinct().join(nodes.select("rid", "n", "doc_id", "tkey"), "rid"), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"), text_key(docs).alias("__key"))
    few = ids.count() <= BROADCAST_ROWS // 4
    texts = texts.join(F.broadcast(ids) if few else ids, texts["__id"].eqNullSafe(ids["doc_id"]) & (texts["__key"] == ids["tkey"]))
    texts = texts.select("rid", "n", "text").dropDuplicates(["rid"])  # rows that repeat an id and text

    def run(batches):
        for batch in common.slices(batches, "text"):
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([registers(s).tobytes() for s in sets], pa.binary()), lists], names=["rid", "n", "regs", "hashes"])

    return work.stored(texts.mapInArrow(common.tidy(run), "rid long, n long, regs binary, hashes array<long>"), "shingles")


def _within_reach(members: DataFrame, tokens: DataFrame, percent: int, work: common.Tables) -> DataFrame:
    """(key, rid, n, reach, share) of the members that share a key with another one that can be
    a partner. ``share`` is the part of a node's shingles, in millionths, that others have too; stored."""
    alone = tokens.select("rid", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("rid").alias("rid"), F.max("rid").alias("last"))
    alone = alone.filter("rid = last").groupBy("rid").agg(F.count(F.lit(1)).alias("u"))
    common_n = F.col("n") - F.coalesce("u", F.lit(0))
    reach = F.floor(common_n * (100 + percent) / percent + 1e-6) - F.col("n")
    sizes = work.stored(tokens.select("rid", "n").join(alone, "rid", "left").select("rid", "n", reach.alias("reach"), F.floor(common_n * 1_000_000 / F.col("n")).alias("share")), "reach")
    now = members.select("key", "rid").join(sizes, "rid")
    ends = now.groupBy("key").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    now = work.stored(now.join(ends, "key").filter("least <= reach and n <= most").drop("least", "most"), "reaching")
    return work.stored(_several(now, "rid"), "open")


def _several(members: DataFrame, column: str) -> DataFrame:
    """The members whose key holds more than one value of ``column``."""
    keys = members.groupBy("key").agg(F.min(column).alias("x"), F.max(column).alias("y")).filter("x <> y").select("key")
    return members.join(keys, "key", "left_semi")


def _confirmed(pairs: DataFrame, tokens: DataFrame, percent: int, work: common.Tables) -> DataFrame:
    """The pairs (lead, rid) whose full shingle sets reach the threshold; stored. Rows of one leader
    and chunk lie together, the leader's own first."""
    parts = F.ceil(F.col("c") / CHUNK).cast("long").alias("parts")
    chunks = work.stored(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("c")).select("lead", parts), "chunks")
    rows = pairs.join(chunks, "lead").select("lead", F.pmod(F.xxhash64("rid"), "parts").alias("part"), F.lit(1).alias("kind"), "rid").join(tokens, "rid")
    heads = chunks.join(tokens.withColumnRenamed("rid", "lead"), "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("lead").alias("rid"), "regs", "hashes")
    rows = rows.select(*heads.columns).unionAll(heads).repartition("lead", "part").sortWithinPartitions("lead", "part", "kind")
    used = np.maximum(np.arange(REGISTERS + 1), 1)
    least = (fewest_equal(percent) / used - COLLISION) / (1 - COLLISION) - 1e-9

    def run(batches):
        lead, lregs, lset = None, None, None
        for batch in batches:
            found = []
            hashes = batch.column(5)
            ends, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
            regs = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            for k, (a, kind, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                own = values[ends[k] : ends[k + 1]]
                if not kind:
                    lead, lregs, lset = a, regs[k].copy(), own.copy()
                    continue
                if lead != a:
                    raise RuntimeError("a pair without its leader")
                j, n = estimate(lregs[None], regs[k][None])
                if j[0] < least[n[0]]:
                    continue
                both = len(np.intersect1d(lset, own, assume_unique=True))
                if 100 * both >= percent * (len(lset) + len(own) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return work.stored(rows.mapInArrow(common.tidy(run), "a long, b long"), "links")


def components(edges: DataFrame, work: common.Tables | None = None, most: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node of its
    component. Large-star and small-star steps until nothing changes; an error if ``most`` don't suffice."""
    work = work or common.Tables()
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    now = work.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    for _ in range(most):
        again = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (again["n"], again["h"]) == mark or again["n"] == 0:
            break
        mark = (again["n"], again["h"])
        # large star: each larger neighbour of a node is tied to the node's smallest neighbour (or itself)
        ends = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = ends.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = work.stored(large, "cc")
        # small star: each smaller neighbour of a node, and the node, are tied to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = work.stored(small, "cc")
    else:
        raise RuntimeError(f"components have not settled after {most} steps")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(roots)


def _unsettled(members: DataFrame, labels: DataFrame, work: common.Tables) -> DataFrame:
    """``members`` with their component, in keys that hold more than one; stored."""
    now = members.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", "n", "reach", F.coalesce("comp", "rid").alias("comp"))
    return work.stored(_several(now, "comp"), "unsettled")


def _leaders(now: DataFrame, many: int, work: common.Tables) -> DataFrame:
    """Up to ``many`` members of each key outside its largest component; stored."""
    sizes = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    top = sizes.groupBy("key").agg(F.max_by("comp", F.col("c")).alias("top"))
    lot = F.pmod(F.xxhash64("rid", F.lit(many)), F.lit(many))
    lead = now.join(top, "key").filter("comp <> top").groupBy("key", lot.alias("lot")).agg(F.min(F.struct("rid", "comp", "n", "reach")).alias("l"))
    return work.stored(lead.select("key", F.col("l.rid").alias("lead"), F.col("l.comp").alias("lcomp"), F.col("l.n").alias("ln"), F.col("l.reach").alias("lreach")), "leaders")


def _met(now: DataFrame, lead: DataFrame, work: common.Tables) -> DataFrame:
    """Pairs (lead, rid) of a leader and a member of another component, within reach, that share a key it
    leads. Two texts share up to ``BANDS`` keys; the pair comes from the smallest of them only."""
    owned = work.stored(now.groupBy("rid").agg(F.collect_set("key").alias("ks")), "open-keys")  # at most one key per band
    led = work.stored(lead.groupBy("lead").agg(F.collect_set("key").alias("lks")), "led-keys")
    own = led.select(F.col("lead").alias("rid"), F.col("lks").alias("own"))
    x = now.join(owned, "rid").join(own, "rid", "left").withColumnRenamed("key", "k")
    y = lead.join(led, "lead")
    near = (x["k"] == y["key"]) & (x["comp"] != y["lcomp"]) & (x["n"] <= y["lreach"]) & (y["ln"] <= x["reach"])
    once = (F.col("rid") < F.col("lead")) | ~F.coalesce(F.array_contains("own", F.col("k")), F.lit(False))  # two leaders meet once
    first = F.array_min(F.array_intersect("ks", "lks")) == F.col("k")
    return x.join(y, near & once & first).select("lead", "rid")


def _linked(members: DataFrame, tokens: DataFrame, percent: int, work: common.Tables) -> DataFrame:
    """(node, comp) of the nodes that have a link; stored."""
    lead = members.groupBy("key").agg(F.max(F.struct("share", (-F.col("rid")).alias("minus"), "n", "reach")).alias("l"))
    lead = lead.select("key", (-F.col("l.minus")).alias("lead"), F.col("l.n").alias("ln"), F.col("l.reach").alias("lreach"))
    pairs = members.join(lead, "key").filter("rid <> lead and n <= lreach and ln <= reach").select("lead", "rid").distinct()
    pairs = work.stored(pairs, "pairs")
    seen = pairs.select(F.least("lead", "rid").alias("a"), F.greatest("lead", "rid").alias("b"))
    labels = work.stored(components(_confirmed(pairs, tokens, percent, work), work), "labels")
    many = 1
    while True:
        many *= LEADERS
        now = _unsettled(members, labels, work)
        if now.isEmpty():
            return labels
        lead = _leaders(now, many, work)
        pairs = _met(now, lead, work).select("lead", "rid", F.least("lead", "rid").alias("a"), F.greatest("lead", "rid").alias("b"))
        pairs = work.stored(pairs.join(seen, ["a", "b"], "left_anti").distinct(), "pairs")
        if not pairs.isEmpty():
            links = _confirmed(pairs.select("lead", "rid"), tokens, percent, work)
            seen = seen.unionAll(pairs.select("a", "b"))
            if not links.isEmpty():
                labels = work.stored(components(links.unionAll(labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))), work), "labels")
        members = now.drop("comp").join(lead.select("key", F.col("lead").alias("rid")), ["key", "rid"], "left_anti")


def groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    return _grouped(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """``groups`` with two more columns: tkey of the row's text, and group, equal in all rows of a group."""
    work = common.Tables()
    drawn = work.stored(sketches(docs, percent), "sketches")
    classes = drawn.filter("n_shingles > 0").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("doc_id"),
        F.coalesce(F.min_by("tkey", "doc_id"), F.min("tkey")).alias("tkey"),
        F.count(F.lit(1)).alias("copies"),
        F.first("n_shingles").alias("n"),
        F.first("keys").alias("keys"),
    )
    classes = work.stored(classes, "classes")
    # A class is the node named by its smallest id. Where an id names several or is null, they are numbered in the same order.
    odd = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null").limit(1).count() > 0
    if odd:
        nodes = work.stored(classes.orderBy(F.col("doc_id").asc_nulls_last(), "s1", "s2").withColumn("rid", F.monotonically_increasing_id()), "nodes")
    else:
        nodes = classes.withColumn("rid", F.col("doc_id"))

    spread = nodes.select("rid", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("rid").alias("x"), F.max("rid").alias("y")).filter("x <> y").select("key")
    members = work.stored(spread.join(shared, "key").select("key", "rid"), "members")
    tokens = _shingles(docs, nodes, members, work)
    # The second time counts only what the nodes left by the first still have in common.
    members = _within_reach(members, tokens, percent, work)
    tokens = work.stored(tokens.join(members.select("rid").distinct(), "rid", "left_semi"), "shingles")
    members = _within_reach(members, tokens, percent, work)
    labels = _linked(members, tokens, percent, work)

    linked = nodes.join(labels.withColumnRenamed("node", "rid"), "rid", "left").filter("copies > 1 or comp is not null").select("s1", "s2", F.coalesce("comp", "rid").alias("comp"))
    names = nodes.select(F.col("rid").alias("comp"), F.col("doc_id").alias("first")) if odd else None
    linked = work.stored(linked.join(names, "comp") if odd else linked.withColumn("first", F.col("comp")), "named")
    work.drop(but=(drawn, linked))
    out = drawn.select("doc_id", "tkey", "n_shingles", "s1", "s2").join(linked, ["s1", "s2"], "left")
    alone = F.concat_ws(" ", F.lit("t"), "doc_id", "tkey")  # no shingles: equal to nothing but itself
    group = F.coalesce(F.concat(F.lit("c"), F.col("comp").cast("string")), F.concat_ws(" ", F.lit("s"), "s1", "s2"), alone)
    group = F.when(F.col("s1").isNull(), alone).otherwise(group)
    first = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    out = out.select("doc_id", "tkey", "n_shingles", first.alias("component_id"), group.alias("group"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, of the smallest doc_id. What goes is decided by id and text,
    so a text stays that only shares its id with one that goes; rows equal in both count once."""
    found = common.stored(_grouped(docs, percent), "near-groups")
    kept = found.filter("kept")
    # A group's smallest id may stand on several texts of it: one stays.
    several = kept.groupBy("group").agg(F.min("tkey").alias("least"), F.max("tkey").alias("most")).filter("least <> most").select("group", "least")
    others = kept.join(several, "group").filter("tkey <> least")
    gone = found.filter("not kept").select("doc_id", "tkey").unionAll(others.select("doc_id", "tkey")).distinct()
    gone = common.stored(gone.select(F.col("doc_id").alias("__gone"), F.col("tkey").alias("__gone_key")), "removed")
    few = gone.count() <= BROADCAST_ROWS
    rest = docs.withColumn("__tkey", text_key(docs))
    rest = rest.join(F.broadcast(gone) if few else gone, rest["doc_id"].eqNullSafe(gone["__gone"]) & (rest["__tkey"] == gone["__gone_key"]), "left_anti")
    again = kept.groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return (rest.dropDuplicates(["doc_id", "__tkey"]) if again else rest).drop("__tkey")
