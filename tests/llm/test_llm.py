"""The training-data operators against brute force, libraries and round trips, with odd rows."""

import base64
import hashlib
import io
import math
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skeinframe.llm import bpe, external_shuffle, hyperminhash, knn_quality, line_rules, queries, repair_store, scaled_sketch, temperature_mix, token_counts, warc_zip

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_rows():
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["changed"] + base[31:]
    return [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, ""), (5, None), (6, "one two"), (7, "One TWO"), (8, " ".join(base)), (9, "x " * 9000), (None, "no id here at all"), (10, "a\x1cb\xa0c d\n\n e"), (8, " ".join(base))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", t) for i, t in odd_rows()], "doc_id long, text string, source string, kept string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts():
    return dict(zip(*pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))


def sets_of(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(items, percent):
    parent = {k: k for k in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(items)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = items[a], items[b]
            m = len(x & y)
            if x and y and 100 * m >= percent * (len(x) + len(y) - m):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in items}


@pytest.mark.parametrize(("percent", "leaders"), [(85, 64), (80, 2)])
def test_near_groups(docs, percent, leaders, monkeypatch):
    monkeypatch.setattr(hyperminhash, "LEADERS", leaders)
    items = {k: sets_of(t) for k, t in texts().items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in hyperminhash.groups(docs, percent).collect()}
    want = components(items, percent)
    assert got == {k: (len(items[k]), want[k], want[k] == k) for k in items}


@pytest.mark.parametrize(("percent", "leaders"), [(80, 64), (85, 2)])
def test_near_group_without_a_centre(spark, percent, leaders, monkeypatch):
    """Chains, a star of edits without its centre, and a shared passage: links that no leader of the first round has."""
    monkeypatch.setattr(hyperminhash, "LEADERS", leaders)
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows, now = [], base
    for k in range(40):
        now = list(now)
        now[rng.randrange(120)] = f"c{k}"
        rows.append((k, " ".join(now)))
    for k in range(40, 160):
        own = list(base)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(120)] = rng.choice([f"s{k}", "s", "also"])
        rows.append((k, " ".join(own[: rng.choice([120, 110])])))
    for k in range(160, 200):
        rows.append((k, " ".join([*base[:40], *(f"p{k}-{i}" for i in range(60))])))
    items = {k: sets_of(t) for k, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    want = components(items, percent)
    assert got == want and 2 < len(set(want.values())) - 40 < 110


def test_near_groups_odd_rows(odd, spark):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in hyperminhash.groups(odd.select("doc_id", "text"), 85).collect()}
    assert got[(3, 56)] == 1 and got[(8, 56)] == 1 and got[(4, 0)] == 4 and got[(5, 0)] == 5 and got[(7, 1)] == 6 and got[(None, 1)] is None
    kept = hyperminhash.keep_one(odd, 80).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == [1, 4, 5, 6, 9, 10]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hyperminhash.groups(empty).count() == 0


def test_keep_one_by_row(spark):
    """Repeated and null ids: what is no duplicate stays, and of each group one row."""
    long = lambda k: " ".join(f"{k}{i}" for i in range(80))
    near = lambda k: long(k).replace(f"{k}40", "changed")
    rows = [(1, long("a")), (2, long("a")), (2, long("b")), (3, near("a")), (3, long("c")), (4, long("d")), (4, long("e")), (5, near("e")), (6, long("f")), (6, long("f")), (6, near("f"))]
    rows += [(None, long("g")), (None, long("h")), (None, long("h")), (None, long("a")), (7, ""), (7, ""), (7, None), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = hyperminhash.keep_one(df.withColumn("more", F.lit(1)), 80)
    assert got.columns == ["doc_id", "text", "more"]
    got = Counter((r["doc_id"], r["text"]) for r in got.collect())
    f = [k for k in got if k[0] == 6]
    assert len(f) == 1 and f[0][1] in (long("f"), near("f"))
    want = [(1, long("a")), (2, long("b")), (3, long("c")), (4, long("d")), (4, long("e")), (None, long("g")), (None, long("h")), (7, ""), (7, None), (None, ""), (None, None)]
    assert got == Counter([*want, *f])
    ids = {(r["doc_id"], r["component_id"]) for r in hyperminhash.groups(df, 80).collect()}
    assert {(3, 1), (3, 3), (5, 4), (2, 1), (2, 2), (None, 1)} <= ids


def test_register_estimate():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)]))
    j, _ = hyperminhash.estimate(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None])
    assert abs(j[0] - 3000 / 5000) < 0.2


@pytest.mark.parametrize(("percent", "band"), [(80, 3e-8), (85, 7e-12)])
def test_register_filter_misses_less_than_bands(percent, band):
    n, t = hyperminhash.REGISTERS, percent / 100
    few = hyperminhash.fewest_equal(percent)
    miss = lambda n: sum(math.comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(int(few[n])))
    assert max(map(miss, range(n + 1))) < band and 0.5 < few[n] / n < t


def test_components_settle_or_fail(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long")
    assert {r["comp"] for r in hyperminhash.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        hyperminhash.components(chain, most=2)


def fuzz():
    rng = random.Random(1)
    letters = list("ab aA\n\t  éÉΣσß漢字😀\x1c\x85\xa0 0١'st!!́<|endoftext|>")
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 3000, " " * 2000, "ab" * 2000, "<|endoftext|>x<|endoftext|>"]


def test_byte_bpe(docs, odd):
    import tiktoken

    raw = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    ranks = bpe.parse_ranks(raw)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(raw, P.PATTERN)
    for t in [*fuzz(), *texts().values()]:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t) and own.decode(ids) == t.encode()
    rows = bpe.encode(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = bpe.decode(rows, P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(rows) == len(odd_rows()) and all((r["text"] or "").encode() == bytes(r["decoded"]) for r in rows)
    digest = lambda t: (len(i := lib.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = queries.op7_byte_bpe(docs.sparkSession, SMALL).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted((k, *digest(t)) for k, t in texts().items())
    got = bpe.encode_digest(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select(columns).collect()
    assert Counter(map(tuple, got)) == Counter((k, *digest(t)) for k, t in odd_rows())
    assert bpe.encode_digest(odd.filter("doc_id < 0"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_counts.Counter(open(path, "rb").read(), P.PATTERN)
    every = [*fuzz(), *texts().values(), "", None]
    assert own.count(every) == [len(e.ids) for e in lib.encode_batch([t or "" for t in every], add_special_tokens=False)]
    own.merger.together = False
    own.known.clear()
    assert own.count(every[:300]) == [len(e.ids) for e in lib.encode_batch(every[:300], add_special_tokens=False)]
    got = queries.op10_token_counts(spark, SMALL).collect()
    n = {k: len(lib.encode(t, add_special_tokens=False).ids) for k, t in texts().items()}
    assert {tuple(r[c] for c in ("doc_id", "n_bytes", "n_tokens", "over_limit")) for r in got} == {(k, len(t.encode()), n[k], n[k] > 1024) for k, t in texts().items()} and len(got) == len(n)
    clash = spark.createDataFrame([(k, t, "x") for k, t in odd_rows()], "doc_id long, text string, n_tokens string")
    rows = token_counts.count_tokens(clash, path, P.PATTERN, limit=1024, keep_text=False)
    assert rows.columns.count("n_tokens") == 1
    got = Counter((r["doc_id"], r["n_tokens"]) for r in rows.collect())
    assert got == Counter((k, len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t in odd_rows())
    assert token_counts.count_tokens(clash.filter("doc_id < 0"), path, P.PATTERN, limit=1024).count() == 0


def test_id_files(spark, odd):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    own = repair_store.ChunkEncoder(open(path, "rb").read())
    for t in fuzz():
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t
    start, want = 0, {}
    for k, t in sorted(texts().items()):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op9_repair_store(spark, SMALL).collect()}
    assert got == want
    stored = repair_store.write(odd.select("doc_id", "text"), path, file_bytes=1 << 12)
    rows = sorted(repair_store.read(stored, with_ids=True).collect(), key=lambda r: r["start"])
    want = {t: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for _, t in odd_rows()}
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((k, tuple(want[t])) for k, t in odd_rows())
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    assert [r["doc_id"] for r in rows] == [None, *sorted(k for k, _ in odd_rows() if k is not None)] and stored.count() > 1
    for k, t in odd_rows():
        if k is not None:
            found = repair_store.read_range(stored, k, 3, 9)
            assert len(found) == sum(k == x for x, _ in odd_rows()) and all(f.tolist() == want[t][3:9] for f in found)
    assert repair_store.read_range(stored, 12345, 0, 5) == []
    assert repair_store.read(repair_store.write(odd.filter("doc_id < 0"), path)).count() == 0


def test_grammar_random_access():
    rng = np.random.default_rng(2)
    docs = [(k, np.append(rng.integers(2, 40, rng.integers(0, 900)), 1).astype(np.uint32)) for k in range(60)]
    body, _ = repair_store.pack_block(docs, 1, 50)
    block = repair_store.Block(body)
    for k, (_, ids) in enumerate(docs):
        assert block.document(k).tolist() == ids.tolist()
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert block.ids_between(k, a, b).tolist() == ids[a:b].tolist()
    for ids in ([5] * 1000, [7, 8] * 500, [1] * 200):
        raw, _ = repair_store.pack_block([(None, np.array(ids, np.uint32))], 1, 10)
        assert repair_store.Block(raw).everything()[0].tolist() == ids
    plain = lambda ds: 64 + 32 * len(ds) + 2 * sum(len(ids) for _, ids in ds)
    for count, top in ((5, 40), (5, 5000), (60, 40), (60, 5000)):  # no block is larger than its ids as they are
        ds = [(k, np.append(rng.integers(2, top, 300), 1).astype(np.uint32)) for k in range(count)]
        assert len(repair_store.pack_block(ds, 1, top)[0]) <= plain(ds)


def test_grammar_is_whole():
    rng = np.random.default_rng(4)
    copy = np.append(rng.integers(2, 400, 1000), 1).astype(np.uint32)
    symbols, rules = repair_store.learn(np.tile(copy, 100), 1, 400)
    assert len(symbols) == 200  # a symbol and the end id for each copy
    block = repair_store.Block(repair_store.pack_block([(k, copy) for k in range(100)], 1, 400)[0])
    assert all(x.tolist() == copy.tolist() for x in block.everything()) and block.ids_between(7, 333, 700).tolist() == copy[333:700].tolist()
    for top, n in ((12, 3000), (3000, 120_000)):  # many pairs share a hash bin in the second
        ids = np.minimum(rng.zipf(1.3, n), top).astype(np.uint32)
        symbols, rules = repair_store.learn(ids, 1, top + 1)
        left, last = Counter(), {}
        for k, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)):
            if 1 not in pair and last.get(pair) != k - 1:
                left[pair] += 1
                last[pair] = k
        assert max(left.values()) < 7 and len(set(map(tuple, rules.tolist()))) == len(rules)
        lengths = repair_store.expansion_lengths(rules, top + 1)
        assert repair_store.Grammar(rules, lengths, top + 1).expand(symbols).tolist() == ids.tolist()
    for room in (5, 300):
        symbols, rules = repair_store.learn(ids, 1, 3001, 3001 + room)
        assert len(rules) == room


def test_archives(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "u\r\nx", ""), (5, "http://b", "é" * 5000), (None, "n", "same"), (2, "http://a/2", "same"), (6, "http://a/{id} {x}", "a"), (7, "http://a/\x85\u2028\t{", "b"), (8, "", "c"), (9, " ", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc_zip.read(warc_zip.write(pages), payloads=True).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    assert by[1]["record_type"] == "revisit" and by[1]["refers_to"] == 2 and by[2]["record_type"] == "response" and by[3]["refers_to"] == 4
    sha = base64.b32encode(hashlib.sha1(("é" * 5000).encode()).digest()).decode()
    assert by[6]["url"] == "http://a/{id}%20{x}" and by[7]["url"] == "http://a/%C2%85%E2%80%A8%09{"
    assert by[5]["payload_digest"] == sha and bytes(by[5]["payload"]).decode() == "é" * 5000 and by[1]["payload_bytes"] == 4
    assert warc_zip.read(warc_zip.write(pages.filter("page_id > 99"))).count() == 0
    rare = warc_zip.read(warc_zip.write(pages, revisit_min_bytes=5)).filter("record_type = 'revisit'")
    assert rare.count() == 0


def test_archive_query(spark):
    pages = pq.read_table(f"{SMALL}/pages.parquet", columns=["page_id", "html"]).to_pylist()
    groups, want = defaultdict(list), {}
    for r in pages:
        groups[(r["html"] or "").encode()].append(r["page_id"])
    for body, ids in groups.items():
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for k in ids:
            kept = k == max(ids)
            want[k] = (k, len(body), sha, "response" if kept else "revisit", None if kept else max(ids))
    got = queries.op1_warc_zip(spark, SMALL)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect())) == sorted(want.values())


def test_zip64_directory(tmp_path):
    path = tmp_path / "x.zip"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(70_000):  # more members than 16 bits count
            z.writestr(f"m{k}", b"")
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"payload")
        z.comment = b"a comment"
    path.write_bytes(out.getvalue())
    with open(path, "rb") as f:
        members = warc_zip.directory(f, path.stat().st_size)
        assert len(members) == 70_001
        at = warc_zip.data_offset(f, members["big"])
        f.seek(at)
        assert f.read(members["big"].size) == b"payload"


def test_sketches(spark, docs, odd):
    got = {r["doc_id"]: r for r in queries.op2_scaled_sketch(spark, SMALL).collect()}
    every = texts()
    order = sorted(every)
    for k, after in zip(order, [*order[1:], order[0]], strict=True):
        t, n = every[k], len(every[k])  # the query's own rows
        edited = t[: n - n // 4] + every[after][: n // 4]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == n
    shown = scaled_sketch.fingerprints(odd.select("doc_id", "text")).collect()
    by_text = defaultdict(set)
    for r in shown:
        by_text[r["text"]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == by_text[None] == {""} and by_text["one two"] != {""}
    errors = []
    for k, after in zip(order, [*order[1:], order[0]], strict=True):
        a = sets_raw(every[k])
        b = sets_raw(every[k][: len(every[k]) - len(every[k]) // 4] + every[order[(order.index(k) + 1) % len(order)]][: len(every[k]) // 4])
        errors.append(abs(got[k]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)))
        c = sets_raw(every[after])
        errors.append(abs(got[k]["near_next"] - (len(a & c) / len(a | c) if a | c else 1)))
        assert (got[k]["fingerprint"] == got[after]["fingerprint"]) == (a == c)
    assert np.mean(errors[::2]) < 0.03 and np.mean(errors[1::2]) < 0.01 and max(errors) < 0.2, (np.mean(errors[::2]), max(errors))
    nulls = scaled_sketch.with_next_text(odd.select("doc_id", "text")).collect()
    assert len(nulls) == len(odd_rows())


def test_sketch_error_by_length(spark):
    rng = random.Random(11)
    rows, want = [], []
    for k, n in enumerate([12] * 80 + [25] * 80 + [60] * 80 + [300] * 40):
        a = [f"a{k}-{i}" for i in range(n)]
        b = a[: rng.randrange(n // 2, n)] + [f"b{k}-{i}" for i in range(n // 4)]
        rows.append((k, " ".join(a), " ".join(b), " ".join(["before", *a, "after", *b])))
        x, y = sets_raw(rows[-1][1]), sets_raw(rows[-1][2])
        want.append((n, len(x & y) / len(x | y)))
    df = spark.createDataFrame(rows, "id long, a string, b string, whole string")
    sk = df.select("id", *[scaled_sketch.sketch(F.col(c)).alias(c.upper()) for c in ("a", "b", "whole")])
    got = sk.select("id", scaled_sketch.likeness(F.col("A"), F.col("B")).alias("j"), scaled_sketch.containment(F.col("A"), F.col("WHOLE")).alias("in")).collect()
    errors = defaultdict(list)
    for r in got:
        n, j = want[r["id"]]
        errors[n].append(abs(r["j"] - j))
        assert r["in"] in (1.0, None)
    assert [n for n, most in ((12, 1e-12), (25, 1e-12), (60, 0.05), (300, 0.035)) if np.mean(errors[n]) > most] == [], {n: np.mean(e) for n, e in errors.items()}
    short = spark.createDataFrame([(f"word{i}", " ".join(["word", *(f"x{i}-{k}" for k in range(100)), f"word{i}"])) for i in range(60)], "a string, b string")
    short = short.select(*[scaled_sketch.sketch(F.col(c)).alias(f"s{c}") for c in ("a", "b")])
    a, b = F.col("sa"), F.col("sb")
    few = short.select(scaled_sketch.containment(a, a).alias("own"), scaled_sketch.merged(a, b).alias("m"), scaled_sketch.merged(a, a).alias("twice"), "sa", "sb").collect()
    assert all(r["own"] == 1.0 and r["twice"] == r["sa"] and r["sa"]["whole"] for r in few)
    assert all(x < 0 for r in few for x in r["m"]["hashes"]) and not any(r["m"]["whole"] for r in few)
    assert all(set(r["sb"]["hashes"]) <= set(r["m"]["hashes"]) for r in few)


def sets_raw(t):
    w = WORD.findall(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_shards(odd, docs):
    for df, size in ((docs, 1 << 14), (odd, 64)):
        rows = external_shuffle.shuffled(df, 7, bucket_bytes=size).collect()
        assert len(rows) == df.count()
        shards = defaultdict(list)
        for r in rows:
            shards[r["shard"]].append(r["slot"])
        assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in shards.values())
        again = external_shuffle.shuffled(df, 7, bucket_bytes=size).collect()
        place = lambda rs: sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in rs)
        assert place(rows) == place(again)
    assert external_shuffle.shuffled(docs.filter("doc_id < 0"), 7).count() == 0


def test_shards_query(spark):
    every = texts()
    rows = queries.op3_external_shuffle(spark, SMALL).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {(k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for k, t in every.items()}
    assert len(rows) == len(every) and sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(40) for k in range(5)]


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    marked = {k + i for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for i in range(5)}
    failed = len(w) < 10 or 100 * len(marked) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), failed


def test_line_rules(odd):
    for t in [*texts().values(), *[t for _, t in odd_rows()], "a b c d e a b c d e\nx\nx\n", *fuzz()[:200]]:
        r = line_rules.judge(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(t)
    good = "This is a sentence of several plain words.\nHere is one more of them, as long as that.\n"
    assert line_rules.judge(good)["kept"] and "Home" not in line_rules.judge(good + "Home | News | Sport | More")["clean_text"]
    assert not line_rules.judge("Home | News | Sport | More | About | Help | Login | Search")["kept"]
    assert line_rules.apply_rules(odd).count() == len(odd_rows())


def test_quality_votes(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op5_knn_quality(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    few = labels.filter("doc_id < 0")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words")], "doc_id long, text string")
    model = knn_quality.fit(docs, few)
    assert [r["score"] for r in knn_quality.score(docs, model).collect()] == [0.5, 0.5, 0.5]


def test_exact_cosines():
    rng = np.random.default_rng(0)
    m = knn_quality.unit(rng.standard_normal((40, 8)).astype(np.float32))
    model = {"weights": np.ones(knn_quality.BUCKETS, np.float32), "projection": rng.standard_normal((knn_quality.BUCKETS, 8)).astype(np.float32), "vectors": m, "y": rng.integers(0, 2, 40).astype(np.float32), "prior": 0.5}
    for t in ("a few words of text", "other words here", ""):
        q = knn_quality.unit(knn_quality.rows_of([t], model["weights"]) @ model["projection"])[0]
        near = sorted(range(40), key=lambda i: -(q @ m[i]))[: knn_quality.NEIGHBOURS]
        w = [max(float(q @ m[i]), 0) for i in near]
        want = sum(a * float(model["y"][i]) for a, i in zip(w, near, strict=True)) / sum(w) if sum(w) else 0.5
        assert abs(knn_quality.vote(model, [t])[0] - want) < 1e-4
    model["vectors"] = np.repeat(m[:1], 40, axis=0)  # ties: the first ones vote
    model["y"] = np.r_[np.ones(7), np.zeros(33)].astype(np.float32)
    texts_ = ["a few words of text", "other words", *list(texts().values())[:120]]
    got = knn_quality.vote(model, texts_)
    sims = [knn_quality.unit(knn_quality.rows_of([t], model["weights"]) @ model["projection"])[0] @ m[0] for t in texts_]
    assert all(abs(s - 7 / 15) < 1e-9 for s, c in zip(got, sims, strict=True) if c > 1e-3) and sum(c > 1e-3 for c in sims) > 20
    model["vectors"] = m
    many = list(texts().values())
    alone = [knn_quality.vote(model, [t])[0] for t in many]
    assert knn_quality.vote(model, many).tolist() == alone == knn_quality.vote(model, many[::-1])[::-1].tolist()


def test_mixing(spark, odd, monkeypatch):
    rows = [(i, "w " * (1 + i % 5), "big" if i < 900 else "mid" if i < 980 else None) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    totals = Counter()
    for _, t, s in rows:
        totals[s] += len(t.split())
    n = sum(totals.values())
    found = temperature_mix.exponent(temperature_mix.shares(docs), max_passes=1e9)
    weights = {s: (v / n) ** found["a"] for s, v in totals.items()}
    z = sum(weights.values())
    entropy = -sum(w / z * np.log(w / z) for w in weights.values())
    raw = -sum(v / n * np.log(v / n) for v in totals.values())
    assert abs(entropy - (raw + 0.5 * (np.log(3) - raw))) < 1e-6
    limited = temperature_mix.exponent(temperature_mix.shares(docs), max_passes=4.0)
    assert abs(limited["passes"] - 4.0) < 1e-3
    uses = temperature_mix.mixed(docs).collect()
    got = Counter()
    for r in uses:
        got[r["source"]] += r["mix_tokens"]
    assert {r["doc_id"] for r in uses} == set(range(1000))
    for s in totals:
        passes = got[s] / totals[s]
        want = (totals["big"] / n) ** (1 - limited["a"]) / (totals[s] / n) ** (1 - limited["a"])
        assert abs(passes * totals[s] - want * totals[s]) <= 6
    assert temperature_mix.mixed(odd.withColumnRenamed("kept", "mix_pass")).count() >= len(odd_rows())
    assert temperature_mix.mixed(docs.filter("doc_id < 0")).count() == 0
    clash = temperature_mix.mixed(odd.select("doc_id", "text", "source", *[F.col("kept").alias(c) for c in ("rest", "w", "blocks", "whole", "tokens", "hash", "n")]))
    assert clash.columns[3:10] == ["rest", "w", "blocks", "whole", "tokens", "hash", "n"] and clash.count() >= len(odd_rows())
    for a, b in (("mix_pass", "mix_key"),):  # all first uses of a source come before its second ones
        ends = defaultdict(list)
        for r in uses:
            ends[(r["source"], r[a])].append(r[b])
        assert all(max(v) <= min(ends[(s, k + 1)]) for (s, k), v in ends.items() if (s, k + 1) in ends)
    assert all(0 <= r["mix_key"] <= 1 for r in uses)
    monkeypatch.setattr(temperature_mix, "BLOCK_TOKENS", 100)
    small = temperature_mix.mixed(docs).collect()
    assert Counter(r["mix_pass"] for r in small)[0] == 1000 and len({r["mix_block"] for r in small if r["source"] == "big"}) > 10
    order = defaultdict(list)
    for r in sorted(small, key=lambda r: r["mix_key"]):
        run = order[(r["source"], r["mix_pass"])]
        if not run or run[-1] != r["mix_block"]:
            run.append(r["mix_block"])
    assert all(len(run) == len(set(run)) for run in order.values())  # block by block
    assert order[("mid", 0)] != order[("mid", 1)] or len(order[("mid", 0)]) < 2
    capped = temperature_mix.mixed(docs, budget=600).collect()
    assert abs(sum(r["mix_tokens"] for r in capped) - 600) <= 18


def test_mix_query(spark):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    rows = queries.op6_temperature_mix(spark, SMALL).collect()
    n = {k: len(WORD.findall(r["text"] or "")) for k, r in docs.items()}
    totals, got, weights = Counter(), Counter(), {}
    for k, r in docs.items():
        totals[r["source"]] += n[k]
    for r in rows:
        assert r["mix_tokens"] == n[r["doc_id"]] and r["source"] == docs[r["doc_id"]]["source"]
        got[r["source"]] += r["mix_tokens"]
        weights[r["source"]] = r["mix_weight"]
    passes = Counter((r["doc_id"], r["mix_pass"]) for r in rows)
    assert set(passes.values()) == {1} and all((k, 0) in passes for k in docs)
    assert abs(sum(weights.values()) - 1) < 1e-9
    whole = sum(totals.values())
    raw = -sum(v / whole * np.log(v / whole) for v in totals.values())
    entropy = -sum(w * np.log(w) for w in weights.values())
    most = max(weights[s] / totals[s] for s in totals) / min(weights[s] / totals[s] for s in totals)
    assert abs(entropy - (raw + 0.5 * (np.log(len(totals)) - raw))) < 1e-6 or abs(most - 4) < 1e-3
    budget = max(totals[s] / weights[s] for s in totals)
    longest = max(n.values())
    assert all(abs(got[s] - weights[s] * budget) <= longest + 1 for s in totals)


def kept_of_near(rows, percent=80):
    """One row of each group, by brute force over the distinct (id, text) rows with words; ids last if null."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    items = {k: sets_of(t) for k, (_, t) in enumerate(rows)}
    comp = components(items, percent)
    return rows, {k: comp[k] for k in items}


def test_pipeline_stages(spark):
    """Each stage against a plain version on its own input."""
    import corpus_pipeline as c
    import tiktoken

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(c.STAGES)
    row = lambda r: (r["doc_id"], r["text"])

    model = knn_quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = stages["quality classifier"](spark, docs, SMALL)
    assert good.columns == columns
    assert sorted(map(row, good.collect())) == sorted(k for k in texts().items() if knn_quality.vote(model, [k[1]])[0] >= 0.5)

    ruled = stages["quality rules"](spark, good, SMALL)
    assert ruled.schema == docs.schema
    want = [(r["doc_id"], j["clean_text"], len(j["clean_text"])) for r in good.collect() if (j := line_rules.judge(r["text"]))["kept"]]
    assert sorted((*row(r), r["n_chars"]) for r in ruled.collect()) == sorted(want) and 100 < len(want) < 200

    alone = stages["near duplicates"](spark, ruled, SMALL)
    assert alone.schema == docs.schema
    rows, comp = kept_of_near([k[:2] for k in want])
    assert sorted(map(row, alone.collect())) == sorted(rows[k] for k in comp if comp[k] == k)
    assert len(want) > alone.count()

    mixed = stages["mixing"](spark, alone, SMALL)
    assert mixed.schema == docs.schema and set(map(row, mixed.collect())) == set(map(row, alone.collect()))

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    coded = stages["byte-level BPE"](spark, mixed, SMALL).collect()
    digest = lambda t: hashlib.sha256(" ".join(map(str, lib.encode_ordinary(t))).encode()).hexdigest()
    assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in coded) == Counter((k, digest(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in map(row, mixed.collect()))
    whole = c.run(spark, SMALL).select("doc_id", "ids_sha256").collect()
    assert Counter(map(tuple, whole)) == Counter((r["doc_id"], r["ids_sha256"]) for r in coded)


def test_pipeline_odd_rows(spark):
    """Nulls, repeated rows, one id with several texts, an extra column with an operator's name, and no rows."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = docs.orderBy("doc_id").limit(120).withColumn("kept", F.lit("x"))
    more = some.filter("doc_id < 40")
    odd = some.unionByName(more).unionByName(more.withColumn("doc_id", F.col("doc_id") + 1)).unionByName(more.withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(more.withColumn("text", F.lit(None).cast("string"))).unionByName(more.withColumn("text", F.lit(""))).unionByName(more.withColumn("source", F.lit(None).cast("string")))
    stages = dict(c.STAGES)
    ruled = stages["quality rules"](spark, stages["quality classifier"](spark, odd, SMALL), SMALL)
    before = [(r["doc_id"], r["text"]) for r in ruled.collect()]
    alone = stages["near duplicates"](spark, ruled, SMALL)
    got = [(r["doc_id"], r["text"]) for r in alone.collect()]
    rows, comp = kept_of_near(before)
    assert len(got) == len(set(got)) and set(got) <= set(before)
    at = {r: k for k, r in enumerate(rows)}
    assert Counter(comp[at[r]] for r in got) == Counter(set(comp.values()))  # one row of each group
    least = {}
    for k, g in comp.items():
        least.setdefault(g, rows[k][0])  # rows are in order of their ids
    assert all(r[0] == least[comp[at[r]]] for r in got)
    out = c.applied(spark, odd, SMALL)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {k for k, _ in got}
    assert c.applied(spark, odd.filter("doc_id < 0"), SMALL).count() == 0
