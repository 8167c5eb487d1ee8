"""Operator 9: token-id files compressed with Re-Pair grammars.

A file is a row of blocks of at most ``BLOCK_IDS`` ids (a longer document gets a
block of its own). Each block has its own grammar: frequent pairs of
neighbouring ids are replaced by new symbols (nonterminals) over and over, for
as long as that saves space. Stored are the rules, the expansion length of each
nonterminal, and for each document where it starts, both in symbols and in ids;
so any document, or any range of ids in one, is decoded from its own symbols
only. Pairs with the end id are never replaced, so no symbol spans two documents.

File layout (little-endian): ``MAGIC``; blocks; footer; footer's length (u64);
``MAGIC``. A block: header of eight u64 (terminals, rules, symbols, ids, documents,
symbol width, 0, 0); rules (u32 left, u32 right); expansion lengths (u32); document
table (u64 document id, u64 first symbol, u64 first id, u64 has an id); symbols
(u16 while they fit, else u32). The footer is JSON: per block its offset, length,
ids and documents.

Writing: rows are partitioned by ranges of (doc_id, checksum of the text), so a hot
doc_id is split too; each task writes its range in order, in files of about
``file_bytes``, under unique names and returns a manifest row per file, so the files of a
lost or repeated attempt are never read. The start of a document is the sum of
the ids in the files before it (one manifest row per file) plus its own start.
``read_range`` decodes a range of ids of one document from its block alone.

Defined results: null text counts as empty and yields the end id alone; rows with a null doc_id come first,
equal doc_ids follow one another in an order fixed by their texts; extra columns
are not stored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import byte_symbols

MAGIC = b"SKRP0001"
BLOCK_IDS = 1 << 20
RULES_A_ROUND, MARK_BITS, LAID_OUT = 2500, 18, 64
MOST_PARTS = 100_000
RULE_BYTES = 12  # a rule in the file: its pair and its expansion length
KEEP_PARTS, KEEP_CHARS = 800_000, 48


# ---------------------------------------------------------------- the grammar


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Where a pair (x, x) overlaps its own occurrence before: in a run every second one from the left counts."""
    same = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    if not len(same):
        return same
    at = np.arange(len(same))
    begin = np.maximum.accumulate(np.where(np.r_[True, same[1:] != same[:-1] + 1], at, 0))
    return same[(at - begin) % 2 == 0]


def learn(ids: np.ndarray, stop: int, base: int, most_symbols: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): ``ids`` with frequent pairs replaced, and rules[k] = (left,
    right) of symbol base + k. Pairs with ``stop`` stay. Each round counts all pairs
    exactly and replaces up to ``RULES_A_ROUND`` of the most frequent ones together; where
    occurrences overlap, the more frequent pair goes first and the other waits for a later
    round. Ends when no pair occurs so often that its rule takes less room than it saves, or no symbol
    is left, and no pair of a rule is left."""
    s = ids.astype(np.uint32)
    room = max(0, most_symbols - base) if base < most_symbols else 1 << 20
    kind, bits = (np.uint32, 16) if base + room <= 1 << 16 else (np.uint64, 32)
    least = RULE_BYTES // (2 if bits == 16 else 4) + 1  # a use saves a symbol
    mix = kind(0x9E3779B1 if bits == 16 else 0x9E3779B97F4A7C15)
    rules = np.empty(0, kind)  # pairs as keys, in order of their symbols
    while len(s) > 1:
        keys = (s[:-1].astype(kind) << kind(bits)) | s[1:]
        free = s != stop
        counted = free[:-1] & free[1:]
        counted[_repeats(keys)] = False
        known = np.sort(rules)
        named = known[:0]
        if len(rules) < room:
            ordered = np.sort(keys[counted])
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
            many = np.diff(np.r_[first, len(ordered)])
            often = np.flatnonzero(many >= least)
            named = ordered[first[often]][np.argsort(-many[often], kind="stable")]
            if room - len(rules) < RULES_A_ROUND:
                fresh = ~_held(known, named)
                named = named[~fresh | (np.cumsum(fresh) <= room - len(rules))]
            named = named[:RULES_A_ROUND]
        new = ~_held(known, named)
        if not len(named):  # what overlaps have left of the rules' pairs
            named, new = rules, np.zeros(len(rules), bool)
        marked = np.zeros(1 << MARK_BITS, bool)
        marked[(named * mix) >> kind(2 * bits - MARK_BITS)] = True
        at = np.flatnonzero(marked[(keys * mix) >> kind(2 * bits - MARK_BITS)] & counted)
        order = np.argsort(named)
        ascending, mine = named[order], keys[at]
        found = np.minimum(np.searchsorted(ascending, mine), len(named) - 1)
        hit = ascending[found] == mine
        found = order[found]
        at, mine = at[hit], found[hit]
        if not len(at):
            break
        close = at[1:] == at[:-1] + 1
        best = np.ones(len(at), bool)
        best[1:] &= ~close | (mine[1:] < mine[:-1])
        best[:-1] &= ~close | (mine[:-1] < mine[1:])
        at, mine = at[best], mine[best]
        # A pair of a rule is replaced wherever it is left; a new one that its neighbours took is counted again next round.
        made = new & (np.bincount(mine, minlength=len(named)) >= least)
        symbol = np.zeros(len(named), np.uint32)
        by = np.argsort(rules)
        symbol[~new] = base + by[np.searchsorted(known, named[~new])]
        symbol[made] = base + len(rules) + np.arange(made.sum(), dtype=np.uint32)
        rules = np.r_[rules, named[made]]
        used = (made | ~new)[mine]
        at, mine = at[used], mine[used]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s[at] = symbol[mine]
        s = s[keep]
    return s, np.stack([rules >> kind(bits), rules & kind((1 << bits) - 1)], 1).astype(np.uint32)


def _held(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.uint32)


def sizes(symbols: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    out = np.ones(len(symbols), np.int64)
    long = symbols >= base
    out[long] = lengths[symbols[long] - base]
    return out


class Grammar:
    """Expands symbols. The ids of every symbol of at most ``LAID_OUT`` ids are laid out once, terminals
    first; longer ones are taken apart into these, so memory doesn't grow with the expansions."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int):
        self.base, self.lengths, self.rules = base, lengths, rules
        self.short = np.r_[np.ones(base, bool), lengths <= LAID_OUT]
        parts: list[bytes | None] = []
        for (a, b), n in zip(rules.tolist(), lengths.tolist(), strict=True):
            parts.append((parts[a - base] if a >= base else struct.pack("<I", a)) + (parts[b - base] if b >= base else struct.pack("<I", b)) if n <= LAID_OUT else None)
        self.flat = np.concatenate([np.arange(base, dtype=np.uint32), np.frombuffer(b"".join(p for p in parts if p), "<u4")])
        laid = np.where(self.short[base:], lengths, 0).astype(np.int64)
        self.at = np.concatenate([np.arange(base), base + np.cumsum(laid) - laid])

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        return sizes(symbols, self.lengths, self.base)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.sizes(symbols)
        to = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        while len(symbols):
            short = self.short[symbols]
            n, s = size[short], symbols[short]
            ends = np.cumsum(n)
            within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
            out[np.repeat(to[short], n) + within] = self.flat[np.repeat(self.at[s], n) + within]
            pair, to = self.rules[symbols[~short] - self.base], to[~short]
            sides = self.sizes(pair[:, 0])
            to = np.concatenate([to, to + sides])
            symbols = np.concatenate([pair[:, 0], pair[:, 1]])
            size = np.concatenate([sides, self.sizes(pair[:, 1])])
        return out


def pack_block(docs: list[tuple[int | None, np.ndarray]], stop: int, terminals: int) -> tuple[bytes, dict]:
    ids = np.concatenate([d for _, d in docs])
    base = max(terminals, int(ids.max()) + 1)
    symbols, rules = learn(ids, stop, base)
    lengths = expansion_lengths(rules, base)
    first_id = np.r_[0, np.cumsum([len(d) for _, d in docs])][:-1]
    first_symbol = np.searchsorted(np.cumsum(sizes(symbols, lengths, base)), first_id, side="right")
    table = np.array([[d or 0, s, i, d is not None] for (d, _), s, i in zip(docs, first_symbol.tolist(), first_id.tolist(), strict=True)], np.int64)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = struct.pack("<8Q", base, len(rules), len(symbols), len(ids), len(docs), width, 0, 0)
    body = b"".join([head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), table.astype("<i8").tobytes(), symbols.astype(f"<u{width}").tobytes()])
    return body, {"length": len(body), "ids": len(ids), "docs": len(docs), "symbols": len(symbols)}


class Block:
    """A block as read: decodes whole documents or ranges of ids in them."""

    def __init__(self, raw: bytes):
        base, n_rules, n_symbols, self.n_ids, n_docs, width, _, _ = struct.unpack_from("<8Q", raw)
        at = 64
        rules = np.frombuffer(raw, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        lengths = np.frombuffer(raw, "<u4", n_rules, at)
        at += 4 * n_rules
        self.table = np.frombuffer(raw, "<i8", 4 * n_docs, at).reshape(-1, 4)
        at += 32 * n_docs
        self.symbols = np.frombuffer(raw, f"<u{width}", n_symbols, at).astype(np.uint32)
        self.grammar = Grammar(rules, lengths, base)
        self.ends = np.r_[self.table[1:, 1:3], [[n_symbols, self.n_ids]]]

    def everything(self) -> list[np.ndarray]:
        """All documents, expanded in one go."""
        ids = self.grammar.expand(self.symbols)
        return [ids[a:b] for a, b in zip(self.table[:, 2].tolist(), self.ends[:, 1].tolist(), strict=True)]

    def document(self, k: int) -> np.ndarray:
        return self.grammar.expand(self.symbols[self.table[k, 1] : self.ends[k, 0]])

    def ids_between(self, k: int, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of document k; skips by expansion lengths, expands only what it needs."""
        s = self.symbols[self.table[k, 1] : self.ends[k, 0]]
        ends = np.cumsum(self.grammar.sizes(s))
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        skipped = int(ends[a - 1]) if a else 0
        return self.grammar.expand(s[a : b + 1])[start - skipped : stop - skipped]


# ---------------------------------------------------------------- the encoder

#: Letters, then punctuation: the pre-tokenizer divides such a chunk there, and lower-cases the letters one by one.
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
_PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?%$&*#|]*)$"


class ChunkEncoder:
    """The tokenizers library over blank-separated chunks. For a vocabulary whose pre-tokenizer
    drops white space and lower-cases, a text's ids are its chunks' ids in turn. A plain chunk is its
    letters in lower case and its punctuation; the parts are encoded once and kept (up to a fixed number)."""

    def __init__(self, raw: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(raw.decode())
        spec = json.loads(raw)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        lower = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.by_chunk = lower and any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") for p in split)
        self.terminals = self.tok.get_vocab_size(with_added_tokens=True)
        self.symbols = str.maketrans({b: s for b, s in enumerate(byte_symbols())})
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Letters in lower case are one pre-token: the library's model alone encodes them."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.tok.model.tokenize(word)]).tobytes()

    def _parts(self, words: list[str]) -> list[bytes]:
        """Ids of each part."""
        found = list(map(self.known.get, words))
        new = [k for k, b in enumerate(found) if b is None]
        others = []
        for k in new:
            if _LETTERS(words[k]):
                found[k] = self._letters(words[k])
            else:
                others.append(k)
        for k, b in zip(others, self._encode([words[k] for k in others]), strict=True):
            found[k] = b
        room = KEEP_PARTS - len(self.known)
        self.known.update((words[k], found[k]) for k in new[: max(0, room)] if len(words[k]) <= KEEP_CHARS)
        return found

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Arrow splits texts into chunks, these into parts, and numbers both; each
        distinct part is looked up once."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            return [np.frombuffer(b, "<u4") for b in self._encode(texts.to_pylist())]
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        halves = pc.extract_regex(chunks, _PLAIN)
        core = pc.coalesce(pc.utf8_lower(pc.struct_field(halves, "core")), chunks)  # not plain: by the whole library
        tail = pc.fill_null(pc.struct_field(halves, "tail"), "")
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        parts = self._parts(both.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(lengths) - lengths
        at = both.indices.to_numpy().reshape(2, -1).T[coded.indices.to_numpy()].ravel()
        sizes_ = lengths[at]
        ends = np.cumsum(sizes_)
        step = np.repeat(starts[at] - (ends - sizes_), sizes_)
        step += np.arange(len(step))
        ids = np.frombuffer(b"".join(parts), "<u4")[step]
        cuts = np.r_[0, ends][2 * (offsets - offsets[0])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


def _encoder(raw: bytes) -> ChunkEncoder:
    key = hashlib.sha256(raw).digest()
    held = common.kept("id files")
    if key not in held:
        held.clear()
        held[key] = ChunkEncoder(raw)
    return held[key]


# ---------------------------------------------------------------- files


class FileWriter:
    """Gathers documents into blocks; ``finish`` writes the file and returns its manifest row."""

    def __init__(self, folder: str, part: int, seq: int, stop: int, terminals: int):
        self.uri = f"{folder}/ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}.skrp"
        self.part, self.seq, self.stop, self.terminals = part, seq, stop, terminals
        self.docs: list = []
        self.held = 0
        self.chunks, self.blocks, self.at = [MAGIC], [], len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.docs and self.held + len(ids) > BLOCK_IDS:
            self.close_block()
        self.docs.append((doc_id, ids))
        self.held += len(ids)

    def close_block(self) -> None:
        body, info = pack_block(self.docs, self.stop, self.terminals)
        ids = [d for d, _ in self.docs if d is not None]
        self.blocks.append({"offset": self.at, **info, "first": min(ids, default=None), "last": max(ids, default=None)})
        self.chunks.append(body)
        self.at += len(body)
        self.docs, self.held = [], 0

    def finish(self) -> tuple:
        if self.docs:
            self.close_block()
        footer = json.dumps(self.blocks).encode()
        size = common.put_file(self.uri, [*self.chunks, footer, struct.pack("<Q", len(footer)), MAGIC])
        ends = [x for b in self.blocks for x in (b["first"], b["last"]) if x is not None]
        sums = [sum(b[k] for b in self.blocks) for k in ("docs", "ids", "symbols")]
        return self.part, self.seq, self.uri, *sums, size, min(ends, default=None), max(ends, default=None)


MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_symbols long, bytes long, first_id long, last_id long"
_ARROW_MANIFEST = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t]) for n, t in (c.split() for c in MANIFEST.split(", "))])


def write(docs: DataFrame, vocabulary: str, end_id: int = 1, file_bytes: int = 64 << 20, folder: str | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text), appends ``end_id`` to each, writes files in
    ascending doc_id order. Returns the manifest, stored in the shared folder."""
    spark: SparkSession = docs.sparkSession
    common.ship(spark)
    folder = folder or common.scratch(spark, "ids")
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())  # one vocabulary file: a fixed size
    parts = min(max(16, 2 * common.input_bytes(docs) // file_bytes), MOST_PARTS)  # beyond, a task writes several files
    order = [F.asc_nulls_first("doc_id"), F.asc("check")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("check", F.crc32(F.coalesce("text", F.lit(""))))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, rows, enc = TaskContext.get().partitionId(), None, [], _encoder(raw.value)
        end = np.array([end_id], np.uint32)
        for batch in common.slices(batches, "text", 8_000_000):
            encoded = enc.encode_all(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                if writer is not None and writer.at >= file_bytes:
                    rows.append(writer.finish())
                    writer = None
                writer = writer or FileWriter(folder, part, len(rows), end_id, enc.terminals)
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            rows.append(writer.finish())
        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW_MANIFEST.names, r, strict=True)) for r in rows], schema=_ARROW_MANIFEST)

    return common.stored(dealt.mapInArrow(common.tidy(run), MANIFEST), "manifest")


def _blocks(path: str, doc_id: int | None = None) -> Iterator[tuple[dict, bytes]]:
    """(footer entry, bytes) of each block, or of those whose range of ids holds ``doc_id``."""
    with common.open_file(path) as f:
        size = f.size()
        tail = common.get_range(f, size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not an id file: {path}")
        n = struct.unpack("<Q", tail[:8])[0]
        for info in json.loads(common.get_range(f, size - 16 - n, n)):
            if doc_id is None or (info["first"] is not None and info["first"] <= doc_id <= info["last"]):
                yield info, common.get_range(f, info["offset"], info["length"])


def read_range(manifest: DataFrame, doc_id: int, start: int, stop: int) -> list[np.ndarray]:
    """ids[start:stop] of each document of that id, decoded from its block only."""
    held = manifest.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "seq").select("path")
    out = []
    for row in held.toLocalIterator():  # one file, or those that share a repeated id
        for _, raw in _blocks(row["path"], doc_id):
            block = Block(raw)
            out += [block.ids_between(k, start, stop) for k in np.flatnonzero((block.table[:, 0] == doc_id) & (block.table[:, 3] == 1))]
    return out


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files."""
    common.ship(manifest.sparkSession)
    # One row per file of tens of MB: a running sum over it is small work at any scale.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base"))
    files = files.repartition(max(1, min(4096, manifest.count())), "path")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for info, raw in _blocks(path):
                    block = Block(raw)
                    rows: list[list] = [[], [], [], [], []]
                    for ids, (doc_id, _, first, has) in zip(block.everything(), block.table.tolist(), strict=True):
                        for column, v in zip(rows, (doc_id if has else None, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids), strict=True):
                            column.append(v)
                    arrays = [pa.array(c, pa.int64()) for c in rows[:4]]
                    if with_ids:
                        arrays.append(pa.array([x.tolist() for x in rows[4]], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])
                    base += info["ids"]

    return files.mapInArrow(common.tidy(run), schema)
