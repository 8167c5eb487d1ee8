"""Operator 1: WARC records in ZIP packages, written and read by range.

A package is a ZIP archive of stored members: ``archive/data.warc.gz`` (one gzip
member per record), ``indexes/index.cdxj`` (a line per record with offset and
length in that member) and ``datapackage.json``. The reader never unpacks a
package: it range-reads the end of the file, follows the ZIP64 locator if there
is one, parses the central directory, finds where the stored members' bytes
begin, range-reads the index, and then range-reads runs of records.

``write``: equal payloads (same SHA-1 and length) of at least
``revisit_min_bytes`` bytes keep one response, that with the largest page_id;
the others become revisit records that name it. The group maxima are aggregated
before any shuffle of payloads, only groups of two or more are kept, and the
table of them is joined back: Spark broadcasts it while it is small and
otherwise splits a hot payload's rows (AQE skew join). Each task packs its rows
and writes packages of about ``package_bytes`` under unique names; the manifest
(a stored table) lists those of successful tasks only.

Defined results: a null html is an empty payload; a null url is left out of the
record; rows with a null page_id, and repeated rows with the largest page_id of
their group, are responses; white space and control characters in a url are percent-encoded;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_CONTROL = re.compile(r"[\s\x00-\x20\x7f-\x9f]")


# ---------------------------------------------------------------- ZIP by range reads


class Member:
    """A ZIP member: name, method, sizes, and where its local header is."""

    __slots__ = ("name", "method", "packed", "size", "header")

    def __init__(self, name: str, method: int, packed: int, size: int, header: int):
        self.name, self.method, self.packed, self.size, self.header = name, method, packed, size, header


def directory(handle, length: int) -> dict[str, Member]:
    """The central directory, ZIP64 or not, from the end of the file."""
    take = min(length, 22 + 65535)
    tail = common.get_range(handle, length - take, take)
    at = len(tail) - 22
    while at >= 0:  # the end record's comment must reach exactly to the end
        at = tail.rfind(END, 0, at + 4)
        if at < 0 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ValueError("no ZIP end record")
    n, size, offset = struct.unpack_from("<HII", tail, at + 10)
    end_at = length - take + at
    if end_at >= 20 and (n == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF):
        locator = common.get_range(handle, end_at - 20, 20)
        if locator[:4] == LOCATOR64:
            (end64,) = struct.unpack_from("<Q", locator, 8)
            record = common.get_range(handle, end64, 56)
            if record[:4] != END64:
                raise ValueError("broken ZIP64 end record")
            n, size, offset = struct.unpack_from("<QQQ", record, 32)
    raw = common.get_range(handle, offset, size)
    out, at = {}, 0
    for _ in range(n):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("broken ZIP central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", raw, at + 20)
        (header,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + name_n : at + 46 + name_n + extra_n]
        k = 0
        while k + 4 <= len(extra):
            tag, length_ = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64 sizes, only those that don't fit above, in this order
                wide = iter(struct.unpack_from(f"<{length_ // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + length_
        out[name] = Member(name, method, packed, full, header)
        at += 46 + name_n + extra_n + comment_n
    return out


def data_offset(handle, member: Member) -> int:
    """Where the member's bytes begin; its local header has its own name and extra lengths."""
    head = common.get_range(handle, member.header, 30)
    if head[:4] != LOCAL or member.method != 0:
        raise ValueError(f"{member.name}: not a stored member")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


# ---------------------------------------------------------------- WARC records


def _encoded(url: str) -> str:
    """A url on one line and without blanks: white space and control characters percent-encoded."""
    return _CONTROL.sub(lambda m: quote(m[0]), url)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record; a revisit has the response's HTTP head but no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _encoded(url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; raises if lengths or a response's digest don't hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n:
        raise ValueError("cut WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    page = lambda s: int(x) if (x := s.strip("<>").removeprefix("urn:page:")) else None
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != int(sizes["content-length"]) or base32_sha1(payload) != digest):
        raise ValueError("payload doesn't match its record")
    return {
        "page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(sizes["content-length"]),
        "payload_digest": digest, "record_type": kind, "refers_to": page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload if kind == "response" else None,
    }


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


class PackageWriter:
    """Gathers records; ``finish`` writes the package and returns its manifest row."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.data, self.index, self.n = io.BytesIO(), [], 0

    def add(self, page_id, url, raw: bytes, date: str) -> None:
        pack = zlib.compressobj(4, zlib.DEFLATED, 31)
        member = pack.compress(raw) + pack.flush()
        entry = {"offset": str(self.data.tell()), "length": str(len(member)), "filename": DATA.partition("/")[2]}
        self.index.append(f"{_encoded(url or '')} {re.sub(r'[^0-9]', '', date)} {json.dumps(entry)}\n")
        self.data.write(member)
        self.n += 1

    def finish(self) -> dict:
        self.index.sort()
        out = io.BytesIO()
        index, data = "".join(self.index).encode(), self.data.getbuffer()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in ((DATA, data), (INDEX, index), ("datapackage.json", self.describe(data, index))):
                z.writestr(zipfile.ZipInfo(name), body)
        return {"path": self.uri, "records": self.n, "bytes": common.put_file(self.uri, [out.getbuffer()])}

    @staticmethod
    def describe(data, index: bytes) -> bytes:
        parts = [{"path": n, "hash": "sha256:" + hashlib.sha256(b).hexdigest(), "bytes": len(b)} for n, b in ((DATA, data), (INDEX, index))]
        return json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": parts}).encode()


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write(pages: DataFrame, folder: str | None = None, revisit_min_bytes: int = 0, package_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes (page_id, url, html) as packages; returns the stored manifest (path, records, bytes)."""
    spark = pages.sparkSession
    common.ship(spark)
    folder = folder or common.scratch(spark, "warc")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "sha1": F.unhex(F.sha1("payload"))})
    groups = rows.filter(F.col("n") >= revisit_min_bytes).groupBy("sha1", "n").agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    groups = common.stored(groups.filter("copies > 1").select("sha1", "n", "kept_id"), "payload-groups")
    dealt = rows.join(groups, ["sha1", "n"], "left").select("page_id", "url", "payload", "sha1", F.when(F.col("page_id") < F.col("kept_id"), F.col("kept_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in common.slices(batches, "payload"):
            for page_id, url, payload, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or PackageWriter(folder)
                writer.add(page_id, url, record(page_id, url, payload, base64.b32encode(sha1).decode(), refers, date), date)
                if writer.data.tell() >= package_bytes:
                    done.append(writer.finish())
                    writer = None
        if writer is not None:
            done.append(writer.finish())
        yield pa.RecordBatch.from_pylist(done, schema=_MANIFEST)

    return common.stored(dealt.mapInArrow(common.tidy(run), "path string, records long, bytes long"), "packages")


# ---------------------------------------------------------------- reading


def locate(packages: DataFrame, run_bytes: int = 4 << 20) -> DataFrame:
    """(path, start, lengths): runs of neighbouring records of about ``run_bytes``,
    from each package's central directory and index."""
    common.ship(packages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with common.open_file(path) as f:
                    members = directory(f, f.size())
                    index = members[INDEX]
                    base = data_offset(f, members[DATA])
                    lines = common.get_range(f, data_offset(f, index), index.size).decode().split("\n")
                found = sorted((int(e["offset"]), int(e["length"])) for e in (json.loads(x[x.rindex(" {") :]) for x in lines if x))  # a url may hold braces, but no blank
                starts, lengths = [], []
                for offset, length in found:
                    if not starts or sum(lengths[-1]) + length > run_bytes or starts[-1] + sum(lengths[-1]) != base + offset:
                        starts.append(base + offset)
                        lengths.append([])
                    lengths[-1].append(length)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts)), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["path", "start", "lengths"])

    paths = packages.select("path")
    return paths.repartition(max(1, min(4096, paths.count())), "path").mapInArrow(common.tidy(run), "path string, start long, lengths array<long>")


def read(packages: DataFrame, payloads: bool = False, parts: int | None = None) -> DataFrame:
    """The records: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    (and payload: null for a revisit). Each run of records is one range read."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = dict(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=False))
    runs = locate(packages)
    total = packages.agg(F.sum("bytes")).first()[0] or 0
    runs = runs.repartition(parts or max(2, min(8192, total // (8 << 20) + 1)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with common.open_file(path) as f:
                    raw = common.get_range(f, start, sum(lengths))
                out, at = [], 0
                for n in lengths:
                    out.append(parse_record(zlib.decompress(raw[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in names], names=names)

    return runs.mapInArrow(common.tidy(run), schema)
