"""Pieces that several training-data operators share.

* ``scratch``/``stored``: tables and files in the folder that the cluster names
  in ``spark.checkpoint.dir`` (every executor and the driver can see it).
* ``put_file``/``get_range``: whole-file writes and range reads by URI.
* ``ship``: sends this subpackage's code to the executors.
* ``words_of``/``shingle_hashes``: words and 5-word windows as numbers.
* ``slices``: bounds how many bytes of text Python holds at once.
"""

from __future__ import annotations

import ctypes
import re
import shutil
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contracts: a word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: What str.split() also takes for white space, beyond the six.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- shared folder


def shared_root(spark: SparkSession) -> str:
    """The shared folder, as a URI. One is made only where the setting is absent and the driver
    and its executors are one machine; on a cluster the setting must be there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, as a URI; a path without a scheme is the default filesystem's."""
    path, _ = _hadoop(spark, f"{shared_root(spark)}/skein-{name}-{uuid.uuid4().hex[:12]}")
    uri = path.toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


def _hadoop(spark: SparkSession, uri: str):
    """(qualified path, filesystem) of a URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path), fs


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts
    lineage, survives lost executors, and is computed once however often read.
    It stays there until ``dropped``."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.skein_path = path
    _STORED.append(out)
    return out


_STORED: list[DataFrame] = []


def mark() -> int:
    """For ``swept``: how many tables are stored now."""
    return len(_STORED)


def swept(since: int, *but: DataFrame) -> None:
    """Deletes the tables stored since ``mark``, except ``but``."""
    dropped(*[df for df in _STORED[since:] if not any(df is x for x in but)])


def dropped(*frames: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in frames:
        path, fs = _hadoop(df.sparkSession, df.skein_path)
        fs.delete(path, True)
    _STORED[:] = [x for x in _STORED if not any(x is df for df in frames)]


class Tables:
    """The stored tables of one computation, deleted together once its result is stored."""

    def __init__(self):
        self.all: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.all.append(stored(df, name))
        return self.all[-1]

    def drop(self, *, but: tuple = ()) -> None:
        dropped(*[df for df in self.all if not any(df is x for x in but)])
        self.all = [df for df in self.all if any(df is x for x in but)]


def put_file(uri: str, chunks: list[bytes]) -> int:
    """Writes under a temporary name, then moves: a file is whole or absent."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.part"
    with fs.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
    fs.move(part, path)
    return sum(map(len, chunks))


def get_range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)


def open_file(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


# ---------------------------------------------------------------- code to executors

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="skein-code-")
    stage = Path(folder, "stage", package.name)
    shutil.copytree(package / "llm", stage / "llm", ignore=shutil.ignore_patterns("__pycache__"))
    (stage / "__init__.py").write_text("")
    zipped = shutil.make_archive(f"{folder}/skein_llm", "zip", f"{folder}/stage")
    sc.addPyFile(zipped)
    _SHIPPED.add(sc.applicationId)


# ---------------------------------------------------------------- what a Python worker keeps

_KEPT: dict = {"owner": None, "held": {}}


def kept(owner: str) -> dict:
    """The store of one operator in this Python worker. Spark uses a worker again for other
    operators' tasks, so what another one kept is let go: a worker's memory is that of one operator."""
    if _KEPT["owner"] != owner:
        _KEPT["held"].clear()
        _KEPT["owner"] = owner
    return _KEPT["held"]


def tidy(run):
    """A function over batches that hands its free memory back to the system when its task is done: Spark
    keeps Python workers for other tasks, and a free block that an allocator holds counts as theirs."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return task


# ---------------------------------------------------------------- words and windows


def words_of(text: str | None) -> list[str]:
    """Words by ``WORD``; none for null."""
    if not text:
        return []
    if _OTHER_SPACE.search(text):
        return _WORD.findall(text)
    return text.split()


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, kept for reuse up to ``bound`` words."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        h = (zlib.crc32(raw) << 32) | zlib.crc32(raw[::-1] + b"~%d" % len(raw))
        if len(self) >= self.bound:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def window_hashes(words: list[str], known: WordHashes, width: int = 5) -> np.ndarray:
    """One 64-bit hash per window of ``width`` words; with fewer words, one for
    the whole sequence; none for no words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = mix64(np.fromiter(map(known.__getitem__, words), np.uint64, n))
    if n < width:
        out = np.uint64(n) * np.ones(1, np.uint64)
        for k in range(n):
            out = mix64(out + h[k : k + 1] * _MIX[k])
        return out
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += h[k : n - width + 1 + k] * _MIX[k % 5] + np.uint64(k)
    return mix64(out)


# ---------------------------------------------------------------- bounded batches


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


# ---------------------------------------------------------------- ordered ranges


def range_splits(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` existing values of ``column``, ascending, that cut it into
    ranges of about equal counts; the first is the minimum. The number is a
    parameter, so what reaches the driver doesn't grow with the data."""
    parts = max(1, min(parts, 32_768))
    probs = [i / parts for i in range(parts)]
    row = df.agg(
        F.percentile_approx(column, F.lit(probs).cast("array<double>"), F.lit(max(10_000, 4 * parts))).alias("q"),
        F.min(column).alias("lo"),
    ).first()
    if row is None or row["lo"] is None:
        return []
    return sorted({row["lo"], *row["q"]})


def range_of(column, splits: list[int]):
    """Index of the range (0-based) that a value falls into; nulls go to the first.
    Two levels: first among every k-th split, then among the k that follow it."""
    if len(splits) <= 1:
        return F.lit(0)
    k = max(1, int(len(splits) ** 0.5))
    table = F.lit(splits).cast("array<bigint>")
    coarse = F.lit(splits[k::k]).cast("array<bigint>") if splits[k::k] else F.array().cast("array<bigint>")
    value = column.cast("bigint")
    first = F.size(F.filter(coarse, lambda x: x <= value)) * k
    fine = F.size(F.filter(F.slice(table, first + 1, k), lambda x: x <= value))
    return F.when(column.isNull(), F.lit(0)).otherwise(F.greatest(first + fine - 1, F.lit(0))).cast("int")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan (file sizes below scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
