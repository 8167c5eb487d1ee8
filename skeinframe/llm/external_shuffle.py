"""Operator 3: two-pass external shuffle into shards, in DataFrame functions only.

Pass 1 scatters rows uniformly into buckets small enough for memory, by a seeded
hash of the id (not of the text, so copies spread). A bucket that still comes out
too large (many rows of one id) is split again by row number. Pass 2 gathers
each bucket, shuffles it with Fisher-Yates (Spark's seeded ``shuffle``) and lays
it out; the buckets in turn, each in its own new order, are one random order of
all rows. Shard s takes the s-th equal run of that order: counts differ by one at
most (the law ``rows``), and a row's slot is its place in the run.

One shuffle moves the rows; the bucket counts are a table of one small row per
bucket, of which there are at most about 2 * ``MOST_BUCKETS``: beyond that many
buckets of ``BUCKET_BYTES`` each holds more bytes. Rows are sorted before they are gathered, and the
number of partitions follows from the data alone, so that a repeated task, or a second run
over the same files, makes the same order again.

``write_shards`` writes each bucket's rows to the folders of the shards that its run of the order
touches, without another shuffle; ``read_shards`` reads them back.

Defined results: null text has 0 bytes; null ids and repeated rows are scattered
like others; an empty table gives no rows; extra columns move with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKET_BYTES, MOST_BUCKETS, SEED = 16 << 20, 200_000, 20240229


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shuffled(df: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    size = row_size(F.col(f"`{text}`"))
    total = df.agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).first()
    bucket_bytes = max(bucket_bytes, (total["b"] or 0) // MOST_BUCKETS)
    rows, n_buckets = total["n"], (total["b"] or 0) // bucket_bytes + 1
    first = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), F.lit(n_buckets))
    # Row numbers within a scan's splits stay the same when a task is repeated.
    numbered = df.withColumns({"__bucket": first, "__row": F.monotonically_increasing_id()})
    sizes = numbered.groupBy("__bucket").agg(F.sum(size).alias("bytes"))
    # Hot ids only: as a large bucket holds 4 buckets' bytes, at most a quarter of their number.
    large = common.stored(sizes.filter(F.col("bytes") > 4 * bucket_bytes).select("__bucket", (F.floor(F.col("bytes") / bucket_bytes) + 1).alias("__ways")), "large-buckets")
    more = large.agg(F.count(F.lit(1)).alias("n"), F.sum("__ways").alias("w")).first()
    sub = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__row")), F.coalesce("__ways", F.lit(1)))
    dealt = numbered.join(F.broadcast(large), "__bucket", "left").withColumn("__sub", sub.cast("int")).drop("__ways")

    counts = dealt.groupBy("__bucket", "__sub").agg(F.count(F.lit(1)).alias("c"))
    # One row per memory-sized bucket; a running sum over them is small work at any scale.
    before = F.sum("c").over(Window.orderBy("__bucket", "__sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    offsets = common.stored(counts.select("__bucket", "__sub", before.alias("__before")), "bucket-offsets")

    parts = n_buckets - more["n"] + (more["w"] or 0)
    columns = [F.col(f"`{c}`") for c in df.columns]
    packed = F.struct(*columns).alias("__item")
    gathered = (
        dealt.select("__bucket", "__sub", F.xxhash64(F.lit(seed + 2), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("__h"), "__row", packed)
        .repartition(parts, "__bucket", "__sub")
        .sortWithinPartitions("__bucket", "__sub", "__h", "__row")
        .groupBy("__bucket", "__sub")
        .agg(F.collect_list("__item").alias("__items"))
    )
    laid = gathered.select("__bucket", "__sub", F.posexplode(F.shuffle("__items", F.lit(seed))).alias("__at", "__item"))
    placed = laid.join(offsets, ["__bucket", "__sub"]).withColumn("__place", F.col("__before") + F.col("__at"))
    low, wide = divmod(rows, shards)  # the first ``wide`` shards have one row more
    edge = wide * (low + 1)
    place = F.col("__place")
    shard = F.when(place < edge, F.expr(f"__place div {low + 1}")).otherwise(wide + F.expr(f"(__place - {edge}) div {max(low, 1)}")).cast("int")
    start = F.when(F.col("shard") < wide, F.col("shard") * (low + 1)).otherwise(edge + (F.col("shard") - wide) * low)
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    return placed.withColumn("shard", shard).select(*[F.col("__item")[c].alias(c) for c in keep], "shard", (place - start).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Writes a ``shuffled`` table: a folder per shard, rows in slot order in each file. Each task holds
    whole buckets, so it writes to few shards and no row moves again."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows that ``write_shards`` wrote, with the columns of the ``shuffled`` table ``like``."""
    return spark.read.schema(like.schema).parquet(path)
