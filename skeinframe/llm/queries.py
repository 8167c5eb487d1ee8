"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, external_shuffle, hyperminhash, knn_quality, line_rules, line_rules_sql, more_sql, repair_store, scaled_sketch, temperature_mix, token_counts, warc_zip

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc_zip.write(_table(spark, sf_dir, "pages"), revisit_min_bytes=0)
    return warc_zip.read(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_sketch.with_next_text(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("edited", scaled_sketch.edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumns({"sk": scaled_sketch.sketch(F.col("text")), "sk_edited": scaled_sketch.sketch(F.col("edited")), "sk_next": scaled_sketch.sketch(F.col("next_text"))})
    return rows.select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        scaled_sketch.fingerprint(F.col("sk")).alias("fingerprint"),
        scaled_sketch.fingerprint(F.col("sk_edited")).alias("edited_fingerprint"),
        scaled_sketch.likeness(F.col("sk"), F.col("sk_edited")).alias("near_edited"),
        scaled_sketch.likeness(F.col("sk"), F.col("sk_next")).alias("near_next"),
    )


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt, path = external_shuffle.shuffled(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS), common.scratch(spark, "shards")
    external_shuffle.write_shards(dealt, path)
    moved = external_shuffle.read_shards(spark, path, dealt)
    text = F.coalesce("text", F.lit(""))
    return moved.select(
        "doc_id", external_shuffle.row_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return line_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), columns, keep_text=False)


def op5_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = knn_quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = knn_quality.score(docs, model, keep_text=False)
    return scored.select("doc_id", (~knn_quality.learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = temperature_mix.mixed(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_passes", "mix_pass", "mix_block", "mix_key")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op9_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repair_store.read(repair_store.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=1024, keep_text=False)


def queries() -> dict:
    found = (op1_warc_zip, op2_scaled_sketch, op3_external_shuffle, op4_line_rules, op5_knn_quality, op6_temperature_mix, op7_byte_bpe, op8_hyperminhash, op9_repair_store, op10_token_counts)
    return {f.__name__: f for f in found}


#: DuckDB SQL for the queries that it can express.
ORACLE: dict[str, str] = {"op1_warc_zip": more_sql.warc_zip_sql(), "op4_line_rules": line_rules_sql.line_rules_sql(), "op8_hyperminhash": more_sql.hyperminhash_sql(85)}
