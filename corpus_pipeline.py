"""The corpus pipeline: five stages over ``documents``, each stored before the next.

1. quality classifier: documents whose neighbours vote label 0 go.
2. quality rules: lines that fail go from the text, and documents that fail the base
   rules or lose too much text go as a whole; n_chars follows the text.
3. near duplicates: of each group (five-word shingles, similarity 0.8 or more) the
   smallest doc_id stays.
4. mixing: sources are repeated to their temperature weights; no document goes.
5. byte-level BPE: ids are encoded and decoded again; per row the digests.

Stages 1 to 4 return the columns of ``documents``; extra columns stay with their rows, and one that has the
name of a column that an operator adds comes back with the operator's value. Null and empty texts have the
classifier's prior and go at the rules; rows that repeat an id and a text count once from stage 3 on; null
ids are kept apart from others; an empty table gives an empty result.
What the operators stored on the way is deleted as soon as a stage's result is stored.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinframe.llm import bpe, common, hyperminhash, knn_quality, line_rules, temperature_mix


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = knn_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return knn_quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_rules.apply_rules(docs, ["kept", "clean_text"]).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.keep_one(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return temperature_mix.mixed(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "source", "text")
    return bpe.encode_digest(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("byte-level BPE", byte_bpe),
]

#: SQL cannot express a trained classifier, the sketches or the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def applied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages on ``docs``, in turn."""
    begun = common.mark()
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.swept(begun, docs)
    return docs
