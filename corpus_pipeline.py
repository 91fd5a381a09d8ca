"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, to be written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``docs``:

1. language_id: documents whose language can't be told go.
2. line_dedup: aligned common blocks of lines go from the later document.
3. simhash: one document of each near-duplicate group stays, the one with the smallest id.
4. decontaminate: documents that hold a passage of a benchmark item go.
5. encode: ids and decoded text of what is left, as digests.

Null texts and texts without letters go in the first stage; null ids have no duplicates
and stay; repeated rows are duplicates of each other; empty tables stay empty; further
columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.llm import byte_cnn, line_dedup, simhash_blocks, winnowing
from codehealth.llm.common import shared_path, table
from codehealth.llm.queries import bpe_digest


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = byte_cnn.identify(docs, byte_cnn.fit(docs), "__language")
    return out.where(F.col("__language.lang") != byte_cnn.UNKNOWN).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(docs, cut="__line_cut")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__line_cut").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash_blocks.near_duplicates(docs)
    copies = found.where("doc_id != component_id").select(F.col("doc_id").alias("__copy")).distinct()
    kept = docs.join(copies, F.col("doc_id") == F.col("__copy"), "left_anti")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is null").union(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = found.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(found, same, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digest(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash", simhash_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

ORACLE_SQL = None  # several stages have no SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
