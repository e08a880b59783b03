"""Corpus pipeline: the stages that turn ``documents`` into training tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result
is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm import decontam, line_edit_dedup, quality_fm, sentencepiece_backend, simhash_blocks
from trolley.llm.common import store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under 0.3 go."""
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model, score_col="__score").where(F.col("__score") >= 0.3).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines close to an earlier line, and short ones equal to one; documents that lose all their words go."""
    # the operator's counts have names that a column of the documents may have as well
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    cleaned = line_edit_dedup.dedup_lines(docs.withColumnsRenamed(aside), short=True)
    had_loss = F.col("n_removed") > 0
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = cleaned.where(~(had_loss & empty)) \
        .withColumn("n_chars", F.when(had_loss, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (three-word shingles, two bits) one document stays: the one with the smallest id."""
    return simhash_blocks.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text that is left, and the digest of what they decode to."""
    return sentencepiece_backend.encode(docs.select("doc_id", "text"), back=True) \
        .select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "decoded_sha256", "round_trip")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("tokens", tokens),
]

#: The first and the last stage, a trained model and a tokenizer library, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs)
    return docs
