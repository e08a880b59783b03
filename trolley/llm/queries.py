"""Registered queries of the training-data operators: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_register
def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import decontam
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.report(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_register
def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import line_quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_quality.line_rules(docs)


@_register
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import simhash_blocks
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_blocks.near_copies(docs)


@_register
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import line_edit_dedup
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_edit_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@_register
def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import quality_fm
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels").where(fold != 0))
    return quality_fm.score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                                                (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_register
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import langid
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.fit(docs.select("doc_id", "text", "lang").where(fold != 1))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score",
                        F.size("language.spans").cast("bigint").alias("n_spans"))


@_register
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import sentencepiece_backend as sp
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sp.encode(docs, back=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), sp.ids_digest(F.col("ids")).alias("ids_sha256"), "decoded_sha256", "round_trip")


@_register
def op7_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import repeated_phrases
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_phrases.dedup_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op8_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import page_diff
    found = page_diff.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), F.col("n_shared").cast("bigint"))


@_register
def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import training_order
    rows, _ = training_order.write_shards(spark, f"{sf_dir}/documents.parquet")
    return rows


@_register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import hard_negatives
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


@_register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import spelling_variants as sv
    runs = sv.runs(table(spark, sf_dir, "documents").select("doc_id", "text")).where(F.length("run") >= 5)
    h, n = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")), F.length("run")
    place = (h % n).cast("int")
    slip = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    return sv.variants(runs.select(F.when(h % 97 == 0, slip).otherwise(F.col("run")).alias("word")))


@_register
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trolley.llm import pii_tagger as pii
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))
