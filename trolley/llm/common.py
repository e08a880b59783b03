"""Helpers shared by the training-data operators: tables, ASCII word rules, row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.session import materialize as _materialize

#: ASCII white space 09-0D and 20, as a set of characters and as a Java/Python class.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """``materialize`` that also gives back the shuffle files of the finished write at once.

    The written table on shared storage replaces them, so a job of many steps holds the
    shuffles of one step only.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return _materialize(df)
    finally:
        spark.conf.set(_CLEANUP, before)


def given_back(made: Iterator) -> Iterator:
    """What a task makes; at its end the free memory goes back, as its Python worker waits beside the JVM for later tasks."""
    try:
        yield from made
    finally:
        made.close()
        del made
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)


def ws_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WS_CLASS + "+")).otherwise(
        F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    """64-bit hash that tells apart rows which share a document id; null has its own value."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))
