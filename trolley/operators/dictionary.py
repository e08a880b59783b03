"""String dictionaries: frequency-ordered dense ids, encoding with an unknown bucket.

Ids follow descending frequency with ties broken by the string itself. Null and unseen
strings encode to N, the number of known strings, so an id block needs N + 1 slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.operators.ranking import dense_ids


def fit_dict(df: DataFrame, col: str, id_col: str | None = None) -> DataFrame:
    """A5: ``(col, id_col, freq)``, one row per distinct non-null string."""
    id_col = id_col or f"{col}_id"
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("freq"))
    return rank_strings(counts, col, id_col)


def rank_strings(counts: DataFrame, col: str, id_col: str) -> DataFrame:
    """``(col, id_col, freq)`` of counted strings ``(col, freq)``."""
    return dense_ids(counts, [F.col("freq").desc(), F.col(col).asc()], id_col).select(col, id_col, "freq")


def dict_size(dictionary: DataFrame) -> int:
    """Number of known strings (= id of the unknown bucket)."""
    return dictionary.count()


def encode(df: DataFrame, dictionary: DataFrame, col: str, size: int, id_col: str | None = None) -> DataFrame:
    """Add ``id_col``; unseen and null strings map to ``size``.

    The dictionary side is joined by key; adaptive execution broadcasts it when its measured
    size is small and splits skewed (hot) strings on the data side otherwise.
    """
    id_col = id_col or f"{col}_id"
    lookup = dictionary.select(col, id_col)
    return (df.join(lookup, col, "left")
            .withColumn(id_col, F.coalesce(F.col(id_col), F.lit(size).cast("bigint"))))


def encode_items(items: DataFrame, item_dict: DataFrame, size: int) -> DataFrame:
    return encode(items, item_dict, "item", size, "item_id")


def save_dict(dictionary: DataFrame, path: str) -> None:
    """Persist a fitted dictionary (overwrite)."""
    dictionary.write.mode("overwrite").parquet(path)


def load_dict(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
