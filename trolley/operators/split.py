"""Deterministic train/test split by a hashed uniform of the instance (or basket) key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions.hashing import uniform


def split_instances(df: DataFrame, test_share: float = 0.01, seed: int = 1,
                    split_by: str = "instance_id") -> DataFrame:
    """Add ``split`` = 'test' for a ``test_share`` of keys, else 'train'.

    ``split_by="pid"`` keeps both instances of a basket on the same side.
    """
    if not 0.0 <= test_share <= 1.0:
        raise ValueError("test_share must be in [0, 1]")
    u = uniform(seed, F.col(split_by))
    return df.withColumn("split", F.when(u < F.lit(test_share), F.lit("test")).otherwise(F.lit("train")))
