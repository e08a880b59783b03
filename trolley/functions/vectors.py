"""The edge to ``pyspark.ml``: long feature rows as sparse vector columns and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def sparse_vectors(labels: DataFrame, features: DataFrame, num_features: int, key: str = "instance_id", col: str = "features") -> DataFrame:
    """``labels`` (one row a key) with a sparse vector of the features of its key, all zeros if it has none.

    Indices are sorted and repeated ones added up before the rows are gathered. The vector column is made
    of whole Arrow batches whose columns have a vector's fields; no value passes through a Python object. An id outside
    the dimension raises, as does a dimension of 2^31 or more, which a vector cannot have.
    """
    if not 0 <= num_features < 1 << 31:
        raise ValueError(f"a vector cannot have {num_features} places")
    inside = (F.col("feature_id") >= 0) & (F.col("feature_id") < F.lit(num_features))
    place = F.when(inside, F.col("feature_id").cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("feature id outside the vector: "), F.col("feature_id").cast("string"))).cast("int"))
    summed = features.groupBy(F.col(key).alias("__key"), "feature_id").agg(F.sum("value").cast("double").alias("value"))
    gathered = summed.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct(place.alias("i"), F.col("value").alias("x")))).alias("__cells"))
    none = F.array().cast("array<struct<i:int,x:double>>")
    cells = F.coalesce("__cells", none)
    fields = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(num_features).alias("size"), F.transform(cells, lambda c: c["i"]).alias("indices"),
                      F.transform(cells, lambda c: c["x"]).alias("values"))
    kept = [c for c in labels.columns if c != col]
    joined = labels.join(gathered, labels[key].eqNullSafe(F.col("__key")), "left").select(*[labels[c] for c in kept], fields.alias(col))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches

    return joined.mapInArrow(same, StructType([*[joined.schema[c] for c in kept], StructField(col, VectorUDT())]))


def long_features(vectors: DataFrame, key: str = "instance_id", col: str = "features") -> DataFrame:
    """Long rows ``(key, feature_id, value)`` of the non-zero places of a vector column."""
    kind = StructType([vectors.schema[key], StructField("v", VectorUDT().sqlType())])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches

    parts = vectors.select(key, F.col(col).alias("v")).mapInArrow(same, kind).select(key, "v.type", "v.size", "v.indices", "v.values")
    places = F.when(F.col("type") == 0, F.col("indices")).otherwise(F.sequence(F.lit(0), F.size("values") - 1))
    cells = parts.select(key, F.explode(F.arrays_zip(places.alias("i"), F.col("values").alias("x"))).alias("c"))
    return cells.select(key, F.col("c.i").cast("bigint").alias("feature_id"), F.col("c.x").alias("value")).where("value != 0")
