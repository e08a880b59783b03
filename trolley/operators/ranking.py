"""Global running sums and dense ids over a total order, without a one-task window.

A window with no partition key moves every row into one task. Instead the rows are
range-partitioned on the order, checkpointed (so partition membership is fixed even if a
stage is recomputed), summed within each range partition, and shifted by the totals of the
preceding partitions. The totals table has one row per partition, so it is small by
construction and safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.session import materialize, shuffle_partitions

_PART = "__rt_part"


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column],
                 partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums of ``sums`` along ``order`` (which must be a total order)."""
    spark = df.sparkSession
    n_parts = partitions or shuffle_partitions(spark)
    value_cols = {name: f"__rt_v_{name}" for name in sums}
    # written first: range partitioning samples its input, which would otherwise rerun the upstream plan
    base = materialize(df.select("*", *[expr.alias(value_cols[name]) for name, expr in sums.items()]))
    ranged = materialize(base.repartitionByRange(n_parts, *order)
                         .withColumn(_PART, F.spark_partition_id()))

    within = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                   Window.currentRow)
    local = ranged.select("*", *[F.sum(v).over(within).alias(f"{v}_local") for v in value_cols.values()])

    totals = ranged.groupBy(_PART).agg(*[F.sum(v).alias(f"{v}_total") for v in value_cols.values()])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PART, *[F.coalesce(F.sum(f"{v}_total").over(before), F.lit(0)).alias(f"{v}_offset")
                                     for v in value_cols.values()])

    joined = local.join(F.broadcast(offsets), _PART)
    return joined.select(*[F.col(c) for c in df.columns],
                         *[(F.col(f"{v}_local") + F.col(f"{v}_offset")).alias(name)
                           for name, v in value_cols.items()])


def dense_ids(df: DataFrame, order: list[Column], id_col: str, partitions: int | None = None) -> DataFrame:
    """0-based position of every row along a total order."""
    ranked = running_sums(df, order, {id_col: F.lit(1).cast("bigint")}, partitions)
    return ranked.withColumn(id_col, F.col(id_col) - F.lit(1))
