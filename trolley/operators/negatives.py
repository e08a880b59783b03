"""Hard-negative sampling: random (basket, item) tries filtered by anti-joins.

A try survives when the item is not in the basket, no basket of the same name holds it,
and at least one of its makers is new to the basket. Every lookup side is de-duplicated on
its join key before the join, so no key repeats on the build side; the tries are uniform,
so the probe side carries no hot key either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.functions.hashing import uniform_int
from trolley.session import materialize_together, shuffle_partitions

ROWS_PER_SLICE = 2_000_000


def candidate_rows(spark, n: int) -> DataFrame:
    """``n`` numbered tries, sliced so each task generates a bounded share."""
    slices = max(shuffle_partitions(spark), -(-n // ROWS_PER_SLICE))
    return spark.range(0, n, 1, slices).select(F.col("id").alias("try_id"))


def sample_pairs(spark, n: int, max_pid: int, n_items: int, seed_pid: int = 1, seed_item: int = 2) -> DataFrame:
    """Uniform ``pid`` in ``[0, max_pid]`` and ``item_id`` in ``[0, n_items]`` (unknown included)."""
    return candidate_rows(spark, n).select(
        "try_id",
        uniform_int(max_pid + 1, seed_pid, F.col("try_id")).alias("pid"),
        uniform_int(n_items + 1, seed_item, F.col("try_id")).alias("item_id"),
    )


def drop_seen_items(cand: DataFrame, pos: DataFrame) -> DataFrame:
    """Drop tries whose (item, basket) pair is a positive."""
    return cand.join(pos.select("item_id", "pid").distinct(), ["item_id", "pid"], "left_anti")


def attach_names(cand: DataFrame, pos: DataFrame) -> DataFrame:
    """The basket's (lower-cased) name; tries on unknown baskets vanish."""
    return cand.join(pos.select("pid", "pname").distinct(), "pid")


def drop_seen_names(cand: DataFrame, pos: DataFrame) -> DataFrame:
    """Drop tries whose item occurs in any basket of the same name (null names never match)."""
    return cand.join(pos.select("item_id", "pname").distinct(), ["item_id", "pname"], "left_anti")


def attach_makers(cand: DataFrame, pos: DataFrame) -> DataFrame:
    """One row per maker of the item (an item with several makers multiplies rows).

    The rows remember the tries with their makers as lists, for ``drop_seen_makers``.
    """
    makers = pos.select("item_id", "maker").distinct().groupBy("item_id") \
        .agg(F.collect_list("maker").alias("__makers"), F.max(F.col("maker").isNull()).alias("__unnamed"))
    packed = cand.join(makers, "item_id")
    out = _maker_rows(packed, F.col("__makers"))
    out._packed = packed
    return out


def _maker_rows(packed: DataFrame, makers: Column) -> DataFrame:
    """A row for each of ``makers``, and one with a null maker where the item has that."""
    every = F.when(F.col("__unnamed"), F.concat(makers, F.array(F.lit(None).cast(packed.schema["__makers"].dataType.elementType)))).otherwise(makers)
    kept = [c for c in packed.columns if c not in ("__makers", "__unnamed", "__seen")]
    return packed.select(*kept, F.explode(every).alias("maker"))


def drop_seen_makers(cand: DataFrame, pos: DataFrame) -> DataFrame:
    """Drop (try, maker) rows whose maker is already in the basket (null makers never match).

    Rows as ``attach_makers`` gives them are not moved: the tries travel with their lists of makers, less those
    of the basket, and become rows at the end.
    """
    packed = getattr(cand, "_packed", None)
    if packed is not None:
        seen = pos.select("pid", "maker").distinct().groupBy("pid").agg(F.collect_list("maker").alias("__seen"))
        met = packed.join(seen, "pid", "left")
        # both lists are distinct, so the difference loses no row
        return _maker_rows(met, F.array_except("__makers", F.coalesce("__seen", F.array().cast(met.schema["__makers"].dataType))))
    return cand.join(pos.select("maker", "pid").distinct(), ["maker", "pid"], "left_anti")


def surviving_tries(pos: DataFrame, n_tries: int, max_pid: int, n_items: int,
                    seed_pid: int = 1, seed_item: int = 2) -> DataFrame:
    """U7 up to J5: surviving ``(try_id, pid, pname, item_id, maker)`` rows."""
    cand = sample_pairs(pos.sparkSession, n_tries, max_pid, n_items, seed_pid, seed_item)
    cand = attach_names(drop_seen_items(cand, pos), pos)
    # J3 and J4 both look the item up: tries and lookups meet where the item is, in one move
    cand = drop_seen_names(cand.repartition("item_id"), pos.repartition("item_id"))
    return drop_seen_makers(attach_makers(cand, pos), pos)


def group_negatives(survivors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1: negative instances ``(pid, label=0, pname)`` and their distinct ``(pid, item_id)``."""
    inst = survivors.groupBy("pid").agg(F.min("pname").alias("pname")).withColumn("label", F.lit(0))
    pairs = survivors.select("pid", "item_id").distinct()
    return inst, pairs


def sample_negatives(pos: DataFrame, n_items: int, ratio: float = 1.0, seed_pid: int = 1,
                     seed_item: int = 2, n_rows: int | None = None, max_pid: int | None = None):
    """Negatives for encoded positives ``(pid, pname, item_id, maker)``.

    ``ratio`` tries per positive basket-item row; the basket range comes from the data.
    """
    if n_rows is None or max_pid is None:
        stats = pos.agg(F.count(F.lit(1)).alias("n"), F.max("pid").alias("max_pid")).first()
        n_rows = stats["n"] if n_rows is None else n_rows
        max_pid = stats["max_pid"] if max_pid is None else max_pid
    n_tries = int(round(ratio * n_rows))
    survivors = surviving_tries(pos, n_tries, int(max_pid), n_items, seed_pid, seed_item)
    # instances and pairs both come from the survivors: found once
    found = materialize_together(survivors.groupBy("pid", "item_id").agg(F.min("pname").alias("pname")))
    inst, pairs = group_negatives(found)
    pairs = found.select("pid", "item_id")  # distinct as they are
    pairs._trolley_table = found._trolley_table
    return inst, pairs
