"""Shared building blocks of the stand-in queries (tables -> items -> encoders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trolley.operators.dictionary import encode_items, fit_dict
from trolley.operators.features import (Encoders, basket_item_pairs, fit_encoders, instance_features,
                                       label_baskets, positive_baskets)
from trolley.operators.negatives import sample_negatives
from trolley.operators.split import split_instances
from trolley.plans.oracle import HISTORY_BEFORE
from trolley.session import materialize, materialize_bucketed, release, shuffle_partitions
from trolley.sources.baskets import stand_in_history_items, stand_in_items, table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in_items(spark, sf_dir)


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basket-item rows written once, for queries that read them several times."""
    return materialize(items(spark, sf_dir))


def history_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in_history_items(spark, sf_dir, HISTORY_BEFORE)


def encoders(spark: SparkSession, sf_dir: str, vocab_size: int | None = None) -> Encoders:
    return fit_encoders(items(spark, sf_dir), vocab_size)


def item_dict(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    d = materialize(fit_dict(items(spark, sf_dir), "item", "item_id"))
    return d, d.count()


def encoded(spark: SparkSession, sf_dir: str, enc: Encoders | None = None) -> DataFrame:
    if enc is None:
        d, n = item_dict(spark, sf_dir)
    else:
        d, n = enc.item_dict, enc.n_items
    return encode_items(items(spark, sf_dir), d, n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def by_basket(encoded_rows: DataFrame) -> DataFrame:
    """Encoded rows written once and laid together by basket: what is joined or grouped by basket does not move them again."""
    return materialize_bucketed(encoded_rows, shuffle_partitions(encoded_rows.sparkSession), "pid")


def labelled(spark: SparkSession, sf_dir: str, enc: Encoders | None = None,
             test_share: float = 0.01, seed: int = 1, rows: DataFrame | None = None):
    """Step 2a on the stand-in: encoders, instances ``(instance_id, pid, label, pname, split)``,
    their long features and the surviving negative tries. ``rows``: the stored items, if the caller has them."""
    own = rows is None
    rows = stored_items(spark, sf_dir) if own else rows
    enc = enc or fit_encoders(rows)
    # basket items feed five joins and two groupings: written once, read by all of them
    e = by_basket(encode_items(rows.select("pid", "pname", "item", "maker"), enc.item_dict, enc.n_items).drop("item"))
    if own:
        release(rows)
    neg_inst, neg_pairs = sample_negatives(e, enc.n_items)
    inst = materialize(split_instances(label_baskets(positive_baskets(e), neg_inst), test_share, seed))
    feats = materialize(instance_features(inst, basket_item_pairs(e), neg_pairs, enc))
    release(e)
    release(neg_pairs)
    return enc, inst, feats
