"""End-to-end batch jobs: fit encoders, build instances, features, train, evaluate, recommend.

Each job is a function over DataFrames and paths; intermediate tables that several stages
reuse are written (or checkpointed) once, so a lost executor never forces recomputing the
whole chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators.baskets import by_basket
from trolley.operators.dictionary import dict_size, encode_items, fit_dict, load_dict, save_dict
from trolley.operators.evaluate import curve_areas
from trolley.operators.features import (Encoders, assert_feature_range, basket_features, basket_item_pairs,
                                       fit_encoders, instance_features, label_baskets, libsvm_lines,
                                       positive_baskets)
from trolley.operators.fm import FMParams, fm_fit_batch, fm_fit_local_sgd, fm_score
from trolley.operators.negatives import sample_negatives
from trolley.operators.recommend import recommend_lists, submission_lines, write_submission
from trolley.operators.split import split_instances
from trolley.session import materialize, release
from trolley.sources.libsvm import read_libsvm, write_libsvm
from trolley.sources.model_io import load_fm, save_fm


def preprocess_job(items: DataFrame, out_dir: str, vocab_size: int | None = None) -> Encoders:
    """Step 1: item dictionary and vocabulary (plus maker and group dictionaries), saved."""
    enc = fit_encoders(items, vocab_size)
    save_dict(enc.item_dict, f"{out_dir}/item_dict")
    save_dict(enc.vocab, f"{out_dir}/vocab")
    for col in ("maker", "grp"):
        save_dict(fit_dict(items, col, f"{col}_id"), f"{out_dir}/{col}_dict")
    return enc


def load_encoders(spark: SparkSession, out_dir: str) -> Encoders:
    item_dict = load_dict(spark, f"{out_dir}/item_dict")
    vocab = load_dict(spark, f"{out_dir}/vocab")
    return Encoders(item_dict, dict_size(item_dict), vocab, dict_size(vocab))


@dataclass
class Labelled:
    instances: DataFrame   # (instance_id, pid, label, pname, split)
    features: DataFrame    # (instance_id, feature_id, value)


def instances_job(items: DataFrame, enc: Encoders, ratio: float = 1.0, test_share: float = 0.01,
                  seed: int = 1, split_by: str = "instance_id", out_dir: str | None = None) -> Labelled:
    """Step 2a: positives + sampled negatives, split, optionally written as libSVM train/test."""
    e = materialize(encode_items(items.select("pid", "pname", "item", "maker"), enc.item_dict, enc.n_items).drop("item"))
    neg_inst, neg_pairs = sample_negatives(e, enc.n_items, ratio)
    inst = split_instances(label_baskets(positive_baskets(e), neg_inst), test_share, seed, split_by)
    inst = materialize(inst)
    feats = materialize(instance_features(inst, basket_item_pairs(e), neg_pairs, enc))
    assert_feature_range(feats, enc.num_features)
    if out_dir:
        # one pass over the features for both splits
        lines = materialize(libsvm_lines(inst, feats).join(inst.select("instance_id", "split"), "instance_id"))
        for part in ("train", "test"):
            write_libsvm(lines.where(F.col("split") == part), f"{out_dir}/{part}")
        release(lines)
    return Labelled(inst, feats)


def positive_instances_job(items: DataFrame, enc: Encoders, test_share: float = 0.01, seed: int = 1,
                           out_dir: str | None = None) -> Labelled:
    """Step 2b: every basket as a positive instance (label 1), split by basket."""
    feats = materialize(basket_features(items, enc))
    inst = split_instances(feats.select("pid").distinct().withColumn("label", F.lit(1)), test_share, seed,
                           split_by="pid")
    inst = materialize(inst.withColumnRenamed("pid", "instance_id"))
    feats = feats.withColumnRenamed("pid", "instance_id")
    if out_dir:
        # one pass over the features for both splits
        lines = materialize(libsvm_lines(inst, feats).join(inst.select("instance_id", "split"), "instance_id"))
        for part in ("train", "test"):
            write_libsvm(lines.where(F.col("split") == part), f"{out_dir}/{part}")
        release(lines)
    return Labelled(inst, feats)


def challenge_features_job(items: DataFrame, enc: Encoders, out_path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Step 3: ``(pid, feature_id, value)`` of every basket, written as Parquet.

    With ``partitions`` the table is laid out by basket first (P8).
    """
    feats = basket_features(items, enc)
    if partitions:
        feats = by_basket(feats, partitions)
    if out_path:
        feats.write.mode("overwrite").parquet(out_path)
        return feats.sparkSession.read.parquet(out_path)
    return materialize(feats)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The feature table written by ``challenge_features_job``."""
    return spark.read.parquet(path).select("pid", "feature_id", "value")


def train_job(lab: Labelled, num_features: int, hp: FMParams, method: str = "local_sgd",
              n_parts: int | None = None, out_path: str | None = None):
    """Step 4 (T8): train on the 'train' split and optionally save the model."""
    train = lab.instances.where(F.col("split") == "train")
    if method == "local_sgd":
        params, meta, hist = fm_fit_local_sgd(train, lab.features, num_features, hp, n_parts)
    else:
        params, meta, hist = fm_fit_batch(train, lab.features, num_features, hp)
    if out_path:
        save_fm(params, meta, out_path)
    return params, meta, hist


TUNED = FMParams(k=20, task=1, iterations=200, step=0.01, reg=(0.0, 0.0, 0.05), init_std=0.01)


def evaluate_job(spark: SparkSession, test_path: str, model_path: str, threshold: float | None = 0.5,
                 min_partitions: int | None = None) -> DataFrame:
    """Step 5 (E3): libSVM hold-out + saved model -> one row of ROC and PR areas."""
    params, meta = load_fm(spark, model_path)
    inst, feats = read_libsvm(spark, test_path, min_partitions, meta.num_features)
    scored = fm_score(inst, feats, params, meta)
    return curve_areas(scored, "prediction", "label", threshold)


def recommend_job(features: DataFrame, params: DataFrame, meta, enc: Encoders, k: int = 500,
                  m: int | None = None, out_path: str | None = None, files: int | None = None) -> DataFrame:
    """Step 6: top-k lines ``pid,item1,...`` for every basket; all items are candidates unless ``m`` is given."""
    lines = submission_lines(recommend_lists(features, params, meta, enc.item_dict, enc.n_items, k=k, m=m))
    if out_path:
        write_submission(lines, out_path, files)
        return lines.sparkSession.read.text(out_path).select(
            F.substring_index("value", ",", 1).cast("bigint").alias("pid"), F.col("value").alias("line"))
    return lines
