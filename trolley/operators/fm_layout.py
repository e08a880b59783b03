"""Co-partitioned tables of a batch training loop.

Every step joins the features twice: by feature id with the parameters (scores), and by instance with
the instances' statistics (gradient). The features are therefore written twice, once bucketed
by feature and once by instance, and every step's parameters and statistics are written into as many
buckets. The two joins of a step then read the features as they lie: what is shuffled is partial
sums, one row per task and instance or per task and feature.

A bucket cannot be split at run time as a shuffle can, so keys with more than ``salt_rows`` rows are
spread over several salts beforehand, by the hash of the other key, and the other side has a row
for each salt. Such keys are few: at most the rows divided by ``salt_rows``. Where no instance is that large,
the instances have no salt: their features are laid down by the join that picks them, and the
statistics by the grouping that makes them, so neither moves again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.session import materialize, materialize_bucketed, release, shuffle_partitions

SALT_ROWS = 1 << 20
SALT = "salt"


def hot_keys(rows: DataFrame, key: str, salt_rows: int) -> DataFrame:
    """Rows (key, salts) of the keys with more than ``salt_rows`` rows."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > salt_rows)
    return materialize(counted.select(key, F.ceil(F.col("n") / F.lit(salt_rows)).alias("salts")))


def salted(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with the salt of each row: 0 but for hot keys, whose rows are spread by the hash of ``by``."""
    return rows.join(hot, key, "left").withColumn(SALT, F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")), F.lit(0).cast("bigint"))).drop("salts")


def spread(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``rows`` of one row a key, once for each salt of its key."""
    every = F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1).cast("bigint")) - 1)
    return rows.join(hot, key, "left").withColumn(SALT, F.explode(every)).drop("salts")


@dataclass
class TrainingLayout:
    """Features of the training instances in both layouts; see the module."""
    key: str
    buckets: int
    by_feature: DataFrame   # (key, feature_id, value, salt) by feature_id, salt
    by_instance: DataFrame  # (key, feature_id, value) by key, or with a salt by key, salt
    hot_features: DataFrame
    hot_instances: DataFrame | None  # None: no instance is salted

    @property
    def instance_keys(self) -> tuple[str, ...]:
        """What ``by_instance`` and the statistics are laid and joined by."""
        return (self.key,) if self.hot_instances is None else (self.key, SALT)

    def lay_params(self, params: DataFrame) -> DataFrame:
        """Parameters (feature_id, w, v, salt) written beside ``by_feature``."""
        return materialize_bucketed(spread(params.select("feature_id", "w", "v"), self.hot_features, "feature_id"), self.buckets, "feature_id", SALT)

    def lay_stats(self, stats: DataFrame) -> DataFrame:
        """Statistics of the instances written beside ``by_instance``."""
        if self.hot_instances is None:
            return materialize_bucketed(stats, self.buckets, self.key, placed=True)
        return materialize_bucketed(spread(stats, self.hot_instances, self.key), self.buckets, self.key, SALT)

    def once(self, stats: DataFrame) -> DataFrame:
        """One row an instance of laid-out statistics."""
        return stats if self.hot_instances is None else stats.where(F.col(SALT) == 0)

    def release(self) -> None:
        for t in (self.by_feature, self.by_instance, self.hot_features, self.hot_instances):
            if t is not None:
                release(t)


def instance_rows(instances: DataFrame, features: DataFrame, key: str = "instance_id", buckets: int | None = None) -> DataFrame:
    """The features of ``instances``, laid down where the join that picks them has them: by instance."""
    rows = features.select(key, "feature_id", "value").join(instances.select(key), key, "left_semi")
    return materialize_bucketed(rows, buckets or shuffle_partitions(instances.sparkSession), key, placed=True)


def training_layout(instances: DataFrame, features: DataFrame, key: str = "instance_id", buckets: int | None = None,
                    salt_rows: int = SALT_ROWS) -> TrainingLayout:
    """Write the features of ``instances`` in both layouts; features of other instances are left out."""
    n = buckets or shuffle_partitions(instances.sparkSession)
    rows = instance_rows(instances, features, key, n)
    hot_f, hot_i = hot_keys(rows, "feature_id", salt_rows), hot_keys(rows, key, salt_rows)
    by_feature = materialize_bucketed(salted(rows, hot_f, "feature_id", key), n, "feature_id", SALT)
    if hot_i.first() is None:
        release(hot_i)
        return TrainingLayout(key, n, by_feature, rows, hot_f, None)
    by_instance = materialize_bucketed(salted(rows, hot_i, key, "feature_id"), n, key, SALT)
    release(rows)
    return TrainingLayout(key, n, by_feature, by_instance, hot_f, hot_i)
