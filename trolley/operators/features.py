"""Baskets to sparse binary features in long form ``(key, feature_id, value)``.

Feature layout: item ids occupy ``0..N`` (N = unknown item), name tokens follow at
``N + 1 + token_id``. Long form keeps a very large basket spread over many tasks; arrays are
built only at the edges (libSVM lines, inspection).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.operators.baskets import TEXT_COLUMNS, fill_names
from trolley.operators.dictionary import encode_items, rank_strings
from trolley.operators.vocab import encode_token_rows, fit_vocab, token_rows
from trolley.session import materialize, release, shuffle_partitions


@dataclass(frozen=True)
class Encoders:
    """Fitted item dictionary and token vocabulary with their sizes."""
    item_dict: DataFrame   # (item, item_id, freq)
    n_items: int           # N: known items; N is also the unknown-item id
    vocab: DataFrame       # (token, token_id, freq)
    n_tokens: int          # vocabulary rows actually kept

    @property
    def token_offset(self) -> int:
        return self.n_items + 1

    @property
    def num_features(self) -> int:
        return self.n_items + 1 + self.n_tokens


def string_counts(items: DataFrame) -> DataFrame:
    """Rows (field, string, n): the distinct strings of the item column and of the text columns, counted in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("string")) for k, c in enumerate(("item", *TEXT_COLUMNS))])
    return (items.select(F.explode(cells).alias("cell")).select("cell.field", "cell.string")
            .where(F.col("string").isNotNull())
            .groupBy("field", "string").agg(F.count(F.lit(1)).alias("n")))


def fit_encoders(items: DataFrame, vocab_size: int | None = None, stop_words: bool = False) -> Encoders:
    """Step 1: item dictionary and vocabulary fitted on basket-item rows.

    The items are read once: both come from the counts of their distinct strings. As the text of
    an item joins its fields by a space, no token spans two of them, and a string that occurs n times is
    tokenized once and counts n times.
    """
    counts = materialize(string_counts(items))
    known = counts.where("field = 0").select(F.col("string").alias("item"), F.col("n").alias("freq"))
    item_dict = materialize(rank_strings(known, "item", "item_id"))
    vocab = materialize(fit_vocab(counts.where("field > 0"), "string", vocab_size, stop_words, weight="n"))
    release(counts)
    return Encoders(item_dict, item_dict.count(), vocab, vocab.count())


def basket_item_pairs(encoded: DataFrame, key: str = "pid") -> DataFrame:
    """U2 in long form: distinct ``(key, item_id)`` of encoded basket-item rows."""
    return encoded.select(key, "item_id").distinct()


def group_baskets(encoded: DataFrame) -> DataFrame:
    """``(pid, name, item_ids)`` with sorted distinct ids (de-duplicated before collecting)."""
    pairs = encoded.select("pid", "name", "item_id").distinct()
    return pairs.groupBy("pid", "name").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))


def name_features(names: DataFrame, key: str, name_col: str, enc: Encoders, one_row: bool = False) -> DataFrame:
    """F3-F5 + offset: ``(key, feature_id)`` of the name tokens, stop words removed.

    ``one_row``: no key has two rows, so a token that is taken once a row needs no grouping over rows.
    """
    filled = fill_names(names.select(key, F.col(name_col).alias("__name")), ["__name"])
    toks = token_rows(filled, [key], "__name", stop_words=True, once=one_row)
    coded = encode_token_rows(toks, [key], enc.vocab, distinct=not one_row)
    return coded.select(key, (F.col("token_id") + F.lit(enc.token_offset)).alias("feature_id"))


def assemble(item_pairs: DataFrame, token_pairs: DataFrame, key: str) -> DataFrame:
    """F8: item block then token block, value 1.0 for every active feature."""
    items = item_pairs.select(key, F.col("item_id").alias("feature_id"))
    return (items.unionByName(token_pairs.select(key, "feature_id"))
            .withColumn("value", F.lit(1.0)))


def basket_features(items: DataFrame, enc: Encoders) -> DataFrame:
    """Step 3: features of every basket, ``(pid, feature_id, value)``."""
    encoded = encode_items(items.select("pid", "name", "item"), enc.item_dict, enc.n_items)
    names = items.select("pid", "name").distinct()
    return assemble(basket_item_pairs(encoded), name_features(names, "pid", "name", enc), "pid")


def positive_baskets(encoded: DataFrame) -> DataFrame:
    """A2: one labelled positive instance per basket: ``(pid, label=1, pname)``."""
    return encoded.groupBy("pid").agg(F.min("pname").alias("pname")).withColumn("label", F.lit(1))


def label_baskets(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Positives and negatives as instances ``(instance_id, pid, label, pname)``."""
    both = pos.select("pid", "label", "pname").unionByName(neg.select("pid", "label", "pname"))
    return both.withColumn("instance_id", F.col("pid") * F.lit(2) + F.col("label")).select(
        "instance_id", "pid", "label", "pname")


def instance_features(instances: DataFrame, pos_pairs: DataFrame, neg_pairs: DataFrame,
                      enc: Encoders) -> DataFrame:
    """Long features of labelled instances: ``(instance_id, feature_id, value)``."""
    item_pairs = (pos_pairs.select((F.col("pid") * 2 + 1).alias("instance_id"), "item_id")
                  .unionByName(neg_pairs.select((F.col("pid") * 2).alias("instance_id"), "item_id")))
    names = instances.select("instance_id", "pname")
    return assemble(item_pairs, name_features(names, "instance_id", "pname", enc, one_row=True), "instance_id")


def check_feature_range(features: DataFrame, num_features: int) -> DataFrame:
    """one row stating whether every feature id lies in ``[0, num_features)``."""
    return features.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("feature_id").alias("min_feature_id"),
        F.max("feature_id").alias("max_feature_id"),
    ).select("*", F.lit(num_features).cast("bigint").alias("num_features"),
             ((F.col("min_feature_id") >= 0) & (F.col("max_feature_id") < F.lit(num_features))).alias("in_range"))


def assert_feature_range(features: DataFrame, num_features: int) -> None:
    row = check_feature_range(features, num_features).first()
    if row["n_rows"] and not row["in_range"]:
        raise ValueError(f"feature ids outside [0, {num_features}): {row['min_feature_id']}..{row['max_feature_id']}")


LINE_ROWS = 1 << 18  # feature rows a task gathers into lines


def line_partitions(features: DataFrame) -> int:
    """Tasks for the lines of a written feature table: a bounded share of the rows each, however many there are."""
    return max(shuffle_partitions(features.sparkSession), -(-features.count() // LINE_ROWS))


def libsvm_lines(labels: DataFrame, features: DataFrame, key: str = "instance_id", partitions: int | None = None) -> DataFrame:
    """S4 text form: ``label idx:value ...`` with 1-based ascending indices.

    Only the distinct active features of one instance are gathered into its line. They move once, to their
    instance, where they are de-duplicated and gathered. ``partitions`` says over how many tasks, for a caller that
    knows their number (``line_partitions``); else adaptive execution merges partitions by their bytes, which for such
    rows, packed tightly on the way, may be millions of rows in a task.
    """
    own = features.select(key, "feature_id", "value")
    pairs = (own.repartition(partitions, key) if partitions else own.repartition(key)).dropDuplicates([key, "feature_id"])
    per_key = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("fv"))
    cells = F.transform("fv", lambda s: F.concat((s["feature_id"] + 1).cast("string"), F.lit(":"),
                                                 s["value"].cast("string")))
    joined = labels.select(key, "label").join(per_key, key, "left")
    line = F.concat_ws(" ", F.col("label").cast("double").cast("string"),
                       F.coalesce(F.array_join(cells, " "), F.lit("")))
    return joined.select(key, F.trim(line).alias("line"))
