"""Token vocabulary (all tokens, or the top V by total count) and binary token encoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions.text import ENGLISH_STOP_WORDS, TOKEN_GAP
from trolley.operators.ranking import dense_ids
from trolley.session import materialize, release

def stop_word_table(spark) -> DataFrame:
    """The fixed stop-word list as a one-column table (181 rows: a bounded broadcast side)."""
    words = F.array(*[F.lit(w.lower()) for w in ENGLISH_STOP_WORDS])
    return spark.range(0, 1, 1, 1).select(F.explode(words).alias("token"))


def token_rows(df: DataFrame, keys: list[str], text_col: str, stop_words: bool = False, once: bool = False) -> DataFrame:
    """F3 (+F4) in row form: one ``(keys..., token)`` row per token occurrence, or with ``once`` per distinct token of a text.

    Same tokens as ``tokenize`` / ``drop_stop_words``, but as a generator plus filter and a
    broadcast anti-join, which stay inside whole-stage code generation.
    """
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TOKEN_GAP, -1)
    toks = (df.select(*keys, F.explode(F.array_distinct(words) if once else words).alias("token"))
            .where(F.length("token") > 0))
    if stop_words:
        toks = toks.join(F.broadcast(stop_word_table(df.sparkSession)), "token", "left_anti")
    return toks


class Summary:
    """Misra-Gries counts of at most ``size`` tokens: a token's true count lies within ``error`` above its count here."""

    def __init__(self, size: int):
        self.size, self.counts, self.error = size, {}, 0

    def add(self, tokens, counts) -> None:
        mine = self.counts
        for token, n in zip(tokens, counts):
            mine[token] = mine.get(token, 0) + n
        if len(mine) > 2 * self.size:
            self.shrink()

    def shrink(self) -> None:
        """Take the (size + 1)-th largest count off every token, and leave out those that reach zero."""
        if len(self.counts) > self.size:
            values = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            cut = int(np.partition(values, -self.size - 1)[-self.size - 1])
            self.counts = {t: n - cut for t, n in self.counts.items() if n > cut}
            self.error += cut


def token_summaries(tokens: DataFrame, size: int) -> DataFrame:
    """Rows (token, low, error): each partition's summary of (token, n), and one row without a token for its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(size)
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by("token").aggregate([("n", "sum")])
            summary.add(found["token"].to_pylist(), found["n_sum"].to_pylist())
        summary.shrink()
        names, counts = [*summary.counts, None], [*summary.counts.values(), 0]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()),
                                          pa.array([0] * (len(names) - 1) + [summary.error], pa.int64())], ["token", "low", "error"])

    return tokens.select("token", "n").mapInArrow(run, "token string, low bigint, error bigint")


def top_counts(tokens: DataFrame, size: int, room: int = 4) -> DataFrame:
    """Rows (token, freq): exact sums of n over (token, n) rows, of tokens that include the ``size`` most frequent ones.

    Every partition sends a summary of ``room * size`` tokens at most, and the summaries add up: a token's true
    count lies between its sum and that sum plus the summed errors. Tokens whose upper bound is below the
    ``size``-th largest lower bound are out; the rest is counted exactly. If the errors alone reach
    that bound, a token in no summary could be among the first, and all tokens are counted.
    """
    merged = materialize(token_summaries(tokens, room * size).groupBy("token").agg(F.sum("low").alias("low"), F.sum("error").alias("error")))
    error = merged.where("token IS NULL").first()
    error = error["error"] if error else 0
    lows = merged.where("token IS NOT NULL")
    if not error:  # nothing was left out: the sums are the counts
        return lows.select("token", F.col("low").alias("freq"))
    bound = lows.orderBy(F.col("low").desc()).limit(size).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low")).first()
    if bound["n"] < size or error >= bound["low"]:
        release(merged)
        return tokens.groupBy("token").agg(F.sum("n").alias("freq"))
    survivors = lows.where(F.col("low") + F.lit(error) >= F.lit(bound["low"])).select("token")
    return tokens.join(survivors, "token", "left_semi").groupBy("token").agg(F.sum("n").alias("freq"))


def fit_vocab(texts: DataFrame, text_col: str = "names", size: int | None = None,
              stop_words: bool = False, room: int = 4, weight: str | None = None) -> DataFrame:
    """``(token, token_id, freq)`` of all tokens, or of the ``size`` most frequent ones.

    Frequency is the total number of occurrences, each counted ``weight`` times if that column
    is named (texts that stand for several equal ones); ties go to the smaller token. Ranking is distributed (range sort). With a ``size``, summaries of ``room * size`` tokens per partition choose the
    tokens that are counted exactly (``top_counts``), so not every rare token is shuffled and ranked.
    """
    if size is not None and size <= 0:
        raise ValueError("vocabulary size must be positive")
    n = F.col(weight) if weight else F.lit(1)
    tokens = token_rows(texts.select(text_col, n.cast("bigint").alias("n")), ["n"], text_col, stop_words)
    counts = tokens.groupBy("token").agg(F.sum("n").alias("freq")) if size is None else top_counts(tokens, size, room)
    ranked = dense_ids(counts, [F.col("freq").desc(), F.col("token").asc()], "token_id")
    if size is not None:
        ranked = ranked.where(F.col("token_id") < F.lit(size))
    return ranked.select("token", "token_id", "freq")


def encode_token_rows(tokens: DataFrame, keys: list[str], vocab: DataFrame, distinct: bool = True) -> DataFrame:
    """F5 on token rows: distinct ``(keys..., token_id)`` of in-vocabulary tokens; ``distinct``: whether rows may repeat."""
    coded = tokens.join(vocab.select("token", "token_id"), "token").select(*keys, "token_id")
    return coded.distinct() if distinct else coded
