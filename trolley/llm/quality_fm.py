"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score: ``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise part is
``1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``, linear in the features of a text. Features are
hashed lower-case words (log counts, unit length per text), statistics of bytes, words, word
triples and lines, and the table's ``n_chars``. Ids, sources, languages and labels are no
features.

Training takes at most ``max_rows`` labelled texts, those of the smallest id hashes, so the
sample is the same on every run and its size does not grow with the table; their sparse
features, not the texts, come to the driver for Adam on the logistic loss. Scoring reads every whole text in Arrow batches, in
slices of bounded size; nothing is shuffled.

Defined cases: null and empty texts have no words and are scored by their statistics; a null
``n_chars`` counts as unknown; labels of a repeated id are averaged; null labels are left out;
without labels every score is 0.5; an empty table gives an empty result; only the id, text, size and label
columns are read, so others may have any names, and a column with the name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm import textbytes as tb
from trolley.llm.common import given_back

BUCKETS, FACTORS, MAX_ROWS = 1 << 14, 8, 8000

#: Byte classes: 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 exclamation, 6 other mark, 7 white space, 8 above ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 6
_CLASS[list(b"#*$%&|<>")], _CLASS[33], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 4, 5, 7, 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
N_STATS = 17


@dataclass
class Model:
    w0: float
    w: np.ndarray  # BUCKETS + N_STATS
    v: np.ndarray  # (BUCKETS + N_STATS) x FACTORS
    mean: np.ndarray
    scale: np.ndarray


def _repeats(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each text, how many keys it holds beyond the distinct ones."""
    h = tb.mix(key ^ tb.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(h, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def features(texts: list[bytes], n_chars: np.ndarray, hasher: tb.SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, bucket, value) of the hashed words, and the statistics as rows."""
    n = len(texts)
    buf, stops = tb.pack(texts)
    size = np.diff(stops, prepend=0)
    classes = np.bincount(np.repeat(np.arange(n), size) * 9 + _CLASS[buf], minlength=9 * n).reshape(n, 9)
    start, stop = tb.words(buf)
    h = hasher(_LOWER[buf], start, stop)
    doc = np.searchsorted(stops, start, side="right")
    count = np.bincount(doc, minlength=n)
    key, times = np.unique(doc * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, bucket, value = key // BUCKETS, key % BUCKETS, np.log1p(times)
    value /= np.sqrt(np.maximum(np.bincount(row, value * value, minlength=n), 1e-12))[row]

    inside = doc[2:] == doc[:-2] if len(doc) > 2 else np.zeros(0, bool)
    triple = (h[:-2] * np.uint64(3) ^ tb.mix(h[1:-1]) + h[2:] * np.uint64(7))[inside] if len(doc) > 2 else np.zeros(0, np.uint64)
    triple_doc = doc[:-2][inside] if len(doc) > 2 else np.zeros(0, np.int64)
    l_start, l_stop = tb.spans(buf == 10)
    l_doc = np.searchsorted(stops, l_start, side="right")
    lines = np.bincount(l_doc, minlength=n)
    per_word, per_byte = np.maximum(count, 1), np.maximum(size, 1)
    letters = np.maximum(classes[:, 1] + classes[:, 2], 1)
    known = n_chars >= 0
    stats = np.stack([
        np.log1p(count), np.log1p(size), (size - classes[:, 7]) / per_word, classes[:, 1] / letters, classes[:, 3] / per_byte,
        classes[:, 4] / per_word, classes[:, 5] / per_word, classes[:, 6] / per_word, classes[:, 8] / per_byte,
        np.bincount(row, minlength=n) / per_word, _repeats(h, doc, n) / per_word, _repeats(triple, triple_doc, n) / per_word,
        np.log1p(lines), np.log1p(count / np.maximum(lines, 1)),
        _repeats(hasher(buf, l_start, l_stop), l_doc, n) / np.maximum(lines, 1),
        np.log1p(np.where(known, n_chars, 0)), known.astype(float)], axis=1)
    return row, bucket, value, stats


def _raw_scores(m: Model, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and the factor sums, in time linear in the features."""
    n = len(z)
    wz, vz = m.w[BUCKETS:], m.v[BUCKETS:]
    sums = z @ vz + np.stack([np.bincount(row, m.v[bucket, f] * value, minlength=n) for f in range(FACTORS)], axis=1)
    squares = (z * z) @ (vz * vz).sum(axis=1) + np.bincount(row, (m.v[bucket] ** 2).sum(axis=1) * value * value, minlength=n)
    return m.w0 + z @ wz + np.bincount(row, m.w[bucket] * value, minlength=n) + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums


def _standard(m: Model, stats: np.ndarray) -> np.ndarray:
    return np.clip((stats - m.mean) / m.scale, -6, 6) / np.sqrt(N_STATS)


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], epochs: int = 30, batch: int = 128, step: float = 0.02,
          decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit on (buckets, values, statistics, label in 0..1) rows; without rows the model scores 0.5."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + N_STATS
    m = Model(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), np.zeros(N_STATS), np.ones(N_STATS))
    if not rows:
        m.v[:] = 0
        return m
    stats = np.stack([r[2] for r in rows])
    m.mean, m.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    y, z = np.array([r[3] for r in rows]), _standard(m, stats)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    theta = np.concatenate([[np.log(rate / (1 - rate))], m.w, m.v.ravel()])
    one, two, t = np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(epochs):
        for ids in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            t += 1
            m.w0, m.w, m.v = theta[0], theta[1:1 + size], theta[1 + size:].reshape(size, FACTORS)
            row = np.repeat(np.arange(len(ids)), [len(rows[i][0]) for i in ids])
            bucket, value = np.concatenate([rows[i][0] for i in ids]), np.concatenate([rows[i][1] for i in ids])
            raw, sums = _raw_scores(m, row, bucket, value, z[ids])
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[ids]) / len(ids)
            gx = g[row] * value
            grad_w = np.concatenate([np.bincount(bucket, gx, minlength=BUCKETS), z[ids].T @ g])
            grad_v = np.empty((size, FACTORS))
            for f in range(FACTORS):
                grad_v[:BUCKETS, f] = np.bincount(bucket, gx * (sums[row, f] - m.v[bucket, f] * value), minlength=BUCKETS)
                grad_v[BUCKETS:, f] = z[ids].T @ (g * sums[:, f]) - (z[ids] ** 2).T @ g * m.v[BUCKETS:, f]
            grad = np.concatenate([[g.sum()], grad_w, grad_v.ravel()])
            one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad * grad
            pace = step * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            theta = theta - pace * (one / (1 - 0.9 ** t) / (np.sqrt(two / (1 - 0.999 ** t)) + 1e-8) + decay * theta)
    m.w0, m.w, m.v = float(theta[0]), theta[1:1 + size].copy(), theta[1 + size:].reshape(size, FACTORS).copy()
    return m


def _each_slice(text: pa.Array, n_chars: pa.Array, hasher: tb.SpanHasher) -> Iterator[tuple[int, int, tuple]]:
    """Features of a batch of texts and sizes in slices: (first row, rows, features)."""
    texts = (tb.encode(t.as_py()) for t in text)
    chars = n_chars.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
    at = 0
    for part in tb.slices(texts):
        yield at, len(part), features(part, chars[at:at + len(part)], hasher)
        at += len(part)


def _plain(docs: DataFrame, text_col: str, chars_col: str | None) -> list:
    chars = F.col(chars_col).cast("double") if chars_col else F.lit(None).cast("double")
    return [F.col(text_col).alias("text"), chars.alias("chars")]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
        label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Train on at most ``max_rows`` labelled rows of ``docs``."""
    chosen = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("label")).where("l_id IS NOT NULL AND label IS NOT NULL") \
        .groupBy("l_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows)
    plain = docs.select(F.col(id_col).alias("id"), *_plain(docs, text_col, chars_col))  # no other column: any name may occur among them
    # at most max_rows ids and numbers: small enough to send everywhere
    sample = plain.join(F.broadcast(chosen), F.col("id") == F.col("l_id")) \
        .select("text", "chars", "label", F.xxhash64("l_id").alias("place"), F.xxhash64("text").alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tb.SpanHasher()
        for batch in batches:
            for at, n, (row, bucket, value, stats) in _each_slice(batch.column(0), batch.column(1), hasher):
                ends = np.cumsum(np.bincount(row, minlength=n))[:-1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.split(bucket.astype(np.int32), ends), pa.list_(pa.int32())), pa.array(np.split(value, ends), pa.list_(pa.float64())),
                    pa.array(list(stats), pa.list_(pa.float64())), *[batch.column(k).slice(at, n) for k in (2, 3, 4)]],
                    ["bucket", "value", "stats", "label", "place", "tie"])

    got = sample.mapInArrow(lambda batches: given_back(run(batches)), "bucket array<int>, value array<double>, stats array<double>, label double, place bigint, tie bigint").toArrow()
    got = got.sort_by([("place", "ascending"), ("tie", "ascending")])
    lists = {}
    for c in ("bucket", "value", "stats"):  # views of the flat values, no Python objects
        column = got.column(c).combine_chunks()
        lists[c] = np.split(column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())[:-1]) if len(column) else []
    return train(list(zip(lists["bucket"], lists["value"], lists["stats"], got.column("label").to_pylist())))


def score(docs: DataFrame, model: Model, text_col: str = "text", chars_col: str | None = "n_chars", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` in 0..1; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # BUCKETS x (FACTORS + 1) numbers, whatever the data

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        m, hasher = Model(*shared.value), tb.SpanHasher()
        for text, chars in batches:
            parts = [_raw_scores(m, row, bucket, value, _standard(m, stats))[0] for _, _, (row, bucket, value, stats) in _each_slice(text, chars, hasher)]
            raw = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))), pa.float64())

    # the texts stay in their Arrow batch; as a pandas series they would be in memory three times
    @F.arrow_udf("double")
    def scorer(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from given_back(run(batches))

    text, chars = _plain(docs, text_col, chars_col)
    return docs.withColumn(score_col, scorer(text, chars))
