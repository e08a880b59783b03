"""Hard-negative mining with segment summaries.

An anchor's positives are its ``n_positives`` best other rows of its own label. A hard negative
of (anchor, positive) is a row of another label whose score lies between ``low`` percent of the
positive's score and the positive's score itself; the best ``n_negatives`` are kept. Scores are
inner products of the vectors in integers, ``floor(scale * x)``; ties go to the smaller id.

Bounds. A vector is cut into segments, and each segment's mean and deviation (the norm of what is
left after the mean) are stored. Over a segment of length L the inner product of two vectors is
``L m_a m_b`` plus or minus ``d_a d_b`` at most, so the summaries alone give an upper and a lower bound.

Plan.
1. Rows are put in order by label and by the signs of their segment means and cut into blocks of
   ``block_rows``, whatever the sizes of the labels. A block keeps the ranges of its
   rows' summaries: one row per block.
2. An anchor first meets its own block. The positives found there bound what others must reach.
3. It then goes to those blocks of its label whose upper bound reaches that score, and, for
   negatives, to the blocks whose bounds meet the band of its positives.
4. In a task, a block's rows come first and anchors stream past them. Segments are refined
   step by step (2, 8, 32, ... of them); only pairs whose bounds pass each step are scored exactly.
5. The best of all blocks are merged by a window with a rank limit.

A block and one Arrow batch of anchors is all a task holds. The block table goes to the driver
and the tasks only up to ``MAX_BLOCKS`` blocks; beyond, anchors visit all blocks of the kind
and the bounds act inside the tasks alone. Scores and results are exact in both cases.

Defined cases: rows with a null id, a null label, a null vector or a null or non-finite component
take no part; of rows that share an id the one with the smallest (label, vector) counts, so repeated rows
count once; shorter vectors meet longer ones as if filled up with zeros; an empty vector scores
zero with all; components beyond ``LIMIT`` after scaling are taken as ``LIMIT``; a negative positive
score has no band; an empty table gives an empty result. Other columns may have any names: only
the id, vector and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.common import store
from trolley.operators.ranking import dense_ids
from trolley.session import release, shuffle_partitions

SCALE = 256
LIMIT = 1 << 22
BLOCK_ROWS = 8192
MAX_BLOCKS = 1 << 17
#: Segments of a row's summary that travels with it and makes the block table.
SEGMENTS = 8
_TILE = 1 << 21  # cells of a score matrix that are in memory at once

_ROW = "block bigint, anchor boolean, id bigint, label bigint, q array<int>, least bigint, pos_ids array<bigint>, pos_scores array<bigint>"
_FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def quantised(vectors: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, as integers."""
    whole = F.transform(vectors, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return F.transform(whole, lambda x: F.least(F.greatest(x, F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))


def _finite(vectors: Column) -> Column:
    return F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


# ---- summaries --------------------------------------------------------------------------

def summary(q: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and deviations of the segments of each row, and the segments' length."""
    size = max(1, -(-q.shape[1] // segments))
    padded = np.zeros((len(q), segments * size))
    padded[:, :q.shape[1]] = q
    cut = padded.reshape(len(q), segments, size)
    mean = cut.mean(axis=2)
    return mean, np.sqrt(np.square(cut - mean[:, :, None]).sum(axis=2)), size


def bounds(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of all pairs, from their summaries."""
    middle, room = a[2] * (a[0] @ b[0].T), a[1] @ b[1].T
    room += 0.5 + 1e-9 * (np.abs(middle) + room)  # scores are integers; covers rounding
    return middle - room, middle + room


def steps(dims: int) -> list[int]:
    """Numbers of segments, coarse to fine, as long as a bound costs half an exact score or less."""
    return [s for s in (2, 8, 32, 128, 512, 2048) if 4 * s <= dims]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2 ** 52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _matrix(lists: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int32)
    for k, x in enumerate(lists):
        out[k, :len(x)] = x
    return out


class _Rows:
    """The rows of a block, by label, with the summaries of every step."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.q = ids[order], labels[order], q[order]
        self.levels = [summary(self.q, s) for s in steps(q.shape[1])]

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]))


def _survivors(q: np.ndarray, rows: _Rows, places: np.ndarray, least: np.ndarray, most: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(places that are left, mask of pairs that may score within ``least`` .. ``most``), refined step by step.

    With ``best``, a pair must also reach the ``best``-th largest lower bound of its anchor.
    """
    may = np.ones((len(q), len(places)), bool)
    for s, (mean, dev, size) in zip(steps(q.shape[1]), rows.levels):
        if not len(places):
            break
        low, high = bounds(summary(q, s), (mean[places], dev[places], size))
        if 0 < best <= len(places):
            low_in = np.where(may, low, -np.inf)
            least = np.maximum(least, np.partition(low_in, -best, axis=1)[:, -best])
        may &= (high >= least[:, None]) & (low <= most[:, None])
        some = may.any(axis=0)
        places, may = places[some], may[:, some]
    return places, may


def _best_positives(ids: np.ndarray, q: np.ndarray, least: np.ndarray, label: int, rows: _Rows, k: int) -> Iterator[tuple]:
    a, b = rows.of_label(label)
    high = np.full(len(ids), np.inf)
    # an anchor's own row is among its block's: one more must be kept
    places, may = _survivors(q, rows, np.arange(a, b), least, high, k + 1)
    scores = exact(q, rows.q[places])
    for i in range(len(ids)):
        at = np.flatnonzero(may[i] & (rows.ids[places] != ids[i]))
        if len(at) > k:
            score = scores[i, at]
            at = at[score >= np.partition(score, -k)[-k]]
        at = at[np.lexsort((rows.ids[places[at]], -scores[i, at]))[:k]]
        for j in at:
            yield ids[i], rows.ids[places[j]], scores[i, j], None, None


def _best_negatives(ids: np.ndarray, q: np.ndarray, positives: list[list[tuple[int, int]]], label: int, rows: _Rows, k: int, low: int) -> Iterator[tuple]:
    bands = [[(p, score, -(-low * score // 100)) for p, score in found if score >= 0] for found in positives]
    least = np.array([min((f for _, _, f in x), default=np.inf) for x in bands], np.float64)
    most = np.array([max((s for _, s, _ in x), default=-np.inf) for x in bands], np.float64)
    a, b = rows.of_label(label)
    places, may = _survivors(q, rows, np.concatenate([np.arange(a), np.arange(b, len(rows.ids))]), least, most)
    scores = exact(q, rows.q[places])
    for i in range(len(ids)):
        at = np.flatnonzero(may[i])
        at = at[np.lexsort((rows.ids[places[at]], -scores[i, at]))]
        down = -scores[i, at]
        for p, score, floor in bands[i]:
            first, stop = np.searchsorted(down, -score), np.searchsorted(down, -floor, side="right")
            for j in at[first:min(stop, first + k)]:
                yield ids[i], p, score, rows.ids[places[j]], scores[i, j]


def _search(dims: int, k: int, low: int | None):
    """Partition function over rows sorted by (block, anchor): a block's rows, then the anchors that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, gathered, rows = None, [], None
        for batch in batches:
            blocks, is_anchor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_anchor[1:] != is_anchor[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
                if blocks[a] != block:
                    block, gathered, rows = blocks[a], [], None
                part = batch.slice(a, b - a)
                ids, labels = part.column(2).to_numpy(), part.column(3).to_numpy()
                q = _matrix(part.column(4).to_numpy(zero_copy_only=False), dims)
                if not is_anchor[a]:
                    gathered.append((ids, labels, q))
                    continue
                if rows is None:
                    rows = _Rows(*(np.concatenate(x) for x in zip(*gathered))) if gathered else _Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims), np.int32))
                    gathered = []
                least = part.column(5).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                known = [list(zip(x or [], y or [])) for x, y in zip(part.column(6).to_pylist(), part.column(7).to_pylist())]
                order, tile = np.argsort(labels, kind="stable"), max(1, _TILE // max(1, len(rows.ids)))
                out = []
                for same in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
                    for s in (same[x:x + tile] for x in range(0, len(same), tile)):
                        label = labels[s[0]]
                        out += _best_positives(ids[s], q[s], least[s], label, rows, k) if low is None else \
                            _best_negatives(ids[s], q[s], [known[i] for i in s], label, rows, k, low)
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _meet(rows: DataFrame, visitors: DataFrame, dims: int, k: int, low: int | None = None) -> DataFrame:
    """What each visitor (an anchor with a ``block``) finds among the rows of that block."""
    none = {"least": "bigint", "pos_ids": "array<bigint>", "pos_scores": "array<bigint>"}
    plain = rows.select("block", F.lit(False).alias("anchor"), "id", "label", "q", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    both = plain.unionByName(visitors.select("block", F.lit(True).alias("anchor"), "id", "label", "q", *none))
    laid = both.repartition(shuffle_partitions(rows.sparkSession), "block").sortWithinPartitions("block", "anchor")
    return laid.mapInArrow(_search(dims, k, low), _FOUND)


# ---- blocks -----------------------------------------------------------------------------

def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block: the range of its labels and of its rows' summaries."""
    each = [agg for s in range(SEGMENTS) for agg in (F.min(F.get("means", F.lit(s))).alias(f"lo{s}"), F.max(F.get("means", F.lit(s))).alias(f"hi{s}"),
                                                      F.max(F.get("devs", F.lit(s))).alias(f"dev{s}"))]
    return rows.groupBy("block").agg(F.min("label").alias("first"), F.max("label").alias("last"), *each)


def _visit(anchors: DataFrame, table: np.ndarray | None, n_blocks: int, size: int, negatives: bool) -> DataFrame:
    """``anchors`` once for each block that may hold what they look for: rows of their label that reach ``least``
    (own block left out), or rows of other labels in ``least`` .. ``most``."""
    if table is None:
        return anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint")))) \
            .where(F.lit(negatives) | (F.col("block") != F.col("home")))
    shared = anchors.sparkSession.sparkContext.broadcast(table)  # MAX_BLOCKS rows at most
    names = anchors.columns
    at = [names.index(c) for c in ("label", "least", "most", "home", "means", "devs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        first, last, lo, hi, dev = t[:, 1], t[:, 2], t[:, 3::3], t[:, 4::3], t[:, 5::3]
        for whole in batches:
            tile = max(1, _TILE // max(1, len(t)))
            for x in range(0, whole.num_rows, tile):
                batch = whole.slice(x, tile)
                label, least, most, home = (batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at[:4])
                mean, spread = (np.array(batch.column(i).to_pylist(), np.float64).reshape(-1, SEGMENTS) for i in at[4:])
                up, down = np.maximum(mean, 0), np.minimum(mean, 0)
                room = spread @ dev.T
                high, low = size * (up @ hi.T + down @ lo.T), size * (up @ lo.T + down @ hi.T)
                room += 0.5 + 1e-9 * (np.abs(high) + np.abs(low) + room)
                other = (first != label[:, None]) | (last != label[:, None])
                same = (first <= label[:, None]) & (last >= label[:, None]) & (t[:, 0] != home[:, None])
                go = (other if negatives else same) & ~(high + room < least[:, None]) & ~(low - room > most[:, None])
                ends = np.cumsum(go.sum(axis=1))[:-1]
                to = pa.array(np.split(t[:, 0].astype(np.int64)[np.nonzero(go)[1]], ends), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, to], [*names, "blocks"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(run, f"{schema}, blocks array<bigint>").withColumn("block", F.explode("blocks")).drop("blocks")


def _top(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
         n_positives: int = 5, n_negatives: int = 5, low: int = 80, block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``, the row's id.
    """
    spark = rows.sparkSession
    taken = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).alias("v")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(_finite(F.col("v")))
    whole = store(taken.groupBy("id").agg(F.min(F.struct("label", quantised(F.col("v"), scale).alias("q"))).alias("r")).select("id", "r.label", "r.q"))
    facts = whole.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims")).first()
    dims, n_blocks = max(1, facts["dims"] or 0), -(-facts["n"] // block_rows)
    size = -(-dims // SEGMENTS)
    part = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda s: F.transform(F.slice("q", s * size + 1, F.lit(size)), lambda x: x.cast("double")))
    zero = F.lit(0.0)
    means = F.transform(part, lambda x: F.aggregate(x, zero, lambda acc, y: acc + y) / size)
    devs = F.zip_with(part, F.col("means"), lambda x, m: F.sqrt(F.aggregate(x, zero, lambda acc, y: acc + (y - m) * (y - m)) + (size - F.size(x)) * m * m))
    signs = F.aggregate("means", F.lit(0), lambda acc, m: acc * 2 + F.when(m > 0, 1).otherwise(0))
    summed = whole.withColumn("means", means).withColumn("devs", devs).withColumn("signs", signs)
    numbered = dense_ids(summed, [F.col("label"), F.col("signs"), F.col("id")], "no")
    laid = store(numbered.select("id", "label", "q", "means", "devs", F.floor(F.col("no") / block_rows).cast("bigint").alias("block")))
    release(whole)

    table = None
    if 0 < n_blocks <= max_blocks:  # a row of 2 + 3 x SEGMENTS numbers for each block
        blocks = _blocks(laid).toArrow()
        table = np.stack([blocks.column(c).to_numpy().astype(np.float64) for c in blocks.column_names], axis=1)
    anchors = laid.withColumnRenamed("block", "home").where(is_anchor)
    blank = {"least": F.lit(None).cast("bigint"), "most": F.lit(None).cast("bigint"), "pos_ids": F.lit(None).cast("array<bigint>"), "pos_scores": F.lit(None).cast("array<bigint>")}
    order = [F.col("positive_score").desc(), F.col("positive_id")]

    at_home = store(_meet(laid, anchors.withColumns(blank).withColumn("block", F.col("home")), dims, n_positives))
    reached = at_home.groupBy("anchor_id").agg(F.when(F.count("*") >= n_positives, F.min("positive_score")).alias("least"))
    seekers = anchors.join(reached, F.col("id") == F.col("anchor_id"), "left").drop("anchor_id").withColumns({c: v for c, v in blank.items() if c != "least"})
    elsewhere = _meet(laid, _visit(seekers, table, n_blocks, size, False), dims, n_positives)
    positives = store(_top(at_home.unionByName(elsewhere), ["anchor_id"], order, n_positives).select("anchor_id", "positive_id", "positive_score"))

    # at most n_positives rows an anchor
    bands = positives.where("positive_score >= 0").groupBy("anchor_id").agg(
        (F.floor(F.min("positive_score") / 100) * low - low).alias("least"), F.max("positive_score").alias("most"),
        F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p"))
    seekers = anchors.join(bands, F.col("id") == F.col("anchor_id")).select(*anchors.columns, "least", "most",
                                                                           F.col("p.positive_id").alias("pos_ids"), F.col("p.positive_score").alias("pos_scores"))
    found = store(_meet(laid, _visit(seekers, table, n_blocks, size, True), dims, n_negatives, low))
    best = _top(found, ["anchor_id", "positive_id"], [F.col("negative_score").desc(), F.col("negative_id")], n_negatives)
    for t in (at_home, positives):
        release(t)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
