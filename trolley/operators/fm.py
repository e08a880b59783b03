"""Factorization machine with parameters in a DataFrame, joined by feature id.

``params(feature_id, w, v ARRAY<DOUBLE>)`` holds one row per feature; ``FMMeta`` holds the
scalars (w0, k, task, label range). Features are long rows ``(key, feature_id, value)``.

    s_f = sum_i v_if x_i
    z   = w0 + sum_i w_i x_i + 1/2 sum_f (s_f^2 - sum_i v_if^2 x_i^2)
    m   = z - y (regression, z clipped)     m = -y (1 - sigmoid(y z)), y in {-1, +1}
    dw0 = m + r0 w0,  dw_i = x_i m + r1 w_i,  dv_if = (s_f x_i - v_if x_i^2) m + r2 v_if

The parameter table is broadcast only when its exact size n (k + 2) doubles is under the
broadcast limit; otherwise it is a shuffled join side (adaptive execution splits hot
feature ids). Per-instance sums are partial-aggregated before any shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from trolley.functions.hashing import gaussian, uniform
from trolley.functions.links import CLASSIFICATION, REGRESSION, link, recode_label
from trolley.operators.fm_layout import SALT, TrainingLayout, training_layout
from trolley.session import materialize, release, shuffle_partitions

FORMAT_VERSION = "1.0"
MODEL_CLASS = "trolley.FactorizationMachine"


@dataclass(frozen=True)
class FMMeta:
    num_features: int
    k: int
    task: int = CLASSIFICATION
    w0: float = 0.0
    min_label: float = -math.inf
    max_label: float = math.inf
    intercept: bool = True
    linear: bool = True

    def to_json(self) -> str:
        d = asdict(self)
        d.update({"class": MODEL_CLASS, "version": FORMAT_VERSION})
        for key in ("min_label", "max_label"):
            if math.isinf(d[key]):
                d[key] = None
        return json.dumps(d, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "FMMeta":
        d = json.loads(text)
        if d.get("class") != MODEL_CLASS or d.get("version") != FORMAT_VERSION:
            raise ValueError(f"unsupported model (class, version): ({d.get('class')}, {d.get('version')})")
        d = {k: v for k, v in d.items() if k not in ("class", "version")}
        d["min_label"] = -math.inf if d.get("min_label") is None else d["min_label"]
        d["max_label"] = math.inf if d.get("max_label") is None else d["max_label"]
        return FMMeta(**d)


@dataclass(frozen=True)
class FMParams:
    """Training hyper-parameters (T5/T6), validated on construction."""
    k: int = 8
    task: int = CLASSIFICATION
    iterations: int = 100
    step: float = 1.0
    reg: tuple = (0.0, 1e-3, 1e-4)
    init_std: float = 0.01
    init_mean: float = 0.0
    intercept: bool = True
    linear: bool = True
    seed: int = 0
    batch_fraction: float = 1.0
    tolerance: float = 0.0
    parts: int | None = None    # T1 averages this many local passes; None: as many as ``part_rows`` gives
    part_rows: int = 1 << 18    # feature rows of a part; both are part of the model, not of the cluster

    def __post_init__(self):
        if (self.parts is not None and self.parts <= 0) or self.part_rows <= 0:
            raise ValueError("parts and part_rows must be positive")
        if self.task not in (REGRESSION, CLASSIFICATION):
            raise ValueError("task must be 0 (regression) or 1 (classification)")
        if self.k <= 0:
            raise ValueError("k must be positive")
        if len(self.reg) != 3 or min(self.reg) < 0:
            raise ValueError("reg must be three non-negative values (r0, r1, r2)")
        if self.init_std <= 0:
            raise ValueError("init_std must be positive")
        if self.iterations < 0:
            raise ValueError("iterations must be non-negative")
        if self.step <= 0:
            raise ValueError("step must be positive")
        if not 0.0 < self.batch_fraction <= 1.0:
            raise ValueError("batch_fraction must be in (0, 1]")
        if not 0.0 <= self.tolerance <= 1.0:
            raise ValueError("tolerance must be in [0, 1]")


# ---- parameters -------------------------------------------------------------------------

def fm_init(spark: SparkSession, num_features: int, k: int, std: float = 0.01, seed: int = 0,
            mean: float = 0.0, partitions: int | None = None) -> DataFrame:
    """M2: w = 0, v_if ~ Normal(mean, std) from md5 uniforms of (seed, feature, factor)."""
    parts = partitions or shuffle_partitions(spark)
    ids = spark.range(0, num_features, 1, parts).select(F.col("id").alias("feature_id"))
    v = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                    lambda f: F.lit(mean) + F.lit(std) * gaussian(seed, "v", F.col("feature_id"), f))
    return ids.select("feature_id", F.lit(0.0).alias("w"), v.alias("v"))


def _vf(f: int) -> Column:
    return F.col("v").getItem(f)


def fm_margin(features: DataFrame, params: DataFrame, meta: FMMeta, key: str = "instance_id",
              keep_sums: bool = False, on: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """M1 core: raw score ``z`` per key (keys with no features are absent).

    One join and one aggregation with k + 1 sums, all JVM-side: the linear part and the squares are one sum.
    """
    j = features.select(key, "value", *on).join(params, list(on))
    x = F.col("value")
    sq = sum((_vf(f) * _vf(f) for f in range(1, meta.k)), _vf(0) * _vf(0))
    own = F.lit(-0.5) * x * x * sq
    aggs = [F.sum(F.coalesce(F.col("w"), F.lit(0.0)) * x + own if meta.linear else own).alias("own")]
    aggs += [F.sum(_vf(f) * x).alias(f"s{f}") for f in range(meta.k)]
    g = j.groupBy(key).agg(*aggs)
    pair = sum((F.col(f"s{f}") * F.col(f"s{f}") for f in range(1, meta.k)), F.col("s0") * F.col("s0"))
    z = F.lit(meta.w0 if meta.intercept else 0.0) + F.col("own") + F.lit(0.5) * pair
    cols = [key, z.alias("z")]
    if keep_sums:
        cols.append(F.array(*[F.col(f"s{f}") for f in range(meta.k)]).alias("s"))
    return g.select(*cols)


def fm_score(keys: DataFrame, features: DataFrame, params: DataFrame, meta: FMMeta,
             key: str = "instance_id", others: bool = True) -> DataFrame:
    """M1: ``keys`` plus ``z`` and ``prediction`` (clipped value or probability).

    A key without any feature scores ``w0``, as an empty vector does. Features of other keys
    are dropped before they meet the parameters. A feature id outside the model raises when
    the result is computed. ``others=False``: ``features`` are of these keys alone, and need not be looked up.
    """
    wanted = features.join(keys.select(key).distinct(), key, "left_semi") if others else features
    inside = (F.col("feature_id") >= 0) & (F.col("feature_id") < F.lit(meta.num_features))
    wanted = wanted.withColumn("feature_id", F.when(inside, F.col("feature_id")).otherwise(
        F.raise_error(F.concat(F.lit("feature id outside the model: "), F.col("feature_id").cast("string"))).cast("bigint")))
    margins = fm_margin(wanted, params, meta, key)
    w0 = meta.w0 if meta.intercept else 0.0
    scored = keys.join(margins, key, "left").withColumn("z", F.coalesce("z", F.lit(w0)))
    return scored.withColumn("prediction", link(F.col("z"), meta.task, meta.min_label, meta.max_label))


def label_range(instances: DataFrame, label: str = "label") -> tuple[float, float]:
    """(min, max) of the labels, for clipping regression scores."""
    row = instances.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    return float(row["lo"]), float(row["hi"])


def residual(z: Column, y: Column, meta: FMMeta) -> Column:
    """M3: error multiplier of one instance (``y`` already re-coded for classification)."""
    if meta.task == REGRESSION:
        zc = F.least(F.greatest(z, F.lit(meta.min_label)), F.lit(meta.max_label))
        return zc - y
    return -y * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(-y * z, F.lit(700.0)))))


def loss(z: Column, y: Column, meta: FMMeta) -> Column:
    if meta.task == REGRESSION:
        zc = F.least(F.greatest(z, F.lit(meta.min_label)), F.lit(meta.max_label))
        return F.lit(0.5) * (zc - y) * (zc - y)
    return F.greatest(-y * z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(y * z)))


def training_labels(instances: DataFrame, meta: FMMeta, key: str = "instance_id") -> DataFrame:
    """classification labels re-coded to +1 / -1; regression labels kept."""
    y = recode_label(F.col("label")) if meta.task == CLASSIFICATION else F.col("label").cast("double")
    return instances.select(key, y.alias("y"))


def fm_residuals(instances: DataFrame, features: DataFrame, params: DataFrame, meta: FMMeta,
                 key: str = "instance_id", on: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Per instance: ``z``, the factor sums ``s``, the residual ``m`` and the loss."""
    margins = fm_margin(features, params, meta, key, keep_sums=True, on=on)
    w0 = meta.w0 if meta.intercept else 0.0
    zero = F.array(*[F.lit(0.0)] * meta.k)
    stats = (training_labels(instances, meta, key).join(margins, key, "left")
             .select(key, "y", F.coalesce("z", F.lit(w0)).alias("z"), F.coalesce("s", zero).alias("s")))
    return stats.select("*", residual(F.col("z"), F.col("y"), meta).alias("m"),
                        loss(F.col("z"), F.col("y"), meta).alias("loss"))


def fm_gradient(features: DataFrame, stats: DataFrame, meta: FMMeta, key: str = "instance_id",
                on: tuple[str, ...] | None = None) -> DataFrame:
    """M4 data part per active feature: ``gw = sum m x``, ``gv_f = sum m s_f x - v_f sum m x^2``.

    Returned as sums ``(feature_id, c, b, a ARRAY)``: gw = c, gv_f = a_f - v_f * b. They are
    computed without the parameter table (only the per-instance stats are joined).
    """
    on = on or (key,)
    j = features.select("feature_id", "value", *on).join(stats.select("m", "s", *on), list(on))
    x, m = F.col("value"), F.col("m")
    aggs = [F.sum(m * x).alias("c"), F.sum(m * x * x).alias("b")]
    aggs += [F.sum(m * F.col("s").getItem(f) * x).alias(f"a{f}") for f in range(meta.k)]
    g = j.groupBy("feature_id").agg(*aggs)
    return g.select("feature_id", "c", "b", F.array(*[F.col(f"a{f}") for f in range(meta.k)]).alias("a"))


def apply_gradient(params: DataFrame, grad: DataFrame, meta: FMMeta, eta: float, n_batch: int,
                   reg: tuple) -> DataFrame:
    """Batch update of active features: theta -= eta * (mean data gradient + L2 term)."""
    r0, r1, r2 = reg
    j = params.join(grad, "feature_id", "left")
    active = F.col("c").isNotNull()
    scale = F.lit(1.0 / max(n_batch, 1))
    new_w = (F.col("w") - F.lit(eta) * (F.col("c") * scale + F.lit(r1) * F.col("w"))) if meta.linear else F.col("w")
    new_v = F.zip_with("v", "a", lambda v, a: v - F.lit(eta) * ((a - v * F.col("b")) * scale + F.lit(r2) * v))
    return j.select("feature_id",
                    F.when(active, new_w).otherwise(F.col("w")).alias("w"),
                    F.when(active, new_v).otherwise(F.col("v")).alias("v"))


def fm_step(instances: DataFrame, features: DataFrame | TrainingLayout, params: DataFrame, meta: FMMeta,
            t: int, hp: FMParams, key: str = "instance_id"):
    """T2 step ``t`` (1-based): returns (new written params, new meta, stats row of the batch).

    ``features`` is a layout of the training instances' features (``training_layout``), whose joins move no
    feature row, or a plain table of them. The instances' statistics are written once and read twice.
    """
    laid = isinstance(features, TrainingLayout)
    by_feature, by_instance = (features.by_feature, features.by_instance) if laid else (features, features)
    batch = instances
    if hp.batch_fraction < 1.0:
        drawn = uniform(hp.seed, "batch", t, F.col(key)) < F.lit(hp.batch_fraction)
        batch, by_feature, by_instance = instances.where(drawn), by_feature.where(drawn), by_instance.where(drawn)
    placed = params
    if laid and not hasattr(params, "_laid"):
        params = _as_params(features.lay_params(params))
    if laid:
        placed = params._laid
    stats = fm_residuals(batch, by_feature, placed, meta, key, ("feature_id", SALT) if laid else ("feature_id",))
    stats = stats.select(key, "s", "m", "loss")
    stats = features.lay_stats(stats) if laid else materialize(stats)
    once = features.once(stats) if laid else stats
    agg = once.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("sm"), F.sum("loss").alias("loss")).first()
    n = int(agg["n"] or 0)
    eta = hp.step / math.sqrt(t)
    if n == 0:
        release(stats)
        return params, meta, {"n": 0, "loss": None}
    grad = fm_gradient(by_instance, stats, meta, key, features.instance_keys if laid else (key,))
    new_params = apply_gradient(params, grad, meta, eta, n, hp.reg)
    new_params = _as_params(features.lay_params(new_params)) if laid else materialize(new_params)
    w0 = meta.w0
    if meta.intercept:
        w0 = w0 - eta * (agg["sm"] / n + hp.reg[0] * w0)
    release(stats)
    return new_params, replace(meta, w0=w0), {"n": n, "loss": agg["loss"] / n}


def _as_params(laid: DataFrame) -> DataFrame:
    """One row a feature of laid-out parameters; remembers them for the next step and for ``release``."""
    out = laid.where(F.col(SALT) == 0).select("feature_id", "w", "v")
    out._laid, out._trolley_table, out._trolley_name = laid, laid._trolley_table, laid._trolley_name
    return out


def _prepare(instances: DataFrame, hp: FMParams, num_features: int, key: str):
    meta = FMMeta(num_features=num_features, k=hp.k, task=hp.task, intercept=hp.intercept, linear=hp.linear)
    if hp.task == REGRESSION:
        lo, hi = label_range(instances)
        meta = replace(meta, min_label=lo, max_label=hi)
    return meta


def fm_fit_batch(instances: DataFrame, features: DataFrame, num_features: int, hp: FMParams,
                 key: str = "instance_id", params: DataFrame | None = None, meta: FMMeta | None = None):
    """Full or mini-batch gradient descent, purely relational.

    Parameters are checkpointed after every step, so lineage stays one step long and a lost
    executor costs at most one step. Stops early when the parameter change is below
    ``tolerance * max(norm, 1)``. Returns (params, meta, history).
    """
    spark = instances.sparkSession
    meta = meta or _prepare(instances, hp, num_features, key)
    if params is None:
        params = fm_init(spark, num_features, hp.k, hp.init_std, hp.seed, hp.init_mean)
    params = materialize(params)
    history = []
    n_rows = instances.count()
    if n_rows == 0:
        return params, meta, history
    layout = training_layout(instances, features, key)
    laid = _as_params(layout.lay_params(params))
    release(params)
    params = laid
    for t in range(1, hp.iterations + 1):
        new_params, new_meta, info = fm_step(instances, layout, params, meta, t, hp, key)
        if new_params is params:  # the mini-batch drew no instance
            history.append(info)
            continue
        if hp.tolerance > 0:
            d = (new_params.alias("n").join(params.alias("o"), "feature_id")
                 .select(F.pow(F.col("n.w") - F.col("o.w"), 2).alias("dw"),
                         F.aggregate(F.zip_with("n.v", "o.v", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                                     lambda acc, e: acc + e).alias("dv"),
                         (F.pow(F.col("n.w"), 2) + F.aggregate("n.v", F.lit(0.0), lambda acc, e: acc + e * e))
                         .alias("nn"))
                 .agg(F.sum(F.col("dw") + F.col("dv")).alias("diff"), F.sum("nn").alias("norm")).first())
            diff = math.sqrt(d["diff"] + (new_meta.w0 - meta.w0) ** 2)
            norm = math.sqrt(d["norm"] + new_meta.w0 ** 2)
            info["diff"] = diff
        release(params)  # superseded step: only tables this loop wrote are deleted
        params, meta = new_params, new_meta
        history.append(info)
        if hp.tolerance > 0 and diff < hp.tolerance * max(norm, 1.0):
            break
    layout.release()
    return params, meta, history


# ---- T1: local SGD per part, averaged --------------------------------------------------------

class _LocalPass:
    """One sequential pass over a part's instances, in key order, on a local copy of the parameters it touches."""

    def __init__(self, fids: np.ndarray, w: np.ndarray, v: np.ndarray, meta: FMMeta, hp: FMParams, t: int):
        order = np.argsort(fids, kind="stable")
        self.fids, self.w0 = fids[order], meta.w0
        self.vw = np.concatenate([v[order], w[order, None]], axis=1)  # one row a feature: v, then w
        self.start = self.vw.copy(), meta.w0
        self.meta, self.hp, self.eta = meta, hp, hp.step / math.sqrt(t)

    def visit(self, ys: np.ndarray, ends: np.ndarray, fids: np.ndarray, xs: np.ndarray) -> None:
        """Instances one after the other: their labels, and their features end to end."""
        local = np.searchsorted(self.fids, fids)
        if len(fids) and (local.max() >= len(self.fids) or (self.fids[local] != fids).any()):
            raise RuntimeError("an instance met a part without its parameters")
        meta, eta, (r0, r1, r2), k = self.meta, self.eta, self.hp.reg, self.meta.k
        vw, w0, exp = self.vw, self.w0, math.exp
        column = xs[:, None]
        square = column * column * np.r_[np.ones(k), 0.0]
        kept = np.r_[np.full(k, 1.0 - eta * r2), 1.0 - eta * r1 if meta.linear else 1.0]
        ends = ends.tolist()
        for a, b, y in zip([0, *ends[:-1]], ends, ys.tolist()):
            idx, x = local[a:b], column[a:b]
            own = vw.take(idx, 0)
            s, vx = xs[a:b].dot(own), own[:, :k] * x
            linear, s[k] = s.item(k), 0.0
            z = (w0 if meta.intercept else 0.0) + (linear if meta.linear else 0.0) + 0.5 * (float(s.dot(s)) - float(np.vdot(vx, vx)))
            if meta.task == REGRESSION:
                m = min(max(z, meta.min_label), meta.max_label) - y
            else:
                m = -y * (1.0 - 1.0 / (1.0 + exp(min(-y * z, 700.0))))
            if meta.intercept:
                w0 -= eta * (m + r0 * w0)
            if meta.linear:
                s[k] = 1.0
            step = eta * m
            vw[idx] = own * (kept + step * square[a:b]) - (step * x) * s
        self.w0 = w0

    def deltas(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature ids, with -1 for the intercept; what w has changed by; what v has changed by)."""
        start, w0 = self.start
        moved = self.vw - start
        return np.r_[self.fids, -1], np.r_[moved[:, -1], self.w0 - w0], np.vstack([moved[:, :-1], np.zeros((1, self.meta.k))])


def _many_passes(part: np.ndarray, given: tuple, rows: tuple, meta: FMMeta, hp: FMParams, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passes of many small parts, side by side: every part's first instance, then every part's second, and so on.

    ``given``: part numbers 0, 1, ..., feature ids, w and v of the parameters; ``part``: the parts' numbers of the instances, in order of
    part and key; ``rows``: their labels, numbers of features (none zero), features and values end to end. Returns what ``_LocalPass.deltas`` does.
    """
    (own, fids, w, v), (ys, sizes, row_fids, xs) = given, rows
    eta, (r0, r1, r2) = hp.step / math.sqrt(t), hp.reg
    n_parts = int(own[-1]) + 1
    known, code = np.unique(fids, return_inverse=True)
    place = own * len(known) + code  # of a parameter: its part, then its feature
    order = np.argsort(place, kind="stable")
    place, start_w, start_v = place[order], w[order], v[order]
    w, v, w0 = start_w.copy(), start_v.copy(), np.full(n_parts, meta.w0)
    at = np.minimum(np.searchsorted(known, row_fids), len(known) - 1)
    wanted = np.repeat(part, sizes) * len(known) + at
    local = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
    if (known[at] != row_fids).any() or (place[local] != wanted).any():
        raise RuntimeError("an instance met a part without its parameters")
    begin = np.cumsum(sizes) - sizes
    turn = np.arange(len(part)) - np.searchsorted(part, part)  # of an instance within its part
    for r in range(int(turn.max()) + 1):
        now = np.flatnonzero(turn == r)
        size, y, p = sizes[now], ys[now], part[now]
        first = np.cumsum(size) - size
        cells = np.repeat(begin[now] - first, size) + np.arange(int(size.sum()))
        idx, x = local[cells], xs[cells]
        vi, wi, xc = v[idx], w[idx], x[:, None]
        vx = vi * xc
        s = np.add.reduceat(vx, first, axis=0)
        z = (w0[p] if meta.intercept else 0.0) + (np.add.reduceat(wi * x, first) if meta.linear else 0.0) \
            + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), first))
        if meta.task == REGRESSION:
            m = np.clip(z, meta.min_label, meta.max_label) - y
        else:
            m = -y * (1.0 - 1.0 / (1.0 + np.exp(np.minimum(-y * z, 700.0))))
        if meta.intercept:
            w0[p] -= eta * (m + r0 * w0[p])
        mc = np.repeat(m, size)
        if meta.linear:
            w[idx] = wi - eta * (x * mc + r1 * wi)
        v[idx] = vi - eta * ((np.repeat(s, size, axis=0) * xc - vi * xc * xc) * mc[:, None] + r2 * vi)
    return (np.r_[known[place % len(known)], np.full(n_parts, -1)], np.r_[w - start_w, w0 - meta.w0],
            np.vstack([v - start_v, np.zeros((n_parts, v.shape[1]))]))


DELTA_SCHEMA = StructType([StructField("feature_id", LongType()), StructField("dw", DoubleType()),
                           StructField("dv", ArrayType(DoubleType()))])
_DELTA_ROWS = 1 << 16  # deltas that are summed before they leave the task, or one part's if that is more
_SIDE_BY_SIDE = 4  # small parts go side by side where there are so many times more parts than instances in the largest of them


def part_rows(features: DataFrame, labels: DataFrame, key: str, part: Column) -> DataFrame:
    """Training rows packed by instance: (part, key, y, fids, xs), features in ascending order."""
    packed = features.select(key, "feature_id", "value").join(labels, key).groupBy(key, "y") \
        .agg(F.sort_array(F.collect_list(F.struct("feature_id", "value"))).alias("f"))
    return packed.select(part.cast("bigint").alias("part"), F.col(key).cast("bigint").alias("key"), F.col("y").cast("double").alias("y"),
                         F.col("f.feature_id").alias("fids"), F.col("f.value").alias("xs"))


def _local_passes(meta: FMMeta, hp: FMParams, t: int):
    """Partition function over rows sorted by (part, key): a part's touched parameters first (null key), then its instances."""
    k = meta.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, given, local, done = None, [], None, []

        def flush() -> pa.RecordBatch:
            ids, dw, dv = (np.concatenate(x) for x in zip(*done))
            done.clear()
            ids, code = np.unique(ids, return_inverse=True)
            dw = np.bincount(code, dw, len(ids))
            dv = np.stack([np.bincount(code, dv[:, f], len(ids)) for f in range(k)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dv.size + 1, k), pa.int32()), pa.array(dv.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dw, pa.float64()), lists], DELTA_SCHEMA.names)

        def many(piece: pa.RecordBatch, parts: np.ndarray, is_row: np.ndarray) -> bool:
            """Whether the whole parts of ``piece`` are small and many, and so were passed side by side."""
            number = np.cumsum(np.r_[0, parts[1:] != parts[:-1]])
            at, rows, params = number[is_row], piece.filter(pa.array(is_row)), piece.filter(pa.array(~is_row))
            if not rows.num_rows or not params.num_rows:
                return False
            per, sizes = np.bincount(at, minlength=number[-1] + 1), rows.column(3).value_lengths().to_numpy()
            if not per.all() or sizes.min() == 0 or len(per) < _SIDE_BY_SIDE * per.max():
                return False
            v = params.column(7).flatten().to_numpy().reshape(-1, k)
            done.append(_many_passes(at, (number[~is_row], params.column(5).to_numpy(), params.column(6).to_numpy(), v),
                                     (rows.column(2).to_numpy(), sizes, rows.column(3).flatten().to_numpy(), rows.column(4).flatten().to_numpy()), meta, hp, t))
            return True

        for batch in batches:
            parts = batch.column(0).to_numpy()
            is_row = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            # parts that begin and end in this batch: neither the first, if it is open, nor the last
            edges = np.flatnonzero(parts[1:] != parts[:-1]) + 1
            lo = 0 if len(parts) and parts[0] != part else edges[0] if len(edges) else 0
            hi = edges[-1] if len(edges) else 0
            skip = lo < hi and many(batch.slice(lo, hi - lo), parts[lo:hi], is_row[lo:hi])
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(parts)]):
                if a == b or skip and lo <= a < hi:
                    continue
                piece = batch.slice(a, b - a)
                if parts[a] != part:
                    if local is not None:
                        done.append(local.deltas())
                    part, given, local = parts[a], [], None
                if not is_row[a]:
                    given.append((piece.column(5).to_numpy(), piece.column(6).to_numpy(), piece.column(7).flatten().to_numpy().reshape(-1, k)))
                    continue
                if local is None:
                    if not given:
                        raise RuntimeError("an instance met a part without its parameters")
                    fids, w, v = (np.concatenate(x) for x in zip(*given))
                    local, given = _LocalPass(fids, w, v, meta, hp, t), []
                fids = piece.column(3)
                ends = np.cumsum(fids.value_lengths().to_numpy())
                local.visit(piece.column(2).to_numpy(), ends, fids.flatten().to_numpy(), piece.column(4).flatten().to_numpy())
            if sum(len(x[0]) for x in done) >= _DELTA_ROWS:
                yield flush()
        if local is not None:
            done.append(local.deltas())
        if done:
            yield flush()

    return run


def fm_local_sgd_step(rows: DataFrame, touched: DataFrame, params: DataFrame, meta: FMMeta,
                      hp: FMParams, t: int, n_parts: int) -> tuple[DataFrame, DataFrame]:
    """T1 step: each part runs SGD from the current model; deltas are summed then divided by P.

    A part is one sorted stream: the parameters it touches, then its instances. A task holds those parameters
    and one Arrow batch, however many instances its parts have. Returns (new params, w0 delta row).
    """
    k = meta.k
    empty = {"key": "bigint", "y": "double", "fids": "array<bigint>", "xs": "array<double>", "feature_id": "bigint", "w": "double", "v": "array<double>"}

    def side(df: DataFrame, *own: str) -> DataFrame:
        return df.select("part", *[F.col(c) if c in own else F.lit(None).cast(kind).alias(c) for c, kind in empty.items()])

    stream = side(touched.join(params, "feature_id"), "feature_id", "w", "v").unionByName(side(rows, "key", "y", "fids", "xs"))
    tasks = min(n_parts, shuffle_partitions(rows.sparkSession))
    # a few parts are dealt by their numbers: by hashes, some would meet in one task
    to = F.pmod("part" if n_parts == tasks else F.xxhash64("part"), F.lit(tasks)).cast("int")
    laid = stream.repartitionById(tasks, F.coalesce(to, F.lit(0))).sortWithinPartitions("part", F.col("key").asc_nulls_first())
    deltas = laid.mapInArrow(_local_passes(meta, hp, t), DELTA_SCHEMA)
    summed = deltas.groupBy("feature_id").agg(
        (F.sum("dw") / F.lit(n_parts)).alias("dw"),
        *[(F.sum(F.col("dv").getItem(f)) / F.lit(n_parts)).alias(f"dv{f}") for f in range(k)])
    summed = summed.select("feature_id", "dw", F.array(*[F.col(f"dv{f}") for f in range(k)]).alias("dv"))
    # one SGD pass per iteration: the averaged deltas are written once and read twice
    summed = materialize(summed)
    new_params = (params.join(summed.where(F.col("feature_id") >= 0), "feature_id", "left")
                  .select("feature_id",
                          (F.col("w") + F.coalesce("dw", F.lit(0.0))).alias("w"),
                          F.when(F.col("dv").isNull(), F.col("v"))
                          .otherwise(F.zip_with("v", "dv", lambda a, b: a + b)).alias("v")))
    w0_row = summed.where(F.col("feature_id") < 0)
    w0_row._trolley_table = getattr(summed, "_trolley_table", None)
    return new_params, w0_row


def fm_fit_local_sgd(instances: DataFrame, features: DataFrame, num_features: int, hp: FMParams,
                     n_parts: int | None = None, key: str = "instance_id",
                     params: DataFrame | None = None, meta: FMMeta | None = None, part: Column | None = None):
    """Parallel SGD with model averaging over ``n_parts`` hash parts of the instances.

    Within a part instances are visited in key order. The number of parts is ``n_parts``, or ``hp.parts``, or follows
    the feature rows (``hp.part_rows`` a part), so results do not depend on the physical layout or the session's
    settings. Every pass visits every row: mini-batches and early stopping belong to the batch trainer.
    ``part`` may name each instance's part; ``n_parts`` is then the number of its values.
    Returns (params, meta, history).
    """
    if hp.batch_fraction < 1.0 or hp.tolerance > 0.0:
        raise ValueError("local SGD takes neither batch_fraction nor tolerance")
    spark = instances.sparkSession
    meta = meta or _prepare(instances, hp, num_features, key)
    if params is None:
        params = fm_init(spark, num_features, hp.k, hp.init_std, hp.seed, hp.init_mean)
    params = materialize(params)
    packed = materialize(part_rows(features, training_labels(instances, meta, key), key, F.lit(0) if part is None else part))
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("fids")).alias("cells")).first()
    history = []
    if not size["n"]:
        release(packed)
        return params, meta, history
    n_parts = n_parts or hp.parts or -(-size["cells"] // hp.part_rows)
    rows = packed if part is not None else packed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n_parts)).cast("bigint"))
    touched = materialize(rows.select("part", F.explode("fids").alias("feature_id")).distinct())
    for t in range(1, hp.iterations + 1):
        new_params, w0_row = fm_local_sgd_step(rows, touched, params, meta, hp, t, n_parts)
        new_params = materialize(new_params)
        dw0 = w0_row.first()
        w0 = meta.w0 + (dw0["dw"] if dw0 is not None and meta.intercept else 0.0)
        release(w0_row)
        release(params)
        params, meta = new_params, replace(meta, w0=w0)
        history.append({"t": t, "w0": w0})
    release(packed)
    release(touched)
    return params, meta, history


def fm_train(instances: DataFrame, features: DataFrame, num_features: int, task: int = CLASSIFICATION,
             iterations: int = 100, step: float = 1.0, dim: tuple = (True, True, 8),
             reg: tuple = (0.0, 1e-3, 1e-4), init_std: float = 0.01, seed: int = 0,
             method: str = "local_sgd", **kwargs):
    """Train entry point with the full argument list; ``method`` picks T1 or T2."""
    hp = FMParams(k=dim[2], task=task, iterations=iterations, step=step, reg=tuple(reg), init_std=init_std,
                  intercept=dim[0], linear=dim[1], seed=seed,
                  batch_fraction=kwargs.pop("batch_fraction", 1.0), tolerance=kwargs.pop("tolerance", 0.0))
    if method == "local_sgd":
        return fm_fit_local_sgd(instances, features, num_features, hp, **kwargs)
    if method == "batch":
        return fm_fit_batch(instances, features, num_features, hp, **kwargs)
    raise ValueError(f"unknown method {method!r}")


def fm_train_short(instances: DataFrame, features: DataFrame, num_features: int, task: int,
                   iterations: int, **kwargs):
    """T7 short form: step 1.0, k = 8, reg (0, 1e-3, 1e-4), init std 0.01."""
    return fm_train(instances, features, num_features, task, iterations, 1.0, (True, True, 8),
                    (0.0, 1e-3, 1e-4), 0.01, **kwargs)
