"""Local passes of small parts go side by side; a few parts go to a task each."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trolley.operators import fm
from trolley.operators.fm import FMMeta, FMParams

K = 3
STREAM = pa.schema([("part", pa.int64()), ("key", pa.int64()), ("y", pa.float64()), ("fids", pa.list_(pa.int64())), ("xs", pa.list_(pa.float64())),
                    ("feature_id", pa.int64()), ("w", pa.float64()), ("v", pa.list_(pa.float64()))])


def stream(seed: int, sizes: list[int], task: int, batch: int) -> list[pa.RecordBatch]:
    rng, rows, key = np.random.default_rng(seed), [], 0
    for part, n in enumerate(sizes):
        own = [sorted(rng.choice(30, rng.integers(1, 6), replace=False).tolist()) for _ in range(n)]
        for f in sorted({f for x in own for f in x}):
            rows.append({"part": part, "feature_id": f, "w": rng.normal(), "v": rng.normal(0, 0.3, K).tolist()})
        for x in own:
            rows.append({"part": part, "key": key, "y": float(rng.choice([-1, 1])) if task else rng.normal(), "fids": x, "xs": rng.normal(1, 0.5, len(x)).tolist()})
            key += 1
    return pa.Table.from_pylist(rows, STREAM).to_batches(max_chunksize=batch)


def summed(batches) -> dict:
    out = {}
    for b in batches:
        for r in b.to_pylist():
            at = out.setdefault(r["feature_id"], np.zeros(K + 1))
            at += [r["dw"], *r["dv"]]
    return out


@pytest.mark.parametrize("task, intercept, linear", [(1, True, True), (0, True, True), (1, False, False)])
@pytest.mark.parametrize("batch", [37, 1000])
def test_small_parts_side_by_side_equal_one_after_the_other(monkeypatch, task, intercept, linear, batch):
    meta = FMMeta(30, K, task, 0.2, -0.5 if task == 0 else -np.inf, 0.5 if task == 0 else np.inf, intercept, linear)
    hp = FMParams(k=K, task=task, step=0.3, reg=(0.01, 0.02, 0.03))
    given = stream(5, [1] * 60 + [2, 1, 3] * 20 + [1] * 40 + [50], task, batch)
    made, plain = [], fm._LocalPass
    monkeypatch.setattr(fm, "_LocalPass", lambda *a: made.append(1) or plain(*a))
    got = summed(fm._local_passes(meta, hp, 2)(iter(given)))
    few = len(made)
    monkeypatch.setattr(fm, "_SIDE_BY_SIDE", 10 ** 9)
    want = summed(fm._local_passes(meta, hp, 2)(iter(given)))
    assert len(made) - few == 161 and (batch < 1000 or few <= 2 * len(given))  # a batch's open parts alone
    assert got.keys() == want.keys()
    for f in want:
        assert got[f] == pytest.approx(want[f], abs=1e-12)


def test_a_part_without_its_parameters_stops_the_pass():
    given = stream(5, [1] * 60, 1, 1000)
    rows = [r for b in given for r in b.to_pylist()]
    gone = next(i for i, r in enumerate(rows) if r["part"] == 30 and r["key"] is None)
    lacking = pa.Table.from_pylist(rows[:gone] + rows[gone + 1:], STREAM)
    with pytest.raises(RuntimeError, match="without its parameters"):
        list(fm._local_passes(FMMeta(30, K), FMParams(k=K), 1)(iter(lacking.to_batches())))


def test_each_of_a_few_parts_has_a_task_of_its_own(spark, monkeypatch):
    """Dealt by hashes, 8 parts met in 5 or 6 tasks."""
    monkeypatch.setattr(fm, "shuffle_partitions", lambda s: 8)

    def whose(meta, hp, t):
        def run(batches):
            parts = {p for b in batches for p in b.column(0).to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([float(len(parts))]), pa.array([[0.0] * K], pa.list_(pa.float64()))], fm.DELTA_SCHEMA.names)
        return run

    monkeypatch.setattr(fm, "_local_passes", whose)
    monkeypatch.setattr(fm, "materialize", lambda df: df)
    rows = spark.range(80).select((F.col("id") % 8).alias("part"), F.col("id").alias("key"), F.lit(1.0).alias("y"), F.array(F.lit(0).cast("bigint")).alias("fids"), F.array(F.lit(1.0)).alias("xs"))
    touched = spark.range(8).select(F.col("id").alias("part"), F.lit(0).cast("bigint").alias("feature_id"))
    params = spark.createDataFrame([(0, 0.0, [0.1] * K)], "feature_id long, w double, v array<double>")
    seen = []
    monkeypatch.setattr(fm.F, "sum", lambda c, f=F.sum: seen.append(c) or (F.max(c) if str(c) == "dw" else f(c)))
    new, _ = fm.fm_local_sgd_step(rows, touched, params, FMMeta(1, K), FMParams(k=K), 1, 8)
    assert seen and new.first()["w"] == pytest.approx(1 / 8)  # the most parts in a task, over 8
