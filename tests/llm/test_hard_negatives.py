import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, block string, id string"


def brute(rows, anchor=lambda i: i % 100 == 0, k=5, low=80):
    """All pairs, in Python integers."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    out = set()
    for a, (label, q) in kept.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, u)) for i, (_, u) in kept.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if kept[i][0] == label][:k]:
            found = [i for i in best if kept[i][0] != label and low * score[p] <= 100 * score[i] <= 100 * score[p]][:k]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(found)}
    return out


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    out = H.mine(table, F.col("id") % 100 == 0, **options)
    got = [tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_rows(n, dims, seed, labels=4, centres=6):
    """Vectors around a few centres; half of them with one label, many equal."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (centres, dims))
    rows = []
    for i in range(n):
        v = centre[rng.integers(centres)] + rng.normal(0, 0.1, dims) * (i % 5 > 0)
        rows.append((i, [float(x) for x in v.astype(np.float32)], 0 if i % 2 else int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("dims,block,blocks", [(64, 100, 1 << 17), (64, 100, 2), (16, 37, 1 << 17), (3, 1000, 1 << 17)])
def test_equals_brute_force(spark, dims, block, blocks):
    rows = random_rows(700, dims, dims)
    want = brute(rows)
    assert len(want) > 20 and mined(spark, rows, block_rows=block, max_blocks=blocks) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.9, 0.1], 2), (4, None, 1), (5, [nan, 1.0], 1),
            (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (8, [2.0, 0.0], None), (None, [1.0, 1.0], 2), (9, [], 2), (10, [0.85], 3), (11, [0.5, 0.5], 1),
            (100, [-1.0, 0.0], 4), (101, [1.0, 0.0], 4), (200, [0.0, 0.0], 5), (201, [0.0, 0.0], 5), (2, [0.8, 0.0], 3)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == set() and mined(spark, [(1, [1.0], 1)]) == set()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (40, 50)), rng.integers(-300, 300, (60, 50))
    true, width = a @ b.T, []
    for s in H.steps(50):
        low, high = H.bounds(H.summary(a, s), H.summary(b, s))
        assert (low <= true).all() and (true <= high).all()
        width.append((high - low).mean())
    assert width == sorted(width, reverse=True)
    huge = np.full((2, 40), H.LIMIT, np.int32)
    assert H.exact(huge, -huge)[0, 0] == -40 * H.LIMIT ** 2
    assert H.exact(a.astype(np.int32), b.astype(np.int32)).tolist() == true.tolist()
