"""Negatives (multi-maker rows), FM math, training properties, top-k ties, curve areas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.operators.evaluate import curve_areas
from trolley.operators.fm import (FMMeta, FMParams, fm_fit_batch, fm_fit_local_sgd, fm_gradient, fm_init, fm_score,
                                  fm_margin, fm_residuals)
from trolley.operators.negatives import attach_makers, drop_seen_makers
from trolley.operators.recommend import _top_places, recommend, recommend_lists, submission_lines


def test_multi_maker_keeps_new_maker_row(spark):
    pos = spark.createDataFrame([(1, "n", 10, "A"), (2, "m", 20, "A"), (2, "m", 20, "B")],
                                "pid long, pname string, item_id long, maker string")
    cand = spark.createDataFrame([(0, 1, 20)], "try_id long, pid long, item_id long")
    out = drop_seen_makers(attach_makers(cand, pos), pos).collect()
    assert [(r.pid, r.item_id, r.maker) for r in out] == [(1, 20, "B")]


def _toy(spark):
    k = 2
    w0 = 0.3
    w = [0.1, -0.2, 0.05, 0.0]
    V = [[0.1, 0.2], [-0.3, 0.4], [0.5, -0.1], [0.2, 0.2]]
    params = spark.createDataFrame([(i, w[i], V[i]) for i in range(4)], "feature_id long, w double, v array<double>")
    rows = [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (1, 1, 2.0), (1, 3, 0.5), (2, 3, 1.0)]
    feats = spark.createDataFrame(rows, "instance_id long, feature_id long, value double")
    meta = FMMeta(num_features=4, k=k, task=1, w0=w0)
    return params, feats, meta, np.array(w), np.array(V), w0, rows


def _naive(x, w, V, w0):
    z = w0 + w @ x
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            z += V[i] @ V[j] * x[i] * x[j]
    return z


def test_score_equals_pairwise_form(spark):
    params, feats, meta, w, V, w0, rows = _toy(spark)
    got = {r.instance_id: r.z for r in fm_margin(feats, params, meta).collect()}
    for inst in (0, 1, 2):
        x = np.zeros(4)
        for i, f, v in rows:
            if i == inst:
                x[f] = v
        assert got[inst] == pytest.approx(_naive(x, w, V, w0), abs=1e-12)


def test_gradient_matches_finite_differences(spark):
    params, feats, meta, w, V, w0, rows = _toy(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "instance_id long, label int")
    stats = fm_residuals(labels, feats, params, meta)
    g = {r.feature_id: r for r in fm_gradient(feats, stats, meta).collect()}
    ys = {0: 1.0, 1: -1.0, 2: 1.0}

    def total_loss(wv, Vv):
        tot = 0.0
        for inst, y in ys.items():
            x = np.zeros(4)
            for i, f, v in rows:
                if i == inst:
                    x[f] = v
            tot += math.log1p(math.exp(-y * _naive(x, wv, Vv, w0)))
        return tot

    eps = 1e-6
    for f in range(4):
        wp = w.copy(); wp[f] += eps
        wm = w.copy(); wm[f] -= eps
        assert g[f].c == pytest.approx((total_loss(wp, V) - total_loss(wm, V)) / (2 * eps), abs=1e-6)
        for q in range(2):
            Vp = V.copy(); Vp[f, q] += eps
            Vm = V.copy(); Vm[f, q] -= eps
            num = (total_loss(w, Vp) - total_loss(w, Vm)) / (2 * eps)
            assert g[f].a[q] - V[f, q] * g[f].b == pytest.approx(num, abs=1e-6)


def test_local_sgd_one_part_equals_numpy_loop(spark):
    params, feats, meta, w, V, w0, rows = _toy(spark)
    inst = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "instance_id long, label int")
    hp = FMParams(k=2, task=1, iterations=2, step=0.5, reg=(0.01, 0.02, 0.03), init_std=0.1)
    p, m, _ = fm_fit_local_sgd(inst, feats, 4, hp, n_parts=1, params=params, meta=meta)
    got = {r.feature_id: (r.w, r.v) for r in p.collect()}
    # plain sequential SGD, instances in key order
    w_, V_, b = w.copy(), V.copy(), w0
    for t in (1, 2):
        eta = 0.5 / math.sqrt(t)
        for inst_id, y in ((0, 1.0), (1, -1.0), (2, 1.0)):
            idx = [f for i, f, v in rows if i == inst_id]
            x = np.array([v for i, f, v in rows if i == inst_id])
            s = x @ V_[idx]
            z = b + w_[idx] @ x + 0.5 * (s @ s - np.sum((V_[idx] * x[:, None]) ** 2))
            mm = -y * (1 - 1 / (1 + math.exp(-y * z)))
            b -= eta * (mm + 0.01 * b)
            w_[idx] -= eta * (x * mm + 0.02 * w_[idx])
            V_[idx] -= eta * ((s[None, :] * x[:, None] - V_[idx] * (x * x)[:, None]) * mm + 0.03 * V_[idx])
    assert m.w0 == pytest.approx(b, abs=1e-12)
    for f in range(4):
        assert got[f][0] == pytest.approx(w_[f], abs=1e-12)
        assert got[f][1] == pytest.approx(list(V_[f]), abs=1e-12)


def test_batch_training_lowers_loss(spark):
    params, feats, meta, w, V, w0, rows = _toy(spark)
    inst = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "instance_id long, label int")
    hp = FMParams(k=2, task=1, iterations=4, step=0.5, reg=(0.0, 0.0, 0.0), init_std=0.1)
    _, _, hist = fm_fit_batch(inst, feats, 4, hp, params=params, meta=meta)
    losses = [h["loss"] for h in hist]
    assert losses[-1] < losses[0]


def test_init_is_seeded_gaussian(spark):
    p = fm_init(spark, 2000, 4, std=0.5, seed=11)
    vals = np.concatenate([np.array(r.v) for r in p.collect()])
    assert abs(vals.mean()) < 0.05 and abs(vals.std() - 0.5) < 0.05
    again = fm_init(spark, 2000, 4, std=0.5, seed=11).orderBy("feature_id").first().v
    assert again == p.orderBy("feature_id").first().v


def test_streamed_local_sgd_equals_a_plain_pass_over_each_part(spark):
    """Every part by hand: its instances in key order from the same start, deltas averaged."""
    rng = np.random.default_rng(4)
    k, n, parts = 3, 12, 4
    hp = FMParams(k=k, task=1, iterations=1, step=0.3, reg=(0.01, 0.02, 0.03), init_std=0.1)
    w, v = rng.normal(0, 0.1, n), rng.normal(0, 0.1, (n, k))
    data = {i: (int(rng.integers(0, 2)), sorted(rng.choice(n, rng.integers(1, 6), replace=False).tolist())) for i in range(200)}
    params = spark.createDataFrame([(i, float(w[i]), v[i].tolist()) for i in range(n)], "feature_id long, w double, v array<double>")
    inst = spark.createDataFrame([(i, y) for i, (y, _) in data.items()], "instance_id long, label int")
    feats = spark.createDataFrame([(i, f, 1.0) for i, (_, b) in data.items() for f in b], "instance_id long, feature_id long, value double")
    meta = FMMeta(num_features=n, k=k, task=1, w0=0.2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # parts and instances lie across batches
    try:
        p, m, _ = fm_fit_local_sgd(inst, feats, n, hp, n_parts=parts, params=params, meta=meta, part=F.col("instance_id") % parts)
        got = {r["feature_id"]: r for r in p.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    dw, dv, dw0 = np.zeros(n), np.zeros((n, k)), 0.0
    for part in range(parts):
        lw, lv, lw0 = w.copy(), v.copy(), 0.2
        for i in sorted(data):
            if i % parts != part:
                continue
            y, b = (1 if data[i][0] else -1), data[i][1]
            s = lv[b].sum(axis=0)
            z = lw0 + lw[b].sum() + 0.5 * (s @ s - (lv[b] ** 2).sum())
            e = -y * (1 - 1 / (1 + math.exp(-y * z)))
            lw0 -= 0.3 * (e + 0.01 * lw0)
            old = lv[b].copy()
            lw[b] -= 0.3 * (e + 0.02 * lw[b])
            lv[b] = old - 0.3 * ((s - old) * e + 0.03 * old)
        dw, dv, dw0 = dw + (lw - w) / parts, dv + (lv - v) / parts, dw0 + (lw0 - 0.2) / parts
    assert m.w0 == pytest.approx(0.2 + dw0)
    for i in range(n):
        assert got[i]["w"] == pytest.approx(w[i] + dw[i]) and got[i]["v"] == pytest.approx((v[i] + dv[i]).tolist())


def test_the_number_of_parts_follows_the_rows(spark):
    params, feats, meta, *_ = _toy(spark)
    inst = spark.createDataFrame([(i, i % 2) for i in range(3)], "instance_id long, label int")
    many, few = (fm_fit_local_sgd(inst, feats, 4, FMParams(k=2, iterations=1, step=0.1, part_rows=r), params=params, meta=meta)[1].w0 for r in (1, 1000))
    given = fm_fit_local_sgd(inst, feats, 4, FMParams(k=2, iterations=1, step=0.1, parts=1), params=params, meta=meta)[1].w0
    assert few == given != many


def test_a_laid_out_step_moves_no_feature_rows(spark):
    from trolley.operators.fm import fm_gradient, fm_residuals, fm_step
    from trolley.operators.fm_layout import SALT, training_layout
    rng = np.random.default_rng(6)
    n, k = 30, 2
    rows = [(i, int(f)) for i in range(150) for f in {0, *rng.integers(0, n, 4).tolist()}] + [(500, f) for f in range(n)]  # feature 0 and instance 500 are hot
    feats = spark.createDataFrame([(i, f, 1.0) for i, f in rows], "instance_id long, feature_id long, value double")
    inst = spark.createDataFrame([(i, int(i % 2)) for i in sorted({i for i, _ in rows})], "instance_id long, label int")
    params = spark.createDataFrame([(i, float(rng.normal()), rng.normal(size=k).tolist()) for i in range(n)], "feature_id long, w double, v array<double>")
    meta, hp = FMMeta(num_features=n, k=k, task=1), FMParams(k=k, step=0.5, reg=(0.01, 0.02, 0.03))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layout = training_layout(inst, feats, buckets=3, salt_rows=20)
        assert layout.by_feature.where("feature_id = 0").select(SALT).distinct().count() > 3 and layout.hot_instances.count() == 1
        laid = layout.lay_params(params)
        plan = fm_residuals(inst, layout.by_feature, laid, meta, on=("feature_id", SALT))._jdf.queryExecution().executedPlan().toString()
        stats = layout.lay_stats(fm_residuals(inst, layout.by_feature, laid, meta, on=("feature_id", SALT)))
        again = fm_gradient(layout.by_instance, stats, meta, on=("instance_id", SALT))._jdf.queryExecution().executedPlan().toString()
        for text in (plan, again):
            join = next(line for line in text.splitlines() if "SortMergeJoin" in line and SALT in line)
            below = text[text.index(join):]
            depth = join.index("SortMergeJoin")
            inside = [line for line in below.splitlines()[1:] if len(line) - len(line.lstrip(" :+-*()0123456789")) > depth]
            assert sum("FileScan" in x or "Scan parquet" in x for x in inside[:12]) == 2 and not any("Exchange" in x for x in inside[:12])
        one, m1, i1 = fm_step(inst, feats, params, meta, 1, hp)
        two, m2, i2 = fm_step(inst, layout, params, meta, 1, hp)
        three, m3, _ = fm_step(inst, layout, two, m2, 2, hp)
        four, m4, _ = fm_step(inst, feats, one, m1, 2, hp)
        assert m1.w0 == pytest.approx(m2.w0) and i1["loss"] == pytest.approx(i2["loss"]) and m3.w0 == pytest.approx(m4.w0)
        got, want = ({r["feature_id"]: [r["w"], *r["v"]] for r in x.collect()} for x in (three, four))
        assert len(got) == n and all(got[i] == pytest.approx(want[i]) for i in want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_top_rows_ties_go_to_lower_id():
    scores = np.array([[0.5, 0.7, 0.5, 0.5], [0.1, 0.2, 0.3, 0.4], [0.2, 0.2, 0.2, 0.2]])
    assert _top_places(scores, 2).tolist() == [[1, 0], [3, 2], [0, 1]]
    assert _top_places(scores, 9).tolist() == [[1, 0, 2, 3], [3, 2, 1, 0], [0, 1, 2, 3]]


def test_recommend_equals_naive_rescoring(spark):
    params, feats, meta, w, V, w0, rows = _toy(spark)
    bf = feats.withColumnRenamed("instance_id", "pid").where(F.col("value") == 1.0)
    items = spark.createDataFrame([(t, f"item{t}") for t in range(4)], "item_id long, item string")
    recs = recommend(bf, params, meta, items, n_items=4, k=2, block_size=3, group_size=1).collect()
    assert all(r["item"] == f"item{r.item_id}" for r in recs)
    got = {}
    for r in recs:
        got.setdefault(r.pid, []).append((r.rank, r.item_id, r.score))
    for pid in got:
        basket = {f for i, f, v in rows if i == pid and v == 1.0}
        scored = []
        for t in range(4):
            if t in basket:
                continue
            x = np.zeros(4)
            x[list(basket | {t})] = 1.0
            scored.append((-1 / (1 + math.exp(-_naive(x, w, V, w0))), t))
        expect = [t for _, t in sorted(scored)[:2]]
        assert [i for _, i, _ in sorted(got[pid])] == expect


def _random_model(spark, task, n=300, k=4, seed=2):
    from trolley.operators.fm import FMMeta
    rng = np.random.default_rng(seed)
    w, v = rng.normal(0, 0.4, n), rng.normal(0, 0.1, (n, k)) * rng.choice([0.1, 1, 6], n, p=[0.7, 0.2, 0.1])[:, None]
    w[40:60], v[40:60] = w[40], v[40]  # ties
    params = spark.createDataFrame([(i, float(w[i]), [float(x) for x in v[i]]) for i in range(n)], "feature_id long, w double, v array<double>")
    meta = FMMeta(num_features=n, k=k, task=task, w0=0.1, min_label=-1.0, max_label=1.0)
    baskets = {p: sorted(rng.choice(n, rng.integers(0, 30), replace=False).tolist()) for p in range(40)} | {90: list(range(n)), 91: list(range(n - 3))}
    feats = spark.createDataFrame([(p, i, 1.0) for p, b in baskets.items() for i in b], "pid long, feature_id long, value double")
    items = spark.createDataFrame([(i, f"item{i}") for i in range(n)], "item_id long, item string")
    return w, v, params, meta, {p: b for p, b in baskets.items() if b}, feats, items


@pytest.mark.parametrize("task", [0, 1])
@pytest.mark.parametrize("options", [dict(block_size=300), dict(block_size=16), dict(block_size=16, broadcast_bytes=0, group_size=7), dict(block_size=50, broadcast_bytes=0, group_size=1000)])
def test_pruned_recommendations_equal_scoring_everything(spark, task, options):
    w, v, params, meta, baskets, feats, items = _random_model(spark, task)
    rows = recommend_lists(feats, params, meta, items, n_items=300, k=7, **options).collect()
    assert len(rows) == len(baskets)
    for r in rows:
        b = baskets[r["pid"]]
        s, q = v[b].sum(axis=0), (v[b] ** 2).sum()
        z = 0.1 + w[b].sum() + 0.5 * (s @ s - q)
        raw = z + w + v @ s
        score = np.clip(raw, -1, 1) if task == 0 else 1 / (1 + np.exp(-raw))
        want = sorted((i for i in range(300) if i not in set(b)), key=lambda i: (-round(score[i], 9), i))[:7]
        got = [t["item_id"] for t in r["top"]]
        assert got == want or [round(score[i], 9) for i in got] == [round(score[i], 9) for i in want]
        assert [t["item"] for t in r["top"]] == [f"item{i}" for i in got]
    if options["block_size"] == 16:
        assert sum(r["scored"] for r in rows) < 0.9 * 300 * len(rows)


def test_curve_areas_fixture(spark):
    # tp 3, fp 1, fn 1, tn 3 at threshold 0.5
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (1, 0.2), (0, 0.1), (0, 0.3), (0, 0.4)]
    df = spark.createDataFrame(rows, "label int, score double")
    a = curve_areas(df, threshold=0.5).first()
    assert a.area_under_roc == pytest.approx(0.75)
    assert a.area_under_pr == pytest.approx(0.71875)


def test_curve_areas_match_builtin(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rng = np.random.default_rng(3)
    rows = [(int(l), float(round(s, 2))) for l, s in zip(rng.integers(0, 2, 400), rng.random(400))]
    df = spark.createDataFrame(rows, "label int, score double")
    a = curve_areas(df).first()
    ev = df.select(F.col("label").cast("double").alias("label"), F.col("score").alias("rawPrediction"))
    roc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(ev)
    pr = BinaryClassificationEvaluator(metricName="areaUnderPR").evaluate(ev)
    assert a.area_under_roc == pytest.approx(roc, abs=1e-12)
    assert a.area_under_pr == pytest.approx(pr, abs=1e-12)


def test_a_basket_with_every_candidate_keeps_its_line(spark):
    params, feats, meta, *_ = _toy(spark)
    full = spark.createDataFrame([(1, t, 1.0) for t in range(4)] + [(2, 0, 1.0)], "pid long, feature_id long, value double")
    items = spark.createDataFrame([(t, f"item{t}") for t in range(4)], "item_id long, item string")
    lines = submission_lines(recommend_lists(full, params, meta, items, n_items=4, k=1, block_size=2)).collect()
    got = {r.pid: r.line for r in lines}
    assert got[1] == "1" and got[2].startswith("2,item")


def test_one_class_has_no_roc_area(spark):
    for label, pr in ((1, 1.0), (0, None)):
        a = curve_areas(spark.createDataFrame([(label, 0.9), (label, 0.1)], "label int, score double")).first()
        assert a.area_under_roc is None and a.area_under_pr == pr


def test_features_outside_the_model_raise(spark):
    params, feats, meta, *_ = _toy(spark)
    keys = spark.createDataFrame([(99,)], "instance_id long")
    wrong = spark.createDataFrame([(99, 10 ** 9, 1.0)], "instance_id long, feature_id long, value double")
    with pytest.raises(Exception, match="outside the model"):
        fm_score(keys, wrong, params, meta).collect()


def test_large_uniform_int_is_exact_and_inside(spark):
    import hashlib
    from trolley.functions.hashing import uniform_int
    size = 6_000_000_007
    for r in spark.range(300).select("id", uniform_int(size, F.col("id")).alias("u")).collect():
        assert r.u == int(hashlib.md5(str(r.id).encode()).hexdigest()[:14], 16) * size // 2 ** 56


@pytest.mark.parametrize("bad", [dict(task=2), dict(k=0), dict(reg=(0, 0)), dict(reg=(-1, 0, 0)), dict(init_std=0), dict(iterations=-1),
                                 dict(step=0), dict(batch_fraction=0), dict(tolerance=2), dict(parts=0)])
def test_hyper_parameters_are_validated(bad):
    with pytest.raises(ValueError):
        FMParams(**bad)


def test_regression_switches_and_stopping(spark):
    from trolley.operators.fm import fm_fit_local_sgd, fm_train, fm_train_short
    params, feats, meta, w, V, w0, rows = _toy(spark)
    inst = spark.createDataFrame([(0, 2.5), (1, -1.0), (2, 0.5)], "instance_id long, label double")
    p, m, hist = fm_train(inst, feats, 4, task=0, iterations=3, step=0.1, dim=(True, True, 2), method="batch")
    assert (m.task, m.min_label, m.max_label) == (0, -1.0, 2.5) and hist[-1]["loss"] < hist[0]["loss"]
    p, m, _ = fm_train(inst, feats, 4, task=0, iterations=2, step=0.1, dim=(False, False, 2), method="batch")
    assert m.w0 == 0.0 and all(r.w == 0.0 for r in p.collect())
    _, _, hist = fm_train(inst, feats, 4, task=0, iterations=9, step=1e-9, dim=(True, True, 2), method="batch", tolerance=0.5)
    assert len(hist) == 1
    _, _, hist = fm_train(inst, feats, 4, task=0, iterations=4, step=0.1, dim=(True, True, 2), method="batch", batch_fraction=0.4)
    assert len(hist) == 4 and min(h["n"] for h in hist) < 3
    _, m, _ = fm_train_short(inst, feats, 4, task=0, iterations=1)
    assert m.k == 8
    with pytest.raises(ValueError):
        fm_fit_local_sgd(inst, feats, 4, FMParams(k=2, batch_fraction=0.5))
    none = inst.where("false")
    assert fm_train(none, feats.where("false"), 4, task=1, iterations=2, method="batch")[2] == []
    assert fm_train(none, feats.where("false"), 4, task=1, iterations=2)[2] == []


def test_local_sgd_does_not_depend_on_session_settings_and_survives_extreme_margins(spark):
    from trolley.operators.fm import fm_fit_local_sgd
    params, feats, meta, w, V, w0, rows = _toy(spark)
    inst = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "instance_id long, label int")
    hp = FMParams(k=2, iterations=2, step=0.1, init_std=0.1, parts=3)
    out = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(fm_fit_local_sgd(inst, feats, 4, hp)[1].w0)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]
    _, m, _ = fm_fit_local_sgd(inst, feats, 4, FMParams(k=2, iterations=3, step=1e6, init_std=5.0, parts=1))
    assert not math.isnan(m.w0)
