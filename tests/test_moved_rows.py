"""What moves between tasks: tables that lie together, lists that do not travel, work done once."""

import os

import pytest
from pyspark.sql import functions as F

from trolley.operators import recommend as rec
from trolley.operators.features import libsvm_lines
from trolley.operators.fm import FMMeta, FMParams, fm_gradient, fm_init, fm_margin, fm_residuals, fm_score, fm_step
from trolley.operators.fm_layout import instance_rows, training_layout
from trolley.operators.negatives import (attach_makers, candidate_rows, drop_seen_items, drop_seen_makers, group_negatives,
                                        sample_negatives, surviving_tries)
from trolley.session import materialize, materialize_bucketed

POS = "pid bigint, pname string, item_id bigint, maker string"


def positives(spark):
    rows = [(p, None if p % 7 == 0 else f"name {p % 3}", (p * 5 + i * 3) % 11, None if i % 4 == 3 else f"m{(p + i) % 5}") for p in range(40) for i in range(p % 5)]
    return spark.createDataFrame(rows + [(41, "name 1", None, None), (2, "name 2", 1, "m1"), (2, "name 2", 1, "m1")], POS)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_surviving_tries_are_found_once(spark):
    pos = materialize(positives(spark))
    inst, pairs = sample_negatives(pos, 11, ratio=3.0)
    assert "Join" not in optimized(inst) and "Join" not in optimized(pairs)
    st = pos.agg(F.count(F.lit(1)).alias("n"), F.max("pid").alias("m")).first()
    want_inst, want_pairs = group_negatives(surviving_tries(pos, 3 * st["n"], st["m"], 11))
    assert pairs.count() > 0
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want_pairs.collect()))
    key = lambda r: (r["pid"], r["pname"] or "", r["label"])
    assert sorted(map(key, inst.collect())) == sorted(map(key, want_inst.collect()))


def test_tries_travel_with_lists_of_makers(spark):
    pos = positives(spark)
    cand = spark.range(200).select(F.col("id").alias("try_id"), (F.col("id") % 40).alias("pid"), (F.col("id") % 11).alias("item_id"))
    rows = attach_makers(cand, pos)
    got = drop_seen_makers(rows, pos)
    plain = drop_seen_makers(rows.select("*"), pos)  # a table that remembers nothing: the anti-join
    plan = optimized(got)
    assert plan.index("Generate") < plan.index("Join")
    cols = ["try_id", "pid", "item_id", "maker"]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    found = sorted(map(key, got.select(*cols).collect()))
    assert found == sorted(map(key, plain.select(*cols).collect())) and any(r[3] == "" for r in found)


def test_positives_that_lie_by_basket_do_not_move(spark):
    pos = materialize_bucketed(positives(spark).where("item_id IS NOT NULL"), 4, "pid")
    cand = candidate_rows(spark, 50).select("try_id", (F.col("try_id") % 40).alias("pid"), (F.col("try_id") % 11).alias("item_id"))
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = drop_seen_items(cand, pos)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 1


def test_margins_move_k_plus_one_sums(spark):
    feats = spark.createDataFrame([(1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "instance_id bigint, feature_id bigint, value double")
    meta = FMMeta(num_features=3, k=4)
    params = materialize(fm_init(spark, 3, 4, 0.1, 7))
    assert optimized(fm_margin(feats, params, meta)).count("sum(") == 5
    keys = feats.select("instance_id").distinct()
    one, two = (fm_score(keys, feats, params, meta, others=o) for o in (True, False))
    assert "LeftSemi" in optimized(one) and "LeftSemi" not in optimized(two)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_no_list_is_written_on_the_way(spark, monkeypatch):
    n, k = 40, 3
    params = materialize(fm_init(spark, n, 4, 0.3, 7))
    meta = FMMeta(num_features=n, k=4)
    feats = spark.createDataFrame([(p, (p * 7 + i) % n, 1.0) for p in range(30) for i in range(p % 4 + 1)], "pid bigint, feature_id bigint, value double")
    names = spark.createDataFrame([(f"i{i}", i) for i in range(n)], "item string, item_id bigint")
    written = []
    monkeypatch.setattr(rec, "materialize", lambda df: written.append(df.schema) or materialize(df))
    prof = materialize(rec.basket_profile(feats, params, meta).withColumn("seen", F.array().cast("array<bigint>")))
    blocks = materialize(rec.candidate_blocks(rec.popular_items(params, n), 1.0, 8))
    lists = rec.top_lists(prof, blocks, meta, k, 4, broadcast_bytes=1)
    assert written and not any({"ids", "scores", "top_ids", "top_scores"} & set(s.names) for s in written)
    whole = rec.top_lists(prof, blocks, meta, k, 4)
    assert sorted((r["pid"], r["ids"]) for r in lists.collect()) == sorted((r["pid"], r["ids"]) for r in whole.collect())
    written.clear()
    assert rec.recommend_lists(feats, params, meta, names, n, k=k).count() == 30
    assert not any({"ids", "scores"} <= set(s.names) and "w" not in s.names for s in written)


@pytest.mark.parametrize("size,splits", [(1000, 65536), (1 << 30, 1 << 24), (1 << 40, 128 << 20)])
def test_large_files_are_not_read_in_tiny_splits(spark, tmp_path, size, splits):
    from trolley.plans.queries import _split_size
    with open(tmp_path / "x.txt", "wb") as f:
        os.truncate(f.fileno(), size)  # a hole: takes no room
    assert _split_size(spark, str(tmp_path), 64 << 10) == f"{splits}b"


def planned(spark, make):
    """The physical plan of ``make()`` without broadcasts and run-time changes, joins on part of the keys allowed."""
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def moves(plan):
    return plan.count("Exchange hashpartitioning")


def test_names_and_makers_are_looked_up_in_one_move(spark):
    pos = materialize_bucketed(positives(spark).where("item_id IS NOT NULL"), 4, "pid")
    plan = planned(spark, lambda: surviving_tries(pos, 50, 41, 11))
    # tries: to the baskets, to the items, back; lookups: (item, name), (item, maker) and its lists
    assert moves(plan) == 6 and "hashpartitioning(item_id" in plan and "hashpartitioning(item_id, pname" not in plan.replace("#", " #")


def test_lines_move_their_features_once(spark):
    feats = materialize(spark.createDataFrame([(1, 2, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 5, 0.5), (4, 1, 1.0)], "instance_id bigint, feature_id bigint, value double"))
    labels = materialize(spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None)], "instance_id bigint, label int"))
    plan = planned(spark, lambda: libsvm_lines(labels, feats))
    assert moves(plan) == 2  # the features and the labels
    got = {r["instance_id"]: r["line"] for r in libsvm_lines(labels, feats).collect()}
    assert got == {1: "1.0 1:1.0 3:1.0", 2: "0.0 6:0.5", 3: "1.0", 4: "2:1.0"}


@pytest.mark.parametrize("salt_rows", [1 << 20, 2])
def test_statistics_move_only_where_an_instance_is_salted(spark, salt_rows):
    feats = spark.createDataFrame([(i, (i * 3 + j) % 7, 1.0) for i in range(20) for j in range(i % 4 + 1)], "instance_id bigint, feature_id bigint, value double")
    inst = materialize(spark.createDataFrame([(i, i % 2) for i in range(0, 22, 1)], "instance_id bigint, label int"))
    meta, hp = FMMeta(num_features=7, k=2), FMParams(k=2, step=0.5, reg=(0.01, 0.001, 0.05))
    params = materialize(fm_init(spark, 7, 2, 0.1, 7))
    layout = training_layout(inst, materialize(feats), salt_rows=salt_rows)
    assert (layout.hot_instances is None) == (salt_rows > 2)
    assert sorted(layout.by_instance.select("instance_id", "feature_id", "value").collect()) == sorted(feats.collect())
    stats = layout.lay_stats(fm_residuals(inst, feats, params, meta).select("instance_id", "s", "m", "loss"))
    assert layout.once(stats).count() == 22
    grad = planned(spark, lambda: fm_gradient(layout.by_instance, stats, meta, on=layout.instance_keys))
    assert moves(grad) == 1  # the sums by feature
    laid, m1, _ = fm_step(inst, layout, params, meta, 1, hp)
    plain, m2, _ = fm_step(inst, feats, params, meta, 1, hp)
    flat = lambda p: sorted((r["feature_id"], round(r["w"], 9), *[round(x, 9) for x in r["v"]]) for r in p.collect())
    assert flat(laid) == flat(plain) and abs(m1.w0 - m2.w0) < 1e-12


def test_placed_rows_are_not_dealt_again(spark):
    inst = materialize(spark.createDataFrame([(i,) for i in range(0, 30, 2)], "instance_id bigint"))
    feats = spark.createDataFrame([(i, j, 1.0) for i in range(30) for j in range(3)], "instance_id bigint, feature_id bigint, value double")
    rows = instance_rows(inst, materialize(feats), buckets=4)
    assert rows.count() == 45 and moves(planned(spark, lambda: rows.groupBy("instance_id").count())) == 0
    assert sorted(r["count"] for r in rows.groupBy("instance_id").count().collect()) == [3] * 15


def test_a_task_gathers_a_bounded_share_of_lines(spark, monkeypatch):
    from trolley.operators import features as f
    feats = materialize(spark.createDataFrame([(i, j, 1.0) for i in range(40) for j in range(3)], "instance_id bigint, feature_id bigint, value double"))
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "instance_id bigint, label int")
    assert f.line_partitions(feats) == 4
    monkeypatch.setattr(f, "LINE_ROWS", 10)
    assert f.line_partitions(feats) == 12
    lines = libsvm_lines(labels, feats, partitions=f.line_partitions(feats))
    assert "hashpartitioning(instance_id" in planned(spark, lambda: lines) and lines.count() == 40
    assert lines.rdd.getNumPartitions() == 12


@pytest.mark.parametrize("task", [0, 1])
def test_baskets_that_broadcast_blocks_settle_do_not_meet_travelling_ones(spark, monkeypatch, task):
    """Only the first block was broadcast where not all were, and every group was sent the others that its widest bounds admit."""
    n, k = 600, 5
    meta = FMMeta(num_features=n, k=4, task=task, min_label=-999.0, max_label=999.0)
    params = spark.range(n).select(F.col("id").alias("feature_id"), F.when(F.col("id") < 9, F.lit(3.0) * F.col("id")).otherwise(0.0).alias("w"),
                                   F.array(*[F.sin(F.col("id") * (3 + f)) * F.when(F.col("id") < 100, 1.0).otherwise(0.02) for f in range(4)]).alias("v"))
    params = materialize(params)
    # scores of the baskets lie far apart, so one bound for a group of them admits every block
    feats = spark.createDataFrame([(p, i, 1.0) for p in range(60) for i in [p % 9, 9 + p]], "pid bigint, feature_id bigint, value double")
    prof = materialize(rec.basket_profile(feats, params, meta).withColumn("seen", F.array().cast("array<bigint>")))
    blocks = materialize(rec.candidate_blocks(rec.popular_items(params, n), 1.0, 40))
    size = blocks.agg(F.sum(F.length("ids") + F.length("w") + F.length("v"))).first()[0]
    whole = {r["pid"]: (r["ids"], r["scores"]) for r in rec.top_lists(prof, blocks, meta, k).collect()}
    ranked = []
    monkeypatch.setattr(rec, "dense_ids", lambda df, *a, f=rec.dense_ids: ranked.append(df.count()) or f(df, *a))
    got = rec.top_lists(prof, blocks, meta, k, 20, broadcast_bytes=size // 2).collect()
    assert {r["pid"]: r["ids"] for r in got} == {p: x[0] for p, x in whole.items()}
    assert all(r["scores"] == pytest.approx(whole[r["pid"]][1], abs=1e-12) for r in got)
    assert sum(ranked) < 30  # of 60


@pytest.mark.parametrize("task, lo, hi", [(1, 0, 0), (0, -0.5, 0.5), (0, -9, 9)])
def test_kept_candidates_equal_sorting_all(task, lo, hi):
    import numpy as np
    rng = np.random.default_rng(3)
    n, k, baskets = 300, 12, 25
    w, v = rng.normal(0, 1, n), rng.normal(0, 1, (n, 3))
    w[100:140], v[100:140] = 0.7, v[100]  # ties
    z, s = rng.normal(0, 20, baskets), rng.normal(0, 1, (baskets, 3))
    seen = [np.sort(rng.choice(n, rng.integers(0, n), replace=False)) for _ in range(baskets)]
    at = rec._Baskets(np.arange(baskets), z, s, seen, k, (task, lo, hi))
    ids = rng.permutation(n)
    for x in range(0, n, 64):
        i = ids[x:x + 64]
        at.meet(rec._Block(i.tobytes(), w[i].tobytes(), v[i].tobytes(), w[i].max(), np.sqrt((v[i] ** 2).sum(axis=1)).max()))
    got = at.lists()
    for b in range(baskets):
        raw = np.array([z[b] + w[i] + s[b] @ v[i] for i in range(n)])
        score = rec._reported(raw, task, lo, hi).round(9)
        want = sorted(set(range(n)) - set(seen[b].tolist()), key=lambda i: (-score[i], i))[:k]
        found = got.column(1)[b].as_py()
        assert found == want or [score[i] for i in found] == [score[i] for i in want]
        assert len(set(found)) == len(found) and not set(found) & set(seen[b].tolist())


@pytest.mark.parametrize("columns", [("pid", "line"), ("line",)])
def test_submission_lines_are_dealt_by_a_key(spark, tmp_path, monkeypatch, columns):
    """Dealt in turn, all lines were sorted first, and spilled."""
    lines = spark.range(50).select(F.col("id").alias("pid"), F.concat_ws(",", F.col("id").cast("string"), F.lit("x")).alias("line")).select(*columns)
    keys, deal = [], type(lines).repartition
    monkeypatch.setattr(type(lines), "repartition", lambda self, n, *by: keys.append((n, *by)) or deal(self, n, *by))
    rec.write_submission(lines, str(tmp_path / "out"), 3)
    assert keys == [(3, columns[0])]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(f"{i},x" for i in range(50))
    assert len(list((tmp_path / "out").glob("part-*"))) <= 3


def test_tries_write_the_columns_they_read(spark, monkeypatch):
    from trolley.operators.baskets import ITEM_COLUMNS
    from trolley.plans import queries
    rows = [(p, "N", "n", f"i{(p + j) % 5}", f"m{j}", "g", "text", "text", "text") for p in range(6) for j in range(3)]
    items = spark.createDataFrame(rows, "pid bigint, " + ", ".join(f"{c} string" for c in ITEM_COLUMNS[1:]))
    written = []
    monkeypatch.setattr(queries, "materialize", lambda df: written.append(set(df.columns)) or materialize(df))
    e, cand = queries._tries(spark, "", items)
    assert written == [{"pid", "pname", "item", "maker"}, {"item", "item_id", "freq"}]
    assert cand.count() == 18 and set(e.columns) == {"pid", "pname", "maker", "item_id"}
