import numpy as np
import pyarrow as pa
from helpers import docs, prose

from trolley.llm import quality_fm as Q
from trolley.llm import textbytes as tb


def test_margin_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = Q.Model(0.3, rng.normal(size=Q.BUCKETS + Q.N_STATS), rng.normal(size=(Q.BUCKETS + Q.N_STATS, Q.FACTORS)), np.zeros(Q.N_STATS), np.ones(Q.N_STATS))
    texts = [b"one two two three", b"", b"x" * 3000, " ".join(prose(50)).encode()]
    row, bucket, value, stats = Q.features(texts, np.array([5.0, -1, 0, 7]), tb.SpanHasher())
    z = Q._standard(m, stats)
    got, _ = Q._raw_scores(m, row, bucket, value, z)
    for d in range(len(texts)):
        x = [*zip(bucket[row == d], value[row == d]), *((Q.BUCKETS + j, z[d, j]) for j in range(Q.N_STATS))]
        want = 0.3 + sum(m.w[i] * a for i, a in x) + sum(m.v[i] @ m.v[j] * a * b for k, (i, a) in enumerate(x) for j, b in x[:k])
        assert abs(got[d] - want) < 1e-6


def test_features_do_not_depend_on_the_slice():
    texts = [" ".join(prose(n, n)).encode() for n in (0, 1, 3, 700, 2)]
    together = Q.features(texts, np.full(5, -1.0), tb.SpanHasher())
    for d, t in enumerate(texts):
        alone = Q.features([t], np.full(1, -1.0), tb.SpanHasher(8))
        assert np.allclose(alone[3][0], together[3][d])
        assert np.array_equal(alone[1], together[1][together[0] == d])


def test_learns_scores_awkward_rows_and_ignores_other_columns(spark):
    good = [" ".join(prose(60, k)) for k in range(40)]
    junk = ["!! ".join(w.upper() for w in prose(60, 100 + k)) for k in range(40)]
    table = docs(spark, good + junk + [None, "", "z" * 200_000, good[0]], [*range(80), 80, None, 82, 0], lang=["en"] * 84)
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80) if k % 2] + [(1, 1), (3, None), (None, 0)], "doc_id bigint, quality int")
    model = Q.fit(table, labels)
    rows = Q.score(table, model).collect()
    assert len(rows) == 84 and all(0 <= r["score"] <= 1 for r in rows)
    held = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 80 and r["doc_id"] % 2 == 0}
    assert sum((s >= 0.5) == (d < 40) for d, s in held.items()) >= 39
    assert np.array_equal(Q.fit(table, labels).w, model.w)  # the same on every run


def test_no_labels_and_empty_table(spark):
    table = docs(spark, ["a b c", None])
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in Q.score(table, Q.fit(table, labels)).collect()] == [0.5, 0.5]
    assert Q.score(table.where("false"), Q.fit(table, labels)).count() == 0


def test_texts_are_scored_in_the_batch_they_came_in(spark, monkeypatch):
    table, found = docs(spark, ["a b c", None]), []
    model = Q.fit(table, spark.createDataFrame([], "doc_id bigint, quality int"))
    monkeypatch.setattr(Q.F, "arrow_udf", lambda kind: lambda f: found.append(f) or (lambda *columns: Q.F.lit(0.5)))
    Q.score(table, model)
    text, chars = pa.array([" ".join(prose(2000, k)) for k in range(400)] + [None]), pa.array([1.0] * 400 + [None])
    usual, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        scores = [x.to_pylist() for x in found[0](iter([(text, chars)]))]
    finally:
        pa.set_memory_pool(usual)
    assert scores == [[0.5] * 401] and text.nbytes > 3_000_000
    assert pool.max_memory() < text.nbytes / 10  # no copy of the texts
