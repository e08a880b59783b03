"""Heavy hitters: the capped vocabulary equals a full count, whatever the summaries leave out."""

import random
from collections import Counter

import pytest

from trolley.operators import vocab as V
from trolley.operators.baskets import item_text
from trolley.operators.dictionary import fit_dict
from trolley.operators.features import fit_encoders


def test_a_summary_bounds_the_true_counts():
    rng = random.Random(3)
    for size in (1, 3, 10):
        tokens = [f"t{min(int(rng.paretovariate(0.8)), 400)}" for _ in range(5000)]
        summary, true = V.Summary(size), Counter(tokens)
        for k in range(0, len(tokens), 37):
            part = Counter(tokens[k:k + 37])
            summary.add(part.keys(), part.values())
        summary.shrink()
        assert len(summary.counts) <= size and summary.error > 0
        assert all(summary.counts.get(t, 0) <= n <= summary.counts.get(t, 0) + summary.error for t, n in true.items())


@pytest.mark.parametrize("skew,size,room", [(1.6, 5, 4), (1.6, 5, 30), (0.3, 20, 1), (1.1, 4000, 4)])
def test_the_capped_vocabulary_equals_a_full_count(spark, skew, size, room, monkeypatch):
    rng = random.Random(size)
    rows = [" ".join(f"w{min(int(rng.paretovariate(skew)), 3000)}" for _ in range(40)) for _ in range(500)]
    texts = spark.createDataFrame([(r,) for r in rows], "names string").repartition(4)
    true = Counter(w for r in rows for w in r.split())
    want = [(t, n) for t, n in sorted(true.items(), key=lambda x: (-x[1], x[0]))[:size]]
    got = sorted((r["token_id"], r["token"], r["freq"]) for r in V.fit_vocab(texts, size=size, room=room).collect())
    assert got == [(k, t, n) for k, (t, n) in enumerate(want)]


def test_few_tokens_and_none(spark):
    texts = spark.createDataFrame([("b a b",), (None,), ("",)], "names string")
    assert [tuple(r) for r in V.fit_vocab(texts, size=9).orderBy("token_id").collect()] == [("b", 0, 2), ("a", 1, 1)]
    assert V.fit_vocab(texts.where("false"), size=9).count() == 0
    with pytest.raises(ValueError):
        V.fit_vocab(texts, size=0)


@pytest.mark.parametrize("size", [None, 4])
def test_encoders_from_string_counts_equal_those_of_the_rows(spark, size):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    rows = [(k % 9, pick("A b", None, "a\tB ", ""), pick("i1", "i2", "i3", None), pick("m", None), "g", pick("x  y x", " ", None), pick("Y", "the z"), pick("z", None))
            for k in range(300)]
    items = spark.createDataFrame(rows, "pid long, name string, item string, maker string, grp string, item_name string, maker_name string, grp_name string").repartition(5)
    enc = fit_encoders(items, size, stop_words=True)

    def told(df):
        return sorted(map(tuple, df.collect()))

    assert told(enc.item_dict) == told(fit_dict(items, "item"))
    assert told(enc.vocab) == told(V.fit_vocab(item_text(items), "names", size, stop_words=True))
    assert (enc.n_items, enc.n_tokens) == (3, 4)  # "a" and "the" are stop words
    empty = fit_encoders(items.where("false"), size)
    assert (empty.n_items, empty.n_tokens) == (0, 0)
