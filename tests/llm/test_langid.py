import itertools

import numpy as np
from helpers import docs

from trolley.llm import langid as L

EN = "the weather was nice and they walked through the quiet streets of this old town with their friends"
DE = "das wetter war schön und sie gingen durch die ruhigen straßen der alten stadt mit ihren freunden zusammen"
RU = "погода была хорошая и они гуляли по тихим улицам старого города вместе с друзьями"


def test_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(60):
        size = rng.integers(1, 6, rng.integers(1, 6))
        score, prior, at = rng.normal(0, 3, (size.sum(), 3)), rng.normal(0, 1, 3), 0
        got = L.viterbi(score, size, 1.5, prior)
        for n in map(int, size):
            x = score[at:at + n]

            def value(p):
                return prior[p[0]] + sum(x[i, p[i]] for i in range(n)) - 1.5 * sum(p[i] != p[i - 1] for i in range(1, n))
            assert abs(max(map(value, itertools.product(range(3), repeat=n))) - value(got[at:at + n])) < 1e-9
            at += n


def model(spark):
    train = docs(spark, [EN, DE, RU, "ignored", None, "x"], lang=["en", "de", "ru", None, "en", ""])
    return L.fit(train)


def test_spans_scripts_and_awkward_texts(spark):
    m = model(spark)
    assert m.langs == ["de", "en", "ru"]
    texts = [EN, DE.upper(), f"{EN}. {DE}. {RU}", None, "", "12 -- !? ²", "город", (EN + " ") * 2000, "日本"]
    got = {r["doc_id"]: r["language"] for r in L.predict(docs(spark, texts), m).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 6, 7)] == ["en", "de", "ru", "en"]
    assert all(got[k] == ("und", 0.0, []) for k in (3, 4, 5))
    assert [s["lang"] for s in got[2]["spans"]] == ["en", "de", "ru"]
    n = [len(EN.split()), len(DE.split()), len(RU.split())]
    ends = [s["stop"] for s in got[2]["spans"]]
    assert abs(ends[0] - n[0]) <= 2 and ends[1] == n[0] + n[1] and ends[2] == sum(n)
    assert got[8]["lang_pred"] in m.langs and 0 <= got[8]["score"] <= 1
    cyrillic = L.SCRIPTS.index("Cyrillic")
    assert m.allowed[cyrillic].tolist() == [False, False, True]


def test_without_training_rows_and_empty_table(spark):
    table = docs(spark, [EN, None])
    m = L.fit(table)
    assert [r["language"]["lang_pred"] for r in L.predict(table, m).collect()] == ["und", "und"]
    assert L.predict(table.where("false"), model(spark)).count() == 0


def test_script_ranges_ascend():
    first = [a for a, _ in L.SCRIPT_RANGES]
    assert first == sorted(set(first))


def test_more_languages_than_a_byte_numbers():
    for n in (129, 200, 300):
        score = np.full((3, n), -50.0)
        score[:, n - 1] = 0
        assert L.viterbi(score, np.array([2, 1]), 1.5, np.zeros(n)).tolist() == [n - 1] * 3
    langs = [f"l{k:03}" for k in range(300)]
    logp = np.zeros((len(L.ORDERS) * L.BUCKETS, 300), np.float32)
    logp[:, 299] = 1
    m = L.Model(langs, logp, np.ones((len(L.SCRIPTS), 300), bool), np.zeros(300))
    assert L.label(["one two", "three"], m) == [("l299", 1.0, [(0, 2, "l299")]), ("l299", 1.0, [(0, 1, "l299")])]
