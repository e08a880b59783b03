import random
import zlib

import pytest
from helpers import docs

from trolley.llm import spelling_variants as V


def apart(a, b):
    """Whether one code point inserted, deleted or replaced makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, least_length=5, least_count=3):
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    near = {w: [u for u in n if apart(w, u)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def counted(spark, counts):
    rows = [(w, n) for w, n in counts.items()]
    return spark.createDataFrame(rows, "w string, n int").selectExpr("explode(array_repeat(w, n)) AS word")


def vocabulary(n, seed, letters="abcdeéß÷"):
    rng, out = random.Random(seed), {"station": 4, "stations": 9, "stationes": 20}
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
        out[w] = rng.randint(2, 40)
        if rng.random() < 0.7:
            i = rng.randrange(len(w))
            out[rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])] = rng.randint(2, 40)
    return out


@pytest.mark.parametrize("hot,alphabets", [(4096, V.ALPHABETS), (3, V.ALPHABETS), (0, (2, 90)), (1, (4, 8, 90))])
def test_equals_brute_force(spark, hot, alphabets):
    counts = vocabulary(400, 3)
    want = brute(counts)
    assert sum(x[4] for x in want) > 200 and any(x[2] not in (x[0], x[1]) for x in want)
    got = [tuple(r) for r in V.variants(counted(spark, counts), hot=hot, alphabets=alphabets).collect()]
    assert len(got) == len(want) and set(got) == want


def test_words_one_letter_apart_by_the_hundred(spark):
    # one place varies: all are near each other, in one bucket or in linked ones
    counts = {f"stem{c}tail": 3 + k for k, c in enumerate(V.LETTERS)}
    got = {tuple(r) for r in V.variants(counted(spark, counts), hot=8).collect()}
    assert got == brute(counts) and all(x[4] == len(counts) - 1 for x in got)


def test_runs_and_query_rule(spark, tmp_path):
    texts = ["Hello hello HELLO élan-vital ÉLAN x1hello", None, "", "  \n", "don't Ünder ünder", "a" * 5000]
    table = docs(spark, texts)
    got = sorted((r["doc"], r["run"]) for r in V.runs(table).collect())
    assert ("0", "Élan"[0].lower() + "lan") in got and ("0", "ÉLAN".replace("LAN", "lan")) in got and ("5", "a" * 5000) in got
    assert sum(run == "hello" for _, run in got) == 4 and ("4", "Ünder") in got and ("4", "ünder") in got
    assert V.runs(table.where("false")).count() == 0 and V.variants(counted(spark, {"x": 1}).where("false")).count() == 0

    from trolley.llm.queries import QUERIES
    words = ["station", "stations", "nation", "national", "stationé"]
    rows = [" ".join(words[(k + j) % 5] for j in range(40)) for k in range(60)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    counts = {}
    for k, text in enumerate(rows):
        for w in text.split():
            h = zlib.crc32(f"{k}:{w}".encode())
            w = w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w
            counts[w] = counts.get(w, 0) + 1
    got = {tuple(r) for r in QUERIES["op12_spelling_variants"](spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute(counts) and any(w not in words for w in counts)
