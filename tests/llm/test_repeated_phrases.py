import random

from helpers import docs, prose

from trolley.llm import repeated_phrases as R


def brute(rows, width):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i:i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if d is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i:i + width])] < d:
                    gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def compare(spark, texts, ids, width=50, phrase=10, **limits):
    got = R.dedup_repeats(docs(spark, texts, ids), window=width, phrase=phrase).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=key) == sorted(brute(list(zip(ids, texts)), width), key=key)


def test_equals_brute_force(spark):
    a, b = prose(200, 1), prose(200, 2)
    texts = [None, "", "short text", " ".join(a), " ".join(a), " ".join(a[:49]), " ".join(a[20:70]), " ".join(b[:60] + a[100:160] + b[60:120]),
             "\n".join(b[:130]), " ".join(a[:100] + ["cut"] + a[100:]), " ".join(["The"] * 700), " ".join(["The"] * 300), " ".join(prose(5000, 9) + a[:80]),
             " ".join(prose(30, 4) + a[40:90] + prose(30, 5)), " ".join(prose(30, 6) + prose(30, 5) + b[50:115]), " ".join(a[150:] + prose(40, 5))]
    compare(spark, texts, list(range(len(texts))))


def test_a_third_document_that_the_owner_does_not_cover(spark):
    """The owner has the phrase in another setting; the window itself first stands in a later document."""
    core, left, right = prose(12, 1), prose(30, 2), prose(30, 3)
    texts = [" ".join(prose(40, 7) + core + prose(40, 8)), " ".join(left + core + right), " ".join(["x"] + left[5:] + core + right[:20] + ["y"]),
             " ".join(left[10:] + core + right)]
    compare(spark, texts, [0, 1, 2, 3])


def test_random_mixes(spark, monkeypatch):
    monkeypatch.setattr(R, "SALT_BYTES", 400)  # many tasks for one owner
    rng = random.Random(4)
    parts = [prose(rng.randrange(5, 40), k) for k in range(8)]
    texts = [" ".join(w for _ in range(rng.randrange(1, 8)) for w in rng.choice(parts)) for _ in range(40)]
    compare(spark, texts, rng.sample(range(100), 40), width=12, phrase=4)


def test_shared_ids_null_ids_and_empty_table(spark):
    a = " ".join(prose(80, 1))
    compare(spark, [a, a, a, a + " more"], [3, 3, None, 5])
    assert R.dedup_repeats(docs(spark, [a]).where("false")).count() == 0


