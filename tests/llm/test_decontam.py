import re

from helpers import docs, prose

from trolley.llm import decontam


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, n=10):
    grams = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            k = min(n, len(w))
            for i in range(len(w) - k + 1):
                grams.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                got = grams.get(tuple(w[i:i + k]))
                if got:
                    hit.update(range(i, i + k))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


def cases():
    base = prose(40, 1)
    items = [(1, " ".join(base[:25])), (2, " ".join(base[20:32])), (3, "Kurz, nur drei"), (10, "uno"), (4, None), (5, "..."), (None, "never seen words here"),
             (1, " ".join(base[:25])), (7, "ÉTÉ Été")]
    long = prose(6000, 5)
    texts = [None, "", "  \n", " ".join(base), "x " + " ".join(base[3:14]).upper().replace(" ", ", ") + " y", "kurz nur drei. KURZ nur",
             "uno dos Uno", "ÉTé été ÉtÉ", " ".join(long + base[:12] + long), " ".join(base[:9]), "été Été", "ÉTÉ Été!", " ".join(base[:12] + base[:12]), "Kurz-nur-drei"]
    return texts, items


def test_report_equals_brute_force_in_both_plans(spark):
    texts, items = cases()
    table = docs(spark, texts + [texts[3]], list(range(len(texts))) + [3])  # a repeated row
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((i, *map(str, r)) for i, r in zip([*range(len(texts)), 3], brute(texts + [texts[3]], items)))
    for limit in (decontam.BROADCAST_BYTES, 0):
        got = decontam.report(table, bench, broadcast_bytes=limit).select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted((r[0], str(r[1]), str(r[2]), str(r[3])) for r in got) == want


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    texts, items = cases()
    got = decontam.report(docs(spark, [texts[3], "clean text"], [1, 1]), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(r["n_hit"] > 0 for r in got) == [False, True]


def test_decontaminate_removes_documents_or_spans(spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    table = docs(spark, ["a, One two\tTHREE four. b", "one two three", None], [5, 6, None])
    left = decontam.decontaminate(table, items)
    assert left.columns == table.columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 6]
    spans = {r["doc_id"]: r["text"] for r in decontam.decontaminate(table, items, remove="spans").collect()}
    assert spans == {5: "a. b", 6: "one two three", None: None}


def test_empty_tables(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontam.report(docs(spark, texts).where("false"), bench).count() == 0
    got = decontam.report(docs(spark, texts), bench.where("false")).collect()
    assert len(got) == len(texts) and all(r["n_hit"] == 0 for r in got)


def test_windows_that_open_alike(spark):
    opening = "which of the following is".split()
    items = [(k, " ".join(opening + prose(7, 900 + k))) for k in range(80)] + [(100 + k, " ".join(opening + prose(2, 50 + k))) for k in range(9)]
    texts = [" ".join(prose(30, k) + items[k][1].split() + prose(9, k) + opening) for k in range(0, 80, 7)] + [" ".join((opening + prose(5, 3)) * 20), " ".join(opening)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(i, *map(str, r)) for i, r in enumerate(brute(texts, items))]
    for limit in (decontam.BROADCAST_BYTES, 0):
        got = decontam.report(docs(spark, texts), bench, broadcast_bytes=limit).select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted((r[0], *map(str, r[1:])) for r in got) == want
