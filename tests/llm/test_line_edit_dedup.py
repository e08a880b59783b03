import re

from helpers import docs, prose

from trolley.llm import line_edit_dedup


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(" \t\n\x0b\x0c\r").lower())


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(texts):
    lines = [(d, p, norm(x).split(" ")) for d, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n")) if len(norm(x).split(" ")) >= 5]
    gone = {(d, p) for k, (d, p, w) in enumerate(lines) if any(one_apart(w, v) for _, _, v in lines[:k])}
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in enumerate(texts)]


def cases():
    a, b = prose(12, 1), prose(5, 2)
    swap = a[:4] + ["new"] + a[5:]
    return [None, "", "\n\n", " ".join(a), " ".join(a).upper() + "\nshort line", "\t".join(swap), " ".join(a[1:]), " ".join(a + ["tail"]),
            " ".join(a[:3] + ["in"] + a[3:]), " ".join(a[:2] + ["x", "y"] + a[4:]), " ".join(b), " ".join(b[:4]), " ".join(b[1:]), " ".join(b[:4] + ["q"]),
            " ".join(["la"] * 9) + "\n" + " ".join(["la"] * 10), " ".join(["la"] * 8), " ".join(prose(3000, 3)), " ".join(prose(3000, 3)[:-1]),
            "a b c d e\nb a c d e", "one two three four five\nsix one two three four five", "un deux trois quatre cinq\n\n  UN deux trois  quatre cinq "]


def test_dedup_equals_brute_force(spark):
    texts = cases()
    out = line_edit_dedup.dedup_lines(docs(spark, texts))
    assert out.columns == docs(spark, texts).columns + ["n_lines", "n_removed"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == dict(enumerate(brute(texts)))


def test_many_random_edits(spark):
    texts = []
    for k in range(60):
        w = prose(7, k % 6, 50)
        j = k % 7
        texts.append(" ".join([w[:j] + ["e%d" % (k % 4)] + w[j + 1:], w[:j] + w[j + 1:], w[:j] + ["i"] + w[j:], w][k % 4]))
    got = {r["doc_id"]: r["text"] for r in line_edit_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_repeated_rows_null_ids_and_empty_table(spark):
    line = " ".join(prose(9, 8))
    table = docs(spark, [line, line, "else", line], [4, 4, 4, None])
    got = sorted((r["doc_id"] or -1, r["text"]) for r in line_edit_dedup.dedup_lines(table).collect())
    assert got == [(-1, line), (4, ""), (4, ""), (4, "else")]  # the null id comes first
    assert line_edit_dedup.dedup_lines(table.where("false")).count() == 0


def test_short_lines_are_judged_by_equality_in_the_pipeline(spark):
    import corpus_pipeline
    long = " ".join(prose(12, 1))
    texts = [f"Home\n\n{long}", f"{long} tail\n  HOME\nRead more now\n\nkept here", "read  more now\nread more then\nHome page\n日本語日本語日本語。", "日本語日本語日本語。\nalso mine", "home"]
    want = [texts[0], "Read more now\n\nkept here", "read more then\nHome page\n日本語日本語日本語。", "also mine"]
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs(spark, texts), "").collect()} == dict(enumerate(want))
    got = {r["doc_id"]: r["text"] for r in line_edit_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute(texts)))  # the query's SQL leaves them


def test_texts_do_not_move_once_they_are_placed(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = line_edit_dedup.dedup_lines(docs(spark, cases()))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 1  # the places of the lines that go


def test_null_and_empty_ids_are_two(spark):
    line = " ".join(prose(9, 8))
    table = spark.createDataFrame([("", line), (None, line), ("a", line + "\nkept")], "doc_id string, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_edit_dedup.dedup_lines(table).collect()}
    assert got == {None: (line, 1, 0), "": ("", 1, 1), "a": ("kept", 2, 1)}
