"""Small tables of awkward rows for the training-data operators."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tkey string, words string, doc string"


def docs(spark, texts, ids=None, **columns):
    """Documents with columns whose names the operators use inside."""
    ids = list(ids) if ids is not None else list(range(len(texts)))
    rows = [(i, t, columns.get("lang", [None] * len(texts))[k], columns.get("source", ["s"] * len(texts))[k],
             None if t is None else len(t), "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed=0, vocabulary=400):
    """Words that look random; equal seeds give equal texts."""
    out, x = [], seed * 7919 + 12345
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("w" + "".join(chr(97 + int(c)) for c in str(x // 65536 % vocabulary)))
    return out
