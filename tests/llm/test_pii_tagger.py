import hashlib
import re
import time

import numpy as np
import pytest
from helpers import docs, prose
from pyspark.sql import functions as F

from trolley.llm import pii_tagger as P
from trolley.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.1"


def brute(text):
    """The rules as their patterns say, with the library's own search."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m.group())) <= 19 and P.luhn(m.group()):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def sample(spark, where):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.col("text").rlike("[0-9@]")).where(where).select("text").collect()
    return [r["text"] for r in rows]


AWKWARD = ["", "a@b", "a@b.c", "x.y@z.w.v@q.r", "@@a@b.co@c.d", "a@b.c@d.e f@g.h", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.2.3.4.5", "001.02.3.0004", "1..2.3.4.5",
           "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "12 4111111111111111", "+1 (826) 555-4081 190.137.223.204", "+1 (826) 555-4081",
           "+49.30.1234567 +1", "++12345678901", "+1 2", "é😀 +1 (826) 555-4081 é a@b.cd", "0" * 40, "0000 0000 0000 00", "a" * 50 + "@" + "b.c" * 20, "+12 3456 7890 () ()"]


@pytest.mark.parametrize("text", AWKWARD)
def test_rules_equal_their_patterns(text):
    assert P.rule_spans(text) == brute(text)


def test_rules_on_whole_documents(spark):
    texts = sample(spark, "true")
    assert [P.rule_spans(t) for t in texts] == [brute(t) for t in texts]


def test_rules_are_linear_in_long_texts():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 400_000, "a@" * 200_000, "+1 " * 130_000, "9 " * 200_000, "1.2.3.4 " * 40_000):
        began = time.time()
        P.rule_spans(text)
        assert time.time() - began < 8


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(0, P.N_SHAPES, (3, P.WIDTH)).astype(np.uint8), np.zeros((3, P.WIDTH), np.uint8)
    tags[:, 20:40] = 2
    tags[:, 20] = 1
    p = P.train(codes, tags, epochs=1)
    _, grads = P.loss_and_gradients(p, codes, tags)
    for k in p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), p[k].shape)
        sides = []
        for move in (1e-2, -1e-2):
            q = {**p, k: p[k].copy()}
            q[k][at] += move
            sides.append(P.loss_and_gradients(q, codes, tags)[0])
        assert grads[k][at] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=0.05)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    k, width = P.N_TAGS, 4
    p, e = {"a": rng.normal(size=(k, k)).astype(np.float32)}, rng.normal(size=(2, width, k)).astype(np.float32)
    grid = np.stack(np.meshgrid(*[np.arange(k)] * width, indexing="ij"), -1).reshape(-1, width)
    for n in range(2):
        total = sum(e[n, t, grid[:, t]] for t in range(width)) + sum(p["a"][grid[:, t], grid[:, t + 1]] for t in range(width - 1))
        assert P.viterbi(p, e)[n].tolist() == grid[total.argmax()].tolist()


def test_reconcile_equals_all_subsets():
    rng = np.random.default_rng(4)
    for _ in range(50):
        found = [("ip", int(a), int(a + n), float(s)) for a, n, s in zip(rng.integers(0, 20, 8), rng.integers(1, 8, 8), rng.integers(1, 9, 8))]
        found = list({f[:3]: f for f in found}.values())
        best = 0.0
        for bits in range(1 << len(found)):
            chosen = sorted((f for k, f in enumerate(found) if bits >> k & 1), key=lambda f: f[1])
            if all(a[2] <= b[1] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(f[3] for f in chosen))
        kept = P.reconcile(found)
        scores = {f[:3]: f[3] for f in found}
        assert sum(scores[s] for s in kept) == best and all(a[2] <= b[1] for a, b in zip(kept, kept[1:]))


@pytest.fixture(scope="module")
def model(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 2 = 0")
    return P.fit(table)


def test_held_out_spans_are_tagged_without_the_rules(spark, model):
    texts = sample(spark, "doc_id % 2 = 1")
    found = [set(x) for x in P.tag_texts(model, texts, [[] for _ in texts])]
    true = [set(P.rule_spans(t)) for t in texts]
    hit, all_true, all_found = (sum(map(len, x)) for x in ([a & b for a, b in zip(found, true)], true, found))
    assert all_true > 200 and hit / all_true > 0.95 and hit / all_found > 0.95


def test_forms_beyond_the_rules(model):
    lead = " ".join(prose(30))
    text = f"{lead} call (487) 555-7209 or {lead} +1 (826) 555-4081 190.137.223.204 and {lead}"
    base = P.rule_spans(text)
    assert [k for k, _, _ in base] == ["ip"]
    added = P.tag_texts(model, [text], [base])[0]
    assert "(487) 555-7209" in [text[a:b] for _, a, b in added] and all(not (a < t and s < b) for _, a, b in added for _, s, t in base)
    assert P.tag_texts(None, [text], [base]) == [[]]


def test_find_and_mask(spark, model):
    long = " ".join(prose(30_000)) + " a@b.org"
    texts = ["mail a.b@c.org now", None, "", "no personal data in here", long, "1.2.3.4 and 1.2.3.4", "x" * 300]
    table = docs(spark, texts, ids=[1, 2, None, 4, 5, 1, 7]).withColumn("spans", F.lit(1)).withColumn("base", F.lit(2))
    found = P.find(table, model)
    assert found.columns == ["doc_id", "text", "base", "spans"]
    rows = {r["text"]: r for r in found.collect()}
    assert [tuple(s) for s in rows["mail a.b@c.org now"]["base"]] == [("email", 5, 14)] and rows[None]["spans"] == [] and rows[""]["base"] == []
    assert [tuple(s) for s in rows[long]["spans"]] == [("email", len(long) - 7, len(long))]
    hidden = {r["text"] for r in P.masked(found).collect()}
    assert {"mail [email] now", None, "", "[ip] and [ip]", long[:-7] + "[email]"} <= hidden
    assert P.find(table.where("false"), model).count() == 0 and P.fit(table.where("false")) is None


def test_query_equals_the_rules(spark, tmp_path):
    texts = [*AWKWARD, None, "mail a.b@c.org now 1.2.3.4 +1 (826) 555-4081 4111111111111111"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op11_pii"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        spans = brute(t or "")
        assert [got[k][f"n_{x}"] for x in P.KINDS] == [sum(s[0] == x for s in spans) for x in P.KINDS]
        said = ",".join(":".join(map(str, s)) for s in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(got[k]["spans"].split(","))
