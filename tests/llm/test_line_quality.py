import re
from collections import Counter

from helpers import docs, prose

from trolley.llm import line_quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    rep = {p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))


def test_base_rules_equal_brute_force(spark):
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x\nx\n\nx", "# a|b <c> *", "é ñ 日本語", " ".join(prose(60, 3)),
             " ".join(prose(60, 3) * 3), "w " * 3000, "\n".join(["same line here"] * 30), " ".join(prose(20_000, 4, 50)), "a\x0bb\x0cc\rd"]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
           for r in line_quality.base_rules(docs(spark, texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_frequent_lines_deplete_only_beyond_the_limit(spark):
    boiler = "Click 7 here to accept  all of the cookies"
    texts = [f"{boiler}\n" + " ".join(prose(80, k)) for k in range(14)] + [(boiler.replace("7", "12").upper() + "\n") * 12 + " ".join(prose(20, 99))]
    rows = line_quality.line_rules(docs(spark, texts + ["other " + texts[0]], source=["h"] * 15 + [None])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["boiler_words"] for i in range(15)] == [9] * 14 + [108] and by[15]["boiler_words"] == 0
    assert all(by[i]["kept"] for i in range(14)) and not by[14]["kept"]


def test_copies_of_one_text_do_not_condemn_each_other(spark):
    text = "\n".join(" ".join(prose(30, k)) for k in range(3))
    rows = line_quality.line_rules(docs(spark, [text] * 40)).collect()
    assert len(rows) == 40 and all(r["kept"] and r["boiler_words"] == 0 for r in rows)


def test_strip_boilerplate_and_empty_table(spark):
    texts = [f"Read more\n{' '.join(prose(60, k))}\n" for k in range(12)]
    table = docs(spark, [*texts, None], source=["h"] * 13)
    left = {r["doc_id"]: r["text"] for r in line_quality.strip_boilerplate(table).collect()}
    assert left == {**{k: " ".join(prose(60, k)) + "\n" for k in range(12)}, 12: None}
    assert line_quality.line_rules(table.where("false")).count() == 0
