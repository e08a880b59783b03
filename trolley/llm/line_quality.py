"""Quality rules: cross-document line frequency on top of per-text base rules.

Native: DataFrame functions only.

Base rules, judged inside one row: words, code points in words, symbols, repeated lines and
the words that three-word windows repeat. Windows are compared as 64-bit integers made of a
hash and the position, sorted; neighbours of equal hash are compared word by word.

Method. Each text's lines are normalised (trimmed, lower case, digit runs as ``0``, white
space as one space) and hashed. A line counts once per distinct text of a host (``source``),
so exact copies of one text count once and do not condemn each other. Partial sums run
before the shuffle, so a hot line or host costs no single task. A line is boilerplate of its
host if it is in more than ``max(min_docs, share * texts of the host)`` texts. A text is
depleted, and not kept, if the boilerplate lines hold more than ``depleted`` of its words.

Defined cases: null texts have no words and fail the base rules; a null host is a host of
its own; rows that share a doc_id are judged each by its own text; repeated rows give
repeated result rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import WS_CHARS, WS_CLASS, store, text_key, ws_words

#: Symbol characters of the base rules.
SYMBOLS = r"[#*$%&|<>]"

MIN_DOCS, SHARE, DEPLETED = 10, 0.01, 0.5


def _removed_chars(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _position_mask(words: Column) -> Column:
    """Low bits of a mark that hold a position: enough for this row's longest one; the rest is hash."""
    bits = F.ceil(F.log2(F.size(words).cast("double") + 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1


def _marks(words: Column, low: Column) -> Column:
    """Sorted marks (hash bits, position) of all three-word windows."""
    packed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))
    return F.when(F.size(words) >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def _same_window(words: Column, low: Column, a: Column, b: Column) -> Column:
    i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
    return F.coalesce((a.bitwiseXOR(b) <= low) & (a.bitwiseXOR(b) >= 0)
                      & (F.slice(words, i + 1, 3) == F.slice(words, j + 1, 3)), F.lit(False))


def base_columns(text: Column) -> list[Column]:
    """First step of the base rules: words, lines with a word, and counts read off the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return [ws_words(text).alias("words"),
            F.coalesce(_removed_chars(text, SYMBOLS), F.lit(0)).cast("bigint").alias("n_symbols"),
            F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0)).cast("bigint").alias("n_dup_lines")]


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows (id, tkey, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.col(text_col)
    one = docs.select(F.col(id_col), text_key(text).alias("tkey"), F.col(host_col).alias("host"), *base_columns(text))
    m, w, low = F.col("marks"), F.col("words"), F.col("low")
    two = one.withColumn("low", _position_mask(w)).withColumn("marks", _marks(w, low))
    # sorted, equal hashes stand together: keep those with an equal neighbour, then compare the words of these few
    alike = two.withColumn("alike", F.filter(m, lambda x, i: (x.bitwiseOR(low) == F.coalesce(F.get(m, i + 1).bitwiseOR(low), F.lit(0)))
                                             | (x.bitwiseOR(low) == F.coalesce(F.get(m, i - 1).bitwiseOR(low), F.lit(0)))))
    c = F.col("alike")
    hit = F.filter(c, lambda x, i: _same_window(w, low, x, F.get(c, i - 1)) | _same_window(w, low, x, F.get(c, i + 1)))
    three = alike.withColumn("at", F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(low).cast("int"))))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))).cast("bigint")),
                          F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    out = three.select(id_col, "tkey", "host", F.size("words").cast("bigint").alias("n_words"),
                       F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
                       "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_hash(line: Column) -> Column:
    """Hash of a normalised line: trimmed, lower case, digit runs as 0, white space as one space."""
    norm = F.regexp_replace(F.lower(F.btrim(line, F.lit(WS_CHARS))), r"[0-9]+", "0")
    return F.xxhash64(F.regexp_replace(norm, WS_CLASS + r"{2,}|[\x09-\x0D]", " "))


def host_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rows (host, tkey, line, words): a normalised line's hash and the words it has in a text, per row of the table."""
    raw = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    pair = F.transform(raw, lambda s: F.struct(line_hash(s).alias("line"),
                                               (F.regexp_count(F.btrim(s, F.lit(WS_CHARS)), F.lit(WS_CLASS + "+")) + 1).alias("words")))
    return docs.select(F.col(host_col).alias("host"), text_key(F.col(text_col)).alias("tkey"), F.explode_outer(pair).alias("l")) \
        .select("host", "tkey", F.col("l.line").alias("line"), F.col("l.words").alias("words")).where("line is not null")


def boilerplate_words(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS,
                      share: float = SHARE) -> DataFrame:
    """Rows (host, tkey, boiler_words): words of boilerplate lines in each distinct text of a host that has any."""
    lines = store(host_lines(docs, text_col, host_col).groupBy("host", "tkey", "line")
                  .agg(F.sum("words").alias("all_words"), F.count("*").alias("times")))
    copies = docs.groupBy(F.col(host_col).alias("host"), text_key(F.col(text_col)).alias("tkey")).agg(F.count("*").alias("copies"))
    texts = copies.groupBy("host").agg(F.count("*").alias("texts"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("in_texts")).where(F.col("in_texts") > min_docs)
    limit = F.greatest(F.lit(float(min_docs)), F.col("texts") * share)
    frequent = counts.alias("c").join(texts.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("in_texts") > limit) \
        .select(F.col("c.host").alias("f_host"), F.col("c.line").alias("f_line"))
    hit = lines.join(frequent, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")))
    # all_words counts every copy of the text; back to one
    sums = hit.groupBy("host", "tkey").agg(F.sum("all_words").alias("w"), F.collect_list("line").alias("boiler_lines"))
    return sums.alias("s").join(copies.alias("k"), (F.col("s.tkey") == F.col("k.tkey")) & F.col("s.host").eqNullSafe(F.col("k.host"))) \
        .select(F.col("s.host").alias("host"), F.col("s.tkey").alias("tkey"), (F.col("w") / F.col("copies")).alias("boiler_words"), "boiler_lines")


def strip_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS,
                      share: float = SHARE) -> DataFrame:
    """``docs`` with the boilerplate lines of each host taken out of the text; all else as it was."""
    found = boilerplate_words(docs, text_col, host_col, min_docs, share).select(
        F.col("host").alias("__host"), F.col("tkey").alias("__tkey"), F.col("boiler_lines").alias("__lines"))
    text = F.col(text_col)
    left = F.filter(F.split(text, "\n"), lambda s: ~s.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains(F.col("__lines"), line_hash(s)))
    cleaned = F.when(F.col("__lines").isNull(), text).otherwise(F.array_join(left, "\n"))
    return docs.join(found, (text_key(docs[text_col]) == F.col("__tkey")) & docs[host_col].eqNullSafe(F.col("__host")), "left") \
        .select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """Base rules and the line-frequency verdict: one row per input row, with ``boiler_words`` and ``kept``."""
    base = base_rules(docs, id_col, text_col, host_col)
    boiler = boilerplate_words(docs, text_col, host_col, min_docs, share) \
        .select(F.col("host").alias("b_host"), F.col("tkey").alias("b_tkey"), "boiler_words")
    out = base.join(boiler, (F.col("tkey") == F.col("b_tkey")) & F.col("host").eqNullSafe(F.col("b_host")), "left") \
        .withColumn("boiler_words", F.coalesce("boiler_words", F.lit(0.0)).cast("bigint"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("boiler_words") <= depleted * F.col("n_words"))) \
        .drop("b_host", "b_tkey", "tkey", "host")
