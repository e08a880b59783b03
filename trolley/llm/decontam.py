"""Benchmark decontamination: a broadcast set of normalised test n-grams against every text.

Native: DataFrame functions only. A word is a run of ``0-9``, ``a-z`` (after lower-casing
``A-Z`` alone) or any non-ASCII character. A window is ``n`` consecutive words of a benchmark
item; an item with fewer words, but not none, is one window of its own length.

Plan. The distinct windows become one written table. If its measured size is within
``broadcast_bytes`` it is broadcast, otherwise the join is left to shuffles. Each text turns
into one 64-bit hash per word position, of the words that a window leads with; the hashes
meet the distinct leads in a hash join. Where one meets, the window's words are read and hashed, meet
the windows by that hash, and are compared as text, so a hash collision never counts and windows
that open alike cost no more than others. Only true hits and a row per text leave the scan. Without the
broadcast the words are joined where leads meet, as no text may travel with each position.

Defined cases: null and blank texts have no words and no hits; rows that share a doc_id are
judged each by its own text; exactly repeated rows give repeated result rows; repeated
windows count once; benchmark rows with null text or null id give no item; an empty
benchmark or an empty document table gives no hits. Other columns of the input may have any
names: the operator reads only the id and text columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.common import store, text_key

#: What separates words, as a Java class, and a word with what stands before it.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TOKEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BROADCAST_BYTES = 64 << 20
#: Words of a window that its key covers; the rest is compared where keys meet.
LEAD = 4
#: Keys of the rows that carry a text itself through the join; many, so that none is hot.
_MARKERS = 1024


def cased_words(text: Column) -> Column:
    """Words of a text as they are written; none for null. Never null, so no null check repeats the work."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def fold(words: Column) -> Column:
    """Normalised words, joined by spaces: ``A-Z`` lower-cased, nothing else."""
    return F.translate(F.array_join(words, " "), _UPPER, _LOWER)


def _lead_hashes(words: Column, k: int) -> Column:
    """Hash of the ``k`` words that start at each position.

    Full lower case serves for hashing only: it is faster, and equal wherever the normalised words are.
    """
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))) \
        .otherwise(F.array().cast("array<bigint>"))


def _lower(words: Column) -> Column:
    return F.transform(words, lambda w: F.lower(w))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """Rows (key, lead, gram, len, window, item): every window of every item, once per item.

    ``gram`` is the window's normalised words joined by spaces, ``key`` a hash of its first ``lead`` words.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.split(fold(cased_words(F.col(text_col))), " ").alias("words")) \
        .where(F.col("item").isNotNull()).where(F.get("words", F.lit(0)) != "").distinct()
    size = F.least(F.size("words"), F.lit(n))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice(F.col("words"), i, size))
    rows = items.select("item", F.explode_outer(grams).alias("words")).distinct() \
        .select("item", "words", F.array_join("words", " ").alias("gram"), F.size("words").alias("len"), F.least(F.size("words"), F.lit(LEAD)).alias("lead"))
    keys = reduce(lambda other, k: F.when(F.col("lead") == k, F.get(_lead_hashes(_lower(F.col("words")), k), F.lit(0))).otherwise(other),
                  range(1, LEAD + 1), F.lit(None).cast("bigint"))
    return rows.select(keys.alias("key"), "lead", "gram", "len", F.xxhash64("gram").alias("window"), "item")


def find_hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc, tkey, pos, len, window, n_words, copies) for each distinct text of an id.

    One row for each place where a window occurs, and one with ``len`` 0 for the text itself.
    """
    spark = docs.sparkSession
    grams = windows.select("key", "lead", "gram", "len", "window").distinct()
    facts = grams.groupBy("lead").agg(F.sum(F.length("gram") * 2 + 80).alias("b")).collect()  # LEAD rows at most
    leads = sorted(r["lead"] for r in facts)
    whole = grams.select("len", "gram", "window").unionByName(spark.range(1).select(F.lit(0).alias("len"), F.lit("").alias("gram"), F.xxhash64(F.lit("")).alias("window"))).distinct()
    markers = spark.range(_MARKERS).select(F.col("id").alias("key"), F.lit(0).alias("lead"), F.lit(0).alias("len"))
    # a lead that many windows share meets a place once for each length, not once for each window
    heads = grams.select("key", "lead", "len").distinct().unionByName(markers)
    base = docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("tkey"), cased_words(F.col(text_col)).alias("words"))
    lower = base.select("*", _lower(F.col("words")).alias("lower"))
    marker = F.array(F.pmod(F.col("tkey"), F.lit(_MARKERS)))
    hashes = lower.select("doc", "tkey", "words", F.size("words").alias("n_words"),
                          F.concat(marker, *[_lead_hashes(F.col("lower"), k) for k in leads]).alias("hashes"))
    # the array holds the marker, then a run of positions for each length of lead
    count, pos, lead, start = F.col("n_words"), F.lit(0), F.lit(0), F.lit(1)
    for k in leads:
        pos = F.when(F.col("at") >= start, F.col("at") - start).otherwise(pos)
        lead = F.when(F.col("at") >= start, F.lit(k)).otherwise(lead)
        start = start + F.greatest(count - k + 1, F.lit(0))
    meets = (F.col("h") == F.col("key")) & (lead == F.col("lead"))
    small = sum(r["b"] for r in facts) <= broadcast_bytes

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    def read(words: Column, at: Column) -> Column:
        return fold(F.slice(words, at + 1, F.col("len")))

    # outer: the plain form infers a filter on the array that would compute it twice
    if small:
        placed = hashes.select("doc", "tkey", "n_words", "words", F.posexplode_outer("hashes").alias("at", "h"))
        met = placed.join(F.broadcast(heads), meets).select("doc", "tkey", "n_words", pos.alias("pos"), "len", read(F.col("words"), pos).alias("found"))
    else:
        # the words must not travel with every position: meet on hashes, then read where they met
        placed = hashes.select("doc", "tkey", "n_words", F.posexplode_outer("hashes").alias("at", "h"))
        places = placed.join(heads, meets).select("doc", "tkey", "n_words", pos.alias("pos"), "len")
        texts = base.select(F.col("doc").alias("d"), F.col("tkey").alias("k"), "words").dropDuplicates(["d", "k"])
        met = places.join(texts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k"))) \
            .select("doc", "tkey", "n_words", "pos", "len", read(F.col("words"), F.col("pos")).alias("found"))
    known = whole.select(F.col("len").alias("w_len"), "gram", "window")
    hit = met.join(sent(known), (F.xxhash64("found") == F.col("window")) & (F.col("len") == F.col("w_len")) & (F.col("found") == F.col("gram")))
    pos = F.col("pos")
    return hit.select("doc", "tkey", pos.alias("pos"), "len", "window", "n_words").repartition("doc", "tkey") \
        .groupBy("doc", "tkey", "pos", "len").agg(F.first("window").alias("window"), F.first("n_words").alias("n_words"),
                                                  F.count("*").alias("copies"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           bench_text_col: str = "text", n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_hit, items array sorted as strings, spans array of (start, stop))."""
    windows = store(benchmark_windows(benchmark, item_col, bench_text_col, n))
    found = store(find_hits(docs, windows, id_col, text_col, broadcast_bytes))
    hits, texts = found.where("len > 0"), found.where("len = 0")

    stop = F.col("pos") + F.col("len")
    before = Window.partitionBy("doc", "tkey").orderBy("pos", stop).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(stop).over(before), F.lit(0))
    covers = hits.select("doc", "tkey", F.greatest(F.col("pos"), reached).alias("start"), stop.alias("stop")).where("stop > start")
    items = hits.select("doc", "tkey", "window").distinct().join(windows.select("window", "item"), "window") \
        .select("doc", "tkey", "item").distinct()

    none = {"n": "int", "copies": "int", "hit": "int", "span": "struct<start:int,stop:int>", "item": "string"}

    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("doc", "tkey", *[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()])

    rows = part(texts, n=F.col("n_words"), copies=F.col("copies")) \
        .unionByName(part(covers, hit=F.col("stop") - F.col("start"), span=F.struct("start", "stop"))) \
        .unionByName(part(items, item=F.col("item")))
    out = rows.groupBy("doc", "tkey").agg(
        F.max("n").cast("bigint").alias("n_words"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"),
        F.array_sort(F.collect_list("item")).alias("items"), F.array_sort(F.collect_list("span")).alias("spans"),
        F.sum("copies").alias("copies"))
    return out.select(F.col("doc").alias(id_col), F.col("tkey"), "n_words", "n_hit", "items", "spans",
                      F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  remove: str = "documents", n: int = 10) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit words in them.

    Removing spans drops each hit word with the separators before it; everything else of
    the text stays as it was.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = report(docs, benchmark, id_col, text_col, n=n).where("n_hit > 0") \
        .select(F.col(id_col).alias("__doc"), F.col("tkey").alias("__tkey"), F.col("spans").alias("__spans")) \
        .dropDuplicates(["__doc", "__tkey"])
    same = docs[id_col].eqNullSafe(F.col("__doc")) & (text_key(docs[text_col]) == F.col("__tkey"))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(_TOKEN), F.lit(0))
    tail = F.regexp_extract(F.col(text_col), SEPARATORS + "$", 0)
    kept = F.filter(tokens, lambda t, i: ~F.exists(F.col("__spans"), lambda s: (i >= s["start"]) & (i < s["stop"])))
    cleaned = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(kept, ""), tail))
    return docs.join(found, same, "left").select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])
