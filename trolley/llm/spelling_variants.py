"""Spelling variants of a corpus' words by reduced alphabets.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Their
letters are hashed to a few symbols: words that are near have reduced words at most one
edit apart, equal ones included.

Plan.
1. Words are counted with partial sums before the shuffle; rare and short ones go.
2. Equal reduced words make a bucket. Each distinct reduced word generates its one-edit
   neighbourhood over the symbols as hashed keys, and the keys meet the buckets. A pair of reduced words
   is generated once, from the longer one by a deletion or from the smaller symbol by a replacement,
   which together are all insertions, deletions and replacements.
3. Words of linked buckets are compared as they are written: the edit distance must be one.
4. A link whose buckets would make more than ``hot`` pairs is not expanded. The words of such links
   are reduced again by the next, larger alphabet; in the last alphabet every letter is a
   symbol of its own, so a bucket is one word. A pair is compared in the first alphabet
   in which its link is not hot, hence once, and none is lost.
5. A word's form is its most frequent near word, if that is at least twice as frequent. Forms grow in
   frequency, so following them ends; roots come from pointer jumping over written tables.

Rows are linear in the words times the neighbourhood (some 50 keys of a ten-letter word in the first
alphabet). No group is collected; a bucket is a count.

Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows
are counted as often as they occur; words without near words keep themselves as root; an empty
table gives an empty result. Other columns may have any names: only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import store
from trolley.session import release

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The letters of a word: ``a-z`` and the code points C0 to FF.
LETTERS = _LOWER + "".join(chr(c) for c in range(0xC0, 0x100))
_GAP = "[^a-zÀ-ÿ]+"
#: Symbols of the alphabets, one after the other; the last one keeps all letters apart.
ALPHABETS = (8, 32, len(LETTERS))
HOT = 4096


def alphabet(size: int) -> tuple[str, str]:
    """(symbol of each letter of ``LETTERS``, all symbols in order)."""
    if size >= len(LETTERS):
        return LETTERS, LETTERS
    symbols = "".join(chr(48 + k) for k in range(size))
    return "".join(symbols[zlib.crc32(c.encode()) % size] for c in LETTERS), symbols


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, run): every maximal run of letters, ``A-Z`` lower-cased."""
    parts = F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), _GAP)
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(parts).alias("run")).where("run != ''")


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """Rows (word, n) of the frequent words of (word)."""
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def neighbourhood(word: Column, symbols: str) -> Column:
    """Keys of a reduced word and of those of its one-edit neighbours that are shorter, or greater at the place that differs."""
    places, every = F.sequence(F.lit(1), F.length(word)), F.array(*[F.lit(s) for s in symbols])
    key = F.xxhash64
    shorter = F.array_distinct(F.transform(places, lambda p: key(F.concat(F.substr(word, F.lit(1), p - 1), F.substr(word, p + 1)))))
    greater = F.transform(places, lambda p: F.transform(F.filter(every, lambda s: s > F.substr(word, p, F.lit(1))),
                                                        lambda s: key(F.concat(F.substr(word, F.lit(1), p - 1), s, F.substr(word, p + 1)))))
    return F.concat(F.array(key(word)), shorter, F.flatten(greater))


def near_pairs(vocab: DataFrame, hot: int = HOT, alphabets: tuple[int, ...] = ALPHABETS) -> DataFrame:
    """Rows (word, n, near, near_n): every pair of near words of (word, n), once."""
    if alphabets[-1] < len(LETTERS):
        raise ValueError("the last alphabet must keep all letters apart")
    hot = max(1, hot)  # a pair of single words is never hot
    words, found, written = vocab.select("word", "n", F.array().cast("array<bigint>").alias("sizes")), [], []
    for size in alphabets:
        table, symbols = alphabet(size)
        reduced = F.translate("word", LETTERS, table)
        buckets = store(words.groupBy(reduced.alias("reduced")).agg(F.count("*").alias("c")).withColumn("r", F.xxhash64("reduced")))
        keys = buckets.select(F.col("r").alias("r1"), F.col("c").alias("c1"), F.explode(neighbourhood(F.col("reduced"), symbols)).alias("r2"))
        links = keys.join(buckets.select(F.col("r").alias("r2"), F.col("c").alias("c2")), "r2")
        may_be_hot = (buckets.agg(F.max("c").alias("m")).first()["m"] or 0) ** 2 > hot
        if may_be_hot:
            links = store(links)
            written.append(links)
        placed = words.select("word", "n", "sizes", F.xxhash64(reduced).alias("r"))
        left = placed.select(F.col("r").alias("r1"), "word", "n", "sizes")
        right = placed.select(F.col("r").alias("r2"), F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("sizes").alias("near_sizes"))
        met = links.where(F.col("c1") * F.col("c2") <= hot).select("r1", "r2").join(left, "r1").join(right, "r2") \
            .where((F.col("r1") != F.col("r2")) | (F.col("word") < F.col("near")))
        # pairs that an earlier alphabet has compared are not compared again
        fresh = F.forall(F.zip_with("sizes", "near_sizes", lambda x, y: x * y > hot), lambda x: x)
        found.append(met.where(fresh & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n"))
        written.append(buckets)
        if not may_be_hot:
            break
        over = links.where(F.col("c1") * F.col("c2") > hot)
        hot_buckets = over.select(F.col("r1").alias("r"), F.col("c1").alias("c")).union(over.select("r2", "c2")).distinct()
        words = store(placed.join(hot_buckets, "r").select("word", "n", F.array_append("sizes", F.col("c")).alias("sizes")))
        written.append(words)
    out = store(reduce(DataFrame.unionByName, found))
    for t in written:
        release(t)
    return out


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Rows (word, root): the last word that each word of (word, form) leads to."""
    now = store(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        up = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = store(now.join(up, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count()
        release(now)
        now = step.select("word", "root")
        now._trolley_table = step._trolley_table
        if not moved:
            return now
    raise RuntimeError("forms did not settle")


def variants(words: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, hot: int = HOT, alphabets: tuple[int, ...] = ALPHABETS) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): one per frequent word of (word)."""
    vocab = store(vocabulary(words, least_length, least_count))
    pairs = near_pairs(vocab, hot, alphabets)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")) \
        .select(F.col("word").alias("w"), "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    leads = F.col("near_n") >= ratio * F.col("n")
    judged = store(vocab.join(near, vocab["word"] == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(leads, F.col("near")).alias("form"), F.when(leads, F.col("near_n")).alias("form_n")))
    last = roots(judged.where("form IS NOT NULL")).select(F.col("word").alias("w"), "root")
    for t in (vocab, pairs):
        release(t)
    return judged.join(last, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
