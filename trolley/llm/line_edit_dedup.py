"""Line dedup by a deletion-neighbourhood join.

Native: DataFrame functions only. A line is a ``\\n``-separated part of a text, lower-cased,
trimmed, white space as one space. Two lines are close if one becomes the other by at most
one word inserted, deleted or replaced; with at least ``min_words`` (5) words that is a
similarity of 0.8 or more (longer lines that are so similar by more edits are not close). Shorter
lines are judged only with ``short``, and then by equality. A line goes if an earlier line of
the input (by document id, then place) is close to it, whether or not that one goes as well.

Plan.
0. The documents are written once, bucketed by id and text hash: the two joins that read their texts
   (4 and 5) take them as they lie, so texts move once at any size.
1. One scan makes a row (hash, id, place) per line, and distinct lines keep the earliest place.
2. Two lines one word apart share their first or their last half (of the shorter one's words).
   Half hashes held by a single distinct line drop out; only lines with a shared half go on.
3. Those emit every variant with one word deleted, as hashed keys that also hold the length.
   Keys are polynomial word hashes, so a line of m words costs O(m). Equal variants with the
   deletion at the same place are a replacement; a variant equal to a whole line is an
   insertion or deletion. Each key passes on its earliest line: rows stay linear in the
   variants, a group never emits its pairs, and partial minima run before the shuffle.
4. The edit distance to the winning earlier line is verified on the words themselves.
5. Every place with an earlier close line is removed and the texts are rebuilt.

Defined cases: null texts have no lines and stay null; empty lines stay, and without ``short``
lines under ``min_words``; rows that share a doc_id are ordered by a hash of their text, exactly
repeated rows are one document and treated alike; null ids come first; an empty table gives
an empty result. Columns other than id and text are passed through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.common import WS_CHARS, WS_CLASS, store, text_key
from trolley.operators.ranking import dense_ids
from trolley.session import materialize_bucketed, release, shuffle_partitions

MIN_WORDS = 5
#: Two primes below 2^31 and the bases of the polynomial hashes.
_HASHES = ((2147483647, 1000003), (2147483629, 998244353))


def norm_lines(text: Column) -> Column:
    """Normalised lines of a text; one step after the other, so that no step is computed twice."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.lower(F.btrim(x, F.lit(WS_CHARS))))
    return F.transform(trimmed, lambda x: F.when(x.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(x, WS_CLASS + "+", " ")).otherwise(x))


def _n_words(norm: Column) -> Column:
    """Words of a normalised line that is not empty."""
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def _row(doc: Column, tkey: Column) -> Column:
    """One key, never null, of a document id and the hash of a text."""
    return F.concat_ws(":", tkey.cast("string"), doc.cast("string"))  # a null id has no colon


def _placed(docs: DataFrame, id_col: str, text_col: str, others: dict[str, str]) -> DataFrame:
    """Rows (row, doc, tkey, text) and ``others`` (column of ``docs``: its name here), written once, bucketed by ``row``."""
    tkey = text_key(F.col(text_col))
    rows = docs.select(_row(F.col(id_col), tkey).alias("row"), F.col(id_col).alias("doc"), tkey.alias("tkey"), F.col(text_col).alias("text"),
                       *[F.col(c).alias(name) for c, name in others.items()])
    return materialize_bucketed(rows, shuffle_partitions(docs.sparkSession), "row")


def _lines(rows: DataFrame, short: bool) -> DataFrame:
    """Rows (doc, tkey, place, norm, m): every line that is judged."""
    parts = rows.select("doc", "tkey", F.posexplode_outer(norm_lines(F.col("text"))).alias("place", "norm"))
    return parts.withColumn("m", _n_words(F.col("norm"))).where((F.col("norm") != "") & (F.col("m") >= (1 if short else MIN_WORDS)))


def _ids(norm: Column) -> list[Column]:
    """96 bits that identify a line's words."""
    return [F.xxhash64(norm).alias("h1"), F.hash(norm).alias("h2")]


def _half_keys(norm: Column, m: Column) -> Column:
    """Hashes of the leading and trailing halves, for itself as the shorter or the longer line of a pair; none of a short line."""
    p, q = F.floor(m / 2).cast("int"), F.floor((m - 1) / 2).cast("int")

    def ends(n: Column) -> list[Column]:
        return [F.xxhash64(F.lit(side), n, F.call_function("substring_index", norm, F.lit(" "), n * side)) for side in (1, -1)]

    return F.when(m < MIN_WORDS, F.array().cast("array<bigint>")).when(p == q, F.array(*ends(p))).otherwise(F.array(*ends(p), *ends(q)))


def _deletions(words: Column, prime: int, base: int) -> Column:
    """Polynomial hash of the whole line (``whole``) and of the line without word i (``rest[i]``)."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    # a: sum of h_j base^j; b: the same with each word one place earlier
    start = F.struct(one.alias("pow"), zero.alias("lag"), zero.alias("a"), zero.alias("b"), F.array().cast("array<bigint>").alias("d"))

    def step(acc: Column, word: Column) -> Column:
        h = F.pmod(F.xxhash64(word), F.lit(prime))
        b = (acc["b"] + h * acc["lag"]) % prime
        return F.struct((acc["pow"] * base % prime).alias("pow"), acc["pow"].alias("lag"), ((acc["a"] + h * acc["pow"]) % prime).alias("a"),
                        b.alias("b"), F.array_append(acc["d"], acc["a"] - b).alias("d"))

    return F.aggregate(words, start, step, lambda acc: F.struct(
        acc["a"].alias("whole"), F.transform(acc["d"], lambda x: F.pmod(x + acc["b"], F.lit(prime))).alias("rest")))


def _pack(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 31).bitwiseOR(low)


def _close(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one word apart."""
    m, n = F.size(a), F.size(b)
    short = F.least(m, n)
    steps = F.sequence(F.lit(0), short)
    # the first place, from either end, where the words differ (or the shorter one ends)
    lead = F.get(F.filter(steps, lambda i: (i == short) | (F.get(a, i) != F.get(b, i))), F.lit(0))
    trail = F.get(F.filter(steps, lambda i: (i == short) | (F.get(a, m - 1 - i) != F.get(b, n - 1 - i))), F.lit(0))
    return (F.abs(m - n) <= 1) & (lead + trail >= F.greatest(m, n) - 1)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """Rows (doc, tkey, places): the places of the lines that go, for each distinct text of an id that loses any."""
    rows = _placed(docs, id_col, text_col, {})
    out = _removed(rows, short)
    release(rows)
    return out


def _removed(rows: DataFrame, short: bool) -> DataFrame:
    place = F.struct("doc", "tkey", "place")
    seen = store(_lines(rows, short).select(*_ids(F.col("norm")), "doc", "tkey", "place", _half_keys(F.col("norm"), F.col("m")).alias("halves")))
    distinct = store(seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("halves").alias("halves")))

    halves = distinct.select("h1", "h2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x != y").select("half")
    near = halves.join(shared, "half").select("h1", "h2").distinct().join(distinct.select("h1", "h2", "first"), ["h1", "h2"])
    # the earliest places in order, as single numbers: light keys for all that follows
    numbered = store(dense_ids(near.select("h1", "h2", "first.*"), [F.col(c) for c in ("doc", "tkey", "place")], "no"))

    chosen = numbered.groupBy(_row(F.col("doc"), F.col("tkey")).alias("row")).agg(F.collect_list(F.struct("place", "no")).alias("at"))
    met = rows.select("row", "text").join(chosen, "row").select("at", norm_lines(F.col("text")).alias("lines"))
    worded = store(met.select(F.explode_outer(F.transform("at", lambda x: F.struct(x["no"].alias("no"), F.get("lines", x["place"]).alias("line")))).alias("c"))
                   .select("c.no", F.split("c.line", " ").alias("words")))

    (p1, b1), (p2, b2) = _HASHES
    hashed = worded.select("no", F.size("words").alias("m"), _deletions(F.col("words"), p1, b1).alias("x"), _deletions(F.col("words"), p2, b2).alias("y"))
    whole = F.array(F.struct(F.lit(-1).alias("gap"), F.xxhash64("m", _pack(F.col("x.whole"), F.col("y.whole"))).alias("key")))
    gone = F.transform(F.col("x.rest"), lambda h, i: F.struct(i.alias("gap"), F.xxhash64(F.col("m") - 1, _pack(h, F.get(F.col("y.rest"), i))).alias("key")))
    # one word twice in a row makes the same variant twice, at two gaps: both stand, as each is a place of its own
    variants = store(hashed.select("no", F.explode_outer(F.concat(whole, gone)).alias("v")).select("no", "v.gap", "v.key"))
    several = variants.groupBy("key").agg(F.min("no").alias("x"), F.max("no").alias("y")).where("x < y").select("key")
    common = store(variants.join(several, "key"))
    release(variants)

    # earliest line of each key: as a whole line, with a deletion anywhere, and with a deletion at one place
    at_gap = common.groupBy("key", "gap").agg(F.min("no").alias("best"))
    kinds = at_gap.groupBy("key").agg(F.min(F.when(F.col("gap") < 0, F.col("best"))).alias("as_whole"),
                                      F.min(F.when(F.col("gap") >= 0, F.col("best"))).alias("as_rest"))
    replaced = common.where("gap >= 0").join(at_gap, ["key", "gap"]).select("no", "best")
    other = F.when(F.col("gap") < 0, F.col("as_rest")).otherwise(F.col("as_whole"))
    resized = common.join(kinds, "key").select("no", other.alias("best"))
    partner = replaced.unionByName(resized).where("best < no").groupBy("no").agg(F.min("best").alias("best"))

    mine = worded.select(F.col("no").alias("f"), F.col("words").alias("w"))
    theirs = worded.select(F.col("no").alias("g"), F.col("words").alias("u"))
    checked = partner.join(mine, F.col("no") == F.col("f")).join(theirs, F.col("best") == F.col("g")).where(_close(F.col("w"), F.col("u"))) \
        .groupBy("no").agg(F.min("best").alias("best"))

    where = numbered.select(F.col("no").alias("best"), place.alias("early"))
    sooner = numbered.select("no", "h1", "h2").join(checked, "no").join(where, "best").select("h1", "h2", "early")
    earliest = distinct.select("h1", "h2", "first").join(sooner, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("early", "first").alias("earliest"))
    gone_rows = seen.select("h1", "h2", "doc", "tkey", "place").join(earliest, ["h1", "h2"]).where(F.col("earliest") < place)
    out = store(gone_rows.groupBy("doc", "tkey").agg(F.collect_set("place").alias("places")))
    for t in (seen, distinct, numbered, worded, common):
        release(t)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``docs`` with the removed lines taken out of the texts, and the columns ``n_lines`` and ``n_removed``."""
    own = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != text_col}
    rows = _placed(docs, id_col, text_col, own)
    gone = _removed(rows, short).select(_row(F.col("doc"), F.col("tkey")).alias("row"), "places")
    joined = rows.select("row", "text", *own.values()).join(gone, "row", "left")
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda s, i: ~F.array_contains("places", i))
    cleaned = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(own[c]).alias(c) for c in docs.columns],
                         F.coalesce(F.size(parts), F.lit(0)).cast("bigint").alias("n_lines"),
                         F.coalesce(F.when(F.col("places").isNotNull(), F.size("places")), F.lit(0)).cast("bigint").alias("n_removed"))
