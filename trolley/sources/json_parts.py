"""Objects of a large JSON document, read by many tasks.

A document such as ``{"info": {...}, "playlists": [{...}, {...}, ...]}`` is one value, which a JSON reader takes whole.
Here the file is read as text in byte ranges, cut at every ``}``. What a piece means depends on all
before it: whether it starts inside a string, and how deep. Both are running sums over the
pieces in file order (quotes, and braces outside strings), so each task adds up its own and the totals are passed on.
An object at the second level runs from the piece that reaches that level to the one that leaves it; only the
pieces of one object are put together again. Its key is the last one before it, for an array's later
objects that of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators.ranking import running_sums
from trolley.session import materialize, release
from trolley.sources.lines import numbered_lines

#: Outside strings up to the next brace; runs are possessive, so that long ones need no stack.
_OUTSIDE = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
FEW_FILES = 10_000
_KEY = r'"((?:[^"\\]|\\.)*)"\s*:\s*\[?\s*$'


def _from_start(rows: DataFrame, until: str, own: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the running sum ``until`` before each row, counted from the start of its file."""
    before = F.col(until) - own
    starts = rows.groupBy("file").agg(F.min(F.struct("line_no", before.alias("b"))).alias("s")).select(F.col("file").alias("f"), F.col("s.b").alias("__base"))
    return rows.join(starts, F.col("file") == F.col("f")).withColumn(name, before - F.col("__base")).drop("f", "__base")


def document_objects(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows (file, no, text): the objects under the top-level ``key`` of the JSON documents in ``path``, one document a file, in order."""
    pieces = materialize(numbered_lines(spark, path, "}"))
    order = [F.col("line_no")]
    plain = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)

    def opened(parity: int) -> Column:
        return F.aggregate(F.filter(plain, lambda s, i: i % 2 == parity), F.lit(0),
                           lambda acc, s: acc + F.length(s) - F.length(F.replace(s, F.lit("{"), F.lit(""))))

    counts = pieces.select("file", "line_no", (F.size(plain) - 1).cast("bigint").alias("quotes"), opened(0).alias("open0"), opened(1).alias("open1"))
    quoted = _from_start(running_sums(counts, order, {"q_until": F.col("quotes")}), "q_until", F.col("quotes"), "q_before")
    opens, inside_end = F.when(F.col("inside") == 0, F.col("open0")).otherwise(F.col("open1")), (F.col("inside") + F.col("quotes")) % 2
    change = opens - F.when(inside_end == 0, 1).otherwise(0)  # the brace that ends the piece
    levels = quoted.withColumn("inside", F.col("q_before") % 2).select("file", "line_no", "inside", opens.alias("opens"), change.cast("bigint").alias("change"))
    deep = _from_start(running_sums(levels, order, {"d_until": F.col("change")}), "d_until", F.col("change"), "depth")
    first = (F.col("depth") < 2) & (F.col("depth") + F.col("opens") >= 2)
    named = running_sums(deep.select("file", "line_no", "inside", "depth", first.alias("first")), order, {"no": F.col("first").cast("bigint")})
    held = named.where((F.col("depth") >= 2) | F.col("first")).select("file", "line_no", "no", F.when(F.col("first"), F.struct("inside", "depth")).alias("head"))

    # never broadcast: a row for each piece, which packs to a byte or two in the written table that the planner goes by
    whole = held.hint("merge").join(pieces.select("line_no", "value"), "line_no").groupBy("file", "no") \
        .agg(F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("line_no", "value"))).alias("v")) \
        .select("file", "no", "head.depth", F.concat(F.when(F.col("head.inside") == 1, F.lit('"')).otherwise(F.lit("")), F.array_join("v.value", "}"), F.lit("}")).alias("text"))
    lead = F.when(F.col("depth") == 1, F.regexp_extract("text", "(?s)^(" + _OUTSIDE + r")\{", 1)) \
        .otherwise(F.regexp_extract("text", "(?s)^(" + _OUTSIDE + r"\{" + _OUTSIDE + r")\{", 1))
    objects = materialize(whole.withColumn("lead", lead).select("file", "no", F.regexp_extract("lead", _KEY, 1).alias("key"), F.substr("text", F.length("lead") + 1).alias("text")))
    release(pieces)
    # a row for each key of the documents' first level that holds objects
    keys = materialize(objects.where("key != ''").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("no", "key"))).alias("keys")))
    if keys.count() <= FEW_FILES:  # else all objects of a file would go to one task
        keys = F.broadcast(keys)
    under = F.element_at(F.filter("keys", lambda k: k["no"] <= F.col("no")), -1)["key"]
    return objects.join(keys, "file").where(under == key).select("file", "no", "text")
