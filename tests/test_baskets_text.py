"""Baskets, dictionaries, tokenizer, stop words, vocabulary (hand fixtures)."""

import json

from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F

from trolley.functions.text import ENGLISH_STOP_WORDS, drop_stop_words, tokenize
from trolley.operators.baskets import basket_items, explode_baskets
from trolley.operators.dictionary import encode, fit_dict
from trolley.operators.ranking import running_sums
from trolley.operators.vocab import fit_vocab
from trolley.sources.baskets import read_baskets


def _tiny_docs(tmp_path):
    # normal, repeated item, empty list, missing list, null name
    doc = {"playlists": [
        {"pid": 1, "name": "Road Trip", "tracks": [
            {"track_uri": "a", "track_name": "A", "artist_uri": "x", "artist_name": "X",
             "album_uri": "p", "album_name": "P"},
            {"track_uri": "b", "track_name": "B", "artist_uri": "y", "artist_name": "Y",
             "album_uri": "p", "album_name": "P"}]},
        {"pid": 2, "name": "Repeat", "tracks": [
            {"track_uri": "a", "artist_uri": "x"}, {"track_uri": "a", "artist_uri": "x"}]},
        {"pid": 3, "name": "Empty", "tracks": []},
        {"pid": 4, "name": "Missing"},
        {"pid": 5, "name": None, "tracks": [{"track_uri": "c", "artist_uri": "z"}]},
    ]}
    path = tmp_path / "slice.0.json"
    path.write_text(json.dumps(doc, indent=2))
    return str(tmp_path / "*.json")


def test_nested_documents_explode(spark, tmp_path):
    items = basket_items(explode_baskets(read_baskets(spark, _tiny_docs(tmp_path))))
    rows = sorted((r.pid, r.item) for r in items.select("pid", "item").collect())
    assert rows == sorted([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None), (4, None), (5, "c")])
    pnames = {r.pid: r.pname for r in items.select("pid", "pname").distinct().collect()}
    assert pnames[1] == "road trip" and pnames[5] is None


def test_dictionary_order_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("10",), ("9",)], "item string")
    d = fit_dict(df, "item", "item_id")
    assert [r.item for r in d.orderBy("item_id").collect()] == ["10", "9", "a", "b"]
    more = spark.createDataFrame([("a",), ("b",), ("zzz",), (None,), ("a",), ("a",)], "item string")
    d2 = fit_dict(more, "item", "item_id")
    assert [(r.item, r.item_id, r.freq) for r in d2.orderBy("item_id").collect()] == \
        [("a", 0, 3), ("b", 1, 1), ("zzz", 2, 1)]
    enc = encode(spark.createDataFrame([("b",), ("new",), (None,)], "item string"), d2, "item", 3)
    assert sorted((r.item or "", r.item_id) for r in enc.collect()) == [("", 3), ("b", 1), ("new", 3)]


def test_running_sums_many_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("v"))
    out = running_sums(df, [F.col("k").asc()], {"c": F.col("v")}, partitions=7)
    got = {r.k: r.c for r in out.collect()}
    assert all(got[k] == 2 * (k + 1) for k in range(1000))


def test_tokenizer_matches_regex_tokenizer(spark):
    texts = ["", "  A b", "The And", "Ünïcödé  TEXT\tmore\nlines", "x  y   z "]
    df = spark.createDataFrame([(t,) for t in texts], "names string")
    ours = [r.t for r in df.select(tokenize(F.col("names")).alias("t")).collect()]
    ref = [r.t for r in RegexTokenizer(inputCol="names", outputCol="t").transform(df).select("t").collect()]
    assert ours == ref
    sw = StopWordsRemover(inputCol="t", outputCol="k")
    kept_ref = [r.k for r in sw.transform(df.select(tokenize(F.col("names")).alias("t"))).collect()]
    kept = [r.k for r in df.select(drop_stop_words(tokenize(F.col("names"))).alias("k")).collect()]
    assert kept == kept_ref
    assert kept[2] == []  # stop-word-only name gives an empty token list


def test_stop_word_list_is_spark_default():
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_vocab_ties_and_cap(spark):
    df = spark.createDataFrame([("b a c",), ("c b",), ("d",)], "names string")
    v = fit_vocab(df, "names", size=3)
    assert [(r.token, r.token_id, r.freq) for r in v.orderBy("token_id").collect()] == \
        [("b", 0, 2), ("c", 1, 2), ("a", 2, 1)]
