"""Basket sources: nested multi-line JSON documents and the table-backed stand-in.

A basket document holds ``playlists[]``, each with ``pid``, ``name`` and ``tracks[]``. The
schema is passed explicitly so reading never starts with an inference pass over the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from trolley.sources.json_parts import document_objects

TRACK_SCHEMA = StructType([
    StructField("track_uri", StringType()),
    StructField("track_name", StringType()),
    StructField("artist_uri", StringType()),
    StructField("artist_name", StringType()),
    StructField("album_uri", StringType()),
    StructField("album_name", StringType()),
])

PLAYLIST_SCHEMA = StructType([
    StructField("pid", LongType()),
    StructField("name", StringType()),
    StructField("tracks", ArrayType(TRACK_SCHEMA)),
])

BASKET_DOC_SCHEMA = StructType([StructField("playlists", ArrayType(PLAYLIST_SCHEMA))])


def read_baskets(spark: SparkSession, path_glob: str, schema: StructType = BASKET_DOC_SCHEMA) -> DataFrame:
    """Read nested multi-line JSON basket documents (one document per file)."""
    return spark.read.schema(schema).option("multiLine", True).json(path_glob)


def read_split_baskets(spark: SparkSession, path: str, schema: StructType = PLAYLIST_SCHEMA) -> DataFrame:
    """S1 for large documents: as ``read_baskets``, but one row a basket, and a file is read by as many tasks as it has splits."""
    return document_objects(spark, path, "playlists").select(F.array(F.from_json("text", schema)).alias("playlists"))


def write_basket_document(baskets: DataFrame, path: str) -> None:
    """Write ``(pid, name, tracks)`` rows, in order of their pids, as one document in one file."""
    first = baskets.agg(F.min("pid")).first()[0]
    comma = F.when(F.col("pid") == F.lit(first), "").otherwise(",")
    rows = baskets.select(F.lit(1).alias("k"), "pid", F.concat(comma, F.to_json(F.struct("pid", "name", "tracks"))).alias("line"))
    edges = baskets.sparkSession.createDataFrame([(0, None, '{"info": {"version": "1"}, "playlists": ['), (2, None, "]}")], "k int, pid long, line string")
    edges.unionByName(rows).repartition(1).sortWithinPartitions("k", "pid").select("line").write.mode("overwrite").text(path)


def write_baskets(baskets: DataFrame, path: str, baskets_per_file: int = 1000) -> None:
    """Write ``(pid, name, tracks)`` rows as documents of ``baskets_per_file`` playlists.

    One document per file, as the multi-line reader expects: the slice number is a partition
    column, and each slice holds exactly one row.
    """
    docs = (baskets
            .withColumn("slice", F.floor(F.col("pid") / F.lit(baskets_per_file)).cast("bigint"))
            .groupBy("slice")
            .agg(F.array_sort(F.collect_list(F.struct("pid", "name", "tracks"))).alias("playlists")))
    docs.write.mode("overwrite").partitionBy("slice").json(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stand_in_items(spark: SparkSession, sf_dir: str, orders_where=None, many_makers: bool = False) -> DataFrame:
    """Basket-item rows from the TPC-H-style tables, one row per order line.

    order -> basket (pid), part -> item, brand -> maker, type -> group,
    segment + nation + priority -> basket name. Orders without lines keep one row with
    null item, exactly as ``explode_outer`` of an empty track list does. With ``many_makers``
    an item's suppliers are its makers, and every seventh basket has no name.
    """
    orders = table(spark, sf_dir, "orders")
    if orders_where is not None:
        orders = orders.where(orders_where)
    orders = orders.select(F.col("o_orderkey").alias("pid"), "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")

    named = (orders
             .join(customer, orders.o_custkey == customer.c_custkey, "left")
             .join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
             .select("pid", F.concat_ws(" ", "c_mktsegment", "n_name", "o_orderpriority").alias("name")))
    if many_makers:
        named = named.withColumn("name", F.when(F.col("pid") % 7 != 0, F.col("name")))
    # the parts meet the bare lines; the rows then move once more, to their baskets, and lie together by basket
    with_parts = lines.join(part, lines.l_partkey == part.p_partkey, "left")
    with_lines = named.join(with_parts, named.pid == with_parts.l_orderkey, "left")
    return with_lines.select(
        "pid",
        "name",
        F.lower("name").alias("pname"),
        F.col("l_partkey").cast("string").alias("item"),
        (F.col("l_suppkey").cast("string") if many_makers else F.col("p_brand")).alias("maker"),
        F.col("p_type").alias("grp"),
        F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("maker_name"),
        F.col("p_type").alias("grp_name"),
    )


def stand_in_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested ``(pid, name, tracks)`` baskets rebuilt from the tables (document form).

    Used for document round trips; the flat pipeline starts from ``stand_in_items``.
    """
    items = stand_in_items(spark, sf_dir)
    track = F.struct(
        F.col("item").alias("track_uri"), F.col("item_name").alias("track_name"),
        F.col("maker").alias("artist_uri"), F.col("maker_name").alias("artist_name"),
        F.col("grp").alias("album_uri"), F.col("grp_name").alias("album_name"))
    # collect_list skips the null struct of an empty basket, leaving an empty track list
    return (items
            .select("pid", "name", F.when(F.col("item").isNotNull(), track).alias("track"))
            .groupBy("pid", "name")
            .agg(F.collect_list("track").alias("tracks")))


def stand_in_history_items(spark: SparkSession, sf_dir: str, before: str = "1996-01-01") -> DataFrame:
    """Basket items of orders placed before ``before``: the history a dictionary is fitted on."""
    return stand_in_items(spark, sf_dir, F.col("o_orderdate") < F.lit(before).cast("timestamp"))
