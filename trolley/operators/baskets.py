"""Basket documents to basket-item rows: explodes, projections, fills, partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions.text import text_of_item

ITEM_COLUMNS = ["pid", "name", "pname", "item", "maker", "grp", "item_name", "maker_name", "grp_name"]
#: The fields whose strings make up the text of a basket-item row.
TEXT_COLUMNS = ["name", "item_name", "maker_name", "grp_name"]


def explode_baskets(docs: DataFrame) -> DataFrame:
    """One row per basket; documents without baskets vanish (inner explode)."""
    return (docs.select(F.explode("playlists").alias("playlist"))
            .select("playlist.pid", "playlist.name", "playlist.tracks"))


def basket_items(baskets: DataFrame) -> DataFrame:
    """One row per (basket, item); empty or missing item lists keep one null row."""
    return (baskets
            .select("pid", "name", F.lower("name").alias("pname"),
                    F.explode_outer("tracks").alias("track"))
            .select("pid", "name", "pname",
                    F.col("track.track_uri").alias("item"),
                    F.col("track.artist_uri").alias("maker"),
                    F.col("track.album_uri").alias("grp"),
                    F.col("track.track_name").alias("item_name"),
                    F.col("track.artist_name").alias("maker_name"),
                    F.col("track.album_name").alias("grp_name")))


def fill_names(df: DataFrame, cols=("name", "pname")) -> DataFrame:
    """Null basket names become empty strings before tokenizing."""
    present = [c for c in cols if c in df.columns]
    return df.na.fill("", subset=present) if present else df


def item_text(items: DataFrame) -> DataFrame:
    """per basket-item row, the text the vocabulary is fitted on."""
    return items.select("pid", "item",
                        text_of_item(*TEXT_COLUMNS).alias("names"))


def by_basket(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash-partition on the basket key so per-basket work stays local."""
    return df.repartition(partitions, "pid") if partitions else df.repartition("pid")
