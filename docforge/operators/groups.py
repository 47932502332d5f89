"""Group viewing history and latest-wins records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def excluded_titles(members: DataFrame, history: DataFrame, dislike_below: float = 3.0) -> DataFrame:
    """``group_id, movie_id`` that some member has watched or disliked.

    ``members`` holds ``group_id, user_id``; ``history`` holds ``user_id,
    movie_id, watched, rating``. History is reduced to one row per user and
    title before the join, so a very active user costs one row per title.
    """
    avoided = (
        history.where(F.col("watched") | (F.col("rating") < dislike_below))
        .select("user_id", "movie_id")
        .distinct()
    )
    return members.distinct().join(avoided, "user_id").select("group_id", "movie_id").distinct()


def exclude_seen(
    candidates: DataFrame, members: DataFrame, history: DataFrame, dislike_below: float = 3.0
) -> DataFrame:
    """Candidates (``group_id, movie_id, ...``) that no member has watched or disliked."""
    excluded = excluded_titles(members, history, dislike_below)
    return candidates.join(excluded, ["group_id", "movie_id"], "left_anti")


def seen_bitmaps(members: DataFrame, history: DataFrame, dislike_below: float = 3.0) -> DataFrame:
    """``group_id, bucket, seen``: a bitmap of the titles that some member has watched or disliked, for each 32,768 titles.

    A member's history becomes words of 64 titles on the map side first, so what meets the members is never
    more than a short row for each title that a member has seen. Whole bitmaps are made for groups alone.
    """
    title = F.col("movie_id")
    word = F.expr("movie_id div 64 - if(movie_id % 64 < 0, 1, 0)")
    own = (
        history.where((F.col("watched") | (F.col("rating") < dislike_below)) & title.isNotNull())
        .groupBy("user_id", word.alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(movie_id, 64) as int))")).alias("bits"))
    )
    met = members.distinct().join(own, "user_id")
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda place: F.getbit("bits", place) == 1)
    seen = met.select("group_id", "word", F.explode(places).alias("place")).select("group_id", (F.col("word") * 64 + F.col("place")).alias("movie_id"))
    return seen.groupBy("group_id", F.bitmap_bucket_number("movie_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("movie_id")).alias("seen")
    )


def exclude_seen_by_bitmap(
    candidates: DataFrame, members: DataFrame, history: DataFrame, dislike_below: float = 3.0
) -> DataFrame:
    """``exclude_seen`` with a bitmap for each group in place of a row for each title that it has seen."""
    bitmaps = seen_bitmaps(members, history, dislike_below).withColumnsRenamed({"bucket": "_bucket", "seen": "_seen"})
    place = F.bitmap_bit_position("movie_id")
    byte = F.conv(F.hex(F.substring("_seen", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright(_byte, cast(_place % 8 as int)) & 1")
    met = candidates.withColumn("_bucket", F.bitmap_bucket_number("movie_id")).join(bitmaps, ["group_id", "_bucket"], "left")
    marked = met.withColumn("_place", place).withColumn("_byte", byte)
    return marked.where(F.col("_seen").isNull() | (held == 0)).select(candidates.columns)


def latest(records: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The newest record of each key.

    The rank filter is pushed below the shuffle, so a key with very many
    records ships one per task.
    """
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return (
        records.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")
    )


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with the rows of ``updates`` replacing those of equal key.

    Null keys are equal to each other. ``updates`` holds one row per key; reduce
    it with ``latest`` first.
    """
    held, new = target.alias("held"), updates.alias("new")
    same = reduce(Column.__and__, [F.col(f"held.{name}").eqNullSafe(F.col(f"new.{name}")) for name in keys])
    return held.join(new, same, "left_anti").unionByName(updates)


def merge_latest(
    target: DataFrame, records: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]
) -> DataFrame:
    """``target`` with ``records`` added; of each key the newest row stays, however late it comes."""
    return latest(target.unionByName(records), keys, newest_first)
