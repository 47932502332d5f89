"""What differs between two states of a table: digests, changed keys, change sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, CHANGED, REMOVED = "added", "changed", "removed"


def payload_digests(bronze: DataFrame, key: str = "movie_id") -> DataFrame:
    """``key, digest`` of the successful payloads of each key.

    The digest is made of sums, so it depends on no order, and a key with very many rows costs one row per task.
    """
    wide = lambda column: F.sum(column.cast("decimal(20,0)")).cast("string")
    return (
        bronze.where(F.col("status") == "success")
        .groupBy(key)
        .agg(F.concat_ws(":", F.count("*"), wide(F.xxhash64("payload")), wide(F.xxhash64(F.lit(1), "payload"))).alias("digest"))
    )


def changed_keys(before: DataFrame, after: DataFrame, key: str = "movie_id") -> DataFrame:
    """``key, change`` of the keys whose digests differ."""
    old, new = before.select(key, F.col("digest").alias("_old")), after.select(key, F.col("digest").alias("_new"))
    kind = F.when(F.col("_old").isNull(), ADDED).when(F.col("_new").isNull(), REMOVED).otherwise(CHANGED)
    return old.join(new, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, kind.alias("change"))


def fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values; a null differs from every text, and neighbouring texts can't run together."""
    value = lambda name: F.coalesce(F.concat(F.length(F.col(name).cast("string")).cast("string"), F.lit(":"), F.col(name).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[value(name) for name in columns]), 256)


def change_set(held: DataFrame, wanted: DataFrame, keys: Sequence[str], deletes: bool = True) -> DataFrame:
    """``wanted``'s columns and ``change``: the rows that make ``held`` into ``wanted``.

    An added or changed row has its new values, a removed one its keys alone. Rows
    are compared by fingerprints of all columns, so only keys and fingerprints of ``held`` are shuffled. Each table
    holds one row per key; null keys are equal to each other. Without ``deletes`` held rows that aren't wanted stay.
    """
    others = [name for name in wanted.columns if name not in keys]
    old = held.select(*[F.col(name).alias(f"_{name}") for name in keys], fingerprint(others).alias("_old"))
    new = wanted.withColumn("_new", fingerprint(others))
    equal = reduce(Column.__and__, [new[name].eqNullSafe(old[f"_{name}"]) for name in keys])
    met = new.join(old, equal, "full_outer" if deletes else "left").where(~F.col("_old").eqNullSafe(F.col("_new")))
    kind = F.when(F.col("_old").isNull(), ADDED).when(F.col("_new").isNull(), REMOVED).otherwise(CHANGED)
    shown = [F.when(F.col("_new").isNull(), F.col(f"_{name}")).otherwise(F.col(name)).alias(name) for name in keys]
    return met.select(*shown, *others, kind.alias("change")).select(*wanted.columns, "change")


def apply_changes(held: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``held`` after a change set."""
    gone, new = held.alias("held"), changes.alias("new")
    equal = reduce(Column.__and__, [F.col(f"held.{name}").eqNullSafe(F.col(f"new.{name}")) for name in keys])
    return gone.join(new, equal, "left_anti").unionByName(changes.where(F.col("change") != REMOVED).drop("change"))
