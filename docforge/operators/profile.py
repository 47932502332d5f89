"""A profile of documents that grows with its table: one state for each partition, merged into the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.sources import tables
from docforge.sources.parts import PART

# Sizes of the sketches. Rank error of the median is below 2 %, relative error of the distinct count below 5 %.
LENGTH_SKETCH = 200
HASH_SKETCH = 12


def partition_states(documents: DataFrame) -> DataFrame:
    """A row for each partition: counts, sums and maxima, and sketches of lengths and of hashes."""
    return documents.groupBy(PART).agg(
        F.count("*").alias("documents"),
        F.count("char_length").alias("lengths"),
        F.sum("char_length").alias("chars"),
        F.max("char_length").alias("max_chars"),
        F.count("review_count").alias("reviewed"),
        F.sum("review_count").alias("reviews"),
        F.count_if(F.col("review_count") > 0).alias("with_reviews"),
        F.kll_sketch_agg_bigint(F.col("char_length").cast("long"), F.lit(LENGTH_SKETCH)).alias("length_sketch"),
        F.hll_sketch_agg("content_hash", F.lit(HASH_SKETCH)).alias("hash_sketch"),
    )


def merged_profile(states: DataFrame) -> DataFrame:
    """One row over all states. Its counts, averages and maximum are those of ``checks.gold_profile``.

    ``near_median_chars`` and ``near_distinct_hashes`` come from the sketches, which merge without the rows; null when there is nothing to count.
    """
    whole = states.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("documents", "lengths", "reviewed", "with_reviews")],
        *[F.sum(name).alias(name) for name in ("chars", "reviews")],
        F.max("max_chars").alias("max_chars"),
        F.kll_merge_agg_bigint("length_sketch").alias("length_sketch"),
        F.hll_union_agg("hash_sketch").alias("hash_sketch"),
    )
    return whole.select(
        "documents",
        F.round(F.try_divide("chars", "lengths")).alias("avg_chars"),
        F.when(F.col("lengths") > 0, F.kll_sketch_get_quantile_bigint("length_sketch", F.lit(0.5))).alias("near_median_chars"),
        "max_chars",
        F.round(F.try_divide("reviews", "reviewed"), 2).alias("avg_reviews"),
        "with_reviews",
        F.when(F.col("documents") > 0, F.hll_sketch_estimate("hash_sketch")).alias("near_distinct_hashes"),
    )


def file_states(documents: DataFrame) -> DataFrame:
    """``part, files`` with a digest of each partition's files: names, sizes and times. No column is read."""
    file = [F.col(f"_metadata.{name}") for name in ("file_path", "file_size", "file_modification_time")]
    seen = documents.select(PART, F.xxhash64(*file).alias("file")).distinct()
    return seen.groupBy(PART).agg(F.bit_xor("file").alias("files"))


def refresh_profile(spark: SparkSession, documents: str, states: str) -> list[int]:
    """Bring the states of a dealt table up to date; returns the partitions that were read.

    Only partitions whose files are not those of their state are profiled. States of partitions that have gone go
    too. The states have no more rows than ``documents`` has partitions.
    """
    table = spark.table(documents)
    now = {row[PART]: row.files for row in file_states(table).collect()}
    tables.recover(spark, states)
    held = spark.table(states) if spark.catalog.tableExists(states) else None
    known = {} if held is None else tables.collect_small(held, PART, "files")
    changed = sorted(part for part, files in now.items() if known.get(part) != files)
    if held is not None and not changed and known.keys() == now.keys():
        return []
    digests = spark.createDataFrame([(part, now[part]) for part in changed], f"{PART} int, files long")
    fresh = partition_states(table.where(F.col(PART).isin(changed))).join(digests, PART)
    if held is not None:
        fresh = held.where(F.col(PART).isin(sorted(now.keys() - set(changed)))).unionByName(fresh)
    tables.write_snapshot(fresh, states)
    return changed
