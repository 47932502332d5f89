"""Parsed, silver and gold tables brought up to date with bronze, by changed records alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.config import Settings
from docforge.operators import changes, checks, gold, parse, silver
from docforge.sources import parts, tables

KEY = ["movie_id"]
#: A table of more bytes than this is rewritten in pieces, of which there are no more than that.
PIECE, PIECES = 64 << 20, 16
LEDGER, PENDING = "payload_ledger", "pending_changes"
#: All that a refresh can keep, beside the reference list.
LAYERS = ("parsed", "silver_movie_genres", "silver_movies", "silver_cast", "silver_keywords", "silver_reviews", "gold_documents")


def refresh(spark: SparkSession, settings: Settings, bronze: DataFrame | None = None, layers: Sequence[str] = LAYERS) -> dict[str, int]:
    """Bring all layers up to date; returns how many records were added, changed and removed.

    A ledger holds the digest of every payload that the layers were made of. Only records whose digest differs are parsed, and
    only partitions that hold one are read and written, in each table. The result equals a full build.

    The changed keys are written down before the first table is touched, and the ledger after the last. A run that was cut
    short is made up for by the next one, whatever happened to bronze in between. Raises, with
    all tables as they were, when bronze holds no payload. A new reference list changes links of records that
    didn't change; those are found by genre among all parsed records.

    ``bronze`` are payloads that are written elsewhere already; by default the table's. ``layers`` are those to keep. One that
    has a table is kept in any case, and one that has none yet is made of all records, like all others in that run. Without
    the parsed table records are parsed on the way.
    """
    if not {*layers} <= {*LAYERS}:
        raise ValueError(f"no such layer: {sorted({*layers} - {*LAYERS})}")
    name = settings.table
    bronze = spark.table(name("bronze_payloads")) if bronze is None else bronze
    ledger = tables.write_barrier(changes.payload_digests(bronze), "ledger")
    if ledger.isEmpty():
        raise checks.QualityError("bronze holds no payload; the layers stay as they are")
    for table in (LEDGER, PENDING, *LAYERS):
        tables.recover(spark, name(table))
    held = {table for table in LAYERS if spark.catalog.tableExists(name(table))}
    kept = held.union(layers)
    whole = kept != held or not spark.catalog.tableExists(name(LEDGER))
    changed = _changed(spark, settings, ledger)
    counts = tables.collect_small(changed.groupBy("change").agg(F.count("*").alias("rows")), "change", "rows")
    tables.write_snapshot(changed, name(PENDING))
    keys = changed.select(*KEY)

    moved_genres = _refresh_genres(spark, settings)
    all_parsed = parse.parse_payloads(bronze.where("movie_id IS NOT NULL"))
    # All there is, without a join, or the changed records; these are written when more than one layer is made of them.
    parsed = all_parsed if whole else parse.parse_payloads(bronze.join(keys, "movie_id", "left_semi"))
    barrier = None if whole or len(kept) == 1 else tables.write_barrier(parsed, "parsed")
    parsed = parsed if barrier is None else barrier
    if "parsed" in kept:
        _bring(spark, settings, whole, "parsed", keys, parsed)
        all_parsed = spark.table(name("parsed")).drop(parts.PART)
        parsed = all_parsed if whole else parsed
    unique = _unique(bronze, parsed, barrier is not None or "parsed" in kept)
    if "silver_movie_genres" in kept:
        if moved_genres is not None and not whole:
            _bring(spark, settings, whole, "silver_movie_genres", *_moved_links(spark, settings, keys, moved_genres, all_parsed))
        else:
            _bring(spark, settings, whole, "silver_movie_genres", keys, silver.genre_links(parsed, spark.table(name("silver_genres")), unique))
    for table, rows in _layers(parsed, settings, unique).items():
        if table in kept:
            _bring(spark, settings, whole, table, keys, rows, whole and unique and "parsed" in kept)

    tables.write_snapshot(ledger, name(LEDGER))
    spark.sql(f"DROP TABLE IF EXISTS {name(PENDING)}")
    for written in (barrier, changed, ledger, moved_genres):
        if written is not None:
            tables.drop_barrier(written)
    return counts


def _unique(bronze: DataFrame, parsed: DataFrame, written: bool) -> bool:
    """Whether no id comes twice in ``parsed``; unless it is ``written``, the payloads' ids are looked at first, since that parses nothing."""
    ids = bronze.where("status = 'success' AND movie_id IS NOT NULL")
    return not written and checks.keys_unique(ids, "movie_id") or checks.keys_unique(parsed, "movie_id")


def _changed(spark: SparkSession, settings: Settings, ledger: DataFrame) -> DataFrame:
    """Keys that differ from the ledger, and those that an unfinished run had begun with."""
    name = settings.table
    if spark.catalog.tableExists(name(LEDGER)):
        found = changes.changed_keys(spark.table(name(LEDGER)), ledger)
    else:
        found = ledger.select(*KEY, F.lit(changes.ADDED).alias("change"))
    if spark.catalog.tableExists(name(PENDING)):
        begun = spark.table(name(PENDING)).select(*KEY, "change")
        found = found.unionByName(begun.join(found.select(*KEY), KEY, "left_anti"))
    return tables.write_barrier(found, "changed")


def _layers(parsed: DataFrame, settings: Settings, unique: bool) -> dict[str, DataFrame]:
    """The rows of each table that depend on one record alone, from the records parsed."""
    movies = silver.movies(parsed)
    cast = silver.cast(parsed, settings.cast_limit, unique)
    reviews = silver.reviews(parsed, settings.review_limit, settings.review_char_limit, unique)
    if unique:
        documents = gold.documents_from_parsed(parsed, settings.cast_limit, settings.review_limit, settings.review_char_limit)
    else:
        documents = gold.documents(movies, cast, reviews)
    # One time for all pieces that the table may be rewritten in.
    now = parsed.sparkSession.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
    documents = documents.withColumn("built_at", F.timestamp_micros(F.lit(now)))
    return {
        "silver_movies": movies,
        "silver_cast": cast,
        "silver_keywords": silver.keywords(parsed, unique),
        "silver_reviews": reviews,
        "gold_documents": documents,
    }


def _bring(spark: SparkSession, settings: Settings, whole: bool, table: str, keys: DataFrame, rows: DataFrame, gathered: bool = False) -> None:
    """``rows`` in place of those of ``keys``; a table that is missing or was built otherwise is dealt to partitions.

    With ``whole`` the rows are all there are; ``gathered`` is told to ``parts.write_whole``.
    """
    name = settings.table(table)
    tables.recover(spark, name)
    if parts.layout(spark, name) and not whole:
        parts.replace_keys(spark, name, keys, rows, parts.pieces(spark, name, PIECE, PIECES))
    else:
        if spark.catalog.tableExists(name) and not whole:
            held = spark.table(name).drop(parts.PART)
            rows = held.join(keys, "movie_id", "left_anti").unionByName(rows)
        parts.write_whole(rows, name, KEY, settings.layer_partitions, gathered)
    if parts.pieces(spark, name, PIECE, PIECES) > 1:
        tables.release(spark)


def _refresh_genres(spark: SparkSession, settings: Settings) -> DataFrame | None:
    """Writes the reference list; the genre ids that came or went, null when none did."""
    name = settings.table("silver_genres")
    wanted = silver.genres(spark.table(settings.table("bronze_genres")))
    moved = None
    if spark.catalog.tableExists(name):
        held, ids = spark.table(name).select("genre_id").distinct(), wanted.select("genre_id").distinct()
        moved = tables.write_barrier(held.exceptAll(ids).union(ids.exceptAll(held)), "genres")
        if moved.isEmpty():
            tables.drop_barrier(moved)
            moved = None
    tables.write_snapshot(wanted, name)
    return moved


def _moved_links(spark: SparkSession, settings: Settings, keys: DataFrame, genres: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys whose links may differ, and their links: changed records, and those that name a genre that came or went."""
    # Nothing else of a record is to be shuffled.
    parsed = parsed.select("movie_id", F.struct("d.genres").alias("d"))
    naming = parsed.select("movie_id", F.explode("d.genres.id").alias("genre_id")).join(genres, "genre_id", "left_semi")
    moved = keys.union(naming.select("movie_id")).distinct()
    links = silver.genre_links(parsed.join(moved, "movie_id", "left_semi"), spark.table(settings.table("silver_genres")))
    return moved, links
