"""Whole jobs: crawl to bronze, bronze to silver and gold, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.config import Settings
from docforge.functions.vectors import HashingEmbedder
from docforge.operators import changes, checks, chunks, embed, fetch, gold, groups, listing, parse, silver
from docforge.schemas import APPLICATION, APPLICATION_KEYS, BRONZE_GENRES
from docforge.sources import jdbc, parts, tables
from docforge.sources.fetchers import Fetcher


def reference_list(spark: SparkSession, entries: Iterable[Mapping] | None) -> DataFrame:
    """The genre list as fetched (``id, name`` records) in its bronze schema."""
    now = datetime.now(timezone.utc)
    rows = [(int(entry["id"]), entry["name"], now) for entry in entries or []]
    return spark.createDataFrame(rows, BRONZE_GENRES)


def ingest(
    spark: SparkSession,
    settings: Settings,
    open_listing: Callable[[], Fetcher],
    open_details: Callable[[], Fetcher],
    genre_entries: Iterable[Mapping] | None,
    resume: bool = False,
) -> dict[str, int]:
    """Crawl to the bronze tables; returns rows per fetch status.

    The listing is asked for up to its end, the records wave by wave. Each answer is written
    once and read back, so no later step calls the service again. Raises when too few records could be fetched; the tables of
    the crawl before then stay as they are. ``resume`` goes on with a crawl that was cut short: its answers
    are kept, only what it did not get is asked for.
    """
    tables.ensure_namespace(spark, settings.catalog, settings.schema)
    tables.write_snapshot(reference_list(spark, genre_entries), settings.table("bronze_genres"))

    rate = settings.max_requests_per_second
    raw_pages = listing.fetch_until_stop(spark, open_listing, listing.check_page(settings.discover_pages), rate)
    tables.write_snapshot(
        raw_pages, settings.table("bronze_listing"), gate=lambda raw: listing.require_pages(listing.parse_pages(raw))
    )
    pages = listing.parse_pages(spark.table(settings.table("bronze_listing")))
    ids = listing.require_rows(listing.first_seen_ids(pages)).select("movie_id")

    target, ledger = settings.table("bronze_payloads"), settings.table("fetch_ledger")
    if not resume:
        spark.sql(f"DROP TABLE IF EXISTS {ledger}")
    fetch.fetch_in_waves(
        ids, open_details, ledger, settings.fetch_waves, settings.fetch_attempts, settings.fetch_partitions, max_requests_per_second=rate
    )
    held = fetch.answers(spark.table(ledger)).join(ids, "movie_id", "left_semi")
    tables.write_snapshot(held, target, gate=checks.require_success)
    spark.sql(f"DROP TABLE IF EXISTS {ledger}")
    return tables.collect_small(checks.status_summary(spark.table(target)), "status", "rows")


def build(spark: SparkSession, settings: Settings) -> dict[str, int]:
    """Bronze to parsed, silver and gold tables; returns rows per table.

    The payload text is parsed once. Whether ids are unique is measured on the
    parsed table, and decides between the narrow plans and the merging ones.
    """
    name = settings.table
    rows = {"parsed": tables.write_snapshot(parse.parse_payloads(spark.table(name("bronze_payloads"))), name("parsed"))}
    parsed = spark.table(name("parsed"))
    unique = checks.keys_unique(parsed, "movie_id")

    def store(table: str, df: DataFrame, gate: Callable | None = None) -> None:
        rows[table] = tables.write_snapshot(df, name(table), settings.buckets, gate=gate)

    rows["silver_genres"] = tables.write_snapshot(
        silver.genres(spark.table(name("bronze_genres"))), name("silver_genres")
    )
    store("silver_movies", silver.movies(parsed))
    store("silver_movie_genres", silver.genre_links(parsed, spark.table(name("silver_genres")), unique))
    store("silver_cast", silver.cast(parsed, settings.cast_limit, unique))
    store("silver_keywords", silver.keywords(parsed, unique))
    store(
        "silver_reviews",
        silver.reviews(parsed, settings.review_limit, settings.review_char_limit, unique),
    )
    if unique:
        documents = gold.documents_from_parsed(
            parsed, settings.cast_limit, settings.review_limit, settings.review_char_limit
        )
    else:
        documents = gold.documents(
            *(spark.table(name(table)) for table in ("silver_movies", "silver_cast", "silver_reviews"))
        )
    store("gold_documents", documents, checks.require_documents)
    return rows


def embed_changed(spark: SparkSession, settings: Settings, open_embedder: Callable = HashingEmbedder) -> int:
    """Embed the documents whose text changed and drop superseded vectors.

    The vectors are partitioned by a hash of the movie. Keys alone are compared, of both tables; then
    only partitions with a changed key are read and written again, and in them no
    vector is shuffled while the stale keys are few enough to be looked up by
    broadcast. The number of partitions is the table's own; the setting counts when it is made. Returns the number of vectors.
    """
    documents = spark.table(settings.table("gold_documents")).drop(parts.PART)
    target = settings.table("movie_embeddings")
    key = list(embed.DOCUMENT_KEY)
    tables.recover(spark, target)
    if not parts.layout(spark, target):
        return parts.write_whole(_embedded(documents, settings, open_embedder), target, ["movie_id"], settings.embedding_partitions)

    wanted, have = documents.select(*key), spark.table(target).select(*key).distinct()
    changed = tables.write_barrier(embed.unembedded(wanted, have), "changed")
    stale = tables.write_barrier(embed.unembedded(have, wanted), "stale")

    def merge(held):
        fresh = _embedded(documents.join(changed, key, "left_semi"), settings, open_embedder)
        return held.join(stale, key, "left_anti").unionByName(fresh)

    parts.rewrite(spark, target, changed.union(stale), merge)
    tables.drop_barrier(changed)
    tables.drop_barrier(stale)
    return spark.table(target).count()


def _embedded(documents: DataFrame, settings: Settings, open_embedder: Callable) -> DataFrame:
    pieces = chunks.chunk_documents(
        documents.select("movie_id", "content_hash", "doc_text"),
        size=settings.chunk_size,
        overlap=settings.chunk_overlap,
    )
    return embed.embed_chunks(pieces, open_embedder)


def create_application_tables(spark: SparkSession, settings: Settings) -> None:
    """Empty user, group, rating, watchlist and recommendation tables, where missing, dealt by their keys."""
    tables.ensure_namespace(spark, settings.catalog, settings.schema)
    for name, columns in APPLICATION.items():
        if not spark.catalog.tableExists(settings.table(name)):
            parts.write_whole(spark.createDataFrame([], columns), settings.table(name), APPLICATION_KEYS[name], settings.layer_partitions)


def record(
    spark: SparkSession, table: str, records: DataFrame, keys: Sequence[str], order: Sequence[Column], partitions: int = 64
) -> int:
    """Add ratings, watchlist entries or the like; the newest record of a key wins. Returns the table's rows.

    That may be the one already held: a record that comes late changes nothing. Only partitions that
    hold a key of ``records`` are read and written. A table that is missing, or dealt by other keys, is
    dealt to ``partitions`` first.
    """
    updates = tables.write_barrier(groups.latest(records, keys, order), "records")
    tables.recover(spark, table)
    held = parts.layout(spark, table)
    if held and held[0] == list(keys):
        parts.rewrite(spark, table, updates, lambda rows: groups.merge_latest(rows, updates, keys, order))
    else:
        merged = updates
        if spark.catalog.tableExists(table):
            merged = groups.merge_latest(spark.table(table).drop(parts.PART), updates, keys, order)
        parts.write_whole(merged, table, keys, partitions)
    tables.drop_barrier(updates)
    return spark.table(table).count()


def publish(
    spark: SparkSession,
    wanted: DataFrame,
    url: str,
    table: str,
    keys: Sequence[str],
    options: Mapping[str, str] | None = None,
    split_by: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 1,
    deletes: bool = False,
) -> dict[str, int]:
    """Bring a serving table over JDBC up to date by its change set; returns rows by kind of change.

    ``split_by``, ``bounds`` and ``partitions`` read the table over several
    connections, as in ``jdbc.read_table``. Only the change set is sent: it is written to the shared folder, then,
    ordered by key in batches, to the table ``<table>__changes``, whose column ``change`` says what
    to do. ``jdbc.merge_statements`` are the statements by which the database takes them over and empties that table. Rows that
    aren't in ``wanted`` go only with ``deletes``.
    """
    target = jdbc.read_table(spark, url, table, options, split_by, bounds, partitions)
    found = tables.write_barrier(changes.change_set(target, wanted, keys, deletes), "publish")
    counts = tables.collect_small(found.groupBy("change").agg(F.count("*").alias("rows")), "change", "rows")
    if counts:
        ordered = found.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
        jdbc.write_table(ordered, url, f"{table}__changes", "append", options, connections=partitions)
    tables.drop_barrier(found)
    return counts
