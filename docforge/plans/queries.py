"""The registered queries: every operator over the whole driver tables."""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Callable
from functools import partial
from uuid import uuid4

import pyarrow.dataset as ds
import pyarrow.fs as pafs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.config import Settings
from docforge.functions import text as T
from docforge.functions.vectors import HashingEmbedder
from docforge.operators import cells, changes, checks, chunks, drift, embed, fetch, gold, groups, listing, parse, postings, profile, search, silver
from docforge.plans import jobs, refresh
from docforge.plans.bridge import crawled, earlier_genres, earlier_payloads, genre_entries, layers, listing_pages, repeated_ids, table, utc_text
from docforge.sources import parts, tables
from docforge.sources.fetchers import FetchError, NotFoundError, TransientError

# Limits that make both cuts bite on the driver's conversations, for one query; all others use the defaults.
TIGHT_REVIEW_LIMIT = 3
TIGHT_REVIEW_CHARS = 500

REQUEST_TEXTS = ("elle nous the and", "dass und ich", "que los para con")
IMAGE_BASE = "https://images.example/t/p"
COMPARED_IDS = (4, 8, 15, 16, 42)
UPSERT_CUT = "2024-01-10 00:00:00"
SEARCHED_TITLE = " Widget "


def request_vectors(count: int = 5, dimensions: int = 64) -> dict[int, list[float]]:
    """Request vectors from a rule, the same for every scale."""
    return {
        q: [round(math.cos(0.37 * (q + 1) * (i + 1)), 6) for i in range(dimensions)] for q in range(count)
    }


# ---------------------------------------------------------------- bronze


class PageReplay:
    """Fetches a page from its own request row; some keys fail by rule."""

    def fetch(self, request):
        turn = request["movie_id"] % 20
        if turn == 3:
            raise NotFoundError("gone")
        if turn == 7:
            raise FetchError("unavailable")
        return {"url": request["url"], "html": request["html"]}


@tables.remembered
def _crawl(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched once per session and folder; every reader uses the written rows."""
    return tables.write_barrier(fetch_pages(spark, folder), "crawl")


def fetch_pages(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "pages").withColumnRenamed("page_id", "movie_id")
    return fetch.fetch_records(requests, PageReplay, partitions=_parts(spark))


def _parts(spark: SparkSession) -> int:
    """Tasks for work that is dear by the row: as many as the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crawl_to_bronze(spark, folder):
    body = F.from_json("payload", "url STRING, html STRING")
    return _crawl(spark, folder).select(
        "movie_id",
        "status",
        "error",
        body["url"].alias("url"),
        T.fingerprint(body["html"]).alias("html_hash"),
    )


class FlakyReplay(PageReplay):
    """Some pages fail by rule in a way that passes, some in one that doesn't."""

    def fetch(self, request):
        turn = request["movie_id"] % 20
        if turn == 13 or turn == 11 and not request["attempt"]:
            raise TransientError("busy")
        return super().fetch(request)


@tables.remembered
def _resumed(spark: SparkSession, folder: str) -> str:
    """The ledger of a crawl that was cut short after three of its five slices, and then went on."""
    ledger = f"{_scratch_schema(spark)}.fetch_ledger"
    requests = table(spark, folder, "pages").withColumnRenamed("page_id", "movie_id")
    run = partial(fetch.fetch_in_waves, requests, FlakyReplay, ledger, slices=5, attempts=3, partitions=_parts(spark))
    run(most_waves=3)
    run()
    return ledger


def resumed_crawl(spark, folder):
    """Each page's answer, and how often it was asked for over both runs."""
    ledger = spark.table(_resumed(spark, folder))
    asked = ledger.groupBy("movie_id").agg(F.count("*").alias("requests"))
    return fetch.answers(ledger).join(asked, "movie_id").select(
        "movie_id", "status", "error", F.get_json_object("payload", "$.url").alias("url"), "requests"
    )


def _scratch_schema(spark: SparkSession) -> str:
    """A namespace of this run in the shared folder."""
    schema = f"docforge_{uuid4().hex[:12]}"
    tables.ensure_namespace(spark, "spark_catalog", schema, f"{tables.shared_root(spark)}/{schema}")
    return f"spark_catalog.{schema}"


def fetch_status_summary(spark, folder):
    return checks.status_summary(_crawl(spark, folder))


def fetch_failures(spark, folder):
    return checks.non_success(_crawl(spark, folder))


def success_ratio(spark, folder):
    return checks.success_ratio(crawled(spark, folder)).select(
        "total", "succeeded", F.round("ratio", 6).alias("ratio")
    )


@tables.remembered
def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed once per session and folder; the stop and the ids read the written pages."""
    return tables.write_barrier(listing.parse_pages(listing_pages(spark, folder)), "listing")


def pages_first_seen_ids(spark, folder):
    return listing.first_seen_ids(_listing(spark, folder))


class PageFiles:
    """Listing pages from files, as a service would answer; beyond the last page nothing is there."""

    def __init__(self, path: str):
        self.store, self.place = pafs.FileSystem.from_uri(path)
        self.ends, self.groups, self.at, self.held = None, [], None, {}

    def fetch(self, request):
        page = request["page"]
        if self.ends is None:
            self._look_up()
        # Files are sorted by page, so one row group can hold it; neighbouring pages are read together.
        at = bisect_left(self.ends, page)
        if at < len(self.ends) and at != self.at:
            rows = self.groups[at].to_table(columns=["page", "payload"])
            self.at, self.held = at, dict(zip(rows["page"].to_pylist(), rows["payload"].to_pylist(), strict=True))
        if page not in self.held:
            raise NotFoundError(f"no page {page}")
        return json.loads(self.held[page])

    def _look_up(self):
        """The row groups in order of their pages, from the files' footers; one of null pages has no statistics."""
        found = []
        for file in ds.dataset(self.place, filesystem=self.store, format="parquet").get_fragments():
            for group in file.split_by_row_group():
                told = group.row_groups[0].statistics.get("page")
                if told:
                    found.append((told["max"], group))
        found.sort(key=lambda each: each[0])
        self.ends, self.groups = [last for last, _ in found], [group for _, group in found]


@tables.remembered
def _listing_source(spark: SparkSession, folder: str) -> DataFrame:
    """The listing as its data source gives it, up to its end."""
    pages = listing_pages(spark, folder)
    path = f"{tables.shared_root(spark)}/listing-{uuid4().hex}"
    pages.select("page", "payload").repartitionByRange(16, "page").sortWithinPartitions("page").write.option("parquet.block.size", 1 << 16).parquet(path)
    last = spark.read.parquet(path).agg(F.max("page")).first()[0]
    return listing.fetch_until_stop(spark, partial(PageFiles, path), int(last))


def listing_source_ids(spark, folder):
    """The ids of ``pages_first_seen_ids``, from pages that were asked for in waves."""
    return listing.first_seen_ids(listing.parse_pages(_listing_source(spark, folder)))


def listing_requests(spark, folder):
    """How many pages were asked for, and how many the listing has up to its end."""
    asked = _listing_source(spark, folder)
    used = listing.until_stop(listing.parse_pages(asked))
    return asked.agg(F.count("*").alias("requested")).crossJoin(used.agg(F.count("*").alias("used")))


def _part_catalogue(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("movie_id"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("popularity"),
        (F.col("p_size") * 10).alias("vote_count"),
        (F.col("p_size") % 7 == 0).alias("adult"),
        F.col("p_brand").alias("overview"),
        (F.col("p_size") / 10).alias("vote_average"),
        F.lit("").alias("release_date"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/"), F.col("p_partkey"), F.lit(".jpg"))).alias(
            "poster_path"
        ),
    )


def listing_filters(spark, folder):
    page = listing.listing_page(_part_catalogue(spark, folder), page=2, popularity_lte=1000.0)
    return page.select("movie_id", "title", "popularity", "vote_count")


def bronze_reference_list(spark, folder):
    """The list as the service sends it, repeats and all."""
    return genre_entries(spark, folder)


# ---------------------------------------------------------------- parse


def parse_props_json(spark, folder):
    props = F.from_json("props", "k INT")
    return table(spark, folder, "events").select("event_id", props["k"].alias("k"))


def parse_yield(spark, folder):
    return parse.parse_yield(crawled(spark, folder))


def payload_drift(spark, folder):
    """Departures of the payloads' own fields."""
    return drift.schema_drift(crawled(spark, folder), depth=1)


# ---------------------------------------------------------------- silver


def _movies(spark, folder):
    return silver.movies(layers(spark, folder).parsed)


def silver_movies(spark, folder):
    listed = ("genre_names", "keyword_names", "provider_names")
    movies = _movies(spark, folder)
    plain = [name for name in movies.columns if name not in (*listed, "ingested_at", "release_date")]
    return movies.select(
        *plain,
        F.col("release_date").cast("string").alias("release_date"),
        *[F.array_join(name, "|").alias(name) for name in listed],
        *[F.size(name).alias(f"n_{name}") for name in listed[1:]],
    )


def silver_null_counts(spark, folder):
    """Nothing but the counts is made of the records, so they are parsed on the way and not written."""
    return checks.null_counts(silver.movies(parse.parse_payloads(crawled(spark, folder))))


def silver_genres(spark, folder):
    return silver.genres(genre_entries(spark, folder))


def silver_links(spark, folder):
    have = layers(spark, folder)
    return silver.genre_links(have.parsed, silver_genres(spark, folder), have.ids_unique)


def orphan_links(spark, folder):
    have = layers(spark, folder)
    return silver.orphan_links(have.parsed, silver_genres(spark, folder), have.ids_unique)


def silver_cast(spark, folder):
    have = layers(spark, folder)
    return silver.cast(have.parsed, one_row_per_id=have.ids_unique)


def silver_cast_merged(spark, folder):
    """The plan for repeated ids; same result."""
    return silver.cast(layers(spark, folder).parsed)


def silver_keywords(spark, folder):
    have = layers(spark, folder)
    return silver.keywords(have.parsed, have.ids_unique)


def silver_keywords_merged(spark, folder):
    """The plan for repeated ids; same result."""
    return silver.keywords(layers(spark, folder).parsed)


def silver_links_merged(spark, folder):
    """The plan for repeated ids; same result."""
    return silver.genre_links(layers(spark, folder).parsed, silver_genres(spark, folder))


def _reviews(spark, folder):
    have = layers(spark, folder)
    return silver.reviews(have.parsed, one_row_per_id=have.ids_unique)


def _with_written_time(reviews):
    """``created_at`` as UTC text, whatever zone the session shows."""
    return reviews.withColumn("created_at", utc_text(F.col("created_at")))


def silver_reviews(spark, folder):
    return _with_written_time(_reviews(spark, folder))


def silver_reviews_merged(spark, folder):
    """The plan for repeated ids; same result."""
    return _with_written_time(silver.reviews(layers(spark, folder).parsed))


def silver_reviews_tight(spark, folder):
    """Both cuts bite here."""
    have = layers(spark, folder)
    return _with_written_time(
        silver.reviews(have.parsed, TIGHT_REVIEW_LIMIT, TIGHT_REVIEW_CHARS, have.ids_unique)
    )


# ---------------------------------------------------------------- gold


def cast_line(spark, folder):
    return gold.cast_lines(silver_cast(spark, folder))


def review_block(spark, folder):
    return gold.review_blocks(_reviews(spark, folder))


def _gold_narrow(spark, folder):
    have = layers(spark, folder)
    if not have.ids_unique:
        return _gold_joined(spark, folder)
    return gold.documents_from_parsed(have.parsed)


def _gold_joined(spark, folder):
    return gold.documents(_movies(spark, folder), silver_cast(spark, folder), _reviews(spark, folder))


def gold_documents(spark, folder):
    return _gold_narrow(spark, folder).drop("built_at")


def gold_documents_joined(spark, folder):
    return _gold_joined(spark, folder).drop("built_at")


@tables.remembered
def _profiled(spark: SparkSession, folder: str) -> DataFrame:
    """What the profile reads, built once per session and folder."""
    return tables.write_barrier(
        _gold_narrow(spark, folder).select("content_hash", "char_length", "review_count"), "gold"
    )


def gold_profile(spark, folder):
    return checks.gold_profile(_profiled(spark, folder))


@tables.remembered
def _profile_states(spark: SparkSession, folder: str) -> str:
    """Documents in a dealt table that grows between two profiles; the second reads grown partitions alone."""
    schema = _scratch_schema(spark)
    documents, states = f"{schema}.documents", f"{schema}.profile"
    rows = _gold_narrow(spark, folder).select("movie_id", "content_hash", "char_length", "review_count")
    late = (F.col("movie_id") % 5 == 2) & (parts.part_of(["movie_id"], _parts(spark)) % 2 == 0)
    parts.write_whole(rows.where(~late), documents, ["movie_id"], _parts(spark))
    profile.refresh_profile(spark, documents, states)
    grown = tables.write_barrier(rows.where(late), "grown")
    parts.replace_keys(spark, documents, grown, grown)
    profile.refresh_profile(spark, documents, states)
    return states


def merged_profile(spark, folder):
    """The exact metrics; what the sketches say is held against its error in the tests."""
    merged = profile.merged_profile(spark.table(_profile_states(spark, folder)))
    return merged.drop("near_median_chars", "near_distinct_hashes")


def document_fingerprint_dups(spark, folder):
    documents = table(spark, folder, "documents")
    return checks.duplicate_fingerprints(documents.select(T.fingerprint(F.col("text")).alias("content_hash")))


def table_counts(spark, folder):
    have = layers(spark, folder)
    return tables.row_counts(
        {
            "bronze_payloads": have.bronze,
            "parsed": have.parsed,
            "silver_genres": silver_genres(spark, folder),
            "silver_movie_genres": silver_links(spark, folder),
            "silver_cast": silver_cast(spark, folder),
            "silver_keywords": silver_keywords(spark, folder),
            "silver_reviews": _reviews(spark, folder),
        }
    )


# ---------------------------------------------------------------- repeated ids


def silver_links_repeated(spark, folder):
    return silver.genre_links(repeated_ids(layers(spark, folder).parsed), silver_genres(spark, folder))


def silver_cast_repeated(spark, folder):
    return silver.cast(repeated_ids(layers(spark, folder).parsed))


def silver_keywords_repeated(spark, folder):
    return silver.keywords(repeated_ids(layers(spark, folder).parsed))


def silver_reviews_repeated(spark, folder):
    return _with_written_time(silver.reviews(repeated_ids(layers(spark, folder).parsed)))


# ---------------------------------------------------------------- changes through the layers


@tables.remembered
def _refreshed(spark: SparkSession, folder: str, layer: str) -> Settings:
    """A catalogue that keeps one layer, built from an earlier crawl and then brought up to date with this one.

    A query returns one layer; all others would be written to be read by nobody.
    """
    schema = _scratch_schema(spark)
    settings = Settings(schema=schema.split(".")[1], layer_partitions=_parts(spark))
    bronze, entries = crawled(spark, folder), genre_entries(spark, folder).distinct()
    for payloads, genres in ((earlier_payloads(bronze), earlier_genres(entries)), (bronze, entries)):
        tables.write_snapshot(genres, settings.table("bronze_genres"))
        refresh.refresh(spark, settings, payloads, [layer])
    return settings


def _refreshed_table(spark, folder, name):
    return spark.table(_refreshed(spark, folder, name).table(name)).drop(parts.PART)


def changed_records(spark, folder):
    """What the ledger finds between the two crawls."""
    bronze = crawled(spark, folder)
    return changes.changed_keys(changes.payload_digests(earlier_payloads(bronze)), changes.payload_digests(bronze))


def refreshed_links(spark, folder):
    return _refreshed_table(spark, folder, "silver_movie_genres").select("genre_id", "movie_id")


def refreshed_cast(spark, folder):
    return _refreshed_table(spark, folder, "silver_cast")


def refreshed_keywords(spark, folder):
    return _refreshed_table(spark, folder, "silver_keywords")


def refreshed_reviews(spark, folder):
    return _with_written_time(_refreshed_table(spark, folder, "silver_reviews"))


def refreshed_documents(spark, folder):
    return _refreshed_table(spark, folder, "gold_documents").drop("built_at")


# ---------------------------------------------------------------- documents and vectors


def chunk_documents(spark, folder):
    return chunks.chunk_documents(table(spark, folder, "documents").select("doc_id", "text"), "text")


def _embedded_chunks(spark, folder):
    """Texts are dealt out before they are cut; embedding costs far more than moving them."""
    documents = table(spark, folder, "documents").select("doc_id", "text").repartition(_parts(spark))
    return embed.embed_chunks(chunks.chunk_documents(documents, "text"))


@tables.remembered
def _vector_layer(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vectors of all chunks, as a job stores them; embedded once per session and folder."""
    return tables.write_barrier(_embedded_chunks(spark, folder).drop("chunk_text"), "vectors")


def embed_chunks(spark, folder):
    """Vectors as text: ``position:value`` of the non-zero values, in millionths."""

    def shown(value, position):
        millionths = F.round(value.cast("double") * 1e6).cast("int")
        return F.when(value != 0, F.concat_ws(":", position.cast("string"), millionths.cast("string")))

    return _embedded_chunks(spark, folder).select(
        "doc_id", "chunk_index", F.array_join(F.transform("embedding", shown), " ").alias("vector")
    )


def semantic_search(spark, folder):
    return search.search_text(_vector_layer(spark, folder), REQUEST_TEXTS, HashingEmbedder, parent="doc_id")


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.expr("vec_id div 4").alias("movie_id"), "vec_id", "label", "embedding"
    )


def vector_top_k(spark, folder):
    return search.vector_top_k(_vectors(spark, folder), request_vectors(), parent="vec_id")


def vector_top_k_parents(spark, folder):
    return search.vector_top_k(_vectors(spark, folder), request_vectors())


@tables.remembered
def _cells(spark: SparkSession, folder: str) -> cells.Cells:
    path = f"{tables.shared_root(spark)}/cells-{uuid4().hex}"
    return cells.write_cells(_vectors(spark, folder), path, cells=32, parent="vec_id")


def pruned_top_k(spark, folder):
    return cells.pruned_top_k(_cells(spark, folder), request_vectors())


def labelled_vector_top_k(spark, folder):
    return search.vector_top_k(_vectors(spark, folder).where("label < 5"), request_vectors(), parent="vec_id")


def constrained_top_k(spark, folder):
    condition = (F.col("runtime_minutes") < 100) & F.array_contains("genre_names", "ECONOMY")
    return search.constrained_top_k(
        _vectors(spark, folder), _movies(spark, folder), condition, request_vectors(), k=5
    )


def _fingerprinted(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("content_hash"))


def _embedded_set(spark, folder):
    """Labelled documents count as embedded; low quality marks a superseded text."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return (
        _fingerprinted(spark, folder)
        .join(labels, "doc_id")
        .select("doc_id", F.when(F.col("quality") == 1, F.col("content_hash")).otherwise("old").alias("content_hash"))
    )


_HASH_KEY = ("doc_id", "content_hash")


def unembedded_documents(spark, folder):
    return embed.unembedded(_fingerprinted(spark, folder), _embedded_set(spark, folder), _HASH_KEY)


def live_embeddings(spark, folder):
    return embed.live_embeddings(_embedded_set(spark, folder), _fingerprinted(spark, folder), _HASH_KEY)


# ---------------------------------------------------------------- application data


def _newest():
    return [F.desc("ts"), F.desc("event_id")]


_RATING_KEY = ("user_id", "event_type")


def _rating_columns(events):
    return events.select(*_RATING_KEY, "event_id", "value")


def latest_ratings(spark, folder):
    return _rating_columns(groups.latest(table(spark, folder, "events"), _RATING_KEY, _newest()))


def upsert_snapshot(spark, folder):
    events = table(spark, folder, "events")
    cut = F.col("ts") < F.lit(UPSERT_CUT).cast("timestamp_ntz")
    before, after = (groups.latest(events.where(side), _RATING_KEY, _newest()) for side in (cut, ~cut))
    return _rating_columns(groups.upsert(before, after, _RATING_KEY))


def late_records(spark, folder):
    """Two batches of records, interleaved in time, some without a user: the newest of each key stays."""
    events = table(spark, folder, "events").withColumn("user_id", F.expr("nullif(user_id % 17, 0)"))
    first, second = (events.where(F.col("event_id") % 2 == side) for side in (0, 1))
    held = groups.latest(first, _RATING_KEY, _newest())
    return _rating_columns(groups.merge_latest(held, second, _RATING_KEY, _newest()))


def _published(spark, folder):
    """A serving table as it was at the cut, and as it should be: one kind of record has gone, one moved on."""
    events = table(spark, folder, "events").withColumn("user_id", F.expr("nullif(user_id % 17, 0)"))
    cut = F.col("ts") < F.lit(UPSERT_CUT).cast("timestamp_ntz")
    held, wanted = (_rating_columns(groups.latest(rows, _RATING_KEY, _newest())) for rows in (events.where(cut), events.where("event_type <> 'error'")))
    return held, wanted


def publish_change_set(spark, folder):
    return changes.change_set(*_published(spark, folder), _RATING_KEY)


def published_rows(spark, folder):
    """The serving table after its change set."""
    held, wanted = _published(spark, folder)
    return changes.apply_changes(held, changes.change_set(held, wanted, _RATING_KEY), _RATING_KEY)


@tables.remembered
def _recorded(spark: SparkSession, folder: str) -> str:
    """Two batches of records, interleaved in time, into one table dealt by its keys."""
    name = f"{_scratch_schema(spark)}.ratings"
    events = table(spark, folder, "events").withColumn("user_id", F.expr("nullif(user_id % 17, 0)"))
    for side in (0, 1):
        jobs.record(spark, name, events.where(F.col("event_id") % 2 == side), _RATING_KEY, _newest(), _parts(spark))
    return name


def recorded_by_part(spark, folder):
    return _rating_columns(spark.table(_recorded(spark, folder)))


def upsert_null_keys(spark, folder):
    """An upsert in which some keys are null: they are replaced like any other."""
    events = table(spark, folder, "events").withColumn("user_id", F.expr("nullif(user_id % 17, 0)"))
    cut = F.col("ts") < F.lit(UPSERT_CUT).cast("timestamp_ntz")
    before, after = (groups.latest(events.where(side), _RATING_KEY, _newest()) for side in (cut, ~cut))
    return _rating_columns(groups.upsert(before, after, _RATING_KEY))


def _watching(spark, folder):
    """Candidates, members and history of groups of users."""
    events = table(spark, folder, "events").withColumn("group_id", F.col("user_id") % 10)
    titles = max(table(spark, folder, "part").count(), 1)
    title = (F.col("event_id") % titles).alias("movie_id")
    kind = F.col("event_type")
    history = events.select(
        "user_id",
        title,
        kind.isin("view", "purchase").alias("watched"),
        F.when(kind == "error", 1.0).otherwise(5.0).alias("rating"),
    )
    candidates = events.where(kind.isin("click", "signup")).select("group_id", title).distinct()
    return candidates, events.select("group_id", "user_id"), history


def group_exclusion(spark, folder):
    return groups.exclude_seen(*_watching(spark, folder))


def group_exclusion_bitmaps(spark, folder):
    return groups.exclude_seen_by_bitmap(*_watching(spark, folder))


def compare_titles(spark, folder):
    compared = search.compare_titles(_movies(spark, folder), COMPARED_IDS)
    return compared.withColumns(
        {
            "release_date": F.col("release_date").cast("string"),
            "genre_names": F.array_join("genre_names", "|"),
            "provider_names": F.array_join("provider_names", "|"),
        }
    )


def title_search(spark, folder):
    return search.title_search(_part_catalogue(spark, folder), SEARCHED_TITLE, image_base=IMAGE_BASE)


@tables.remembered
def _title_index(spark: SparkSession, folder: str) -> tuple[str, str]:
    schema = _scratch_schema(spark)
    names = f"{schema}.titles", f"{schema}.title_postings"
    postings.write_title_index(_part_catalogue(spark, folder), *names, _parts(spark))
    return names


def title_search_indexed(spark, folder):
    return postings.indexed_title_search(spark, *_title_index(spark, folder), SEARCHED_TITLE, image_base=IMAGE_BASE)


def poster_urls(spark, folder):
    path = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 != 1, F.concat(F.lit("/"), F.col("url")))
    return table(spark, folder, "pages").select("page_id", T.poster_url(path, IMAGE_BASE).alias("poster_url"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        crawl_to_bronze,
        resumed_crawl,
        fetch_status_summary,
        fetch_failures,
        success_ratio,
        pages_first_seen_ids,
        listing_source_ids,
        listing_requests,
        listing_filters,
        bronze_reference_list,
        parse_props_json,
        parse_yield,
        payload_drift,
        silver_movies,
        silver_null_counts,
        silver_genres,
        silver_links,
        orphan_links,
        silver_cast,
        silver_cast_merged,
        silver_keywords,
        silver_keywords_merged,
        silver_links_merged,
        silver_reviews,
        silver_reviews_merged,
        silver_reviews_tight,
        silver_links_repeated,
        silver_cast_repeated,
        silver_keywords_repeated,
        silver_reviews_repeated,
        cast_line,
        review_block,
        gold_documents,
        gold_documents_joined,
        gold_profile,
        merged_profile,
        document_fingerprint_dups,
        table_counts,
        changed_records,
        refreshed_links,
        refreshed_cast,
        refreshed_keywords,
        refreshed_reviews,
        refreshed_documents,
        chunk_documents,
        embed_chunks,
        semantic_search,
        vector_top_k,
        vector_top_k_parents,
        pruned_top_k,
        labelled_vector_top_k,
        constrained_top_k,
        unembedded_documents,
        live_embeddings,
        latest_ratings,
        upsert_snapshot,
        upsert_null_keys,
        late_records,
        publish_change_set,
        published_rows,
        recorded_by_part,
        group_exclusion,
        group_exclusion_bitmaps,
        compare_titles,
        title_search,
        title_search_indexed,
        poster_urls,
    )
}
