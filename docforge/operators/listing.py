"""Paged listings: request, parse, early stop, first-seen ids, filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.operators.fetch import fetch_records, outcome
from docforge.schemas import LISTING
from docforge.sources import tables
from docforge.sources.fetchers import Fetcher
from docforge.sources.listing_source import listing_source, read_pages

# Limits of the external listing.
RESULTS_PER_PAGE = 20
MAX_PAGE = 500
MIN_VOTES = 50

#: Tasks that a wave of pages is dealt to, for each task that runs at once.
TASKS_PER_SLOT = 4


def check_page(page: int) -> int:
    if not 1 <= page <= MAX_PAGE:
        raise ValueError(f"page must be between 1 and {MAX_PAGE} (got {page})")
    return page


def fetch_pages(
    spark: SparkSession,
    open_fetcher: Callable[[], Fetcher],
    pages: int,
    partitions: int = 4,
    max_requests_per_second: float | None = None,
) -> DataFrame:
    """Pages 1..``pages`` fetched in parallel, as bronze rows keyed by ``page``."""
    requests = spark.range(1, check_page(pages) + 1).select(F.col("id").alias("page"))
    raw = fetch_records(requests, open_fetcher, partitions, "page", max_requests_per_second)
    return raw.withColumnRenamed("movie_id", "page")


def fetch_until_stop(
    spark: SparkSession,
    open_fetcher: Callable[[], Fetcher],
    most_pages: int,
    max_requests_per_second: float | None = None,
) -> DataFrame:
    """Pages in waves of doubling size, until the listing ends; bronze rows keyed by ``page``.

    The waves end at page 1, 2, 4, 8 ..., so fewer than twice the pages up to the end are asked for. Each wave is
    written before its end is looked for, and no page is asked for twice. A page that failed doesn't end the listing.
    """
    slots = spark.sparkContext.defaultParallelism
    pause = slots / max_requests_per_second if max_requests_per_second else 0.0
    source = listing_source(open_fetcher, outcome, pause, TASKS_PER_SLOT * slots)
    done, last, ended = None, 0, False
    while last < most_pages and not ended:
        first, last = last + 1, min(max(2 * last, 1), most_pages)
        wave = tables.write_barrier(read_pages(spark, source, first, last), "pages")
        ended = not parse_pages(wave).where((F.col("status") == "success") & _ends_here()).isEmpty()
        done = wave if done is None else done.union(wave)
    return done


def _ends_here():
    """A page without results, or the last by its own count."""
    return ~(F.coalesce(F.size("results"), F.lit(0)) > 0) | F.coalesce(F.col("page") >= F.col("total_pages"), F.lit(False))


def parse_pages(raw: DataFrame) -> DataFrame:
    """Listing text to ``page, status, total_pages, results``; a non-integer id becomes null."""
    return raw.select("page", "status", F.from_json("payload", LISTING).alias("body")).select(
        "page", "status", "body.total_pages", "body.results"
    )


def until_stop(pages: DataFrame) -> DataFrame:
    """Pages up to the end of the listing.

    The end is the first loaded page that has no results or is the last by its
    own ``total_pages``. The cut is a one-value subquery, not a join.
    """
    has_results = F.coalesce(F.size("results"), F.lit(0)) > 0
    ends_here = ~has_results | (F.col("page") >= F.col("total_pages"))
    stop = pages.where((F.col("status") == "success") & ends_here).agg(F.min("page")).scalar()
    return pages.where(F.col("page") <= F.coalesce(stop, F.lit(2**39 - 1)))


def require_pages(pages: DataFrame) -> DataFrame:
    """Raise when a page before the end of the listing failed to load."""
    lost = until_stop(pages).where(F.col("status") != "success").agg(F.count("*")).first()[0]
    if lost:
        raise RuntimeError(f"{lost} listing pages failed to load")
    return pages


def first_seen_ids(pages: DataFrame) -> DataFrame:
    """Distinct ids with the place they were first listed: ``movie_id, page, position``.

    Order by ``page, position`` to get first-seen order. Page and position are
    packed into one long (24 bits hold the position within a page), so that
    the aggregate runs as a hash aggregate with map-side combine and an id
    listed very often costs one row per task.
    """
    place = F.shiftleft(F.col("page").cast("long"), 24) + F.col("pos")
    return (
        until_stop(pages)
        # The outer form, because Spark adds a size test below the plain one and
        # would parse the listing text for it once more. Its null rows go next.
        .select("page", F.posexplode_outer("results.id").alias("pos", "movie_id"))
        .where(F.col("movie_id").isNotNull())
        .groupBy("movie_id")
        .agg(F.min(place).alias("place"))
        .select(
            "movie_id",
            F.shiftright("place", 24).alias("page"),
            F.col("place").bitwiseAND(F.lit(2**24 - 1)).cast("int").alias("position"),
        )
    )


def require_rows(ids: DataFrame) -> DataFrame:
    if ids.isEmpty():
        raise RuntimeError("the listing returned no ids; check the credential and the network")
    return ids


def listing_page(
    catalogue: DataFrame,
    page: int = 1,
    min_votes: int = MIN_VOTES,
    include_adult: bool = False,
    **ranges: object,
) -> DataFrame:
    """One page of the catalogue by popularity; any page from 1 on.

    ``ranges`` are ``<column>_gte`` / ``<column>_lte`` bounds, which replace
    ``min_votes`` where they name ``vote_count``.
    """
    bounds = {"vote_count_gte": min_votes, **ranges}
    rows = catalogue if include_adult else catalogue.where(~F.col("adult"))
    for name, value in bounds.items():
        column, _, side = name.rpartition("_")
        if side not in ("gte", "lte"):
            raise ValueError(f"unknown filter {name!r}")
        rows = rows.where(F.col(column) >= value if side == "gte" else F.col(column) <= value)
    if page < 1:
        raise ValueError(f"page must be at least 1 (got {page})")
    return (
        rows.orderBy(F.desc("popularity"), "movie_id")
        .offset((page - 1) * RESULTS_PER_PAGE)
        .limit(RESULTS_PER_PAGE)
    )
