"""Expressions over one parsed payload.

Child collections live inside their parent's row, so ranking, cutting and
de-duplicating them is done there: no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docforge.functions.text import blank_to_null

MIN_REVIEW_CHARS = 100  # reviews must be longer than this
MAX_KEYWORDS = 15  # keyword names kept on the parent row


def no_strings() -> Column:
    return F.array().cast("array<string>")


def genre_names(d: Column) -> Column:
    """Null when the payload carries no genre list."""
    return d["genres"]["name"]


def keyword_names(d: Column) -> Column:
    return F.slice(F.coalesce(d["keywords"]["keywords"]["name"], no_strings()), 1, MAX_KEYWORDS)


def provider_names(d: Column) -> Column:
    offers = d["watch/providers"]["results"]["US"]["flatrate"]
    return F.coalesce(offers["provider_name"], no_strings())


def release_date(d: Column) -> Column:
    return F.try_to_date(blank_to_null(d["release_date"]))


def ranked_cast(d: Column, limit: int) -> Column:
    """The ``limit`` top-billed members, best first.

    Field order is the ranking: known billing before unknown, then billing,
    person, character and name, so equal rank means equal rows.
    """
    usable = F.filter(
        d["credits"]["cast"], lambda c: c["id"].isNotNull() & c["name"].isNotNull()
    )
    keyed = F.transform(
        usable,
        lambda c: F.struct(
            c["order"].isNull().alias("unbilled"),
            c["order"].alias("billing"),
            c["id"].alias("person_id"),
            blank_to_null(c["character"]).alias("character_name"),
            c["name"].alias("name"),
        ),
    )
    return F.slice(F.sort_array(keyed), 1, limit)


def ranked_reviews(d: Column, limit: int) -> Column:
    """The ``limit`` longest reviews above the minimum length, longest first.

    Rank uses the whole content; truncation is left to the caller.
    """
    usable = F.filter(
        d["reviews"]["results"], lambda r: F.length(r["content"]) > MIN_REVIEW_CHARS
    )
    keyed = F.transform(
        usable,
        lambda r: F.struct(
            (-F.length(r["content"])).alias("shortness"),
            r["id"].alias("review_id"),
            r["author"].alias("author"),
            r["content"].alias("content"),
            F.try_to_timestamp(r["created_at"]).alias("created_at"),
        ),
    )
    return F.slice(F.sort_array(keyed), 1, limit)
