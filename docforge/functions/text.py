"""Text expressions: null handling, image links, document assembly, chunking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section labels and separators of an assembled document.
SECTION_BREAK = "\n\n"
TAGLINE = "Tagline: "
GENRES = "Genres: "
RUNTIME = "Runtime: "
RUNTIME_UNIT = " minutes"
OVERVIEW = "Overview: "
THEMES = "Themes: "
CAST = "Cast: "
REVIEWS = "What viewers said:\n"
REVIEW_BY = "Review by "
NO_AUTHOR = "anonymous"

POSTER_SIZE = "w342"


def blank_to_null(text: Column) -> Column:
    """An empty string means the field was absent."""
    return F.nullif(text, F.lit(""))


def poster_url(path: Column, base: str, size: str = POSTER_SIZE) -> Column:
    """Full image link for a relative path; null when there is no path."""
    return F.concat(F.lit(f"{base.rstrip('/')}/{size}"), blank_to_null(path))


def credit_label(name: Column, character: Column) -> Column:
    """``name as character``, or just the name; concat_ws skips a null character."""
    return F.concat_ws(" as ", name, character)


def review_text(author: Column, content: Column) -> Column:
    return F.concat(
        F.lit(REVIEW_BY), F.coalesce(author, F.lit(NO_AUTHOR)), F.lit(":\n"), content
    )


def _names_section(label: str, names: Column) -> Column:
    # size() of a null array is null or -1; neither is above 0.
    return F.when(F.size(names) > 0, F.concat(F.lit(label), F.concat_ws(", ", names)))


def document_text(
    *,
    title: Column,
    tagline: Column,
    release_date: Column,
    genre_names: Column,
    runtime_minutes: Column,
    overview: Column,
    keyword_names: Column,
    cast_line: Column,
    reviews_block: Column,
) -> Column:
    """One labelled document; a section whose source is null disappears.

    ``concat`` is null as soon as one part is null and ``concat_ws`` skips
    nulls, so the sections need no explicit tests.
    """
    year = F.concat(F.lit(" ("), F.year(release_date).cast("string"), F.lit(")"))
    return F.concat_ws(
        SECTION_BREAK,
        F.concat(title, F.coalesce(year, F.lit(""))),
        F.concat(F.lit(TAGLINE), tagline),
        _names_section(GENRES, genre_names),
        F.concat(F.lit(RUNTIME), runtime_minutes.cast("string"), F.lit(RUNTIME_UNIT)),
        F.concat(F.lit(OVERVIEW), overview),
        _names_section(THEMES, keyword_names),
        F.concat(F.lit(CAST), cast_line),
        F.concat(F.lit(REVIEWS), reviews_block),
    )


def fingerprint(text: Column) -> Column:
    """Lower-case hex SHA-256, used to detect changed documents."""
    return F.sha2(text, 256)
