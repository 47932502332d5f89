"""One fingerprinted document per movie, from silver tables or straight from the parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import payload as P
from docforge.functions import text as T


def cast_lines(cast: DataFrame) -> DataFrame:
    """``movie_id, cast_line`` in billing order.

    The order is fixed inside the aggregate, so it cannot depend on how
    partial lists meet. Groups are small: the cast table is already cut.
    """
    credit = F.struct("billing_order", T.credit_label(F.col("name"), F.col("character_name")).alias("label"))
    return cast.groupBy("movie_id").agg(
        F.array_join(F.sort_array(F.collect_list(credit))["label"], ", ").alias("cast_line")
    )


def review_blocks(reviews: DataFrame) -> DataFrame:
    """``movie_id, reviews_block, review_count`` in review rank order."""
    entry = F.struct("review_rank", T.review_text(F.col("author"), F.col("content")).alias("body"))
    return reviews.groupBy("movie_id").agg(
        F.array_join(F.sort_array(F.collect_list(entry))["body"], T.SECTION_BREAK).alias("reviews_block"),
        F.count("*").cast("int").alias("review_count"),
    )


def _finish(assembled: DataFrame, review_count: Column) -> DataFrame:
    return assembled.select(
        "movie_id",
        "title",
        "doc_text",
        T.fingerprint(F.col("doc_text")).alias("content_hash"),
        review_count.cast("int").alias("review_count"),
        F.length("doc_text").alias("char_length"),
        F.current_timestamp().alias("built_at"),
    )


def documents(movies: DataFrame, cast: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents from the silver tables.

    Both right sides hold one row per movie, so no movie multiplies. With
    tables bucketed by ``movie_id`` the plan needs no shuffle.
    """
    text = T.document_text(
        cast_line=F.col("cast_line"),
        reviews_block=F.col("reviews_block"),
        **{
            name: F.col(name)
            for name in (
                "title",
                "tagline",
                "release_date",
                "genre_names",
                "runtime_minutes",
                "overview",
                "keyword_names",
            )
        },
    )
    joined = movies.join(cast_lines(cast), "movie_id", "left").join(
        review_blocks(reviews), "movie_id", "left"
    )
    return _finish(
        joined.select("movie_id", "title", text.alias("doc_text"), "review_count"),
        F.ifnull("review_count", F.lit(0)),
    )


def documents_from_parsed(
    parsed: DataFrame,
    cast_limit: int = 10,
    review_limit: int = 8,
    review_char_limit: int = 4000,
) -> DataFrame:
    """The same documents in one narrow pass over the parsed rows.

    Needs ``movie_id`` to be unique there. Reads each payload once and moves
    no row between partitions, whatever the size of the catalogue.
    """
    d = F.col("d")
    sections = parsed.select(
        "movie_id",
        d["title"].alias("title"),
        T.blank_to_null(d["tagline"]).alias("tagline"),
        P.release_date(d).alias("release_date"),
        P.genre_names(d).alias("genre_names"),
        d["runtime"].alias("runtime_minutes"),
        d["overview"].alias("overview"),
        P.keyword_names(d).alias("keyword_names"),
        F.transform(
            P.ranked_cast(d, cast_limit), lambda c: T.credit_label(c["name"], c["character_name"])
        ).alias("credits"),
        F.transform(
            P.ranked_reviews(d, review_limit),
            lambda r: T.review_text(r["author"], F.left(r["content"], F.lit(review_char_limit))),
        ).alias("bodies"),
    )

    def joined_or_null(items: str, separator: str) -> Column:
        return F.when(F.size(items) > 0, F.array_join(items, separator))

    text = T.document_text(
        title=F.col("title"),
        tagline=F.col("tagline"),
        release_date=F.col("release_date"),
        genre_names=F.col("genre_names"),
        runtime_minutes=F.col("runtime_minutes"),
        overview=F.col("overview"),
        keyword_names=F.col("keyword_names"),
        cast_line=joined_or_null("credits", ", "),
        reviews_block=joined_or_null("bodies", T.SECTION_BREAK),
    )
    return _finish(
        sections.select("movie_id", "title", text.alias("doc_text"), F.size("bodies").alias("n")),
        F.when(F.col("n") > 0, F.col("n")).otherwise(0),
    )
