"""Title search by postings of trigrams: only titles that hold all trigrams of a query are read and tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.operators import search
from docforge.sources import parts, tables

GRAM = 3


def title_postings(catalogue: DataFrame) -> DataFrame:
    """``gram, movie_id`` for each different trigram of a lower-cased title; linear in the title's length."""
    starts = F.sequence(F.lit(0), F.size("letters") - GRAM)
    grams = F.transform(starts, lambda at: F.concat(*[F.get("letters", at + place) for place in range(GRAM)]))
    lettered = catalogue.select("movie_id", F.split(F.lower("title"), "").alias("letters"))
    return lettered.select("movie_id", F.explode(F.when(F.size("letters") >= GRAM, F.array_distinct(grams))).alias("gram"))


def write_title_index(catalogue: DataFrame, titles: str, postings: str, partitions: int) -> None:
    """Store the catalogue dealt by id, and its postings dealt by trigram. A trigram that many titles share is split into several files."""
    spark = catalogue.sparkSession
    parts.write_whole(catalogue, titles, ["movie_id"], partitions)
    parts.write_whole(title_postings(spark.table(titles)), postings, ["gram"], partitions)


def indexed_title_search(spark: SparkSession, titles: str, postings: str, query: str, limit: int = 5, image_base: str = "") -> DataFrame:
    """What ``search.title_search`` gives on the stored catalogue.

    Postings of the query's trigrams are intersected, and the exact test runs over the partitions of the titles that are left.
    Ids may repeat or be null: then more titles are tested, never fewer. A query of less
    than three letters has no trigram and scans all titles.
    """
    wanted = query.strip().lower() if query else ""
    grams = sorted({wanted[at : at + GRAM] for at in range(len(wanted) - GRAM + 1)})
    catalogue = spark.table(titles)
    if grams:
        listed = parts.only(spark, postings, spark.createDataFrame([(gram,) for gram in grams], "gram string"))
        shared = listed.where(F.col("gram").isin(grams)).groupBy("movie_id").agg(F.count("*").alias("n")).where(F.col("n") >= len(grams))
        hits = tables.write_barrier(shared.select("movie_id"), "title-hits")
        near = parts.only(spark, titles, hits)
        catalogue = near.join(hits, parts.same(near, hits, ["movie_id"]), "left_semi")
    return search.title_search(catalogue.drop(parts.PART), query, limit, image_base)
