"""Bronze payload text to typed records, with the yield by cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.schemas import PAYLOAD


def _usable(d: Column) -> Column:
    """A title must be present (it may be empty); an overview must have text."""
    return d["title"].isNotNull() & (F.length(d["overview"]) > 0)


def parse_payloads(bronze: DataFrame) -> DataFrame:
    """Successful payloads as ``movie_id, ingested_at, d``.

    Malformed text parses to nulls, and a value of the wrong type becomes a
    null field; the row goes only when title or overview is missing. The test
    sits inside the generator: as a filter above the projection it would be
    pushed down and parse every text again.
    """
    parsed = F.array(F.from_json("payload", PAYLOAD))
    return bronze.where(F.col("status") == "success").select(
        "movie_id", "ingested_at", F.explode(F.filter(parsed, _usable)).alias("d")
    )


def parse_yield(bronze: DataFrame) -> DataFrame:
    """Rows per outcome of the parse: ``outcome, rows``."""
    d = F.from_json("payload", PAYLOAD)
    outcome = (
        F.when(F.col("status") != "success", F.concat(F.lit("fetch_"), F.col("status")))
        .when(_usable(d), "parsed")
        # Only rows that failed get here, so the second look at the text is rare.
        .when(F.json_object_keys("payload").isNull(), "bad_json")
        .when(d["title"].isNull(), "no_title")
        .otherwise("no_overview")
    )
    return (
        bronze.select(outcome.alias("outcome"))
        .groupBy("outcome")
        .agg(F.count("*").alias("rows"))
    )
