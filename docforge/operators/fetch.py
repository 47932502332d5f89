"""Partitioned fan-out fetch: one row out per request, failures kept as rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.operators import groups
from docforge.schemas import BRONZE_PAYLOADS, FETCH_LEDGER
from docforge.sources import tables
from docforge.sources.fetchers import Fetcher, FetchError, NotFoundError, TransientError

# Fetched text is handed back to the JVM in pieces of about this size, so a
# task holds one piece and not one whole batch of payloads.
FLUSH_CHARS = 8_000_000


def fetch_records(
    requests: DataFrame,
    open_fetcher: Callable[[], Fetcher],
    partitions: int | None = 4,
    key: str = "movie_id",
    max_requests_per_second: float | None = None,
) -> DataFrame:
    """Fetch every request; returns the bronze payload schema.

    ``partitions`` caps the concurrent connections, and each task spaces its
    calls so that all of them together stay below the rate given. With ``None``
    the requests stay where they are, for sources that need no such cap. The
    result is lazy and calls the service each time it runs: write it once, read
    that table afterwards. A retried task fetches its keys again.
    """
    return _fetched(requests, open_fetcher, partitions, key, max_requests_per_second).drop("retry")


def _fetched(requests, open_fetcher, partitions, key, max_requests_per_second) -> DataFrame:
    """Bronze rows, and ``retry``: whether the failure may pass."""
    if max_requests_per_second and partitions is None:
        raise ValueError("a request rate needs a number of partitions")
    pause = partitions / max_requests_per_second if max_requests_per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = open_fetcher()
        started = datetime.now(timezone.utc)
        last_call = float("-inf")
        rows, chars = [], 0
        for batch in batches:
            for request in batch.to_dict("records"):
                time.sleep(max(0.0, last_call + pause - time.monotonic()))
                last_call = time.monotonic()
                row = outcome(fetcher, request)
                rows.append((int(request[key]), *row[:3], started, row[3]))
                chars += len(row[0] or "")
                if chars > FLUSH_CHARS:
                    yield _frame(rows)
                    rows, chars = [], 0
            if rows:
                yield _frame(rows)
                rows, chars = [], 0

    spread = requests if partitions is None else requests.repartition(partitions)
    return spread.mapInPandas(run, f"{BRONZE_PAYLOADS}, retry BOOLEAN")


def outcome(fetcher: Fetcher, request: dict) -> tuple[str | None, str, str | None, bool]:
    """``payload, status, error`` of one request, and whether its failure may pass."""
    try:
        return json.dumps(fetcher.fetch(request)), "success", None, False
    except NotFoundError as missing:
        return None, "not_found", str(missing), False
    except FetchError as failed:
        return None, "error", str(failed), isinstance(failed, TransientError)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame.from_records(rows, columns=["movie_id", "payload", "status", "error", "ingested_at", "retry"])


# ---------------------------------------------------------------- waves


def outstanding(requests: DataFrame, ledger: DataFrame, attempts: int, slices: int, key: str = "movie_id") -> DataFrame:
    """Requests that no answer is held for, with ``attempt``, how often they were made, and ``slice``, the wave they belong to.

    An answer is a payload, a missing key, or a failure that won't pass. Of the ledger only
    keys and marks are read, one row per key and task is shuffled.
    """
    made = ledger.groupBy(F.col("movie_id").alias(key)).agg(F.count("*").alias("attempt"), F.min("retry").alias("again"))
    slice_ = F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")
    return (
        requests.join(made, key, "left")
        .where(F.col("again").isNull() | (F.col("again") & (F.col("attempt") < attempts)))
        .withColumn("attempt", F.coalesce("attempt", F.lit(0)).cast("int"))
        .drop("again")
        .withColumn("slice", slice_)
    )


def fetch_in_waves(
    requests: DataFrame,
    open_fetcher: Callable[[], Fetcher],
    ledger: str,
    slices: int = 8,
    attempts: int = 3,
    partitions: int | None = 4,
    key: str = "movie_id",
    max_requests_per_second: float | None = None,
    most_waves: int | None = None,
) -> bool:
    """Fetch every request into the table ``ledger``, wave by wave; whether none is left.

    A wave is one slice of the keys, and is committed as a whole. What the ledger answers isn't asked for
    again, so a run that was cut short, or that ends after ``most_waves``, goes on where it stood. A failure that may pass
    comes back after all slices had their turn, up to ``attempts`` times in all; the request row
    then says so in ``attempt``. Keys are unique in ``requests``.
    """
    spark = requests.sparkSession
    if not spark.catalog.tableExists(ledger):
        spark.createDataFrame([], FETCH_LEDGER).write.format("parquet").saveAsTable(ledger)
    wave = spark.table(ledger).agg(F.max("wave")).first()[0] or 0
    while most_waves is None or most_waves > 0:
        todo = outstanding(requests, spark.table(ledger), attempts, slices, key)
        turn = todo.agg(F.min(F.struct("attempt", "slice"))).first()[0]
        if turn is None:
            return True
        now = tables.write_barrier(todo.where((F.col("attempt") == turn.attempt) & (F.col("slice") == turn.slice)).drop("slice"), "wave")
        wave += 1
        _fetched(now, open_fetcher, partitions, key, max_requests_per_second).withColumn("wave", F.lit(wave)).write.format("parquet").mode("append").saveAsTable(ledger)
        spark.catalog.refreshTable(ledger)
        tables.drop_barrier(now)
        most_waves = most_waves and most_waves - 1
    return outstanding(requests, spark.table(ledger), attempts, slices, key).isEmpty()


def answers(ledger: DataFrame) -> DataFrame:
    """The bronze rows of a fetch ledger: the last one of each key."""
    return groups.latest(ledger, ["movie_id"], [F.desc("wave")]).drop("wave", "retry")
