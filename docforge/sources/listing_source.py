"""A paged listing as a Spark data source: its input partitions are runs of pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docforge.sources.fetchers import Fetcher

NAME = "docforge_listing"
SCHEMA = "page BIGINT, payload STRING, status STRING, error STRING, ingested_at TIMESTAMP"


def listing_source(open_fetcher: Callable[[], Fetcher], outcome: Callable, pause: float = 0.0, tasks: int = 64) -> type[DataSource]:
    """A data source class for the listing behind a fetcher. Options ``first`` and ``last`` are the pages to ask for.

    ``outcome`` turns a fetcher and a request into ``payload, status, error``. The pages are asked for by at most ``tasks`` tasks, each of
    which opens one fetcher, and sleeps ``pause`` seconds before each request.
    """

    class Pages(DataSourceReader):
        def __init__(self, options):
            self.first, self.last = int(options["first"]), int(options["last"])

        def partitions(self) -> list[InputPartition]:
            pages = self.last + 1 - self.first
            runs = min(pages, tasks)
            cuts = [self.first + pages * run // runs for run in range(runs)] + [self.last + 1]
            return [InputPartition(run) for run in zip(cuts, cuts[1:], strict=False)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            fetcher = open_fetcher()
            for page in range(*partition.value):
                time.sleep(pause)
                yield (page, *outcome(fetcher, {"page": page})[:3], datetime.now(timezone.utc))

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Pages(self.options)

    return Listing


def read_pages(spark: SparkSession, source: type[DataSource], first: int, last: int) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(NAME).option("first", first).option("last", last).load()
