"""Serving database access through Spark's JDBC source."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


# What may hold a mark as text, or the mark itself.
_MARKS = re.compile(
    r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|%s""", re.DOTALL
)


def _mark(found: re.Match) -> str:
    return "?" if found[0] == "%s" else found[0]


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    options: Mapping[str, str] | None = None,
    split_by: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A table as a DataFrame; filters and columns are pushed to the database.

    ``split_by`` with ``bounds`` reads in that many range slices at once.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {}))
    if split_by:
        low, high = bounds
        reader = reader.options(
            partitionColumn=split_by, lowerBound=str(low), upperBound=str(high), numPartitions=partitions
        )
    return reader.load()


def run_query(
    spark: SparkSession,
    sql: str,
    params: Sequence[Any] = (),
    tables: Mapping[str, DataFrame] | None = None,
) -> list[dict]:
    """Rows of a parameterised SELECT as dicts; ``?`` or ``%s`` mark the parameters.

    Marks inside quotes and comments are text. ``tables`` names the frames the
    statement reads, usually from ``read_table``. The rows come to the driver:
    meant for lookups.
    """
    for name, frame in (tables or {}).items():
        frame.createOrReplaceTempView(name)
    return [row.asDict() for row in spark.sql(_MARKS.sub(_mark, sql), args=list(params)).collect()]


def write_table(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "append",
    options: Mapping[str, str] | None = None,
    connections: int = 8,
) -> int:
    """Append to or replace a table over at most ``connections`` connections.

    Returns the number of rows. A replace keeps the table and its grants. The
    frame is counted apart from the write, so pass one read from a table.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = df.count()
    (
        df.coalesce(connections)
        .write.format("jdbc")
        .mode(mode)
        .options(url=url, dbtable=table, truncate="true", **(options or {}))
        .save()
    )
    return rows


def merge_statements(table: str, columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    """SQL by which a database takes over ``<table>__changes``, to be run in one transaction.

    Removed and changed rows go, added and changed ones come, and the changes are emptied. Plain
    SQL; null keys are equal to each other.
    """
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    both = " AND ".join(f"(t.{quoted(k)} = c.{quoted(k)} OR (t.{quoted(k)} IS NULL AND c.{quoted(k)} IS NULL))" for k in keys)
    listed = ", ".join(map(quoted, columns))
    staged = f"{table}__changes"
    return [
        f"DELETE FROM {table} AS t WHERE EXISTS (SELECT 1 FROM {staged} AS c WHERE {both})",
        f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staged} WHERE \"change\" <> 'removed'",
        f"DELETE FROM {staged}",
    ]
