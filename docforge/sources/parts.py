"""Tables dealt to partitions by a hash of their keys, of which only touched partitions are read and written again."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.sources import tables

PART = "part"
_NUMBER, _KEYS = "docforge.partitions", "docforge.keys"


def part_of(keys: Sequence[str], partitions: int) -> Column:
    """The partition of a row's keys. Null keys have one of their own choice, like any other."""
    return F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int").alias(PART)


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of all keys, nulls equal to each other."""
    return reduce(Column.__and__, [left[key].eqNullSafe(right[key]) for key in keys])


def layout(spark: SparkSession, table: str) -> tuple[list[str], int] | None:
    """The keys and the number of partitions that a table was dealt by; null for other tables.

    They are read from the table, never from settings: a setting that changes later can't
    send a row to a partition of another numbering.
    """
    if not spark.catalog.tableExists(table):
        return None
    held = {row.key: row.value for row in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return (held[_KEYS].split(","), int(held[_NUMBER])) if _NUMBER in held else None


def write_whole(df: DataFrame, table: str, keys: Sequence[str], partitions: int, gathered: bool = False) -> int:
    """Replace ``table`` by the rows of ``df``, dealt by ``keys``; returns how many there are.

    The rows are written to the shared folder first, so ``df`` may read the table; where there is no table yet, they go straight
    into it. A table dealt by these keys keeps its number of partitions
    and is overwritten in place. Others give way: an undealt one keeps its rows under another name until the new one
    stands, and ``tables.recover`` puts it back. (Renaming would leave a partitioned table's partitions behind in some catalogs.)
    Each partition is gathered before it is written; Spark splits one that is large. ``gathered`` says that rows of one
    partition lie together already, as they do when they are made row by row from a table dealt alike.
    """
    spark = df.sparkSession
    tables.recover(spark, table)
    held = layout(spark, table)
    kept = held is not None and held[0] == list(keys)
    number = held[1] if kept else partitions
    columns = [name for name in (spark.table(table).columns if kept else df.columns) if name != PART]
    dealt = df.select(*columns, part_of(keys, number))
    dealt = dealt if gathered else dealt.hint("rebalance", PART)
    if held is None and not spark.catalog.tableExists(table):
        _create(dealt, table, keys, number)
        return spark.table(table).count()
    rows = tables.write_barrier(dealt, "parts")
    if kept:
        _exchange(rows, table, [row[PART] for row in spark.table(table).select(PART).distinct().collect()])
    else:
        old = None
        if held:
            spark.sql(f"DROP TABLE {table}")
        elif spark.catalog.tableExists(table):
            old = tables.side_names(table)[1]
            tables.rename(spark, table, old)
        _create(rows, table, keys, number)
        if old:
            spark.sql(f"DROP TABLE {old}")
    tables.drop_barrier(rows)
    spark.catalog.refreshTable(table)
    return spark.table(table).count()  # from the files' footers


def _create(rows: DataFrame, table: str, keys: Sequence[str], number: int) -> None:
    made = rows.writeTo(table).using("parquet").option("compression", tables.COMPRESSION).partitionedBy(F.col(PART))
    made.tableProperty(_NUMBER, str(number)).tableProperty(_KEYS, ",".join(keys)).create()


def _exchange(rows: DataFrame, table: str, before: Iterable[int]) -> None:
    """The partitions ``before`` of a table replaced by written rows of its layout; those without rows go."""
    spark = rows.sparkSession
    tables.overwrite_partitions(rows, table)
    for empty in set(before) - {row[PART] for row in rows.select(PART).distinct().collect()}:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({PART} = {empty})")


def pieces(spark: SparkSession, table: str, size: int, most: int) -> int:
    """Into how many pieces a table is to be cut so that each has about ``size`` bytes, but no more than ``most``."""
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    held = sum(length for _, length, _ in tables.files_of(spark, place))
    return max(1, min(most, -(-held // size)))


def only(spark: SparkSession, table: str, touched: DataFrame) -> DataFrame:
    """The partitions of ``table`` that can hold a key of ``touched``; no other is read."""
    return spark.table(table).where(F.col(PART).isin(_touched(spark, table, touched)))


def _touched(spark: SparkSession, table: str, touched: DataFrame) -> list[int]:
    keys, partitions = layout(spark, table)
    return sorted(row[PART] for row in touched.select(part_of(keys, partitions)).distinct().collect())  # no more than the table has


def rewrite(spark: SparkSession, table: str, touched: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the partitions that hold a key of ``touched`` by ``merge`` of their rows; returns their numbers.

    No other partition is read. The new rows are written to the shared folder first, so a failure before the exchange leaves the
    table as it was; the exchange itself goes partition by partition, and running it again gives the same rows.
    """
    return _rewrite(spark, table, _touched(spark, table, touched), merge)


def _rewrite(spark: SparkSession, table: str, parts: list[int], merge: Callable[[DataFrame], DataFrame]) -> list[int]:
    keys, partitions = layout(spark, table)
    if parts:
        held = spark.table(table)
        merged = merge(held.where(F.col(PART).isin(parts)).drop(PART))
        columns = [name for name in held.columns if name != PART]
        rows = tables.write_barrier(merged.select(*columns, part_of(keys, partitions)).hint("rebalance", PART), "parts")
        _exchange(rows, table, parts)
        tables.drop_barrier(rows)
        spark.catalog.refreshTable(table)
    return parts


def replace_keys(spark: SparkSession, table: str, stale: DataFrame, fresh: DataFrame, pieces: int = 1) -> list[int]:
    """``fresh`` rows in place of those whose keys ``stale`` holds; ``fresh`` has no other keys.

    With ``pieces`` the partitions are replaced so many runs after each other, so the copies beside the table are as much smaller. A
    failure between two runs leaves the partitions of those before replaced.
    """
    keys, number = layout(spark, table)
    gone = stale.select(*keys).distinct()
    parts = _touched(spark, table, gone)
    for run in range(pieces):
        some = parts[run::pieces]
        here = part_of(keys, number).isin(some)
        old, new = (gone, fresh) if pieces == 1 else (gone.where(here), fresh.where(here))
        _rewrite(spark, table, some, lambda held, old=old, new=new: held.join(old, same(held, old, keys), "left_anti").unionByName(new))
        if pieces > 1:
            tables.release(spark)
    return parts
