"""Snapshot tables: namespace, write, swap, counts, and written barriers."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
from collections.abc import Callable
from contextlib import suppress
from functools import reduce, wraps
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# Of all written tables and barriers; texts take about half the room that Spark's default leaves them.
COMPRESSION = "zstd"


def ensure_namespace(spark: SparkSession, catalog: str, schema: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {catalog}.{schema}{place}")


def write_snapshot(
    df: DataFrame,
    table: str,
    buckets: int = 0,
    key: str = "movie_id",
    gate: Callable[[DataFrame], object] | None = None,
) -> int:
    """Replace ``table`` and its schema by ``df``; returns the rows written.

    The new snapshot is written beside the old one. ``gate`` sees it there and may
    raise. Only then names are exchanged, and the old snapshot is dropped last: a
    failure before leaves the old rows in place, and ``df`` may read ``table``.
    Where a crash fell between the two renames, the next call puts the old
    snapshot back first (``recover``).

    Rows are counted while they are written, with no second scan. With
    ``buckets`` above 0 later joins and aggregates on ``key`` need no shuffle;
    rows are gathered by bucket first, so each bucket becomes one file.
    """
    spark = df.sparkSession
    recover(spark, table)
    fresh, old = side_names(table)
    try:
        rows = _write(df, fresh, buckets, key)
        if gate:
            gate(spark.table(fresh))
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    exists = spark.catalog.tableExists(table)
    if exists:
        rename(spark, table, old)
    rename(spark, fresh, table)
    if exists:
        spark.sql(f"DROP TABLE {old}")
    spark.catalog.refreshTable(table)
    return rows


# What an exchange leaves behind when it is cut short; the time in nanoseconds follows, in digits of one length, so names sort by age.
_OLD, _NEW = "__old_", "__new_"


def side_names(table: str) -> tuple[str, str]:
    """The names of a new and of an old snapshot during an exchange."""
    stamp = f"{time.time_ns():020d}"
    return f"{table}{_NEW}{stamp}", f"{table}{_OLD}{stamp}"


def leftovers(spark: SparkSession, table: str) -> dict[str, list[str]]:
    """Names that interrupted writes of ``table`` left, of both kinds, the oldest first."""
    schema, _, name = table.rpartition(".")
    if not schema or not spark.catalog.databaseExists(schema):
        return {_OLD: [], _NEW: []}
    found = [row.tableName for row in spark.sql(f"SHOW TABLES IN {schema} LIKE '{name}__*'").collect()]
    kinds = {kind: sorted((each for each in found if each.startswith(f"{name.lower()}{kind}")), key=_age) for kind in (_OLD, _NEW)}
    return {kind: [f"{schema}.{each}" for each in names] for kind, names in kinds.items()}


def _age(name: str) -> tuple[int, str]:
    stamp = re.split("__(?:old|new)_", name)[-1]
    return (int(stamp) if stamp.isdigit() else -1, stamp)


def recover(spark: SparkSession, table: str) -> bool:
    """Mend an interrupted write; whether a snapshot got its name back.

    If ``table`` lost its name between the two renames, the newest old snapshot takes it again. All else
    that interrupted writes left goes: older snapshots, and new ones that never got the
    name. One job at a time writes a table, so none of them is being written.
    """
    left = leftovers(spark, table)
    lost = not spark.catalog.tableExists(table) and bool(left[_OLD])
    if lost:
        rename(spark, left[_OLD].pop(), table)
    for name in left[_OLD] + left[_NEW]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return lost


def _write(df: DataFrame, table: str, buckets: int, key: str) -> int:
    seen = Observation()
    if buckets:
        df = df.repartition(buckets, key)
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("parquet").option("compression", COMPRESSION)
    if buckets:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(table)
    return seen.get["rows"]


def rename(spark: SparkSession, table: str, name: str) -> None:
    # The new name is resolved inside the table's own catalog.
    spark.sql(f"ALTER TABLE {table} RENAME TO {'.'.join(name.split('.')[-2:])}")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rows`` for every table; Parquet answers from file footers."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for written barriers: the one the cluster names for checkpoints.

    Only a local session may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="docforge-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def write_barrier(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the files.

    What follows neither recomputes ``df`` nor depends on its executors.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _barriers[id(out)] = path
    if not _at_exit:
        _at_exit.append(atexit.register(_drop_rest, spark))
    return out


_barriers: dict[int, str] = {}
_at_exit: list = []


def _drop_rest(spark: SparkSession) -> None:
    """Barriers that nobody dropped go when the program ends."""
    with suppress(Exception):  # the session may have ended before
        for path in _barriers.values():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def overwrite_partitions(written: DataFrame, table: str) -> None:
    """Replace those partitions of ``table`` that a barrier has rows for.

    The mode is a setting, and Spark takes it from no option here; it is set in a
    session of its own, so the caller's stays as it is.
    """
    own = written.sparkSession.newSession()
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    rows = own.read.schema(written.schema).parquet(_barriers[id(written)])
    rows.write.mode("overwrite").insertInto(table)


def release(spark: SparkSession) -> None:
    """Let the driver collect plans that have ended, so that their shuffle files go; else they stay as long as its heap has room.

    The first pass frees what Python held; only the one after it reaches the plans themselves.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def drop_barrier(written: DataFrame) -> None:
    """Delete a barrier's files; nothing derived from it may run afterwards."""
    path = _barriers.pop(id(written))
    spark = written.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def files_of(spark: SparkSession, folder: str) -> tuple:
    """What lies in a folder: names, sizes and times, through the file system that Spark reads it by."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    files = []
    while found.hasNext():
        each = found.next()
        files.append((each.getPath().toString(), each.getLen(), each.getModificationTime()))
    return tuple(sorted(files))


def remembered(make: Callable) -> Callable:
    """``make(spark, folder, ...)``, once for each state of a folder's files, and for what else it is given, in a session.

    Files that change are read again. What ``make`` writes stays until the program ends.
    """
    held: dict[tuple, object] = {}

    @wraps(make)
    def get(spark: SparkSession, folder: str, *more: str):
        key = spark.sparkContext.applicationId, folder, files_of(spark, folder), *more
        if key not in held:
            held[key] = make(spark, folder, *more)
        return held[key]

    return get


def collect_small(df: DataFrame, key: str, value: str) -> dict:
    """A grouped summary as a dict; only for frames already reduced to a few rows."""
    return {row[key]: row[value] for row in df.select(key, value).collect()}

