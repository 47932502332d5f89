"""Words, hashes, scratch folders and files that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import time
from collections.abc import Iterable
from contextlib import suppress
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.sources.tables import shared_root

#: Entries that a task remembers per memo before it starts anew; bounds memory, changes no result.
REMEMBERED = 200_000


class Memo(dict):
    """A function's values, remembered up to a bound."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.function(key)
        return value


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; bytes split at exactly these six characters."""
    return text.split() if text else []


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _letters() -> np.ndarray:
    """A random number for each byte at each of 256 places in a word."""
    return mix(np.arange(1 << 16, dtype=np.uint64) * _ODD + np.uint64(1))


def name_words(column: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The names of all words ``[^\\x20\\x09-\\x0D]+`` of a column's texts, and where each text's words end.

    A name is the sum of random numbers, one for each byte at its place, mixed with the length: 64 bits, made for all
    words together and read in place. ``table`` maps each byte to the one it counts as. Nulls have no words.
    """
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    none = np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    if not len(column):
        return none
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if bounds[-1] == bounds[0]:
        return none
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    if table is not None:
        data = table[data]
    ends = bounds[1:] - bounds[0]
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    lengths = np.flatnonzero(last) + 1 - starts
    places = np.flatnonzero(inside)
    inner = places - np.repeat(starts, lengths)
    letters = data[places].astype(np.int64)
    values = _LETTERS[(inner & 255) << 8 | letters]
    if lengths.max() > 256:
        far = inner > 255
        values[far] = mix(values[far] + (inner[far] >> 8).astype(np.uint64) * _ODD)
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64)), np.searchsorted(starts, ends)


#: Bytes of text that a task works on at a time; a longer text is a group of its own.
GROUP_BYTES = 1 << 20


def text_groups(column: pa.Array, size: int = GROUP_BYTES):
    """``first, slice``: neighbouring rows of about ``size`` bytes together, read in place."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, column.slice(at, stop - at)
        at = stop


_LETTERS = _letters()


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of the ordered pair of two names."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right + np.uint64(0x632BE59BD9B4E019)))


def window_hashes(names: np.ndarray, width: int) -> np.ndarray:
    """Name of every run of ``width`` consecutive names, built by doubling."""
    if len(names) < width:
        return names[:0]
    whole, done, power, size = None, 0, names, 1
    while done < width:
        if width & size:
            whole = power if whole is None else join_hashes(whole[: len(names) - done - size + 1], power[done:])
            done += size
        if done < width:
            power = join_hashes(power[:-size], power[size:])
            size *= 2
    return whole[: len(names) - width + 1]


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def row_and_text(docs: DataFrame, *more) -> DataFrame:
    """The whole row as one struct beside what a task reads, so that no column name can clash."""
    return docs.select(F.struct("*").alias("row"), *more)


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def frugal(task):
    """A task over Arrow batches that hands its memory back to the system when it ends.

    Workers live on for the tasks of later stages; without this they keep the most that any stage took.
    """

    def run(batches):
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only the GNU C library has the call
            ctypes.CDLL(None).malloc_trim(0)

    return run


# ---------------------------------------------------------------- scratch folders


@lru_cache(maxsize=8)
def _root(spark: SparkSession) -> str:
    root = f"{shared_root(spark)}/llm-{uuid4().hex}"
    atexit.register(lambda: remove(spark, root))
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that driver and executors share; removed when the program ends."""
    return f"{_root(spark)}/{name}-{uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # a file that stays behind does no harm, and the session may have ended
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def barrier(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read from there, and its path."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let the driver collect plans that have ended and aren't held any more, so that their shuffle files go.

    The first pass frees what Python held; only the one after it reaches the plans themselves.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


# ---------------------------------------------------------------- files in a shared store


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it, for a local path or a URI."""
    return pafs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """The file appears whole or not at all: it is written beside its name and then takes it."""
    write_pieces(path, [data])


def write_pieces(path: str, pieces: Iterable[bytes]) -> None:
    """``write_file`` of what the pieces make up, none of which is held longer than it takes to write it."""
    store, place = open_store(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.{uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        for piece in pieces:
            out.write(piece)
    try:
        store.move(part, place)
    except OSError:  # some stores don't move onto a file that an earlier attempt has left
        store.delete_file(place)
        store.move(part, place)


def read_file(path: str) -> bytes:
    store, place = open_store(path)
    with store.open_input_file(place) as source:
        return source.read()
