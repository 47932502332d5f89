"""Filter interaction audit: what each filter removes in every order in which the filters can be applied.

Each document becomes one cell of a 2 x 2 x 2 x 2 x 2 tensor of its part, an axis for each filter (0 passes, 1 fails).
Counting cells is the only work over documents. A step of an order is then a contraction: along each
axis a vector selects those that pass, that fail, or all.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import barrier, frugal, text_groups, texts_of

#: The filters, in the order of the tensor's axes.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
#: What is counted in each cell.
MEASURES = ("documents", "good", "toxic")
#: Parts whose tensors are contracted together.
TOGETHER = 64


def failures_of(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    points = len(text) - len(text.translate(None, _LEADING)) if not text.isascii() else len(text)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * points,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << axis for axis, failed in enumerate(fails) if failed)


#: Bytes that begin a code point.
_LEADING = bytes(byte for byte in range(256) if byte & 0xC0 != 0x80)


def _facts(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``doc, part, first, second, bits`` of each document: the name of its text, and the filters A to D that it fails."""

    def measure(batches):
        for batch in batches:
            for at, group in text_groups(batch.column("text")):
                texts = [value or b"" for value in texts_of(group)]
                names = [xxhash.xxh3_128_intdigest(value) for value in texts]
                both = np.array([(name >> 64, name & (1 << 64) - 1) for name in names], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(at, len(group)),
                        batch.column("part").slice(at, len(group)),
                        pa.array(np.ascontiguousarray(both[:, 0]).view(np.int64)),
                        pa.array(np.ascontiguousarray(both[:, 1]).view(np.int64)),
                        pa.array([failures_of(value) for value in texts], pa.int32()),
                    ],
                    ["doc", "part", "first", "second", "bits"],
                )

    rows = docs.select(
        F.col(key).cast("long").alias("doc"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).cast("string").alias("text"),
    )
    return rows.mapInArrow(frugal(measure), "doc long, part string, first long, second long, bits int")


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, cell, documents, good, toxic``: how many documents of a part fail just the filters in the bits of ``cell``."""
    facts, _ = barrier(_facts(docs, key, text, part), "facts")
    # Least ids combine on the map side; they come back by text and id together, so a text of many copies is no hot key.
    first = facts.groupBy("first", "second").agg(F.min("doc").alias("doc")).withColumn("least", F.lit(True))
    marks = (
        labels.groupBy(F.col(key).cast("long").alias("doc"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        .where("doc IS NOT NULL")
    )
    copy = F.col("doc").isNotNull() & F.col("least").isNull()
    return (
        facts.join(first, ["first", "second", "doc"], "left")
        .join(marks, "doc", "left")
        .groupBy("part", (F.col("bits") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("cell"))
        .agg(
            F.count("*").alias("documents"),
            F.count(F.when(F.col("good"), 1)).alias("good"),
            F.count(F.when(F.col("toxic"), 1)).alias("toxic"),
        )
    )


@lru_cache(maxsize=1)
def _steps():
    """The selections that all steps of all orders need, and for each step: order, number, axis, and its selections."""
    known: dict[tuple, int] = {}

    def select(passing=(), failing=()):
        vectors = tuple(PASS if axis in passing else FAIL if axis in failing else ALL for axis in range(len(FILTERS)))
        return known.setdefault(vectors, len(known))

    rows = []
    for order in permutations(range(len(FILTERS))):
        for at, axis in enumerate(order):
            others = [other for other in order if other != axis]
            chosen = select(order[: at + 1]), select(order[:at], [axis]), select((), [axis]), select(others, [axis])
            rows.append(("".join(FILTERS[i] for i in order), at + 1, axis, *chosen))
    return np.array(list(known), np.int64), rows


def contract(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of all steps, an array of parts by steps each, from tensors of parts, measures and an axis for each filter."""
    selections, rows = _steps()
    axis, kept, removed, failed, alone = (np.array([row[at] for row in rows]) for at in range(2, 7))
    found = np.einsum("pmabcde,sa,sb,sc,sd,se->pms", tensors, *(selections[:, at] for at in range(len(FILTERS))), optimize="greedy")
    lost = found[:, 0, removed]
    shares = lost @ (axis[:, None] == np.arange(len(FILTERS))).astype(np.int64)
    return {
        "kept": found[:, 0, kept],
        "removed": lost,
        "redundant": found[:, 0, failed] - lost,
        "unique_fails": found[:, 0, alone],
        "good_lost": found[:, 1, removed],
        "toxic_lost": found[:, 2, removed],
        "shapley": shares[:, axis],
    }


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, filter_order, step`` and the counts of that step, for each part and all 120 orders of the five filters.

    The filters fail a document that has A under 200 words, B under half its words distinct, C over 2 % capital letters, D
    one of ``#$%&*|``, E the text of a smaller id. ``kept`` documents are left after the step, ``removed`` go in it,
    ``redundant`` fail its filter but went before, ``unique_fails`` fail no other; ``good_lost`` and ``toxic_lost`` are
    removed ones with such a label; ``shapley`` sums what the step's filter removes over all orders.

    A null or empty text is the empty text, of no words and no code points: it fails A alone, and E if a smaller id is
    empty too. A null part is the empty string. A document without an id fails E never and has no labels; rows
    that repeat an id with one text are all its first copy. Several label rows of an id count as one that
    holds what any of them says. Texts are read whole, however long. Columns besides these may have any names. No documents give no rows.
    """
    counted = cells(docs, labels, key, text, part).groupBy("part").agg(F.collect_list(F.struct("cell", *MEASURES)).alias("cells"))  # 32 cells at most
    names = list(contract(np.zeros((1, len(MEASURES), *[2] * len(FILTERS)), np.int64)))

    def steps(batches):
        _, rows = _steps()
        orders, numbers = pa.array([row[0] for row in rows]), np.array([row[1] for row in rows], np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                tensors = np.zeros((some.num_rows, len(MEASURES), *[2] * len(FILTERS)), np.int64)
                for number, found in enumerate(some.column("cells").to_pylist()):
                    for cell in found:
                        place = tuple(cell["cell"] >> axis & 1 for axis in range(len(FILTERS)))
                        tensors[(number, slice(None), *place)] = [cell[name] for name in MEASURES]
                counts = contract(tensors)
                parts = some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), len(rows))))
                columns = [parts, pa.concat_arrays([orders] * some.num_rows), pa.array(np.tile(numbers, some.num_rows))]
                columns += [pa.array(counts[name].ravel()) for name in names]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *names])

    return counted.mapInArrow(steps, "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in names))
