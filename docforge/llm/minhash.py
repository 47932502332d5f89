"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, stars of candidates.

A set's names are hashes already, so one permutation is enough: their highest bits say the bin, the least name of a bin is its value, and an empty
bin borrows that of the first full bin in a random order of its own. Bands of values are buckets. A bucket
of ``n`` sets gives ``n - 1`` candidates, its least node with each other one; what stars can't see, links between two
others of a bucket, is looked for afterwards in buckets that the links found so far leave apart.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm import parity
from docforge.llm.common import LOWER, barrier, frugal, join_hashes, mix, name_words, text_groups, texts_of, window_hashes
from docforge.llm.components import components, join_more, labelled

SHINGLE = 4
#: Similarity is at least OVER / UNDER.
OVER, UNDER = 4, 5
BINS = 256
ROWS = 6
BANDS = BINS // ROWS
#: Sets of fewer shingles can't be linked with another set: 4 / 5 takes at least 4 common ones of 5.
LEAST = OVER
#: Bits of the filter that spares most texts the way to the confirmation. A full filter spares fewer.
FILTER_BITS = 1 << 24


def shingle_sets(column: pa.Array):
    """The sorted, distinct names of each text's shingles, A-Z in lower case; with fewer words, one name for them all."""
    names, ends = name_words(column, LOWER)
    grams = window_hashes(names, SHINGLE)
    start = 0
    for end in ends.tolist():
        if end - start >= SHINGLE:
            yield np.unique(grams[start : end - SHINGLE + 1])
        else:
            yield mix(window_hashes(names[start:end], end - start) + np.uint64(end - start)) if end > start else names[:0]
        start = end


@lru_cache(maxsize=1)
def _lenders() -> np.ndarray:
    """``[bin, other]``: the place of the other bin in the random order in which an empty bin asks for a value."""
    draw = mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BINS, BINS)
    return np.argsort(np.argsort(draw, axis=1), axis=1).astype(np.int16)


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def signature(names: np.ndarray) -> np.ndarray:
    """The value of each bin: its least name, or that of the bin that lends to it."""
    first = np.searchsorted(names, _EDGES)
    full = np.append(first[1:], len(names)) > first
    lends = np.flatnonzero(full)
    empty = np.flatnonzero(~full)
    values = np.empty(BINS, np.uint64)
    values[lends] = names[first[lends]]
    if len(empty):
        values[empty] = values[lends[_lenders()[np.ix_(empty, lends)].argmin(axis=1)]]
    return values


_PLACES = np.arange(1, BANDS + 1, dtype=np.uint64)


def bands_of(names: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    rows = signature(names)[: BANDS * ROWS].reshape(BANDS, ROWS)
    found = mix(_PLACES)
    for row in range(ROWS):
        found = join_hashes(found, rows[:, row])
    return found


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    """Exact test on two sorted sets: 100 |A ∩ B| >= 80 |A ∪ B|."""
    if not len(left) or not len(right):
        return False
    common = len(np.intersect1d(left, right, assume_unique=True))
    return UNDER * common >= OVER * (len(left) + len(right) - common)


def _print(names: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(names.tobytes())
    return (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


def _profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, n, first, second, bands, parity``: each document's set by size, name, buckets and parity bits."""

    def profile(batches):
        for batch in batches:
            for at, group in text_groups(batch.column("text")):
                n, first, second, bands, bits = [], [], [], [], []
                for names in shingle_sets(group):
                    one, two = _print(names)
                    n.append(len(names))
                    first.append(one)
                    second.append(two)
                    bands.append(bands_of(names).view(np.int64) if len(names) >= LEAST else None)
                    bits.append(parity.parity_of(names) if len(names) >= LEAST else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(at, len(group)),
                        pa.array(n, pa.int64()),
                        pa.array(first, pa.int64()),
                        pa.array(second, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(bits, pa.binary()),
                    ],
                    ["doc", "n", "first", "second", "bands", "parity"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(frugal(profile), "doc long, n long, first long, second long, bands array<bigint>, parity binary")


def _texts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes. A filter over ids, of fixed size, keeps most other texts from being shuffled."""
    place = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    bit = F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for part in wanted.select(place.alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("word")).agg(bit).collect():  # FILTER_BITS / 64 rows at most
        bits[part.word] = part.bits

    def keep(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            hit = (bits[at >> 6] >> (at & 63)) & 1 == 1
            if hit.any():
                yield batch.select(["node", "text"]).filter(pa.array(hit))

    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("text")).where("node IS NOT NULL")
    return rows.withColumn("place", place).mapInArrow(frugal(keep), "node long, text string").join(wanted, "node", "left_semi")


def _confirmed(docs: DataFrame, key: str, text: str, pairs: DataFrame) -> DataFrame:
    """The pairs that are linked by their full sets, made anew from whole texts; written."""
    wanted, _ = barrier(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    texts, _ = barrier(_texts(docs, key, text, wanted), "texts")

    def check(batches):
        known: dict[bytes, np.ndarray] = {}

        def set_of(value):
            if value not in known:
                if len(known) >= 64:
                    known.clear()
                known[value] = next(shingle_sets(pa.array([value], pa.binary())))
            return known[value]

        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sides = [part.column("a").to_pylist(), part.column("b").to_pylist(), texts_of(part.column("text_a")), texts_of(part.column("text_b"))]
                for a, b, one, two in zip(*sides, strict=True):
                    if one is not None and two is not None and linked(set_of(one), set_of(two)):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([pair[side] for pair in found], pa.int64()) for side in (0, 1)], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return barrier(both.mapInArrow(frugal(check), "a long, b long").distinct(), "links")[0]


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n_shingles, component, kept`` for each row: components of similarity 4/5 or more.

    A set holds the distinct four-word shingles of a text with A-Z in lower case; a shorter text is one shingle; null, empty and blank texts have none
    and are linked with nothing. ``component`` is the least id that links reach, ``kept`` says that it is
    the document's own. Rows that share an id are one document, linked by any of their texts; repeated rows and
    equal texts change nothing else. A row without an id is linked with nothing, has no component and stays. Texts
    are read whole. Other columns are not read, so any names do. No rows give no rows.

    A pair of similarity 4/5 misses all bands with a probability of (1 - 0.8^6)^42, 3 in a million; all other steps are exact.
    """
    profiles, _ = barrier(_profile(docs, key, text), "profiles")
    named = profiles.where("doc IS NOT NULL AND n > 0")
    # Equal sets first: one node for each, its least id. Every other document hangs on it.
    classes, _ = barrier(named.groupBy("first", "second").agg(F.min("doc").alias("node")), "classes")
    placed, _ = barrier(named.select("doc", "first", "second").join(classes, ["first", "second"]).select("doc", "node").where("doc <> node").distinct(), "placed")
    own = classes.withColumn("doc", F.col("node"))
    heads = named.where(F.col("n") >= LEAST).join(own, ["first", "second", "doc"]).dropDuplicates(["first", "second", "doc"])
    sets, _ = barrier(heads.select("node", "n", "bands", "parity"), "sets")
    entries = sets.select("node", F.explode("bands").alias("sign"))
    centers, _ = barrier(entries.groupBy("sign").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1").select("sign", "center"), "centers")
    spokes, _ = barrier(entries.join(centers, "sign").where("node <> center").select("center", "node").distinct(), "spokes")
    stars, _ = barrier(parity.filter_pairs(spokes.select(F.col("center").alias("a"), F.col("node").alias("b")), sets, OVER, UNDER), "stars")
    labels, _ = barrier(components(_confirmed(docs, key, text, stars)), "labels")
    labels = parity.between_spokes(spokes, labels, sets, OVER, UNDER, lambda pairs: _confirmed(docs, key, text, pairs))

    # Documents hang on nodes. One that hangs on several, or is a node itself, has several texts under its id and ties their nodes together.
    hanging = placed.select(F.col("doc").alias("a"), F.col("node").alias("b"))
    several = hanging.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").union(hanging.join(classes.select(F.col("node").alias("a")), "a", "left_semi").select("a"))
    labels = join_more(labels, hanging.join(several.distinct(), "a", "left_semi"))
    hung = labelled(placed, labels).groupBy("doc").agg(F.min("label").alias("of"))
    marked = profiles.select("doc", "n").join(hung, "doc", "left").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    component = F.when(F.col("n") > 0, F.coalesce("of", "label", "doc")).otherwise(F.col("doc"))
    return marked.select("doc", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))
