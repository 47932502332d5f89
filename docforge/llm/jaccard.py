"""N-gram Jaccard join: universe partition, pigeonhole signatures, exact verification, components.

Equal sets form a class first, and only classes are joined. Classes that share a signature of which one is
a probe are candidates. They are tested along stars, then the components so found leave only pairs
between different components to test; those are looked for in blocks of a bucket, by parity bits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm import parity
from docforge.llm import shingles as S
from docforge.llm.common import barrier, frugal, release, remove, text_groups, texts_of
from docforge.llm.components import components

#: Shingles counted at once by a task, and those it may report; the list of frequent ones only steers costs.
COUNTED = 1_000_000
REPORTED = 20_000
FREQUENT = 50_000
FREQUENT_SHARE = 0.002
#: Bits of the filter that spares most texts the way to the verification. A full filter spares fewer.
FILTER_BITS = 1 << 24
SEEN = 1_000_000

_CLASS_BITS = 61


@dataclass(frozen=True)
class Keys:
    """Class keys: the low bits of a set's first 64, or an alias where another set has the same."""

    bits: int = _CLASS_BITS
    aliases: dict[tuple[int, int], int] = field(default_factory=dict)

    def of(self, names: np.ndarray) -> int:
        both = S.print_of(names)
        return self.aliases.get(both, both[0] & (1 << self.bits) - 1)

    def added(self, rows: DataFrame) -> DataFrame:
        """``rows`` of ``first, second`` with their ``class``."""
        plain = F.col("first").bitwiseAND(F.lit((1 << self.bits) - 1))
        if not self.aliases:
            return rows.withColumn("class", plain)
        known = rows.sparkSession.createDataFrame([(*both, key) for both, key in self.aliases.items()], "first long, second long, alias long")
        return rows.join(known, ["first", "second"], "left").withColumn("class", F.coalesce("alias", plain)).drop("alias")


def _sets(column: pa.Array):
    for _, group in text_groups(column):
        yield from S.shingle_sets(group)


def _among(names: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which names a sorted list holds."""
    if not len(ranked):
        return np.zeros(len(names), bool)
    return ranked[np.minimum(np.searchsorted(ranked, names), len(ranked) - 1)] == names


def _profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``kind`` 0: ``key, tie, n, first, second, parity`` of each document; 1: shingle ``first`` and its count ``n`` in a task."""

    def profile(batches):
        seen, held, size, counts, total = set(), [], 0, {}, 0

        def count():
            names, number = np.unique(np.concatenate(held), return_counts=True)
            often = number > 1
            for name, n in zip(names[often].tolist(), number[often].tolist(), strict=True):
                counts[name] = counts.get(name, 0) + n
            held.clear()
            if len(counts) > 4 * REPORTED:
                for name in sorted(counts, key=counts.get)[:-REPORTED]:
                    del counts[name]

        for batch in batches:
            rows = []
            for names in _sets(batch.column("text")):
                first, second = S.print_of(names)
                rows.append((len(names), first, second, parity.parity_of(names)))
                total += 1
                if len(seen) < SEEN and first not in seen:
                    seen.add(first)
                    held.append(names)
                    size += len(names)
                    if size >= COUNTED:
                        count()
                        size = 0
            n, first, second, bits = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield _batch([0] * len(rows), batch.column("key"), batch.column("tie"), n, first, second, bits)
        if held:
            count()
        least = max(2, FREQUENT_SHARE * total)
        top = sorted((name for name, n in counts.items() if n >= least), key=counts.get)[-REPORTED:]
        names = np.array(top, np.uint64).view(np.int64)
        none = pa.nulls(len(top), pa.int64())
        yield _batch([1] * len(top), none, none, [counts[name] for name in top], names, [0] * len(top), [None] * len(top))

    def _batch(kind, keys, ties, n, first, second, bits):
        columns = [pa.array(kind, pa.int8()), keys, ties, pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bits, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "key", "tie", "n", "first", "second", "parity"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(frugal(profile), "kind byte, key long, tie long, n long, first long, second long, parity binary")


def _frequent(profiles: DataFrame) -> np.ndarray:
    """Names of the shingles that many documents hold; at most ``FREQUENT``, and no result depends on them."""
    total = profiles.where("kind = 0").count()
    counted = profiles.where("kind = 1").groupBy("first").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, FREQUENT_SHARE * total))
    names = [row["first"] for row in counted.orderBy(F.desc("n")).limit(FREQUENT).collect()]
    return np.sort(np.array(names, np.int64).view(np.uint64))


def _keys(members: DataFrame, bits: int = _CLASS_BITS) -> Keys:
    """Keys that tell all sets of ``members`` (``first, second``) apart.

    Sets that share their low bits get aliases: of ``n`` sets about ``n ** 2 / 2 ** 62`` pairs do, 540 of 5 x 10^10 sets, so the
    list of aliases is short, and it is drawn anew until no alias meets another set.
    """
    plain, _ = barrier(Keys(bits).added(members.select("first", "second").distinct()), "prints")
    shared = plain.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    rows = plain.join(shared, "class", "left_semi").select("first", "second").collect()
    seed = 0
    while rows:
        drawn = {(row["first"], row["second"]): xxhash.xxh3_64_intdigest(b"%d %d" % tuple(row), seed=seed) >> 64 - _CLASS_BITS for row in rows}
        seed += 1
        met = plain.where(F.col("class").isin(*drawn.values())).limit(1).count()
        if len(set(drawn.values())) == len(rows) and not met:
            return Keys(bits, drawn)
    return Keys(bits)


def _entries(docs: DataFrame, text: str, class_of: Keys, frequent: np.ndarray) -> DataFrame:
    """``sign, entry``: signatures of all sets; an entry is the role above the class. A task emits a set once."""

    def emit(batches):
        seen = set()
        for batch in batches:
            for _, group in text_groups(batch.column("text")):
                sets, often, keys = [], [], []
                for names in S.shingle_sets(group):
                    if not len(names):
                        continue
                    key = class_of.of(names)
                    if key in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(key)
                    sets.append(names)
                    keys.append(key)
                    often.append(_among(names, frequent))
                if sets:
                    owner, sign, role = S.signatures_of(sets, often)
                    entry = (role << np.int64(_CLASS_BITS)) | np.array(keys, np.int64)[owner]
                    yield pa.RecordBatch.from_arrays([pa.array(sign.view(np.int64)), pa.array(entry)], ["sign", "entry"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(frugal(emit), "sign long, entry long")


def _stars(entries: DataFrame) -> DataFrame:
    """``sign, center, member, probes``: each bucket's first probe with all its other members.

    Buckets stream by in order, and only the current one's center is kept. Entries of sets whose
    allocation fell short pass through without a center.
    """
    mask = np.int64((1 << _CLASS_BITS) - 1)

    def stream(batches):
        last_sign, center, last = None, np.int64(0), np.int64(-1)
        for batch in batches:
            sign = batch.column("sign").to_numpy()
            entry = batch.column("entry").to_numpy()
            if not len(sign):
                continue
            fresh = np.concatenate([[last_sign is None or sign[0] != last_sign], sign[1:] != sign[:-1]])
            run = np.cumsum(fresh)  # 0 continues the bucket of the batch before
            centers = np.concatenate([[center], entry[fresh]])[run]
            same = np.concatenate([[entry[0] == last and not fresh[0]], (entry[1:] == entry[:-1]) & ~fresh[1:]])
            role, known = entry >> np.int64(_CLASS_BITS), entry & mask
            short = role == S.SHORT
            keep = (~fresh & ~same & (centers >> np.int64(_CLASS_BITS) == S.PROBE) & (known != centers & mask) & ~short) | (short & ~same)
            last_sign, center, last = sign[-1], centers[-1], entry[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sign[keep]), pa.array(centers[keep] & mask, mask=short[keep]), pa.array(known[keep]), pa.array(role[keep] == S.PROBE)],
                ["sign", "center", "member", "probes"],
            )

    ordered = entries.repartition("sign").sortWithinPartitions("sign", "entry")
    return ordered.mapInArrow(frugal(stream), "sign long, center long, member long, probes boolean")


def _ordered(a: str, b: str):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _filled(places: DataFrame) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits with those at ``p`` set."""
    words = places.groupBy((F.col("p") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for part in words.collect():  # FILTER_BITS / 64 rows at most
        bits[part.word] = part.bits
    return bits


def _texts(docs: DataFrame, key: str, text: str, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, text`` of a document of each wanted class.

    A filter over keys, of fixed size, keeps most other texts from being shuffled; the join decides.
    """
    chosen = wanted.join(members, "class").select("class", F.col("doc").alias("key"))
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    bits = _filled(chosen.select(place.alias("p")))

    def keep(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            hit = (bits[at >> 6] >> (at & 63)) & 1 == 1
            if hit.any():
                yield batch.select(["key", "text"]).filter(pa.array(hit))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    near = rows.withColumn("place", place).mapInArrow(frugal(keep), "key long, text string")
    return near.join(chosen, near["key"].eqNullSafe(chosen["key"])).select("class", "text")


def _verify(pairs: DataFrame, texts: DataFrame, class_of: Keys) -> DataFrame:
    """The pairs whose sets, made anew from the texts, are linked."""

    def check(batches):
        known: dict[int, np.ndarray] = {}

        def set_of(key, value):
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                names = next(S.shingle_sets(pa.array([value], pa.binary())))
                # A key may stand for several rows; a text of another class gives no set.
                known[key] = names if len(names) and class_of.of(names) == key else None
            return known[key]

        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for a, b, left, right in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), texts_of(part.column("text_a")), texts_of(part.column("text_b")), strict=True):
                    one, two = set_of(a, left), set_of(b, right)
                    if one is None or two is None:
                        known.pop(a, None), known.pop(b, None)
                    elif S.linked(one, two):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([pair[side] for pair in found], pa.int64()) for side in (0, 1)], ["a", "b"])

    left = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b").mapInArrow(frugal(check), "a long, b long").distinct()


def _short_pairs(docs: DataFrame, text: str, class_of: Keys, short: DataFrame) -> DataFrame:
    """Candidates of sets whose allocation fell short: all sets that hold one of their first shingles.

    One pass over all texts emits the shingles that pass a filter of fixed size; the join decides.
    """
    place = F.pmod(F.col("sign"), F.lit(FILTER_BITS))
    bits = _filled(short.select(place.alias("p")))

    def emit(batches):
        for batch in batches:
            signs, keys = [], []
            for have in _sets(batch.column("text")):
                at = (have & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                hits = have[(bits[at >> 6] >> (at & 63)) & 1 == 1]
                if len(hits):
                    signs.append(hits)
                    keys.append(np.full(len(hits), class_of.of(have), np.int64))
            if signs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signs).view(np.int64)), pa.array(np.concatenate(keys))], ["sign", "class"])

    held = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(frugal(emit), "sign long, class long").distinct()
    return short.join(held, "sign").where("member <> class").select(*_ordered("member", "class")).distinct()


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tie, n_shingles, component`` for each row of ``docs``: components of similarity 3/4 or more.

    Sets are distinct five-word shingles of the text with A-Z in lower case; a shorter text is one
    shingle; null and empty texts have none and are linked with nothing. ``component`` is the least
    key that links reach; ``tie`` is a hash of the text, for rows that share a key. Repeated rows and equal texts are one class. A null key is a row that others may
    link through; where nothing else is in its component, the component is null. No rows give no rows.
    """
    spark = docs.sparkSession
    profiles, _ = barrier(_profile(docs, key, text), "profiles")
    documents = profiles.where("kind = 0")
    named = documents.where("n > 0")
    class_of = _keys(named)
    frequent = _frequent(profiles)
    classes, _ = barrier(class_of.added(named).groupBy("class").agg(F.min("key").alias("doc"), F.first("n").alias("n"), F.first("parity").alias("parity")), "classes")
    sets = classes.select(F.col("class").alias("node"), "n", "parity")

    stars, _ = barrier(_stars(_entries(docs, text, class_of, frequent)), "stars")
    release(spark)
    spokes, _ = barrier(stars.where("center IS NOT NULL").select("center", F.col("member").alias("node")).distinct(), "spokes")
    first = spokes.select(*_ordered("center", "node"))
    short = stars.where("center IS NULL").select("sign", "member")
    if short.limit(1).count():
        first = first.union(_short_pairs(docs, text, class_of, short))
    first = first.distinct()
    tested, _ = barrier(parity.filter_pairs(first, sets, S.OVER, S.UNDER), "pairs")
    del first

    def confirm(pairs):
        return _tested(docs, key, text, classes, pairs, class_of)

    labels, _ = barrier(components(confirm(tested)), "labels")
    labels = parity.between_spokes(spokes, labels, sets, S.OVER, S.UNDER, confirm)
    placed = classes.select("class", "doc").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("top", F.coalesce("label", "class"))
    least = placed.groupBy("top").agg(F.min("doc").alias("component"))
    placed = placed.join(least, "top").select("class", "component")
    return (
        class_of.added(documents)
        .withColumn("class", F.when(F.col("n") > 0, F.col("class")))
        .join(placed, "class", "left")
        .select("key", "tie", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))
    )


def _tested(docs, key, text, classes, pairs, class_of) -> DataFrame:
    """The links among ``pairs``, written."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    texts, texts_path = barrier(_texts(docs, key, text, classes.select("class", "doc"), wanted), "texts")
    links, _ = barrier(_verify(pairs, texts, class_of), "links")
    remove(spark, texts_path)
    release(spark)
    return links


def one_of_each_component(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that another of their component stands for, with their own columns.

    The row of least key, and of least text hash among rows of that key, stays; of repeated rows one. Documents
    without shingles all stay.
    """
    found = similar_components(docs, key, text).where("n_shingles > 0")
    best = found.groupBy("component").agg(F.min(F.struct("key", "tie")).alias("best")).select("best.*").distinct()
    has_words = F.coalesce(F.col(text).cast("string").rlike(r"[^ \t-\r]"), F.lit(False))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), has_words.alias("words"))
    same = rows["key"].eqNullSafe(best["key"]) & (rows["tie"] == best["tie"])
    kept = rows.where("words").join(best, same, "left_semi").dropDuplicates(["key", "tie"])
    return kept.unionByName(rows.where("NOT words")).select("row.*")
