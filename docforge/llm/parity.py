"""Parity bits of sets: a bound on how far two sets differ, and a search for possible links inside groups.

A set's names are dealt to bits, and each bit holds whether an odd number of them fell on it. Two sets that differ by ``d`` names differ
by ``d`` bits at most, so pairs whose bits differ by more than a link allows are no links, and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import barrier, frugal
from docforge.llm.components import join_more, labelled

#: Bits for each name, at least; twice as many at most. Sets of up to 1 / SHARE of each other's size are compared bit by bit.
BITS = 8
#: Members of a group that are compared with as many others at once.
BLOCK = 512
_BLOCK_KEY = ("center", "kind", "i", "j")


def parity_of(names: np.ndarray) -> bytes:
    """Parity bits of a set, a power of two of them that fits its size. The upper half folds onto the lower."""
    size = max(64, 1 << (BITS * len(names) - 1).bit_length()) if len(names) else 64
    at = (names & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def _fold(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _words(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)


def possible(n_left, n_right, apart, over: int, under: int):
    """Whether sizes, and the least number of names that differ, allow a similarity of ``over / under``."""
    least, most = np.minimum(n_left, n_right), np.maximum(n_left, n_right)
    return (least * under >= over * most) & (apart <= (n_left + n_right) * (under - over) // (under + over))


def filter_pairs(pairs: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """The pairs ``a, b`` whose sets (``node, n, parity``) may be similar enough; null sides fall out."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("parity").alias(f"parity_{name}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(n_a, n_b) * {under} >= {over} * greatest(n_a, n_b)")

    def check(batches):
        for batch in batches:
            keep = []
            for n_a, n_b, one, two in zip(*(batch.column(name).to_pylist() for name in ("n_a", "n_b", "parity_a", "parity_b")), strict=True):
                left, right = _words([one]), _words([two])
                width = min(left.shape[1], right.shape[1])
                apart = int(np.bitwise_count(_fold(left, width) ^ _fold(right, width)).sum())
                keep.append(bool(possible(n_a, n_b, apart, over, under)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(frugal(check), "a long, b long")


def dealt(members: DataFrame) -> DataFrame:
    """Members of groups with something to look for, each with its block ``own`` and the numbers of blocks ``k_in, k_out`` of its group.

    ``members`` has ``center, node, inside`` and what goes with them; ``inside`` says that the node's label is the center's.
    """
    counted = members.groupBy("center").agg(F.count(F.when(F.col("inside"), 1)).alias("n_in"), F.count(F.when(~F.col("inside"), 1)).alias("n_out"))
    counted, _ = barrier(counted.where("n_out > 0 AND n_in + n_out > 1"), "groups")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sized = members.join(counted, "center").withColumn("k_in", blocks("n_in")).withColumn("k_out", blocks("n_out"))
    return sized.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("k_in")).otherwise(F.col("k_out"))).cast("int"))


def in_blocks(members: DataFrame) -> DataFrame:
    """``center, kind, i, j, own`` and the rest of each of the ``dealt`` members, once for each pair of blocks that it is part of.

    Pairs to look at are of kind 0, both outside, and kind 1, one of each. Inside members meet no other inside ones, so a group
    of which few are outside is sent about once.
    """
    place = lambda kind, i, j: F.struct(F.lit(kind).cast("int").alias("kind"), i.alias("i"), j.alias("j"))
    up_to = lambda n, made: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), made)).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))
    own = F.col("own")
    outside = F.concat(up_to("k_out", lambda other: place(0, F.least(own, other), F.greatest(own, other))), up_to("k_in", lambda other: place(1, own, other)))
    spread = members.withColumn("at", F.explode(F.when(F.col("inside"), up_to("k_out", lambda other: place(1, other, own))).otherwise(outside)))
    return spread.select("center", "at.kind", "at.i", "at.j", "own", "inside", "node", "label", "n", "parity")


def of_blocks(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``in_blocks`` that are in one of the distinct ``wanted`` pairs of blocks; no others are made."""
    side = lambda pairs, own, inside: pairs.select(*_BLOCK_KEY, F.col(own).alias("own"), F.lit(inside).alias("inside"))
    sides = side(wanted, "i", False).union(side(wanted.where("kind = 1"), "j", True)).union(side(wanted.where("kind = 0 AND i <> j"), "j", False))
    return members.join(sides, ["center", "own", "inside"]).select(*_BLOCK_KEY, "own", "inside", "node", "label", "n", "parity")


def _passing(rows: pa.Table, key, over: int, under: int):
    """``at, others`` for each row: those behind it, of another label, that may be linked with it."""
    own, label, size, inside = (rows[name].to_numpy() for name in ("own", "label", "n", "inside"))
    bits = rows["parity"].to_pylist()
    width = np.array([len(value) for value in bits])
    for least in np.unique(width).tolist():
        here = np.flatnonzero(width == least)
        near = np.flatnonzero((width == least) | (width == 2 * least))
        mine = _words([bits[at] for at in here.tolist()])
        theirs = np.concatenate([_fold(_words([bits[at]]), least // 8) for at in near.tolist()])
        for at, mask in zip(here.tolist(), mine, strict=True):
            fits = (label[near] != label[at]) & ((width[near] > least) | (near > at))
            if key[1]:
                fits &= inside[near] != inside[at]
            elif key[2] != key[3]:
                fits &= own[near] != own[at]
            fits &= possible(size[near], size[at], 0, over, under)
            some = np.flatnonzero(fits)
            if len(some):
                apart = np.bitwise_count(theirs[some] ^ mask).sum(axis=1, dtype=np.int64)
                some = some[possible(size[near[some]], size[at], apart, over, under)]
                if len(some):
                    yield at, near[some]


def possible_links(blocks: DataFrame, over: int, under: int, spanning: bool) -> DataFrame:
    """``center, kind, i, j, a, b``: pairs of a block's nodes of different labels that may be linked.

    ``spanning`` gives a forest only: no pair between labels that the block's pairs before it tie already. If all pairs of a block's forest are
    links, no other of its pairs can join anything more. Rows of a block come together and are bounded by two blocks.
    """

    def compare(batches):
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in _BLOCK_KEY], axis=1)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                own = tuple(keys[start].tolist())
                if key is not None and own != key:
                    yield pairs_of(pa.Table.from_batches(held), key)
                    held = []
                key = own
                held.append(batch.slice(start, stop - start))
        if held:
            yield pairs_of(pa.Table.from_batches(held), key)

    def pairs_of(rows, key):
        node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
        root: dict[int, int] = {}

        def find(one):
            while (above := root.get(one, one)) != one:
                one = above
            return one

        left, right = [], []
        if (label != label[0]).any():
            for at, others in _passing(rows, key, over, under):
                for other in others.tolist():
                    if spanning:
                        one, two = find(label[at].item()), find(label[other].item())
                        if one == two:
                            continue
                        root[max(one, two)] = min(one, two)
                    left.append(node[at])
                    right.append(node[other])
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        same = [pa.array(np.full(len(a), value), kind) for value, kind in zip(key, (pa.int64(), *[pa.int32()] * 3), strict=True)]
        return pa.RecordBatch.from_arrays([*same, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], [*_BLOCK_KEY, "a", "b"])

    ordered = blocks.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)
    return ordered.mapInArrow(frugal(compare), "center long, kind int, i int, j int, a long, b long")


def between_spokes(pairs: DataFrame, labels: DataFrame, sets: DataFrame, over: int, under: int, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``labels`` after the links between two spokes of a star, which no star can see.

    ``pairs`` are the distinct ``center, node`` of all stars, each of which was tested before; ``sets`` has ``node, n, parity``;
    ``confirm`` gives the links among pairs, written. All spokes of a center are one group, however many stars they share with it.
    Groups that labels leave apart are looked through in blocks, each of which gives a forest of possible links. A forest with a
    pair that is no link may hide one: its block is looked through once more, all pairs of it.
    """
    named, _ = barrier(labelled(sets.select("node", "n", "parity"), labels), "named")
    marked = pairs.join(named.select("node", "label"), "node").join(named.select(F.col("node").alias("center"), F.col("label").alias("of")), "center")
    apart, _ = barrier(marked.where("label <> of").select("center").distinct(), "apart")
    members = marked.join(apart, "center", "left_semi").select("center", "node", (F.col("label") == F.col("of")).alias("inside"))
    members, _ = barrier(members.join(named, "node"), "members")
    members = dealt(members)
    forest, _ = barrier(possible_links(in_blocks(members), over, under, spanning=True), "forest")
    links = confirm(forest.select("a", "b").distinct())
    labels = join_more(labels, links)
    refuted = labelled(labelled(forest.join(links, ["a", "b"], "left_anti"), labels, "a", "x"), labels, "b", "y").where("x <> y")
    doubtful, _ = barrier(refuted.select(*_BLOCK_KEY).distinct(), "doubtful")
    again = of_blocks(labelled(members.drop("label"), labels), doubtful)
    rest = possible_links(again, over, under, spanning=False)
    rest, _ = barrier(rest.select("a", "b").distinct().join(links, ["a", "b"], "left_anti"), "rest")
    return join_more(labels, confirm(rest))
