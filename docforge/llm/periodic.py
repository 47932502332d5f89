"""Periodic runs of words, by maximal pairs: a bottom-up walk over LCP intervals with position lists.

A maximal pair is two equal stretches that no word extends on either side. If it is ``l`` words long
and its ends are ``d`` apart with ``l >= 3 d``, then the words from the first stretch's start to the second's end repeat with period
``d`` at least four times, and nothing extends them: the pair is a run. Each run is met once. Let ``q`` be its smallest period. A
stretch between the two ends of the pair of distance ``q`` would give the run a smaller period still, so these ends are neighbours in the
position list of the interval in which they meet; and the ends of a pair of distance ``2 q, 3 q ...`` have met a nearer
neighbour in a deeper interval. So it is enough to look at neighbours that a merge of lists brings together, whose left words are of different classes.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import frugal, mix, name_words, row_and_text, text_groups, texts_of, window_hashes

LEAST_LENGTH = 6
LEAST_EXPONENT = 4


def _repeated(names: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """Documents in which a window of ``width`` words comes twice; no other holds a run."""
    if len(names) < width:
        return docs[:0]
    grams = window_hashes(names, width)
    whole = docs[: len(grams)] == docs[width - 1 :]
    of = docs[: len(grams)][whole]
    grams = mix(grams[whole] + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(grams)
    twice = grams[order[1:]] == grams[order[:-1]]
    return np.unique(of[order[1:][twice]])


def _sorted_suffixes(names: np.ndarray, docs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions in the order of their documents' suffixes, and the words that each shares with the one before.

    Ranks are doubled in length. A group of suffixes of equal rank is sorted by the ranks behind; ranks
    are places in the order, so a suffix that is alone keeps its rank for good.
    """
    count = len(names)
    order = np.lexsort((names, docs))
    fresh = np.ones(count, bool)
    fresh[1:] = (names[order[1:]] != names[order[:-1]]) | (docs[order[1:]] != docs[order[:-1]])
    rank = np.empty(count, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(count), 0))
    levels, width = [rank.astype(np.int32)], 1
    while True:
        alone = fresh & np.append(fresh[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        active = order[places]
        behind = active + width
        second = np.where(behind < ends[docs[active]], rank[np.minimum(behind, count - 1)] + 1, 0)
        key = rank[active] * (count + 2) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        order[places] = active
        starts = np.ones(len(key), bool)
        starts[1:] = key[1:] != key[:-1]
        fresh[places] |= starts
        rank[active] = np.maximum.accumulate(np.where(starts, places, 0))
        levels.append(rank.astype(np.int32))
        width *= 2
    shared = np.zeros(count, np.int64)
    at = np.flatnonzero(docs[order[1:]] == docs[order[:-1]]) + 1
    one, two = order[at], order[at - 1]
    stop = ends[docs[one]]
    done = np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks, step = levels[level], 1 << level
        i, j = one + done, two + done
        fits = np.maximum(i, j) + step <= stop
        equal = fits & (ranks[np.minimum(i, count - 1)] == ranks[np.minimum(j, count - 1)])
        done[equal] += step
    shared[at] = done
    return order, shared


def _pairs(names, docs, starts, order, shared, least_length, least_exponent):
    """``first, second, words`` of the maximal pairs that are runs.

    Intervals are walked from the deepest up: each step joins two neighbouring ones, the shorter
    list of positions into the longer. Only positions that become neighbours there can be a run's.
    """
    times = least_exponent - 1
    least = max(1, -(-least_length * times // least_exponent))
    edges = np.flatnonzero(shared >= least)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    left = names.copy()
    left[1:] = names[:-1]
    left, order, first_of = left.tolist(), order.tolist(), starts[docs]
    lists: dict[int, list[int]] = {}  # of the interval that begins at a place of the order
    span: dict[int, int] = {}  # from one end of an interval to its other
    found = []

    def meet(one, two, words):
        gap = two - one
        if gap * times <= words and words + gap >= least_length and (one == first_of[one] or left[one] != left[two]):
            found.append((one, two, words))

    for edge, words in zip(edges.tolist(), shared[edges].tolist(), strict=True):
        low, high = span.pop(edge - 1, edge - 1), span.pop(edge, edge)
        few, many = lists.pop(low, None) or [order[edge - 1]], lists.pop(edge, None) or [order[edge]]
        if len(few) > len(many):
            few, many = many, few
        if len(few) == 1:
            at = bisect_left(many, few[0])
            if at:
                meet(many[at - 1], few[0], words)
            if at < len(many):
                meet(few[0], many[at], words)
            many.insert(at, few[0])
        else:
            own = set(few)
            if len(few) * 32 < len(many):
                for place in few:
                    many.insert(bisect_left(many, place), place)
            else:
                many = sorted(many + few)
            for place in few:
                at = bisect_left(many, place)
                if at and many[at - 1] not in own:
                    meet(many[at - 1], place, words)
                if at + 1 < len(many) and many[at + 1] not in own:
                    meet(place, many[at + 1], words)
        lists[low] = many
        span[low], span[high] = high, low
    return found


def runs_of(names: np.ndarray, ends: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows ``text, start, length, period`` of all runs, by text, start and period.

    ``names`` are the words of texts one after the other, equal words by equal names; text ``t`` ends before ``ends[t]``.
    """
    if least_exponent < 3:
        raise ValueError("a maximal pair stands for one run from three periods on")
    sizes = np.diff(ends, prepend=0)
    docs = np.repeat(np.arange(len(ends)), sizes)
    held = _repeated(names, docs, max(1, -(-least_length * (least_exponent - 1) // least_exponent)))
    if not len(held):
        return np.zeros((0, 4), np.int64)
    inside = np.isin(docs, held)
    names = names[inside]
    small = np.repeat(np.arange(len(held)), sizes[held])
    stops = np.cumsum(sizes[held])
    starts = stops - sizes[held]
    order, shared = _sorted_suffixes(names, small, stops)
    found = _pairs(names, small, starts, order, shared, least_length, least_exponent)
    if not found:
        return np.zeros((0, 4), np.int64)
    one, two, words = np.array(found, np.int64).T
    rows = np.stack([held[small[one]], one - starts[small[one]], words + two - one, two - one], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def find_runs(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``row, n_words, runs, strongest, collapsed`` for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, as they stand, numbered from 0. A run is a stretch of words with smallest period ``period``
    and at least ``least_length`` words and ``least_exponent`` periods that no neighbouring word extends. ``runs`` is an array of ``start, length, period``
    by start and period; ``strongest`` the one of most periods, of equal ones the first (null without runs);
    ``collapsed`` the words joined by one space without those that a run holds after its first period.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Texts are read whole; one of very many words
    is a group of its own, and takes up to some hundred bytes a word while it is worked on. Each row is worked on alone, so repeated rows and ids, ties and null ids
    need no rule; all columns stay in ``row``, so no name can clash. No rows give no rows.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches):
        for batch in batches:
            for at, group in text_groups(batch.column("text")):
                names, ends = name_words(group)
                found = runs_of(names, ends, least_length, least_exponent)
                bounds = np.searchsorted(found[:, 0], np.arange(len(group) + 1))
                best, collapsed = [], []
                for number, value in enumerate(texts_of(group)):
                    words = (value or b"").split()
                    mine = found[bounds[number] : bounds[number + 1], 1:].tolist()
                    strongest = None
                    if mine:
                        turns = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in mine:
                            turns[start + period] += 1
                            turns[start + length] -= 1
                            if strongest is None or length * strongest[2] > strongest[1] * period:
                                strongest = (start, length, period)
                        gone = np.cumsum(turns[:-1]) > 0
                        words = [words[place] for place in np.flatnonzero(~gone).tolist()]
                    best.append(strongest and dict(zip(("start", "length", "period"), strongest, strict=True)))
                    collapsed.append(b" ".join(words).decode())
                columns = [pa.array(np.ascontiguousarray(found[:, place])) for place in (1, 2, 3)]
                runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(run)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(at, len(group)),
                        pa.array(np.diff(ends, prepend=0)),
                        runs,
                        pa.array(best, run),
                        pa.array(collapsed, pa.string()),
                    ],
                    ["row", "n_words", "runs", "strongest", "collapsed"],
                )

    rows = row_and_text(docs, F.col(text).cast("string").alias("text"))
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs array<{kind}>, strongest {kind}, collapsed string"
    return rows.mapInArrow(frugal(scan), schema)


def digest(runs: str = "runs") -> F.Column:
    """SHA-256 of the lines ``start,length,period`` of all runs."""
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    return F.sha2(F.array_join(F.transform(runs, lambda run: F.concat(line(run), F.lit("\n"))), ""), 256)
