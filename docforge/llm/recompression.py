"""Recompression of word sequences: rounds that name runs and pairs, and the symbols that windows share.

A round replaces each maximal run of one symbol by a name, then each pair of a left and a right symbol, where
a hash of the symbol says which it is. A name is a hash of what it stands for, so all tasks give
equal pairs and runs equal names, round for round, and no dictionary has to travel. Since a pair depends on its
two symbols alone, equal sequences are cut alike except at their ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from docforge.llm.common import join_hashes, mix

ROUNDS = 2


@dataclass
class Symbols:
    """A sequence of symbols: names, the words that each covers, and the document of each."""

    names: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray


def name_runs(symbols: Symbols, seed: int) -> tuple[Symbols, np.ndarray]:
    """Runs of a symbol become one; also the run of each symbol."""
    names, docs = symbols.names, symbols.docs
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (docs[1:] != docs[:-1])
    first = np.flatnonzero(fresh)
    if len(first) == len(names):
        return symbols, np.arange(len(names))
    last = np.append(first[1:], len(names)) - 1
    named = names[first]
    long = last > first
    named[long] = join_hashes(named[long], (last - first)[long].astype(np.uint64) + np.uint64(seed << 32))
    return Symbols(named, symbols.starts[first], symbols.ends[last], docs[first]), np.cumsum(fresh) - 1


def sides(names: np.ndarray, seed: int) -> np.ndarray:
    """True for right symbols."""
    return (mix(names ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)


def name_pairs(symbols: Symbols, right: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Each left symbol with a right one behind it becomes one; also the new place of each symbol."""
    first = np.zeros(len(right), bool)
    first[:-1] = ~right[:-1] & right[1:] & (symbols.docs[1:] == symbols.docs[:-1])
    second = np.zeros(len(right), bool)
    second[1:] = first[:-1]
    keep = ~second
    names, ends = symbols.names.copy(), symbols.ends.copy()
    names[first] = join_hashes(symbols.names[first], symbols.names[second])
    ends[first] = symbols.ends[second]
    return Symbols(names[keep], symbols.starts[keep], ends[keep], symbols.docs[keep]), np.cumsum(keep) - 1


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least value in each range, the first of equal ones, by ranges of doubling length."""
    size = high - low
    place = np.arange(len(values))
    found = np.zeros(len(low), np.int64)
    width = 1
    while len(low):
        now = (size >= width) & (size < 2 * width)
        if now.any():
            one, two = place[low[now]], place[high[now] - width]
            found[now] = np.where(values[two] < values[one], two, one)
        if not (size >= 2 * width).any():
            break
        left, right = place[:-width], place[width:]
        place = np.concatenate([np.where(values[right] < values[left], right, left), place[len(left) :]])
        width *= 2
    return found


def anchors(names: np.ndarray, docs: np.ndarray, width: int, rounds: int = ROUNDS):
    """``window, name, start, length`` of an interior symbol of every window of ``width`` words.

    What a window's own words don't decide is popped from its ends, round by round: the runs
    that may go on outside, a right symbol in front and a left symbol behind. What stays is the same in each
    window of equal words. The anchor is, of the symbols of the last round in which something stays, the one of
    least hash: equal windows have equal anchors at equal distances, and windows that overlap share
    theirs more often than not.
    """
    count = len(names)
    if count < width:
        none = np.zeros(0, np.int64)
        return none, names[:0], none, none
    windows = np.flatnonzero(docs[: count - width + 1] == docs[width - 1 :])
    found_name, found_start = names[windows], windows.copy()
    found_length = np.ones(len(windows), np.int64)
    symbols = Symbols(names, np.arange(count), np.arange(1, count + 1), docs)

    def settle(which, low, high):
        """The anchors of windows whose last symbols stand from ``low`` to ``high``."""
        if len(which):
            best = _least(mix(symbols.names + np.uint64(seed)), low, high)
            found_name[which], found_start[which] = symbols.names[best], symbols.starts[best]
            found_length[which] = symbols.ends[best] - symbols.starts[best]

    at = np.arange(len(windows))
    low, high = windows, windows + width
    for seed in range(1, rounds + 1):
        before = symbols
        symbols, run = name_runs(symbols, seed)
        next_low, next_high = run[low] + 1, run[high - 1]
        right = sides(symbols.names, seed)
        last = len(right) - 1
        stays = next_low < next_high
        next_low = next_low + (stays & right[np.minimum(next_low, last)])
        next_high = next_high - (stays & ~right[np.maximum(next_high - 1, 0)])
        stays = next_low < next_high
        after, place = name_pairs(symbols, right)
        if not stays.all():
            symbols = before
            settle(at[~stays], low[~stays], high[~stays])
        symbols = after
        at, low, high = at[stays], place[next_low[stays]], place[next_high[stays] - 1] + 1
        if not len(at):
            break
    settle(at, low, high)
    return windows, found_name, found_start, found_length


#: One odd factor for each part that a round pops from a window.
_FACTORS = mix(np.arange(1, 8, dtype=np.uint64)) | np.uint64(1)


def spellings(names: np.ndarray, docs: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """A name of the words of each window of ``width`` words from ``windows``, made of its symbols.

    The rounds go on until every window is spelled. In each, what its own words don't decide is popped from its
    ends and spelled out: the first and the last run with their lengths inside, a right symbol in front, a
    left symbol behind. What stays goes on to the next round as fewer, higher symbols; where nothing would
    stay, the symbols of the level before are spelled out. So equal windows have equal spellings, and a
    spelling says which words they are.
    """
    spelled = np.zeros(len(windows), np.uint64)
    symbols = Symbols(names, np.arange(len(names)), np.arange(1, len(names) + 1), docs)
    at, low, high = np.arange(len(windows)), windows, windows + width
    seed = 0
    while len(at):
        seed += 1
        runs, run = name_runs(symbols, seed)
        right = sides(runs.names, seed)
        first, behind = run[low], run[high - 1]
        last = len(right) - 1
        some = first + 1 < behind
        front = some & right[np.minimum(first + 1, last)]
        back = some & ~right[behind - 1]
        next_low, next_high = first + 1 + front, behind - back
        stays = next_low < next_high
        done = ~stays
        spelled[at[done]] = _spell(spelled[at[done]], symbols.names, low[done], high[done], seed)
        at, low, high, first, behind, front, back = (column[stays] for column in (at, low, high, first, behind, front, back))
        begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        popped = [
            spelled[at],
            symbols.names[low],
            (begins[first + 1] - low).astype(np.uint64),
            np.where(front, runs.names[first + 1], np.uint64(0)),
            np.where(back, runs.names[behind - 1], np.uint64(0)),
            (high - begins[behind]).astype(np.uint64),
            symbols.names[high - 1],
        ]
        spelled[at] = mix(sum(part * factor for part, factor in zip(popped, _FACTORS, strict=True)))
        symbols, place = name_pairs(runs, right)
        low, high = place[next_low[stays]], place[next_high[stays] - 1] + 1
    return spelled


def _spell(before: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """``before`` with all symbols from ``low`` to ``high`` added, symbol by symbol of all windows."""
    spelled = join_hashes(before, np.full(len(before), level, np.uint64))
    left = np.arange(len(before))
    while len(left):
        spelled[left] = join_hashes(spelled[left], names[low[left]])
        low = low + 1
        left = left[low[left] < high[left]]
    return spelled
