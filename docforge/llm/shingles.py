"""Shingle sets and the universe partition that the n-gram Jaccard join draws its signatures from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from docforge.llm.common import LOWER, join_hashes, mix, name_words, window_hashes

SHINGLE = 5
#: Similarity is at least OVER / UNDER.
OVER, UNDER = 3, 4


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted, distinct names of each text's shingles; with fewer words, one name for them all."""
    names, ends = name_words(column, LOWER)
    grams = window_hashes(names, SHINGLE)
    start = 0
    for end in ends.tolist():
        if end - start >= SHINGLE:
            yield np.unique(grams[start : end - SHINGLE + 1])
        else:
            yield mix(window_hashes(names[start:end], end - start) + np.uint64(end - start)) if end > start else names[:0]
        start = end


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    """Exact test on two sorted sets: 100 |A ∩ B| >= 75 |A ∪ B|."""
    if not len(left) or not len(right):
        return False
    if min(len(left), len(right)) * UNDER < OVER * max(len(left), len(right)):
        return False
    both = np.concatenate([left, right])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return UNDER * common >= OVER * (len(left) + len(right) - common)


def most_differences(left: int, right: int) -> int:
    """Elements that two linked sets of these sizes can differ by: at most a seventh of their sum."""
    return (UNDER - OVER) * (left + right) // (UNDER + OVER)


def print_of(names: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    value = xxhash.xxh3_128_intdigest(names.tobytes())
    return (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


# ---------------------------------------------------------------- size bands


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` elements. Pairs belong to the band of their smaller set.

    The universe is hashed into ``segments``. ``deleting`` bands index one-deletion neighbourhoods too.
    """

    number: int
    low: int
    high: int
    segments: int
    deleting: bool


#: Below this size a set has few segments, and neighbourhoods of all of them are cheap.
SMALL = 48
GROWTH = 1.6


@lru_cache(maxsize=1)
def bands() -> tuple[Band, ...]:
    """Bands up to sets of 2^40 elements. Segments are as many as the largest partner's allocation needs, and
    a fifth more, so that it can pass over empty ones."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * GROWTH))
        need = most_differences(high, high * UNDER // OVER) + 1
        small = high <= SMALL
        out.append(Band(len(out), low, high, need if small else need * 6 // 5 + 2, small))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=1)
def _lows() -> np.ndarray:
    return np.array([band.low for band in bands()], np.int64)


def band_of(size: int) -> int:
    return int(np.searchsorted(_lows(), size, side="right")) - 1


def probed_bands(size: int) -> range:
    """Bands that may hold a smaller partner of a set of this size, its own last."""
    return range(band_of(-(-OVER * size // UNDER)), band_of(size) + 1)


@dataclass
class Segments:
    """A set dealt to a band's segments: the elements in segment order, where each segment starts, and its name."""

    band: Band
    used: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    names: np.ndarray
    elements: np.ndarray
    common: np.ndarray

    @classmethod
    def deal(cls, names: np.ndarray, band: Band, frequent: np.ndarray) -> Segments:
        place = mix(names ^ np.uint64(0xA5A5 + 7919 * band.number))
        segment = (place % np.uint64(band.segments)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment = segment[order]
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        values = place[order]
        used = segment[starts]
        sizes = np.diff(np.concatenate([starts, [len(segment)]]))
        common = np.logical_and.reduceat(frequent[order], starts)
        return cls(band, used, starts, sizes, cls._name(np.add.reduceat(values, starts), used, sizes, band), values, common)

    @staticmethod
    def _name(sums, segments, sizes, band):
        """A segment's subset by the sum of its hashed elements, its size and its place."""
        place = segments.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(band.number)
        return join_hashes(sums, mix(place) + sizes.astype(np.uint64))

    def deletions(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """Names of the subsets with one element left out, of all or of the chosen segments."""
        owner = np.repeat(np.arange(len(self.used)), self.sizes)
        sums = np.add.reduceat(self.elements, self.starts)[owner] - self.elements
        keep = self.sizes[owner] > 1
        if chosen is not None:
            keep &= np.isin(owner, chosen)
        owner, sums = owner[keep], sums[keep]
        return self._name(sums, self.used[owner], self.sizes[owner] - 1, self.band)


def allocate(segments: Segments, need: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Segments to probe for an equal subset, and those to probe for one that differs by an element.

    Two sets that differ by fewer than ``need`` elements agree on one of the first, or nearly on one of the
    second, if each of the first counts one and each of the second two. The cheapest go first: large
    subsets are rare, those of frequent elements alone come last, one-deletion probes cost a probe for
    each element, and empty segments, which all sets would share, are never probed. None if the
    segments can't reach ``need``.
    """
    order = np.lexsort((-segments.sizes, segments.common))
    count = len(order)
    if count >= need:
        return order[:need], order[:0]
    near = need - count
    if segments.band.deleting:
        able = order[segments.sizes[order] > 1][::-1]
        if len(able) >= near:
            return np.setdiff1d(order, able[:near]), able[:near]
    return None


#: Roles of an entry. A pair meets where one of the two probes.
PROBE, INDEX, SHORT = 0, 1, 2


def signatures(names: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``signature, role`` of a set in all bands.

    In its own band a set indexes all its subsets (and one-deletion neighbours, in deleting bands). In
    each band that may hold a smaller partner it probes what it allocates. Names of deletions and of whole subsets
    are alike, so subsets that differ by one element meet. Where an allocation falls short, the
    set's first elements by name follow as ``SHORT``: a linked set holds one of any ``size / 4 + 1``.
    """
    found: list[np.ndarray] = []
    roles: list[np.ndarray] = []

    def add(signs, role):
        found.append(signs)
        roles.append(role if isinstance(role, np.ndarray) else np.full(len(signs), role, np.int64))

    size, short = len(names), False
    own = band_of(size)
    for number in probed_bands(size):
        band = bands()[number]
        dealt = Segments.deal(names, band, frequent)
        chosen = allocate(dealt, most_differences(size, min(size, band.high)) + 1)
        short |= chosen is None
        exact, near = chosen or (np.zeros(0, np.int64), np.zeros(0, np.int64))
        probes = np.concatenate([exact, near])
        if number == own:
            role = np.full(len(dealt.used), INDEX, np.int64)
            role[probes] = PROBE
            add(dealt.names, role)
            if band.deleting:
                owner = np.repeat(np.arange(len(dealt.used)), dealt.sizes)
                owner = owner[dealt.sizes[owner] > 1]
                add(dealt.deletions(), np.where(np.isin(owner, near), PROBE, INDEX).astype(np.int64))
        else:
            add(dealt.names[probes], PROBE)
            if len(near):
                add(dealt.deletions(near), PROBE)
    if short:
        add(names[: size // UNDER + 1], SHORT)
    return np.concatenate(found), np.concatenate(roles)


def _slowly(sets: list[np.ndarray], often: list[np.ndarray]):
    for number, (names, frequent) in enumerate(zip(sets, often, strict=True)):
        sign, role = signatures(names, frequent)
        yield np.full(len(sign), number), sign, role


def signatures_of(sets: list[np.ndarray], often: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``set, signature, role`` of many sets: ``signatures`` of each, worked out together.

    Sets in deleting bands, and those whose allocation must go beyond whole subsets, are done one by one.
    """
    table = bands()
    plain = [number for number, names in enumerate(sets) if not table[probed_bands(len(names))[0]].deleting]
    slow = sorted(set(range(len(sets))) - set(plain))
    out = list(_slowly([sets[number] for number in slow], [often[number] for number in slow]))
    out = [(np.array(slow)[owner], sign, role) for owner, sign, role in out]
    if plain:
        pairs = [(number, band) for number in plain for band in probed_bands(len(sets[number]))]
        owner = np.array([number for number, _ in pairs])
        band = np.array([number for _, number in pairs])
        size = np.array([len(sets[number]) for number in owner.tolist()])
        own = np.array([band_of(int(n)) for n in size]) == band
        high = np.array([table[number].high for number in band.tolist()])
        need = (UNDER - OVER) * (size + np.minimum(size, high)) // (UNDER + OVER) + 1
        segments = np.array([table[number].segments for number in band.tolist()], np.uint64)
        elements = np.concatenate([sets[number] for number in owner.tolist()])
        frequent = np.concatenate([often[number] for number in owner.tolist()])
        of = np.repeat(np.arange(len(pairs)), size)
        place = mix(elements ^ (np.uint64(0xA5A5) + np.uint64(7919) * band.astype(np.uint64))[of])
        segment = of << 40 | (place % segments[of]).astype(np.int64)
        order = np.argsort(segment)
        segment, place = segment[order], place[order]
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        pair = segment[starts] >> 40
        sizes = np.diff(np.append(starts, len(segment)))
        common = np.logical_and.reduceat(frequent[order], starts)
        where = (segment[starts] & ((1 << 40) - 1)).astype(np.uint64) * np.uint64(1 << 20) + band[pair].astype(np.uint64)
        sign = join_hashes(np.add.reduceat(place, starts), mix(where) + sizes.astype(np.uint64))
        ranked = np.argsort(pair << 30 | common.astype(np.int64) << 29 | ((1 << 29) - 1 - sizes), kind="stable")
        counts = np.bincount(pair, minlength=len(pairs))
        rank = np.empty(len(pair), np.int64)
        rank[ranked] = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
        probe = rank < need[pair]
        failed = np.unique(owner[counts < need])
        keep = (probe | own[pair]) & ~np.isin(owner[pair], failed)
        out.append((owner[pair[keep]], sign[keep], np.where(probe[keep], PROBE, INDEX).astype(np.int64)))
        for number in failed.tolist():
            out += [(np.full(len(sign), number), sign, role) for _, sign, role in _slowly([sets[number]], [often[number]])]
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*out, strict=True)) if out else empty
