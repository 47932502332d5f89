"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's terms, hashed into a fixed number of features. A
randomised singular value decomposition over all passages gives the latent space; windows of every
document are compared with every item there; what comes near is decided by the longest common
subsequence and, for paraphrases, by the item's answer. The documents are read three times, however many items
there are: for document frequencies, for the fit, and for the search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import LOWER, frugal, mix, name_words, sql_type, text_groups

#: Terms are hashed into this many features, whatever the benchmark's size.
FEATURES = 8192
RANK = 256
OVERSAMPLE = 16
#: Words in half a passage of the fit.
STEP = 16
#: Words in half a window; an item is compared with the narrowest windows that could hold it. Windows overlap by half.
STEPS = (4, 8, 16, 32)
#: Terms of each passage of an item that are features at least, however common they are.
RAREST = 6

_TABLE = np.array([LOWER[byte] if chr(byte).isalnum() or byte > 127 or byte == 39 else 32 for byte in range(256)], np.uint8)


@dataclass(frozen=True)
class Limits:
    cosine: float = 0.35  # a window this near to a passage of its own size is checked; less near to a smaller one
    share: float = 0.15  # and holds at least this part of the passage's own length in the space
    same: float = 0.8  # common subsequence, of the item's words, that decides alone
    paraphrase: float = 0.6  # that decides with the answer
    answer: float = 0.6  # of the answer's words, in order
    common: float = 0.03  # terms in more than this part of all documents are no features


def plain_words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and bytes beyond ASCII; A-Z in lower case."""
    return text.translate(_TABLE.tobytes()).split() if text else []


def names_of(words: list[bytes]) -> list[int]:
    return name_words(pa.array([b" ".join(words)], pa.binary()))[0].tolist()


def answer_words(text: bytes) -> list[bytes]:
    """What follows the last question mark, else the last sentence; the last fifth of the words if that is all."""
    words = plain_words(text)
    tail = plain_words(text.rpartition(b"?")[2]) if b"?" in text else plain_words(text.rstrip(b" .!\n").rpartition(b".")[2])
    return tail if 0 < len(tail) <= len(words) // 2 else words[-max(1, len(words) // 5) :]


def positions(words: list[int]) -> dict[int, int]:
    """The positions of each word, as bits."""
    places: dict[int, int] = {}
    for position, word in enumerate(words):
        places[word] = places.get(word, 0) | 1 << position
    return places


@dataclass
class Item:
    """An item of the benchmark: its words and its answer's by name. Positions are worked out where a task first meets the item."""

    key: object
    words: list[int]
    answer: list[int]

    @cached_property
    def places(self) -> dict[int, int]:
        return positions(self.words)

    @cached_property
    def answer_places(self) -> dict[int, int]:
        return positions(self.answer)

    @classmethod
    def of(cls, key, text: bytes) -> Item:
        return cls(key, names_of(plain_words(text)), names_of(answer_words(text)))

    def step(self) -> int:
        return next((step for step in STEPS if len(self.words) <= 2 * step), STEPS[-1])

    def passages(self) -> list[list[int]]:
        """All words, if a window can hold them, else passages of the widest window's size that overlap by half."""
        step = self.step()
        last = max(len(self.words) - 2 * step, 0)
        return [self.words[at : at + 2 * step] for at in (*range(0, last, step), last)]


def matches_of(words: list[int], places: dict[int, int]) -> list[int]:
    """The positions, as bits, of those words that an item has."""
    return list(filter(None, map(places.get, words)))


def longest(matches: list[int], size: int) -> int:
    """Length of the longest common subsequence, one bit operation on the item per match."""
    full = (1 << size) - 1
    row = full
    for match in matches:
        kept = row & match
        row = ((row + kept) | (row - kept)) & full
    return size - row.bit_count()


def common_subsequence(words: list[int], places: dict[int, int], size: int) -> int:
    return longest(matches_of(words, places), size)


class Terms:
    """A sorted list of names of the items' words, and the numbers of those among other names. ``use`` marks those that are features."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.use = np.ones(len(names), bool)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(names & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the names are terms, and which."""
        at = np.flatnonzero(self.filter[(names & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(at) or not len(self.names):
            return at[:0], at[:0]
        number = np.minimum(np.searchsorted(self.names, names[at]), len(self.names) - 1)
        hit = self.names[number] == names[at]
        return at[hit], number[hit]

    def groups(self, column: pa.Array, step: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For neighbouring texts together: the first one's row, all names, where each text's begin (and the end),
        the first half window of each (and the end), where items' words stand, and the half windows and numbers of features.
        Half windows of any width begin with the text, and the widest one after it is empty."""
        for first, group in text_groups(column):
            names, ends = name_words(group, _TABLE)
            begins = np.concatenate([[0], ends])
            slots = np.concatenate([[0], np.cumsum(np.diff(begins) // STEPS[-1] + 2)]) * (STEPS[-1] // step)
            known, term = self.find(names)
            used = self.use[term]
            at, term = known[used], term[used]
            owner = np.searchsorted(ends, at, side="right")
            yield first, names, begins, slots, known, slots[owner] + (at - begins[owner]) // step, term


def _sums(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows summed by ascending group: the groups, and their sums."""
    if not len(groups):
        return groups, rows
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return groups[starts], np.add.reduceat(rows, starts, axis=0)


def _short_sums(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_sums`` for many groups of few rows: all first rows, then all second ones where there are any, and so on."""
    if not len(groups):
        return groups, rows
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    sums = rows[starts]
    longer, place = np.flatnonzero(sizes > 1), 1
    while len(longer):
        sums[longer] += rows[starts[longer] + place]
        place += 1
        longer = longer[sizes[longer] > place]
    return groups[starts], sums


def document_frequencies(docs: DataFrame, text: str, terms: Terms) -> np.ndarray:
    """Documents that hold each term, over all documents; the last number is the count of documents."""

    def count(batches):
        total = np.zeros(len(terms.names) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, group in text_groups(batch.column("text")):
                names, ends = name_words(group, _TABLE)
                at, term = terms.find(names)
                held = np.unique(np.searchsorted(ends, at, side="right") << 32 | term)
                total[:-1] += np.bincount(held & 0xFFFFFFFF, minlength=len(terms.names))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["term", "docs"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(frugal(count), "term long, docs long")
    out = np.zeros(len(terms.names) + 1, np.int64)
    for row in counted.groupBy("term").agg(F.sum("docs").alias("docs")).collect():  # a row for each term of the block
        out[row.term] = row.docs
    return out


@dataclass
class Space:
    """Each term has a feature and a weight; ``basis`` has the latent coordinates of each feature, a fixed number of rows."""

    terms: Terms
    features: np.ndarray
    weights: np.ndarray
    basis: np.ndarray

    def vectors(self, found: np.ndarray) -> np.ndarray:
        return self.basis[self.features[found]] * self.weights[found, None]

    def place(self, words: list[int]) -> np.ndarray:
        found = self.terms.find(np.array(words, np.uint64))[1]
        return self.vectors(found[self.terms.use[found]]).sum(axis=0)


_BAND = 64  # features in one row of what tasks send


def fit_space(docs: DataFrame, text: str, items: list[Item], limits: Limits, seed: int = 11) -> Space:
    """The latent space of the TF-IDF passages of all documents and of the items.

    With A the passages' matrix and R a random one, tasks sum ``A' (A R)``, whose range holds the
    leading right singular vectors; bands of features are summed in Spark, and the driver orthonormalises one matrix
    of ``FEATURES`` times ``RANK + OVERSAMPLE``, a size that depends on no table.
    """
    known = Terms(np.array(sorted({word for item in items for word in item.words}), np.uint64))
    counts = document_frequencies(docs, text, known)
    total = max(int(counts[-1]), 1)
    use = counts[:-1] <= limits.common * total
    passages = [words for item in items for words in item.passages()]
    for words in passages:
        own = np.unique(known.find(np.array(words, np.uint64))[1])
        if use[own].sum() < RAREST:
            use[own[np.argsort(counts[own], kind="stable")[:RAREST]]] = True
    known.use = use
    weights = np.log((1 + total) / (1 + counts[:-1])).astype(np.float32) + np.float32(0.1)
    features = (mix(known.names) % np.uint64(FEATURES)).astype(np.int64)
    random = np.random.default_rng(seed).standard_normal((FEATURES, RANK + OVERSAMPLE)).astype(np.float32)

    def product(slots, found, into):
        """Adds A' (A R) for the passages that the slots number."""
        if len(found):
            rows = random[features[found]] * weights[found, None]
            held, images = _short_sums(rows, slots)
            back = images[np.searchsorted(held, slots)] * weights[found, None]
            order = np.argsort(features[found], kind="stable")
            held, sums = _sums(back[order], features[found][order])
            into[held] += sums

    def multiply(batches):
        into = np.zeros_like(random, dtype=np.float64)
        for batch in batches:
            for *_, slots, found in known.groups(batch.column("text")):
                product(slots // 2, found, into)
        bands = into.astype(np.float32).reshape(-1, _BAND * into.shape[1])
        used = np.flatnonzero(np.abs(bands).max(axis=1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([bands[band].tobytes() for band in used], pa.binary())], ["band", "sums"])

    def add(rows):
        total = None
        band = None
        for batch in rows:
            for own, data in zip(batch.column("band").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                if own != band and band is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([band], pa.int64()), pa.array([total.astype("<f4").tobytes()], pa.binary())], ["band", "sums"])
                    total = None
                band = own
                value = np.frombuffer(data, "<f4").astype(np.float64)
                total = value if total is None else total + value
        if band is not None:
            yield pa.RecordBatch.from_arrays([pa.array([band], pa.int64()), pa.array([total.astype("<f4").tobytes()], pa.binary())], ["band", "sums"])

    schema = "band long, sums binary"
    partial = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(frugal(multiply), schema)
    summed = partial.repartition("band").sortWithinPartitions("band").mapInArrow(frugal(add), schema)
    image = np.zeros_like(random, dtype=np.float64)
    for row in summed.collect():  # FEATURES / _BAND rows
        image[row.band * _BAND : (row.band + 1) * _BAND] += np.frombuffer(row.sums, "<f4").reshape(_BAND, -1)
    for words in passages:
        found = known.find(np.array(words, np.uint64))[1]
        found = found[use[found]]
        product(np.zeros(len(found), np.int64), found, image)
    left, values, _ = np.linalg.svd(image, full_matrices=False)
    basis = left[:, :RANK] * np.sqrt(np.divide(1, values[:RANK], out=np.zeros(RANK), where=values[:RANK] > 1e-9 * values[0]))
    return Space(known, features, weights, basis.astype(np.float32))


class Queries:
    """The passages of the items that windows of one width are compared with."""

    def __init__(self, space: Space, items: list[Item], step: int):
        own = [(number, words) for number, item in enumerate(items) if item.step() == step for words in item.passages()]
        vectors = np.array([space.place(words) for _, words in own], np.float32)
        lengths = np.linalg.norm(vectors, axis=1)
        use = lengths > 0
        self.step = step
        self.items = np.array([number for number, _ in own], np.int64)[use]
        self.lengths = lengths[use]
        self.scaled = np.ascontiguousarray((vectors[use] / self.lengths[:, None] ** 2).T)
        self.fill = np.sqrt(np.array([len(words) / (2 * step) for _, words in own]))[use]

    def candidates(self, held: np.ndarray, sums: np.ndarray, limits: Limits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows and items that come near, and their cosine, for ``CELLS`` windows times passages together.

        A window is two neighbouring half windows. Only those that hold a term are given (``held``, ascending, and their
        ``sums``), each is multiplied with all passages once, and a window's product is the sum of its halves'. Vectors of whole windows
        are built for candidates alone.
        """
        windows = np.union1d(held, held - 1)
        windows = windows[windows >= 0]
        size = max(CELLS // max(len(self.items), 1), 1)
        for low in range(0, len(windows) if len(self.items) else 0, size):
            part = windows[low : low + size]
            start, stop = np.searchsorted(held, (part[0], part[-1] + 2))
            rows = np.concatenate([sums[start:stop], np.zeros((1, sums.shape[1]), sums.dtype)])
            left, right = _places(held[start:stop], part), _places(held[start:stop], part + 1)
            products = rows @ self.scaled
            shares = products[left] + products[right]  # of the passage's own length
            window, query = np.divmod(np.flatnonzero(shares >= limits.share), len(self.items))
            different, own = np.unique(window, return_inverse=True)
            lengths = np.linalg.norm(rows[left[different]] + rows[right[different]], axis=1)
            cosine = shares[window, query] * self.lengths[query] / np.maximum(lengths, 1e-12)[own]
            near = cosine >= limits.cosine * self.fill[query]
            yield part[window[near]], self.items[query[near]], cosine[near]


def _places(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted numbers stand in an ascending list, or its length."""
    at = np.searchsorted(held, wanted)
    return np.where(held[np.minimum(at, len(held) - 1)] == wanted, at, len(held)) if len(held) else at


#: Windows times passages that are compared at a time.
CELLS = 1 << 23


MATCHES = "array<struct<item_id:long,item_words:long,lcs:long,answer_lcs:long,cosine:double>>"


def verify(words: list[int], item: Item, limits: Limits) -> tuple[int, int] | None:
    """The lengths of the common subsequence and of the answer's, if they decide for a leak."""
    size = len(item.words)
    held = matches_of(words, item.places)
    if len(held) < limits.paraphrase * size:  # a subsequence has no more words than match at all
        return None
    length = longest(held, size)
    if length < limits.paraphrase * size:
        return None
    said = common_subsequence(words, item.answer_places, len(item.answer))
    if length >= limits.same * size or said >= limits.answer * len(item.answer):
        return length, said
    return None


def items_of(benchmark: DataFrame, key: str, text: str) -> list[Item]:
    """The stated query set; items without words are left out."""
    rows = benchmark.select(F.col(key).cast("long"), F.col(text).cast("string")).toLocalIterator()
    return [Item.of(row[0], row[1].encode()) for row in rows if row[1] and plain_words(row[1].encode())]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``row`` (the document's columns) and ``matches``: the items that its text holds, verbatim or as a paraphrase.

    All documents against all items: one fit over all passages and one search over all windows. The items, their vectors
    and their terms travel to every task, so the benchmark must fit in a task's memory (about 1.5 kB for each passage); nothing of the documents does.
    Null and empty texts match nothing; a very long text is searched whole; repeated rows are judged each for itself;
    items that share a text match together, items with one key, or without, make one match; an empty benchmark matches nothing. Columns of any name stay in ``row``.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    items = items_of(benchmark, item_key, item_text)
    if not items:
        return rows.select("row", F.array().cast(MATCHES).alias("matches"))
    space = fit_space(docs, text, items, limits)
    queries = [Queries(space, items, step) for step in sorted({item.step() for item in items})]
    least = queries[0].step

    def search(batches):
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("item_words", pa.int64()), ("lcs", pa.int64()), ("answer_lcs", pa.int64()), ("cosine", pa.float64())]))
        for batch in batches:
            found: list[dict[object, dict]] = [{} for _ in range(batch.num_rows)]
            for first, names, begins, ends, known, slots, terms in space.terms.groups(batch.column("text"), least):
                used, sums = _short_sums(space.vectors(terms), slots)
                for wide in queries:
                    ratio = wide.step // least
                    held, own = _short_sums(sums, used // ratio) if ratio > 1 else (used, sums)
                    for near in wide.candidates(held, own, limits):
                        decide(*near, wide.step, first, names, begins, known, ends // ratio, found)
            out = [sorted(own.values(), key=lambda match: (match["item_id"] is None, match["item_id"] or 0)) for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], ["row", "matches"])

    def decide(window, item, cosine, step, first, names, begins, known, ends, found):
        owner = np.searchsorted(ends, window, side="right") - 1
        places: dict[tuple[int, int], list] = {}
        for own, slot, number, value in zip(owner.tolist(), (window - ends[owner]).tolist(), item.tolist(), cosine.tolist(), strict=True):
            places.setdefault((own, number), []).append((value, slot))
        for (own, number), near in places.items():
            one = items[number]
            size = len(one.words)
            reach = size + max(STEP, step)
            if one.key in found[first + own]:
                continue
            best = {slot: value for value, slot in sorted(near)}  # an item's passages may come near in one place
            for slot, value in sorted(best.items(), key=lambda place: -place[1]):
                middle = int(begins[own]) + (slot + 1) * step
                start, stop = np.searchsorted(known, (max(middle - reach, begins[own]), min(middle + reach, begins[own + 1])))
                decided = verify(names[known[start:stop]].tolist(), one, limits)  # other words match no item
                if decided:
                    found[first + own][one.key] = {"item_id": one.key, "item_words": size, "lcs": decided[0], "answer_lcs": decided[1], "cosine": float(value)}
                    break

    return rows.mapInArrow(frugal(search), f"row {sql_type(rows, 'row')}, matches {MATCHES}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents without a match, with their own columns."""
    return scan(docs, benchmark, text, limits=limits).where(F.size("matches") == 0).select("row.*")
