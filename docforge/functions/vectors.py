"""Numeric kernels that run on Arrow batches inside tasks."""

from __future__ import annotations

from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

DIMENSIONS = 384
REMEMBERED_WORDS = 2**20
ROWS_AT_ONCE = 256


class WordHashes(dict):
    """First 28 bits of md5 by word; words repeat, so each is hashed once."""

    def __missing__(self, word: str) -> int:
        hashed = int.from_bytes(md5(word.encode()).digest()[:4], "big") >> 4
        self[word] = hashed
        return hashed


class HashingEmbedder:
    """Signed feature hashing of lower-cased words, L2-normalised.

    Stands in for a learned model where none can be downloaded. A word adds +1
    or -1 to one position; its hash gives both. Words end at white space.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self._hashes = WordHashes()

    def __call__(self, texts: pd.Series) -> np.ndarray:
        out = np.empty((len(texts), self.dimensions), np.float32)
        # Few rows at a time, so that the counting table stays in the cache.
        for start in range(0, len(texts), ROWS_AT_ONCE):
            out[start : start + ROWS_AT_ONCE] = self._embed(texts[start : start + ROWS_AT_ONCE])
        if len(self._hashes) > REMEMBERED_WORDS:
            self._hashes.clear()
        return out

    def _embed(self, texts: pd.Series) -> np.ndarray:
        words = [text.lower().split() for text in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        hashed = np.fromiter(
            map(self._hashes.__getitem__, chain.from_iterable(words)), np.int64, counts.sum()
        )
        row = np.repeat(np.arange(len(words)), counts)
        table = np.bincount(
            row * self.dimensions + hashed % self.dimensions,
            weights=1.0 - 2.0 * (hashed // self.dimensions % 2),
            minlength=len(words) * self.dimensions,
        ).reshape(len(words), self.dimensions)
        return normalise(table)


def normalise(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero."""
    rows = np.asarray(rows, np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def to_lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as an Arrow ``list<float>`` array, without a Python object per value."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(rows.astype(np.float32, copy=False).ravel()))


def to_matrix(lists: pa.Array, dimensions: int) -> np.ndarray:
    """An Arrow list array as a float64 matrix; every vector must have ``dimensions`` values."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if not (lengths == dimensions).all():
        raise ValueError(f"every vector must have {dimensions} values")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


class TopMatches:
    """Running best ``k`` parents per query over the batches of one task.

    A parent scores as its best chunk. Keeping k parents per task is exact: a
    parent of the overall best k beats all but k-1 others wherever its best
    chunk is. Equal scores rank by smaller id.
    """

    def __init__(self, queries: np.ndarray, k: int, digits: int):
        self._queries = normalise(np.asarray(queries, np.float64))
        self._k = k
        self._digits = digits
        empty = (np.empty(0, np.int64), np.empty(0, np.float64))
        self._best = [empty] * len(self._queries)

    def add(self, parents: np.ndarray, vectors: np.ndarray) -> None:
        sound = np.isfinite(vectors).all(axis=1)  # a broken vector matches nothing
        parents = parents[sound]
        scores = np.round(normalise(vectors[sound]) @ self._queries.T, self._digits)
        for q, (ids, held) in enumerate(self._best):
            self._best[q] = self._cut(
                np.concatenate([ids, parents]), np.concatenate([held, scores[:, q]])
            )

    def _cut(self, ids: np.ndarray, scores: np.ndarray):
        ids, scores = self._above_kth_parent(ids, scores)
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[: self._k]
        return ids[first], scores[first]

    def _above_kth_parent(self, ids: np.ndarray, scores: np.ndarray):
        """Cheap first cut: drop what lies below a score that k parents reach."""
        wanted = self._k
        while wanted < len(scores):
            floor = np.partition(scores, -wanted)[-wanted]
            reach = scores >= floor
            if len(np.unique(ids[reach])) >= self._k:
                return ids[reach], scores[reach]
            wanted *= 4
        return ids, scores

    def rows(self):
        """``query_index, ids, scores`` of what is held."""
        for q, (ids, scores) in enumerate(self._best):
            yield q, ids, scores
