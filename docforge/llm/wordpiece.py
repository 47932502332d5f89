"""Greedy word-piece counts by a linear longest-match automaton over the vocabulary's trie."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import Memo, frugal, row_and_text, split_words, sql_type, texts_of

END = 256  # the mark behind a word's last byte
SYMBOLS = 257
NONE = -1
#: A word without a decomposition counts as one unknown piece.
UNKNOWN = 1


class LongestMatch:
    """Trie with failure links. ``popped[v]`` is the number of pieces that greedy matching has cut
    off when it falls from node ``v`` to ``fail[v]``; the pieces themselves are never built.

    A piece is a tuple of symbols: bytes, and ``END`` where it closes a word. With ``END`` alone among the pieces
    a word may also close behind a piece that doesn't say so; that mark counts nothing.
    """

    def __init__(self, pieces):
        self.child: dict[int, int] = {}
        parent, symbol, whole = [NONE], [NONE], [False]
        for piece in pieces:
            node = 0
            for x in piece:
                key = node * SYMBOLS + x
                after = self.child.get(key)
                if after is None:
                    after = self.child[key] = len(parent)
                    parent.append(node)
                    symbol.append(x)
                    whole.append(False)
                node = after
            whole[node] = node != 0
        self.fail = [NONE] * len(parent)
        self.popped = [0] * len(parent)
        self._link(parent, symbol, whole)

    def _link(self, parent, symbol, whole) -> None:
        depth = np.zeros(len(parent), np.int32)
        for node in range(1, len(parent)):  # parents come before their children
            depth[node] = depth[parent[node]] + 1
        for node in map(int, np.argsort(depth, kind="stable")[1:]):
            if whole[node]:
                self.fail[node], self.popped[node] = 0, int(parent[node] != 0 or symbol[node] != END)
                continue
            above, x = parent[node], symbol[node]
            at, count = self.fail[above], self.popped[above]
            while at != NONE and at * SYMBOLS + x not in self.child:
                at, count = self.fail[at], count + self.popped[at]
            if at != NONE:
                self.fail[node], self.popped[node] = self.child[at * SYMBOLS + x], count

    def count(self, word: bytes) -> int:
        """Pieces of one word: each symbol moves forward once, each fall pops at least one piece."""
        child, node, count = self.child, 0, 0
        for x in (*word, END):
            after = child.get(node * SYMBOLS + x)
            while after is None:
                count += self.popped[node]
                node = self.fail[node]
                if node == NONE:
                    return UNKNOWN
                after = child.get(node * SYMBOLS + x)
            node = after
        while node:
            count += self.popped[node]
            node = self.fail[node]
            if node == NONE:
                return UNKNOWN
        return count


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes (fixed by their format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(byte): byte for byte in plain}
    rest = [byte for byte in range(256) if byte not in set(plain)]
    return letters | {chr(256 + position): byte for position, byte in enumerate(rest)}


def pieces_of(path: str, word_end: str = "</w>"):
    """The pieces of a vocabulary file of the tokenizers library whose pieces mark word ends."""
    with open(path, encoding="utf-8") as source:
        vocabulary = json.load(source)["model"]["vocab"]
    letters = byte_letters()
    yield (END,)
    for piece in sorted(vocabulary):
        body = piece.removesuffix(word_end)
        if body and all(letter in letters for letter in body):
            yield (*[letters[letter] for letter in body], *[END] * piece.endswith(word_end))


@lru_cache(maxsize=4)
def matcher(path: str) -> LongestMatch:
    return LongestMatch(pieces_of(path))


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``row`` (the document's columns), ``n_words`` and ``n_pieces``.

    Words ``[^\\x20\\x09-\\x0D]+``, lower-cased, are cut greedily into the longest pieces. Whole texts,
    no shuffle. Null and empty texts have no words; repeated rows count each for itself; an empty
    table gives an empty result. ``vocabulary`` is a file that every executor can open.
    """

    def count(batches):
        pieces = Memo(matcher(vocabulary).count)
        for batch in batches:
            words = [split_words(value.decode("utf-8", "replace").lower().encode() if value else None) for value in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(map(len, words), pa.int64()),
                    pa.array((sum(map(pieces.__getitem__, own)) for own in words), pa.int64()),
                ],
                ["row", "n_words", "n_pieces"],
            )

    rows = row_and_text(docs, F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(frugal(count), f"row {sql_type(rows, 'row')}, n_words long, n_pieces long")
