"""Token-id output: shards of directly addressable codes in ascending document order, and their readers."""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.llm.codes import Codes, encode
from docforge.llm.common import Memo, barrier, read_file, scratch, texts_of, write_file
from docforge.llm.wordpiece import byte_letters

#: A shard is closed when it holds this many ids or documents; bounds a task's memory and a file's size.
SHARD_IDS = 4_000_000
SHARD_DOCS = 200_000
_HEAD = "<8sQ"
_MAGIC = b"IDSHARD1"
#: Words that a task remembers before it starts anew.
REMEMBERED = 600_000
#: Letters before this one are precomposed, so no normal form changes them.
_PLAIN = "\u0250"
_BYTE_LETTERS = {byte: letter for letter, byte in byte_letters().items()}
#: Marks that may close a word. They are pieces of their own wherever they follow letters; an apostrophe isn't always.
_PUNCTUATION = b".,;:!?#$%&*"
#: Bytes of the texts that are encoded together.
_BLOCK = 4 << 20
_ANY_BYTES = pc.CastOptions(pa.large_string(), allow_invalid_utf8=True)


class WordEncoder:
    """Ids of texts, word by word.

    For byte-level tokenizers that drop white space and never join across it, fold letters to lower case, and read
    letters and the marks that close a word as pieces of their own. Words that repeat are remembered by a
    number, their ids in one pool. New words of Latin letters go to the tokenizer's model as it
    reads them itself, in lower case and byte by byte, once for all their spellings by case and closing marks; any other word
    goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = Memo(lambda marks: self._encode([marks.decode()])[0])
        self._forget()

    def _forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.pool = array("I")
        self.ends = array("q", [0])

    def _encode(self, parts: list[str]) -> list[list[int]]:
        return [code.ids for code in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        pieces, words_of, pool, ends, marked = self.tokenizer.model.tokenize, self.words, self.pool, self.ends, self.marks
        others: list[bytes] = []
        for word in words:
            core, marks = word, b""
            if not word.isalpha():  # ASCII letters alone
                core = word.rstrip(_PUNCTUATION)
                marks = word[len(core) :]
            if core.isalpha():
                letters, text = core.lower(), None
            else:
                text = core.decode("utf-8", "replace")
                lower = text.lower()
                if not (text.isalpha() and lower.isalpha() and max(text) < _PLAIN):
                    others.append(word)
                    continue
                letters = lower.encode()
            number = words_of.get(letters)
            if number is None:
                read = letters.decode() if text is None else letters.decode("latin-1").translate(_BYTE_LETTERS)
                pool.extend([piece.id for piece in pieces(read)])
                number = words_of[letters] = len(ends) - 1
                ends.append(len(pool))
            if marks:
                pool.extend(pool[ends[number] : ends[number + 1]])
                pool.extend(marked[marks])
                number = len(ends) - 1
                ends.append(len(pool))
            words_of[word] = number
        for word, ids in zip(others, self._encode([word.decode("utf-8", "replace") for word in others]), strict=True):
            pool.extend(ids)
            words_of[word] = len(ends) - 1
            ends.append(len(pool))

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; the distinct words of some texts at a time are looked up and learnt."""
        at = 0
        while at < len(texts):
            some, held = [], 0
            while at < len(texts) and held < _BLOCK:
                some.append(texts[at] or b"")
                held += len(some[-1])
                at += 1
            # Arrow cuts at the same six characters; a word of no letters stands for white space at an end, and has no ids.
            cut = pc.ascii_split_whitespace(pa.array(some, pa.large_binary()).cast(options=_ANY_BYTES))
            told = pc.dictionary_encode(cut.flatten())
            words = told.dictionary.cast(pa.large_binary()).to_pylist()
            known = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
            missing = np.flatnonzero(known < 0)
            if len(missing):
                new = [words[place] for place in missing.tolist()]
                self._learn(new)
                known[missing] = np.fromiter(map(self.words.__getitem__, new), np.int64, len(new))
            numbers = known[told.indices.to_numpy()]
            stops = cut.offsets.to_numpy()[1:]
            ends = np.frombuffer(self.ends, np.int64)
            starts = ends[numbers]
            sizes = ends[numbers + 1] - starts
            after = np.cumsum(sizes)
            total = int(after[-1]) if len(after) else 0
            ids = np.frombuffer(self.pool, np.uint32)[np.repeat(starts - after + sizes, sizes) + np.arange(total)] if total else np.zeros(0, np.uint32)
            del ends  # a view of a growing array
            places = np.concatenate([[0], after])
            start = 0
            for stop in places[stops].tolist():
                yield ids[start:stop]
                start = stop
            if len(self.words) > REMEMBERED:
                self._forget()


class TextEncoder:
    """Ids of texts by any tokenizer file, each text encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        for text in texts:
            code = self.tokenizer.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False)
            yield np.array(code.ids, np.uint32)


#: The steps of tokenizer files that ``WordEncoder`` is right for.
_NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def by_words(path: str) -> bool:
    """Whether a tokenizer file reads texts word by word, as ``WordEncoder`` does.

    Its steps must be the known ones, no text may be cut or filled, and each added token must hold a character that
    sends words with it through the whole tokenizer.
    """
    with open(path, encoding="utf-8") as source:
        held = json.load(source)
    marked = all(
        not (token["lstrip"] or token["rstrip"])
        and not any(letter.isspace() for letter in token["content"])
        and any(not letter.isalpha() and letter not in _PUNCTUATION.decode() for letter in token["content"])
        for token in held.get("added_tokens") or []
    )
    return (
        marked
        and (held.get("normalizer") or {}).get("normalizers") == _NORMALISERS
        and (held.get("pre_tokenizer") or {}).get("pretokenizers") == _SPLITTERS
        and held["model"].get("type") == "BPE"
        and not any(held.get(name) for name in ("truncation", "padding", "post_processor"))
        and not any(held["model"].get(name) for name in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder | TextEncoder:
    """The encoder for a tokenizer file: by words where that gives the same ids, else by whole texts."""
    return WordEncoder(path) if by_words(path) else TextEncoder(path)


def pack(keys: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A shard: documents' keys (a bitmap marks nulls), the ends of their ids, the codes."""
    null = np.packbits(np.array([key is None for key in keys], bool), bitorder="little").tobytes()
    return b"".join(
        [
            struct.pack(_HEAD, _MAGIC, len(keys)),
            np.array([key or 0 for key in keys], "<i8").tobytes(),
            np.cumsum(counts, dtype=np.uint64).astype("<u8").tobytes(),
            null + bytes(-len(null) % 8),
            encode(ids),
        ]
    )


class Shard:
    """A shard's documents and ids; any id can be read by its position."""

    def __init__(self, data: bytes):
        magic, count = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize(_HEAD)
        self.keys = np.frombuffer(data, "<i8", count, at)
        self.ends = np.frombuffer(data, "<u8", count, at + 8 * count).astype(np.int64)
        at += 16 * count
        size = (count + 7) // 8
        self.null = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count, bitorder="little").astype(bool)
        self.codes = Codes(memoryview(data)[at + (size + 7) // 8 * 8 :])

    def documents(self):
        """``key, start in the shard, ids`` of each document; the shard's ids are read as one range."""
        start, ids = 0, self.codes.read(0, self.codes.size)
        for key, null, end in zip(self.keys.tolist(), self.null.tolist(), self.ends.tolist(), strict=True):
            yield None if null else key, start, ids[start:end]
            start = end


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents in ascending key order; returns ``part, number, path, docs, ids`` of each shard.

    Rows are dealt by ranges of key and text hash, so rows that share a key are split as any others;
    null keys come first, ties go by text hash. A null text has the end id alone. An empty table
    gives no shards. A task that is run again writes the same files under the same names, and a
    file appears whole or not at all.
    """
    ordered = (
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("key", "tie")
        .sortWithinPartitions("key", "tie")
        .select("key", "text")
    )

    def write(batches):
        code, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys: list = []
        counts: list[int] = []
        coded: list[np.ndarray] = []
        tail = np.array([end_id], np.uint32)

        def close():
            nonlocal number
            path = f"{folder}/ids-{part:06d}-{number:05d}.dac"
            write_file(path, pack(keys, counts, np.concatenate(coded)))
            out = pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": path, "docs": len(keys), "ids": sum(counts)}])
            number += 1
            keys.clear(), counts.clear(), coded.clear()
            return out

        held = 0
        for batch in batches:
            for own, ids in zip(batch.column("key").to_pylist(), code.encode(texts_of(batch.column("text"))), strict=True):
                keys.append(own)
                counts.append(len(ids) + 1)
                coded += [ids, tail]
                held += len(ids) + 1
                if held >= SHARD_IDS or len(keys) >= SHARD_DOCS:
                    held = 0
                    yield close()
        if keys:
            yield close()

    written = ordered.mapInArrow(write, "part long, number long, path string, docs long, ids long")
    return barrier(written, "shards")[0]


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, path`` of each document, all read from the shards' files.

    ``start`` counts the ids of all documents before it: one row per shard is summed in order, and the
    positions inside come from the shard.
    """
    ahead = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("path", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("base"))
    tasks = min(max(shards.count(), 1), 10_000)

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = [(key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, start, ids in Shard(read_file(path)).documents()]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(values, pa.int64()) for values in columns), pa.array([path] * len(rows))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "path"],
                )

    return placed.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def tokenize_to_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``read_shards`` of ``write_shards``, in a scratch folder if none is given."""
    spark: SparkSession = docs.sparkSession
    return read_shards(write_shards(docs, folder or scratch(spark, "tokens"), tokenizer, end_id, key, text))
