"""Substring dedup by recompression: shared symbols reveal repeated windows, their spellings in symbols verify them.

Four steps, each a shuffle of its own size: every window's anchor goes by its name, and those that occur once
fall out; documents with shared anchors send their windows by spelling, and all but the first occurrence come back;
each document is then cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import barrier, frugal, join_hashes, mix, name_words, release, remove, sql_type, text_groups, texts_of, window_hashes
from docforge.llm.recompression import anchors, spellings

WIDTH = 20
#: Words beside an anchor that its name takes in, where the window has them.
BESIDE = 3

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(count, base, np.uint64)]))


def anchor_keys(names: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``window, key, place`` for each window: the anchor's symbol with the words beside it, by name and as
    ``64 * start + length`` in the sequence. Equal windows have equal keys."""
    window, symbol, start, length = anchors(names, docs, width)
    low = np.maximum(window, start - BESIDE)
    high = np.minimum(window + width, start + length + BESIDE)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(names * _powers(_ODD, len(names))[:-1])])
    beside = (sums[high] - sums[low]) * _powers(_INVERSE, len(names))[low]
    return window, join_hashes(symbol, beside + (high - low).astype(np.uint64)), low * 64 + (high - low)


def _documents(ends: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))


def _spread(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names for rows that are decided already and only have to travel: one for 64 places of a document, so that
    rows spread, and lie together where they are written."""
    return mix(keys.astype(np.uint64) * np.uint64(_ODD) + (starts >> 6).astype(np.uint64))


def _send_anchors(width: int):
    """``name, key, place, sure`` of each distinct anchor of a document; places count from the document's start.

    Of a name that some neighbouring texts hold more than once, all are shared (``sure``) and go under names of
    their own; one goes under the name, for the others elsewhere. So a name brings a row for each group of
    texts to its task, however common it is.
    """

    def send(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for first, group in text_groups(batch.column("text")):
                names, ends = name_words(group)
                docs = _documents(ends)
                _, name, place = anchor_keys(names, docs, width)
                place, index = np.unique(place, return_index=True)
                name, owner = name[index], docs[place >> 6]
                own, place = keys[first + owner], place - np.concatenate([[0], ends])[owner] * 64
                order = np.argsort(name, kind="stable")
                fresh = np.concatenate([[True], name[order][1:] != name[order][:-1]])[: len(order)]
                often = np.bincount(np.cumsum(fresh) - 1, minlength=int(fresh.sum()))[np.cumsum(fresh) - 1] > 1
                alone, sure = np.sort(order[fresh]), np.sort(order[often])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([name[alone], _spread(own[sure], place[sure] >> 6)]).view(np.int64)),
                        pa.array(np.concatenate([own[alone], own[sure]])),
                        pa.array(np.concatenate([place[alone], place[sure]])),
                        pa.array(np.arange(len(alone) + len(sure)) >= len(alone)),
                    ],
                    ["name", "key", "place", "sure"],
                )

    return send


def _keep_shared(batches):
    """Rows, in the order of their name, whose name occurs again or that are sure; what is held is one row."""
    held = None
    shared = False
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        name = batch.column("name").to_numpy()
        same = name[1:] == name[:-1]
        keep = np.zeros(len(name), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= shared and held is not None
        keep |= batch.column("sure").to_numpy(zero_copy_only=False)
        shared = bool(keep[-1])
        held = batch.slice(len(name) - 1, 1)
        yield batch.select(["key", "place"]).filter(pa.array(keep[:-1].tolist() + [False]))
    if held is not None and shared:
        yield held.select(["key", "place"])


def _send_windows(width: int):
    """``name, check, key, tie, start, sure`` of each window whose anchor is shared.

    ``name`` is the window's spelling in symbols, ``check`` a second name made of its words. A window that has an earlier equal among neighbouring texts is decided there (``sure``) and goes under a name of
    its own; only the first of each name competes with those of other tasks.
    """

    def send(batches):
        for batch in batches:
            keys, ties = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "tie"))
            places = batch.column("places")
            for first, group in text_groups(batch.column("text")):
                names, ends = name_words(group)
                docs = _documents(ends)
                begins = np.concatenate([[0], ends])
                window, _, place = anchor_keys(names, docs, width)
                shared = places.slice(first, len(group))
                counts = np.diff(shared.offsets.to_numpy())
                known = np.sort(shared.flatten().to_numpy() + 64 * np.repeat(begins[:-1], counts))
                if not len(known) or not len(window):
                    continue
                hit = known[np.minimum(np.searchsorted(known, place), len(known) - 1)] == place
                window = window[hit]
                if not len(window):
                    continue
                owner = docs[window]
                name = spellings(names, docs, window, width)
                check = window_hashes(mix(names + np.uint64(_ODD)), width)[window]
                place = (keys[first + owner], ties[first + owner], window - begins[owner])
                order = np.lexsort((*place[::-1], check, name))
                name, check, (key, tie, start) = name[order], check[order], (column[order] for column in place)
                fresh = np.ones(len(name), bool)
                fresh[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
                least = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                sure = (key != key[least]) | (tie != tie[least]) | (start != start[least])
                name = np.where(sure, _spread(key ^ tie, start), name)
                check = np.where(sure, 0, check)
                again = np.zeros(len(name), bool)  # the same place of a row that is repeated
                again[1:] = ~fresh[1:] & (key[1:] == key[:-1]) & (tie[1:] == tie[:-1]) & (start[1:] == start[:-1])
                send = np.lexsort((start, key))
                send = send[~again[send]]
                name, check, key, tie, start, sure = (column[send] for column in (name, check, key, tie, start, sure))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(check.view(np.int64)), pa.array(key), pa.array(tie), pa.array(start), pa.array(sure)],
                    ["name", "check", "key", "tie", "start", "sure"],
                )

    return send


def _keep_later(batches):
    """Windows, in the order of their names and places, that are sure or not at the place of the first of their name."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        name, check, *place = (batch.column(column).to_numpy() for column in ("name", "check", "key", "tie", "start"))
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (check[1:] != check[:-1])
        goes_on = last is not None and last[:2] == (name[0], check[0])
        fresh[0] = not goes_on
        run = np.cumsum(fresh) - (0 if goes_on else 1)
        later = batch.column("sure").to_numpy(zero_copy_only=False).copy()
        firsts = []
        for position, column in enumerate(place):
            first = column[fresh]
            if goes_on:
                first = np.concatenate([[last[2 + position]], first])
            later |= column != first[run]
            firsts.append(first[-1])
        last = (name[-1], check[-1], *firsts)
        yield batch.select(["key", "tie", "start"]).filter(pa.array(later))


def cut(text: bytes | None, starts: list[int] | None, width: int = WIDTH) -> tuple[int, list[bytes]]:
    """The number of words, and those that no window from ``starts`` covers."""
    words = text.split() if text else []
    if not starts:
        return len(words), words
    edges = np.zeros(len(words) + 1, np.int32)
    edges[starts] += 1
    np.subtract.at(edges, np.array(starts) + width, 1)
    kept = np.flatnonzero(np.cumsum(edges[:-1]) <= 0)
    return len(words), [words[place] for place in kept.tolist()]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``row`` (the document's columns), ``n_words``, ``n_removed``, ``kept`` (words joined by one space) and ``kept_sha256``.

    Words ``[^\\x20\\x09-\\x0D]+`` of whole texts. Each word is removed that lies in a window of
    ``width`` words whose words also start earlier: in a document with a smaller key, or earlier in the same
    one. Windows are judged on the input. Null and empty texts, and texts of fewer words, keep all they
    have. A null key is smaller than any. Rows with one key stand in the order of a hash of their text; rows equal in both
    are one document, so neither takes the other's words. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own_key = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    value = F.col(text).cast("string")
    plain = docs.select(own_key.alias("key"), F.xxhash64(value).alias("tie"), value.alias("text"))

    # Rows that share a key share their places too: a place more is a window more to look at.
    sent = plain.mapInArrow(frugal(_send_anchors(width)), "name long, key long, place long, sure boolean")
    shared = sent.repartition("name").sortWithinPartitions("name").mapInArrow(frugal(_keep_shared), "key long, place long")
    places, places_path = barrier(shared.groupBy("key").agg(F.collect_set("place").alias("places")), "anchors")
    del sent, shared
    release(spark)

    asked = plain.join(places, "key").select("key", "tie", "text", "places")
    windows = asked.mapInArrow(frugal(_send_windows(width)), "name long, check long, key long, tie long, start long, sure boolean")
    ordered = windows.repartition("name", "check").sortWithinPartitions("name", "check", "key", "tie", "start")
    later = ordered.mapInArrow(frugal(_keep_later), "key long, tie long, start long")
    repeats, _ = barrier(later.groupBy("key", "tie").agg(F.collect_set("start").alias("starts")), "repeats")
    del asked, windows, ordered, later, places
    remove(spark, places_path)
    release(spark)

    def finish(batches):
        for batch in batches:
            starts = batch.column("starts")
            counts, removed, kept, digests = [], [], [], []
            for first, group in text_groups(batch.column("text")):
                for value, own in zip(texts_of(group), starts.slice(first, len(group)).to_pylist(), strict=True):
                    count, words = cut(value, own, width)
                    joined = b" ".join(words)
                    counts.append(count)
                    removed.append(count - len(words))
                    kept.append(joined)
                    digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                ["row", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    rows = docs.select(F.struct("*").alias("row"), own_key.alias("key"), F.xxhash64(value).alias("tie"))
    marked = rows.join(repeats, ["key", "tie"], "left").select("row", F.col(f"row.{text}").cast("string").alias("text"), "starts")
    return marked.mapInArrow(frugal(finish), f"row {sql_type(rows, 'row')}, n_words long, n_removed long, kept string, kept_sha256 string")
