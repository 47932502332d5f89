import random

import numpy as np
import pyarrow as pa
import pytest
from llm import brute
from llm.brute import copies

from docforge.llm import recompression, substring
from docforge.llm.common import name_words, text_groups, window_hashes


def result(frame):
    return {row["row"]["doc_id"]: (row.n_words, row.n_removed, row.kept_sha256) for row in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_brute_force(make_docs, seed):
    texts = copies(seed, count=80)
    assert result(substring.remove_repeats(make_docs(texts))) == brute.cut(list(enumerate(texts)))


def test_documents_against_brute_force(documents, document_rows):
    assert result(substring.remove_repeats(documents)) == brute.cut(document_rows)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    for alphabet in (1, 2, 5, 1000):
        names = rng.integers(0, alphabet, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        names[2000:2300] = names[100:400]
        names[3000:3050] = names[3100]
        docs = np.repeat(np.arange(8), 500)
        window, key, place = substring.anchor_keys(names, docs, 20)
        whole = window_hashes(names, 20)[window]
        seen = {}
        for name, anchor, at, start in zip(whole.tolist(), key.tolist(), place.tolist(), window.tolist(), strict=True):
            assert seen.setdefault(name, (anchor, (at >> 6) - start, at & 63)) == (anchor, (at >> 6) - start, at & 63)
        assert ((place >> 6 >= window) & ((place >> 6) + (place & 63) <= window + 20)).all()


@pytest.mark.parametrize("alphabet", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("width", [1, 2, 5, 20])
def test_spellings_are_equal_where_windows_are(alphabet, width):
    rng = np.random.default_rng(alphabet + width)
    names = rng.integers(0, alphabet, 6000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    names[2000:2300] = names[100:400]
    names[3000:3050] = names[3100]
    docs = np.repeat(np.arange(12), 500)
    window = np.flatnonzero(docs[: 6000 - width + 1] == docs[width - 1 :])
    window = window[rng.random(len(window)) < 0.8]
    spelled = recompression.spellings(names, docs, window, width).tolist()
    words = [tuple(names[start : start + width].tolist()) for start in window.tolist()]
    known = {}
    for name, own in zip(spelled, words, strict=True):
        assert known.setdefault(name, own) == own
    assert len(known) == len(set(words))


def test_rounds_shrink_a_sequence():
    names = np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64)
    symbols = recompression.Symbols(names, np.arange(10_000), np.arange(1, 10_001), np.zeros(10_000, int))
    shorter, _ = recompression.name_pairs(symbols, recompression.sides(names, 1))
    assert 7000 < len(shorter.names) < 8000 and shorter.ends[-1] == 10_000
    assert (shorter.starts[1:] == shorter.ends[:-1]).all()


def test_words_are_named_alike_wherever_they_stand():
    rng = random.Random(3)
    parts = ["a", "b", "é", " ", "\n", "\t", "\x0b", "\x0c", "\r", "ab", "x" * 300, "\x1c", "\xa0", "\x85"]
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(400)]
        column = pa.array([text.encode() if text is not None and kind == pa.binary() else text for text in texts], kind).slice(3)
        known = {}
        for first, group in text_groups(column, 200):
            names, ends = name_words(group)
            words = [brute.words_of(text) for text in texts[3 + first :][: len(group)]]
            assert ends.tolist() == np.cumsum([len(own) for own in words]).tolist()
            for word, name in zip(sum(words, []), names.tolist(), strict=True):
                assert known.setdefault(word, name) == name
        assert len(set(known.values())) == len(known)


def test_repeated_rows_ties_and_clashing_columns(spark):
    text = " ".join(f"w{n}" for n in range(30))
    rows = [(1, text, 5), (1, text, 5), (2, text + " tail", 6), (None, "x " + text, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((row["row"]["kept"], row.n_removed, row.kept) for row in substring.remove_repeats(docs).collect())
    # A null key comes first, so its text stays; equal rows are one document and lose the same words.
    assert got == [(5, 30, ""), (5, 30, ""), (6, 30, "tail"), (7, 0, "x " + text)]
    alone = spark.createDataFrame(rows[:2], "doc_id long, text string, kept int")
    assert [row.n_removed for row in substring.remove_repeats(alone).collect()] == [0, 0]
    assert substring.remove_repeats(docs.limit(0)).collect() == []


def test_long_text_with_itself(make_docs):
    rng = random.Random(6)
    part = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    texts = [part + " middle " + part, "b " * 100]
    assert result(substring.remove_repeats(make_docs(texts))) == brute.cut(list(enumerate(texts)))
