import random

import numpy as np
import pyarrow as pa
import pytest
from llm import brute
from llm.brute import copies

from docforge.llm import minhash, parity


def shingles(text):
    words = (text or "").encode().translate(brute.LOWER).split()
    if not words:
        return set()
    return {tuple(words[at : at + 4]) for at in range(max(1, len(words) - 3))}


def similar(one, two):
    common = len(one & two)
    return bool(one and two) and 100 * common >= 80 * (len(one) + len(two) - common)


def expected(rows):
    """``(id, shingles, component, kept)`` of ``(id, text)`` rows; rows of an id are one document."""
    held = [(key, shingles(text)) for key, text in rows]
    named = [(key, names) for key, names in held if key is not None and names]
    root = {key: key for key, _ in named}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    for at, (one, left) in enumerate(named):
        for two, right in named[at + 1 :]:
            if find(one) != find(two) and similar(left, right):
                low, high = sorted((find(one), find(two)))
                root[high] = low
    tops = [find(key) if key is not None and names else key for key, names in held]
    return sorted(((key, len(names), top, key is None or top == key) for (key, names), top in zip(held, tops, strict=True)), key=str)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(make_docs, seed):
    texts = copies(seed, count=120)
    assert found(minhash.similar_components(make_docs(texts))) == expected(list(enumerate(texts)))


def test_documents_against_brute_force(documents, document_rows):
    assert found(minhash.similar_components(documents)) == expected(document_rows)


def test_links_that_no_star_sees(make_docs, monkeypatch):
    """Many copies of one text, most linked with one another but not with the least id."""
    monkeypatch.setattr(parity, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{n}" for n in range(120)]
    near = base[:96] + [f"v{n}" for n in range(24)]
    texts = [" ".join(base)]
    for _ in range(30):
        words = list(near)
        for at in rng.sample(range(120), rng.choice([1, 2, 3])):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    assert found(minhash.similar_components(make_docs(texts))) == expected(list(enumerate(texts)))


def _passes(one, two):
    left, right = (parity._words([parity.parity_of(names)]) for names in (one, two))
    width = min(left.shape[1], right.shape[1])
    apart = int(np.bitwise_count(parity._fold(left, width) ^ parity._fold(right, width)).sum())
    return bool(parity.possible(len(one), len(two), apart, minhash.OVER, minhash.UNDER))


def test_a_doubtful_forest_is_looked_through_again(make_docs):
    """Pairs just short of a link, some of which the parity bits let pass."""
    rng = random.Random(7)
    base = [f"w{n}" for n in range(124)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(124), 2) + rng.sample([0, 1, 2, 121, 122, 123], rng.randint(0, 2)):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    sets = list(minhash.shingle_sets(pa.array([text.encode() for text in texts], pa.binary())))
    false = [(one, two) for number, one in enumerate(sets) for two in sets[:number] if _passes(one, two) and not minhash.linked(one, two)]
    assert len(false) > 5
    assert found(minhash.similar_components(make_docs(texts))) == expected(list(enumerate(texts)))


def test_odd_rows(spark):
    words = " ".join(f"w{n}" for n in range(50))
    rows = [
        (9, words), (4, words.upper()), (4, words.upper()), (4, "another text of this id"), (7, "Another text OF this id"),
        (None, words), (None, None), (2, None), (2, ""), (3, " \n"), (11, "one"), (12, "ONE"), (13, "a b c"), (14, "a b c d"), (15, words + " more"),
        (20, "z " * 400_000), (21, "q" * 1_500_000), (22, "z " * 5),
    ]
    docs = spark.createDataFrame([(key, text, 1, "x", "y") for key, text in rows], "doc_id long, text string, node int, label string, sign string")
    assert found(minhash.similar_components(docs)) == expected(rows)
    assert minhash.similar_components(docs.limit(0)).collect() == []


def test_signatures_estimate_similarity_and_bands_find_links():
    rng = np.random.default_rng(3)
    missed = tried = 0
    for size in [4, 5, 9, 20, 60, 250, 1000, 5000]:
        agree, all_ = 0.0, 0
        for _ in range(60):
            union = np.unique(rng.integers(0, 1 << 63, size + max(1, size // 4), dtype=np.uint64) * np.uint64(2))
            common = -(-8 * len(union) // 10)
            one = np.sort(np.concatenate([union[rng.permutation(len(union))[:common]]]))
            rest = np.setdiff1d(union, one)
            left, right = np.sort(np.concatenate([one, rest[::2]])), np.sort(np.concatenate([one, rest[1::2]]))
            agree += (minhash.signature(left) == minhash.signature(right)).mean() - len(one) / len(union)
            all_ += 1
            tried += 1
            missed += not np.intersect1d(minhash.bands_of(left), minhash.bands_of(right)).size
        assert abs(agree / all_) < 0.05
    assert missed == 0 and tried == 480


def test_parity_never_exceeds_the_difference():
    rng = random.Random(6)
    for _ in range(200):
        size = rng.choice([1, 5, 60, 300, 2000])
        one = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
        two = np.unique(np.concatenate([one[rng.randint(0, size // 2) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, size))], np.uint64)]))
        if not len(two):
            continue
        left, right = (parity._words([parity.parity_of(names)]) for names in (one, two))
        width = min(left.shape[1], right.shape[1])
        apart = int(np.bitwise_count(parity._fold(left, width) ^ parity._fold(right, width)).sum())
        assert apart <= len(np.setxor1d(one, two))


def test_one_print_for_one_set():
    sets = list(minhash.shingle_sets(pa.array([b"a b c d e", b"A b C d  e", b"a b c d f"], pa.binary())))
    assert minhash._print(sets[0]) == minhash._print(sets[1]) != minhash._print(sets[2])
