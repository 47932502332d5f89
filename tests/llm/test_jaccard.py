import random

import numpy as np
import pyarrow as pa
import pytest
from llm import brute
from llm.brute import copies

from docforge.llm import components as C
from docforge.llm import jaccard, parity, shingles
from docforge.llm.components import components


def sets_of(texts):
    return list(shingles.shingle_sets(pa.array([text.encode() if text is not None else None for text in texts], pa.binary())))


def found(frame):
    return {row.key: (row.n_shingles, row.component) for row in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(make_docs, seed):
    texts = copies(seed, count=120)
    assert found(jaccard.similar_components(make_docs(texts))) == brute.groups(list(enumerate(texts)))


def test_documents_against_brute_force(documents, document_rows):
    assert found(jaccard.similar_components(documents)) == brute.groups(document_rows)


def edited(rng, base, most):
    """A set that differs from ``base`` by some elements."""
    gone = rng.sample(range(len(base)), min(len(base) - 1, rng.randint(0, most)))
    new = np.array([rng.getrandbits(64) for _ in range(rng.randint(0, most))], np.uint64)
    return np.unique(np.concatenate([np.delete(base, gone), new]))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 21, 40, 60, 100, 300, 2000])
def test_linked_sets_always_meet_at_a_probe(size):
    rng = random.Random(size)
    for _ in range(60):
        one = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
        two = edited(rng, one, max(1, size // 6))
        if not shingles.linked(one, two):
            continue
        often = [np.array([rng.random() < 0.3 for _ in names]) for names in (one, two)]
        signs = []
        for names, frequent in zip((one, two), often, strict=True):
            sign, role = shingles.signatures(names, frequent)
            assert not (role == shingles.SHORT).any() or size < 40
            signs.append(dict(zip(sign.tolist(), role.tolist(), strict=True)))
        met = [sign for sign in signs[0].keys() & signs[1].keys() if shingles.PROBE in (signs[0][sign], signs[1][sign])]
        short = any(shingles.SHORT in each.values() for each in signs)
        assert met or short


def test_many_sets_together_give_the_same_signatures():
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(rng.choice([1, 4, 30, 70, 200, 900]))], np.uint64)) for _ in range(60)]
    often = [np.array([rng.random() < 0.2 for _ in names]) for names in sets]
    owner, sign, role = shingles.signatures_of(sets, often)
    for number, (names, frequent) in enumerate(zip(sets, often, strict=True)):
        one, its = shingles.signatures(names, frequent)
        mine = owner == number
        assert sorted(zip(sign[mine].tolist(), role[mine].tolist(), strict=True)) == sorted(zip(one.tolist(), its.tolist(), strict=True))


def test_sets_whose_allocation_falls_short_are_found(spark, make_docs):
    texts = copies(5, count=40)
    keys = jaccard.Keys()
    sets = [(keys.of(names), names) for names in sets_of(texts) if len(names)]
    asked = [(int(sign), key) for key, names in sets[::3] for sign in names[: len(names) // 4 + 1].view(np.int64)]
    short = spark.createDataFrame(asked, "sign long, member long").distinct()
    got = {(row.a, row.b) for row in jaccard._short_pairs(make_docs(texts), "text", keys, short).collect()}
    links = {tuple(sorted((one, two))) for one, left in sets[::3] for two, right in sets if one != two and shingles.linked(left, right)}
    assert links and links <= got


def test_sets_that_share_a_key_are_told_apart(make_docs, monkeypatch):
    made = jaccard._keys
    monkeypatch.setattr(jaccard, "_keys", lambda members: made(members, bits=5))
    texts = copies(6, count=80)
    docs = make_docs(texts)
    keys = made(jaccard._profile(docs, "doc_id", "text").where("kind = 0 AND n > 0"), bits=5)
    assert len(keys.aliases) > 20
    assert found(jaccard.similar_components(docs)) == brute.groups(list(enumerate(texts)))


def test_links_between_spokes(make_docs, monkeypatch):
    """Copies linked with one another but not with the one that their star starts from."""
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
    assert found(jaccard.similar_components(make_docs(texts))) == brute.groups(list(enumerate(texts)))


def test_only_doubtful_blocks_are_made_again(spark, monkeypatch):
    monkeypatch.setattr(parity, "BLOCK", 3)
    rows = [(center, 100 * center + at, at % 3 == 0, 7, 10, b"") for center in (1, 2) for at in range(20)]
    members = parity.dealt(spark.createDataFrame(rows, "center long, node long, inside boolean, label long, n long, parity binary"))
    blocks = parity.in_blocks(members)
    key = ["center", "kind", "i", "j"]
    wanted = blocks.where("center = 1 AND (kind = 0 AND (i = j OR j = 4) OR kind = 1 AND j = 1)").select(*key).distinct()
    assert wanted.where("kind = 0 AND i = j").count() and wanted.where("kind = 0 AND i < j").count() and wanted.where("kind = 1").count()
    again = parity.of_blocks(members, wanted)
    assert again.columns == blocks.columns
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, blocks.join(wanted, key, "left_semi").select(blocks.columns).collect()))
    again = parity.of_blocks(members, spark.createDataFrame([(1, 0, 0, 0)], "center long, kind int, i int, j int"))
    assert "Generate" not in again._jdf.queryExecution().executedPlan().toString()


def test_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{n % 5000}" for n in range(60_000))
    rows = [(1, long), (2, long + " one more"), (3, "q" * 1_000_000), (4, None), (5, long.upper())]
    docs = spark.createDataFrame([(key, text, 1, "x", "y", "z") for key, text in rows], "doc_id long, text string, key int, tie string, component string, class string")
    assert found(jaccard.similar_components(docs)) == brute.groups(rows)


def test_large_buckets_are_compared_in_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(parity, "BLOCK", 3)
    rng = random.Random(8)
    base = [f"w{n}" for n in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(60), 3):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    assert found(jaccard.similar_components(make_docs(texts))) == brute.groups(list(enumerate(texts)))


def test_one_of_each_component_stays(spark, make_docs):
    text = " ".join(f"w{n}" for n in range(40))
    rows = [(3, text, 1), (1, text, 2), (1, text, 2), (2, text + " more", 3), (5, "other words here", 4), (6, None, 5), (7, " ", 6), (7, " ", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class int")
    kept = jaccard.one_of_each_component(docs)
    assert kept.columns == docs.columns
    assert sorted((row.doc_id, row["class"]) for row in kept.collect()) == [(1, 2), (5, 4), (6, 5), (7, 6), (7, 6)]


def test_empty_and_null(spark, make_docs):
    assert jaccard.similar_components(make_docs([])).collect() == []
    assert found(jaccard.similar_components(make_docs([None, "", "A b", "a B"]))) == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (1, 2)}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(9)
    links = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(links)
    got = {row.node: row.label for row in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_many_chunks_are_tied_by_stars(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "CHUNK", 7)
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.choice([25, 40, 55]))]
    root = {node: node for link in links for node in link}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    alone = {node for node in root if not any(a != b and node in (a, b) for a, b in links)}
    got = {row.node: row.label for row in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {node: find(node) for node in root if node not in alone}


def test_more_links_join_components(spark):
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    labels = components(links([(1, 2), (5, 6), (8, 9)]))
    got = {row.node: row.label for row in C.join_more(labels, links([(6, 2), (20, 9), (30, 31), (5, 6)])).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}
