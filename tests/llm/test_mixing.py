import random
from collections import defaultdict
from hashlib import md5

import pytest
from llm import brute
from pyspark.sql import functions as F

from docforge.llm import mixing
from docforge.llm.queries import op3_mixing

LEVELS = ["level0", "level1"]


def fill(caps, weights, budget):
    """Sibling budgets by the rule itself: fill who can't take its share, share out the rest."""
    given, open_ = dict.fromkeys(caps, 0.0), {name for name in caps if weights[name] > 0}
    left = budget
    while open_:
        total = sum(weights[name] for name in open_)
        full = {name for name in open_ if caps[name] <= left * weights[name] / total + 1e-9}
        if not full:
            return {**given, **{name: left * weights[name] / total for name in open_}}
        for name in full:
            given[name] = caps[name]
            left -= caps[name]
        open_ -= full
    for name in sorted(name for name in caps if weights[name] <= 0):
        given[name] = min(caps[name], max(left, 0))
        left -= given[name]
    return given


def tree(supply, weights, share, epochs):
    tops = defaultdict(dict)
    for (top, leaf), tokens in supply.items():
        tops[top][leaf] = tokens * epochs
    caps = {top: sum(leaves.values()) for top, leaves in tops.items()}
    weigh = lambda *path: weights.get(path, 1.0)
    upper = fill(caps, {top: weigh(top) for top in caps}, share * sum(supply.values()))
    return {(top, leaf): tokens for top, leaves in tops.items() for leaf, tokens in fill(leaves, {leaf: weigh(top, leaf) for leaf in leaves}, upper[top]).items()}


@pytest.mark.parametrize("seed", range(4))
def test_budgets_flow_to_siblings_first(spark, seed):
    rng = random.Random(seed)
    supply = {(f"d{n % 3}", f"s{n}"): rng.choice([1, 10, 200, 5000]) for n in range(9)}
    weights = {(f"d{n}",): rng.choice([0.0, 1.0, 3.0]) for n in range(3)} | {(top, leaf): rng.choice([0.0, 1.0, 7.0]) for top, leaf in supply}
    share, epochs = rng.choice([(0.3, 1), (0.9, 1), (1.5, 2), (3.0, 2)])
    given = spark.createDataFrame([(len(path) - 1, list(path), weight) for path, weight in weights.items()], "level int, path array<string>, weight double")
    frame = spark.createDataFrame([(*leaf, tokens, 1) for leaf, tokens in supply.items()], "level0 string, level1 string, supply long, docs long")
    got = {(row.level0, row.level1): row.budget for row in mixing.allocate(frame, LEVELS, given, share, epochs).collect()}
    want = tree(supply, weights, share, epochs)
    assert got.keys() == want.keys()
    for leaf, budget in want.items():
        assert abs(got[leaf] - budget) <= 1, (leaf, got, want)


def test_each_leaf_gives_a_prefix_of_its_seeded_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 4)
    rows = [(n, "w " * (n % 7), f"s{n % 2}" if n % 5 else None) for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shares = [0.2, 0.5, 1.0, 1.3, 2.0]
    taken = []
    for share in shares:
        mixed = mixing.mix(docs, [F.col("source")], share=share, epochs=2, seed=3).select("row.doc_id", "row.source", "tokens", "copies").collect()
        taken.append({row.doc_id: row.copies for row in mixed})
        total = sum(row.tokens * row.copies for row in mixed)
        assert share * sum(n % 7 for n in range(200)) <= total + 2 and total <= share * sum(n % 7 for n in range(200)) + 3 * 7
        assert all(row.tokens == row.doc_id % 7 > 0 for row in mixed)
    for fewer, more in zip(taken, taken[1:], strict=False):
        assert all(more.get(key, 0) >= copies for key, copies in fewer.items())
    assert all(copies == 2 for copies in taken[-1].values()) and len(taken[-1]) == sum(n % 7 > 0 for n in range(200))
    other = mixing.mix(docs, [F.col("source")], share=0.2, seed=4).select("row.doc_id").collect()
    assert {row.doc_id for row in other} != taken[0].keys()


def place_of(seed, epoch, key, text):
    """The document's place in its leaf's order of an epoch."""
    name = f"{seed}:{epoch}:{key}:{md5(text.encode()).hexdigest()}"
    return int(md5(name.encode()).hexdigest()[: mixing.DIGITS], 16)


@pytest.mark.parametrize("share, epochs", [(0.2, 1), (0.7, 1), (1.3, 2)])
def test_chosen_documents_against_brute_force(spark, documents, document_rows, share, epochs, monkeypatch):
    """Whole epochs, then documents in the order of the epoch's hash before which less than the rest of the budget stands."""
    monkeypatch.setattr(mixing, "SLICE", 8)
    rows = {row.doc_id: row for row in documents.select("doc_id", "text", "lang", "source").collect()}
    words = {key: len(brute.words_of(row.text or "")) for key, row in rows.items()}
    leaves = defaultdict(list)
    for key, row in rows.items():
        if words[key]:
            leaves[row.lang, row.source].append(key)
    budgets = tree({leaf: sum(words[key] for key in keys) for leaf, keys in leaves.items()}, {}, share, epochs)
    want = {}
    for leaf, keys in leaves.items():
        supply = sum(words[key] for key in keys)
        full, rest = divmod(round(budgets[leaf]), supply)
        place = {key: place_of(7, full, key, rows[key].text) for key in keys}
        ahead = 0
        for key in sorted(keys, key=place.get):
            copies = full + (ahead < rest)
            ahead += words[key]
            if copies:
                want[key] = copies
    levels = [F.col("lang"), F.col("source")]
    got = mixing.mix(documents, levels, share=share, epochs=epochs, seed=7).select("row.doc_id", "copies").collect()
    assert len(got) == len(want) and {row.doc_id: row.copies for row in got} == want


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, tokens int"
    rows = [(1, "a b", None, 9), (1, "a b", None, 9), (None, "c d", "x", 9), (2, None, "x", 9), (3, " \n", "x", 9)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mix(docs, [F.col("lang")], share=1.0).collect()
    assert sorted((row["row"]["doc_id"] or 0, row.tokens, row["row"]["tokens"], row.copies) for row in got) == [(0, 2, 9, 1), (1, 2, 9, 1), (1, 2, 9, 1)]
    assert mixing.mix(docs.limit(0), [F.col("lang")]).collect() == []


def test_token_count_is_by_ascii_white_space(spark):
    texts = [None, "", " \t\n", "a", " a  b\x0bc\r\n", "é ü"]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    assert [row[0] for row in frame.select(mixing.whitespace_tokens(F.col("text"))).collect()] == [0, 0, 0, 1, 3, 2]


def test_query_has_no_python_and_meets_its_budget(spark, small, documents):
    mixed = op3_mixing(spark, small)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    total = documents.select(F.sum(mixing.whitespace_tokens(F.col("text")))).first()[0]
    rows = mixed.collect()
    assert 0.5 * total - 1 <= sum(row.tokens * row.copies for row in rows) <= 0.5 * total + 20_000 * len({row.source for row in rows})
