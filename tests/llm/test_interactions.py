import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from docforge.llm import interactions

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text):
    text = text or ""
    words = text.encode().split()
    fails = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }
    return {name for name, failed in fails.items() if failed}


def audited(rows, labels):
    """Every order applied to every document, one filter after the other."""
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    documents = defaultdict(list)
    for key, text, part in rows:
        fails = failures(text) | ({"E"} if key is not None and key > first[text or ""] else set())
        documents[part or ""].append((fails, any(q == 1 for k, q, _ in labels if k == key and key is not None), any(t == 1 for k, _, t in labels if k == key and key is not None)))
    out, shares = {}, Counter()
    for part, held in documents.items():
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, name in enumerate(order, 1):
                lost = [doc for doc in left if name in doc[0]]
                failing = [doc for doc in held if name in doc[0]]
                left = [doc for doc in left if name not in doc[0]]
                alone = sum(doc[0] == {name} for doc in held)
                out[part, order, step] = (len(left), len(lost), len(failing) - len(lost), alone, sum(doc[1] for doc in lost), sum(doc[2] for doc in lost))
                shares[part, name] += len(lost)
    return {(part, order, step): (*counts, shares[part, order[step - 1]]) for (part, order, step), counts in out.items()}


def found(frame):
    return {(row.part, row.filter_order, row.step): tuple(row[name] for name in (*COUNTS, "shapley")) for row in frame.collect()}


def text_of(rng):
    words = [rng.choice(["a", "Bc", "d#", "é", "fgh", "i"]) + str(rng.randrange(rng.choice([3, 900]))) for _ in range(rng.choice([0, 3, 199, 200, 230]))]
    return " ".join(words if rng.random() < 0.5 else [word.lower().replace("#", "") for word in words])


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "A", "%", "É" * 300, "w " * 400_000] + [text_of(rng) for _ in range(25)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s1", "s1", "s2"])) for _ in range(150)]
    rows += rows[:5]
    labels = [(rng.choice([None, *range(70)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, text string, source string, part string, good int")
    marks = spark.createDataFrame([(*row, "y") for row in labels], "doc_id long, quality int, toxic int, cell string")
    assert found(interactions.audit(docs, marks)) == audited(rows, labels)


def test_a_text_held_by_most_documents(spark):
    rows = [(key, "same text", "hot") for key in range(3000)] + [(5000, "other", "cold")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = found(interactions.audit(docs, none))
    assert got["hot", "EABCD", 1] == (1, 2999, 0, 0, 0, 0, got["hot", "EABCD", 1][-1])
    assert got["cold", "EABCD", 1][:4] == (1, 0, 0, 0)
    assert sum(got["hot", "ABCDE", step][1] for step in range(1, 6)) == 3000


def test_no_documents_give_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(docs, none).collect() == []


def test_more_parts_than_are_contracted_together(spark, monkeypatch):
    monkeypatch.setattr(interactions, "TOGETHER", 3)
    rows = [(key, f"Word{key}#", f"s{key % 11}") for key in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(interactions.audit(docs, none)) == audited(rows, [])
