import random
from functools import cache

import public_tokenizers
from llm import brute

from docforge.llm import wordpiece
from docforge.llm.wordpiece import END, LongestMatch

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_equal_greedy_cutting():
    rng = random.Random(2)
    for _ in range(300):
        pieces = {tuple(rng.choices([97, 98, 99], k=rng.randint(1, 4))) + (END,) * rng.randint(0, 1) for _ in range(rng.randint(1, 14))}
        if rng.random() < 0.7:
            pieces |= {(x,) for x in (97, 98, 99, END)}
        machine = LongestMatch(pieces)
        for _ in range(40):
            word = bytes(rng.choices([97, 98, 99], k=rng.randint(1, 9)))
            count = brute.greedy_pieces(word, pieces)
            assert machine.count(word) == (wordpiece.UNKNOWN if count is None else count), (pieces, word)


def test_documents_against_greedy_cutting(documents, document_rows):
    pieces = set(wordpiece.pieces_of(PATH))
    got = {row["row"]["doc_id"]: (row.n_words, row.n_pieces) for row in wordpiece.count_tokens(documents, PATH).collect()}
    count = cache(lambda word: brute.greedy_pieces(word, pieces))
    assert len(got) == len(document_rows)
    for key, text in document_rows:
        words = brute.words_of(text.lower())
        assert got[key] == (len(words), sum(map(count, words)))


def test_odd_rows(spark, make_docs):
    rows = wordpiece.count_tokens(make_docs([None, "", " \n", "the THE", "the " * 50_000]), PATH).collect()
    assert [(row.n_words, row.n_pieces) for row in rows] == [(0, 0), (0, 0), (0, 0), (2, 2), (50_000, 50_000)]
    assert wordpiece.count_tokens(make_docs([]), PATH).collect() == []
    odd = spark.createDataFrame([("the", 5)] * 2, "text string, n_pieces int")
    assert [(row["row"]["n_pieces"], row.n_pieces) for row in wordpiece.count_tokens(odd, PATH).collect()] == [(5, 1)] * 2
