"""Document checks, chunks, embeddings and search against brute force."""

import math
import time
import warnings
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docforge.functions.vectors import HashingEmbedder, TopMatches
from docforge.operators import checks, chunks, embed, search, silver


def documents(spark, *texts, reviews=1):
    data = [(i, text, "%064x" % hash_of(text), len(text), reviews) for i, text in enumerate(texts)]
    return spark.createDataFrame(
        data, "movie_id long, doc_text string, content_hash string, char_length int, review_count int"
    )


def hash_of(text):
    return int(md5(text.encode()).hexdigest(), 16)


# ---------------------------------------------------------------- gates


def test_profile(spark):
    found = checks.gold_profile(documents(spark, "a" * 900, "b" * 1000, "b" * 1000, "c" * 801)).first().asDict()
    assert found == {
        "documents": 4,
        "avg_chars": 925.0,
        "median_chars": 900,
        "max_chars": 1000,
        "avg_reviews": 1.0,
        "with_reviews": 4,
        "distinct_hashes": 3,
    }


def test_document_gates(spark):
    with pytest.raises(checks.QualityError):
        checks.require_documents(documents(spark, "x").where("false"))
    with pytest.warns(checks.QualityWarning, match="1 documents share"):
        checks.require_documents(documents(spark, "a" * 900, "a" * 900))
    with pytest.warns(checks.QualityWarning, match="799 characters"):
        checks.require_documents(documents(spark, "a" * 799))
    with warnings.catch_warnings():
        warnings.simplefilter("error", checks.QualityWarning)
        assert checks.require_documents(documents(spark, "a" * 800))["median_chars"] == 800


def test_duplicate_fingerprints(spark):
    data = documents(spark, "a", "b", "a", "a", "c", "b")
    assert rows(checks.duplicate_fingerprints(data), "documents") == [
        ("%064x" % hash_of("b"), 2),
        ("%064x" % hash_of("a"), 3),
    ]


# ---------------------------------------------------------------- chunks


def windows(text, size, overlap):
    step = size - overlap
    n = max(1, math.ceil((len(text) - overlap) / step))
    return [text[i * step : i * step + size] for i in range(n)]


@pytest.mark.parametrize("size, overlap", [(800, 100), (10, 3), (10, 0), (10, 8), (7, 6)])
def test_chunks_equal_windows(spark, size, overlap):
    alphabet = "aé\n😀 ç|"
    lengths = [0, 1, 2, 3, 6, 7, 9, 10, 11, 17, 18, 24, 99, 100, 101, 799, 800, 801, 1499, 1500, 1501, 5000]
    texts = ["".join(alphabet[(i * 7 + i // 5) % len(alphabet)] for i in range(n)) for n in lengths]
    data = spark.createDataFrame(list(enumerate(texts)), "movie_id long, doc_text string")
    found = rows(chunks.chunk_documents(data, size=size, overlap=overlap))
    want = [
        (movie, index, chunk)
        for movie, text in enumerate(texts)
        for index, chunk in enumerate(windows(text, size, overlap))
    ]
    assert found == sorted(want)


def test_null_text_makes_no_chunk_and_bad_overlap_raises(spark):
    data = spark.createDataFrame([(1, None)], "movie_id long, doc_text string")
    assert chunks.chunk_documents(data).isEmpty()
    with pytest.raises(ValueError):
        chunks.chunk_documents(data, size=10, overlap=10)


# ---------------------------------------------------------------- embeddings


def slow_embedding(text, dimensions=384):
    total = [0.0] * dimensions
    for word in text.lower().split():
        h = int(md5(word.encode()).hexdigest()[:7], 16)
        total[h % dimensions] += -1.0 if h // dimensions % 2 else 1.0
    length = math.sqrt(sum(v * v for v in total))
    return [v / length if length else 0.0 for v in total]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abcÀÉ \t\n\u00a0\u2003", max_size=30), min_size=1, max_size=5))
def test_embedder_equals_loop(texts):
    got = HashingEmbedder()(pd.Series(texts, dtype=object))
    np.testing.assert_array_equal(got, np.float32([slow_embedding(text) for text in texts]))


def test_embed_chunks(spark):
    data = spark.createDataFrame([(1, "Hello hello World"), (2, "")], "movie_id long, chunk_text string")
    embedded = embed.embed_chunks(data)
    assert dict(embedded.dtypes)["embedding"] == "array<float>"
    found = dict(rows(embedded.select("movie_id", "embedding"), "movie_id"))
    np.testing.assert_array_equal(found[1], np.float32(slow_embedding("hello hello world")))
    assert len(found[2]) == 384 and not any(found[2])


def test_only_changed_documents_are_embedded(spark):
    before = documents(spark, "a", "b", "c")
    embedded = before.select("movie_id", "content_hash").withColumn("chunk_index", F.lit(0))
    assert embed.unembedded(before, embedded).isEmpty()
    after = documents(spark, "a", "CHANGED", "c", "new")
    assert [r[0] for r in rows(embed.unembedded(after, embedded).select("movie_id"))] == [1, 3]
    assert [r[0] for r in rows(embed.live_embeddings(embedded, after).select("movie_id"))] == [0, 2]


# ---------------------------------------------------------------- vector search


def ranked(parents, vectors, query, k, digits=6):
    def cosine(v):
        length = np.linalg.norm(v) * np.linalg.norm(query)
        return float(np.round(v @ query / length, digits)) if length else 0.0

    best = {}
    for parent, vector in zip(parents, vectors):
        best[parent] = max(best.get(parent, -2.0), cosine(vector))
    return sorted(((-score, parent) for parent, score in best.items()))[:k]


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 9), st.integers(-1, 1), st.integers(-1, 1)), min_size=1, max_size=40),
    st.integers(1, 5),
    st.integers(1, 7),
)
def test_running_top_k_equals_sorting(data, k, batch):
    """Few distinct vectors, so most scores tie and many rows are copies."""
    parents = np.array([row[0] for row in data])
    vectors = np.array([row[1:] for row in data], float)
    queries = np.array([[1.0, 0.5], [-1.0, 0.0]])
    best = TopMatches(queries, k, 6)
    for start in range(0, len(data), batch):
        best.add(parents[start : start + batch], vectors[start : start + batch])
    for q, ids, scores in best.rows():
        found = sorted(zip((-scores).tolist(), ids.tolist()))
        assert found == ranked(parents.tolist(), vectors, queries[q], k)


def corpus(spark, count=300, copies=100):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(count, 8)).astype(np.float32)
    vectors[:copies] = vectors[0]  # a third of all rows are copies of one
    data = [(i % 90, i, vectors[i].tolist()) for i in range(count)]
    return data, spark.createDataFrame(data, "movie_id long, chunk_index int, embedding array<float>")


def test_vector_top_k_equals_sorting(spark):
    data, frame = corpus(spark)
    requests = {7: [1.0] * 8, 9: [float(i) for i in data[0][2]]}
    found = rows(search.vector_top_k(frame.repartition(5), requests, 6), "query_id", "rank")
    want = []
    for query_id, query in requests.items():
        best = ranked([r[0] for r in data], np.array([r[2] for r in data], float), np.array(query), 6)
        want += [(query_id, parent, -score, place) for place, (score, parent) in enumerate(best, 1)]
    assert found == want


def test_many_requests_take_several_passes(spark, monkeypatch):
    _, frame = corpus(spark)
    requests = {q: [math.sin(q + i) for i in range(8)] for q in range(5)}
    once = rows(search.vector_top_k(frame, requests, 3))
    monkeypatch.setattr(search, "REQUESTS_PER_PASS", 2)
    assert rows(search.vector_top_k(frame, requests, 3)) == once


def test_search_rejects_bad_vectors(spark):
    _, frame = corpus(spark)
    with pytest.raises(ValueError):
        search.vector_top_k(frame, {})
    with pytest.raises(Exception, match="every vector must have 3 values"):
        search.vector_top_k(frame, {0: [1.0] * 3}).collect()


def test_constrained_and_text_search(spark):
    texts = {1: "space robots fight", 2: "space romance", 3: "robots in love", 4: "cooking show"}
    data = spark.createDataFrame(list(texts.items()), "movie_id long, chunk_text string")
    vectors = embed.embed_chunks(data)
    movies = spark.createDataFrame(
        [(1, 150, ["Sci-Fi"]), (2, 90, ["Sci-Fi"]), (3, 95, ["Comedy", "Sci-Fi"]), (4, 60, None)],
        "movie_id long, runtime_minutes int, genre_names array<string>",
    )
    assert [r.movie_id for r in search.search_text(vectors, ["SPACE robots"], HashingEmbedder, 2).orderBy("rank").collect()][0] == 1
    short = (F.col("runtime_minutes") < 120) & F.array_contains("genre_names", "Sci-Fi")
    request = {0: slow_embedding("space robots")}
    found = search.constrained_top_k(vectors, movies, short, request).orderBy("rank").collect()
    assert {r.movie_id for r in found} == {2, 3}


# ---------------------------------------------------------------- titles


def catalogue(spark):
    return spark.createDataFrame(
        [
            (1, "The Arrival", "", "o", 7.0, "/a.jpg", 5.0, 100),
            (2, "ARRIVAL II", "2020-01-01", "o", 6.0, "", 9.0, 90),
            (3, "Departure", None, "o", 5.0, None, 99.0, None),
            (4, "arrival", "2016-11-11", "o", 8.0, None, 9.0, 116),
        ],
        "movie_id long, title string, release_date string, overview string, vote_average double, "
        "poster_path string, popularity double, runtime_minutes int",
    )


def test_title_search(spark):
    hits = search.title_search(catalogue(spark), "  Arrival ", 2, "https://img/t/p/")
    assert [(r.movie_id, r.release_date, r.poster_url) for r in hits.collect()] == [
        (2, "2020-01-01", None),
        (4, "2016-11-11", None),
    ]
    every = {r.movie_id: r for r in search.title_search(catalogue(spark), "arrival", image_base="https://img/t/p/").collect()}
    assert every[1].poster_url == "https://img/t/p/w342/a.jpg"
    assert every[1].release_date is None
    with pytest.raises(ValueError):
        search.title_search(catalogue(spark), "  ")
    with pytest.raises(LookupError):
        search.require_hits(search.title_search(catalogue(spark), "nothing"), "nothing")


def test_compare_titles(spark):
    found = search.compare_titles(catalogue(spark), [4, 1], ["movie_id", "runtime_minutes"]).collect()
    assert [tuple(r) for r in found] == [(1, 100), (4, 116)]


def test_null_texts_and_broken_vectors_match_nothing(spark):
    data = spark.createDataFrame([(1, "a b"), (2, None), (3, "a")], "movie_id long, chunk_text string")
    vectors = embed.embed_chunks(data)
    assert [row.embedding is None for row in vectors.orderBy("movie_id").collect()] == [False, True, False]
    assert [row.movie_id for row in search.search_text(vectors, ["a b"], HashingEmbedder).orderBy("rank").collect()] == [1, 3]
    frame = spark.createDataFrame(
        [(1, [-1.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [1.0, None]), (5, [float("inf"), 1.0])], "movie_id long, embedding array<float>"
    )
    assert [(row.movie_id, row.score) for row in search.vector_top_k(frame, {0: [1.0, 0.0]}).collect()] == [(1, -1.0)]


def test_many_keywords_in_one_record(spark):
    """Linear in the record: a quadratic comparison would take minutes here."""
    entries = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda n: F.struct((n % 40_000).alias("id"), F.when(n % 3 != 0, F.concat(F.lit("k:"), n % 40_000)).alias("name")))
    d = F.struct(F.struct(entries.cast("array<struct<id:bigint,name:string>>").alias("keywords")).alias("keywords")).alias("d")
    parsed = spark.range(1).select(F.lit(1).cast("long").alias("movie_id"), d)
    started = time.monotonic()
    found = silver.keywords(parsed, True).collect()
    assert time.monotonic() - started < 20
    want = {(n % 40_000, f"k:{n % 40_000}" if n % 3 else None) for n in range(1, 60_001)}
    assert len(found) == len(want) and {(row.keyword_id, row.name) for row in found} == want
