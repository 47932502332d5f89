"""Finding documents: vector top-k, title search, side-by-side comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions.text import blank_to_null, poster_url
from docforge.functions.vectors import TopMatches, to_matrix

# Requests scored in one pass over the corpus. They travel to every task with
# the function, so their number is bounded; more requests take more passes.
REQUESTS_PER_PASS = 256
SCORE_DIGITS = 6

COMPARED = (
    "movie_id",
    "title",
    "release_date",
    "runtime_minutes",
    "vote_average",
    "vote_count",
    "popularity",
    "genre_names",
    "provider_names",
)


def vector_top_k(
    corpus: DataFrame,
    requests: Mapping[int, Sequence[float]],
    k: int = 10,
    parent: str = "movie_id",
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` parents nearest to each request vector by cosine.

    Returns ``query_id, <parent>, score, rank``. A parent scores as its best
    chunk; scores are compared at six digits, equal ones by parent id. Each
    task keeps k parents per request while it streams over its vectors, so what
    is shuffled depends on the number of tasks and not on the corpus.

    To search under constraints, filter ``corpus`` first.
    """
    wanted = list(requests.items())
    passes = [wanted[i : i + REQUESTS_PER_PASS] for i in range(0, len(wanted), REQUESTS_PER_PASS)]
    if not passes:
        raise ValueError("no request vectors")
    candidates = reduce(
        DataFrame.unionByName, (_task_matches(corpus, part, k, parent, vector) for part in passes)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), parent))
    return (
        candidates.groupBy("query_id", parent)
        .agg(F.max("score").alias("score"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
    )


def _task_matches(corpus, requests, k, parent, vector):
    ids = [int(query_id) for query_id, _ in requests]
    vectors = np.array([list(values) for _, values in requests], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopMatches(vectors, k, SCORE_DIGITS)
        for batch in batches:
            # Tested here and not by a filter, which would run a lazy embedding once more.
            batch = batch.filter(batch.column(1).is_valid())
            best.add(
                batch.column(0).to_numpy(zero_copy_only=False),
                to_matrix(batch.column(1), vectors.shape[1]),
            )
        for q, parents, scores in best.rows():
            yield pa.RecordBatch.from_pydict(
                {"query_id": np.full(len(parents), ids[q], np.int64), parent: parents, "score": scores}
            )

    return corpus.where(F.col(parent).isNotNull()).select(F.col(parent).cast("long"), F.col(vector).cast("array<float>")).mapInArrow(
        run, f"query_id BIGINT, `{parent}` BIGINT, score DOUBLE"
    )


def constrained_top_k(
    corpus: DataFrame,
    movies: DataFrame,
    condition: Column,
    requests: Mapping[int, Sequence[float]],
    k: int = 10,
) -> DataFrame:
    """Vector top-k among the movies that satisfy ``condition``, e.g. runtime and genre."""
    allowed = movies.where(condition).select("movie_id")
    return vector_top_k(corpus.join(allowed, "movie_id", "left_semi"), requests, k)


def search_text(
    corpus: DataFrame,
    texts: Sequence[str],
    open_embedder: Callable,
    k: int = 10,
    parent: str = "movie_id",
) -> DataFrame:
    """Top-k for request texts, embedded as the corpus was."""
    import pandas as pd

    vectors = open_embedder()(pd.Series(list(texts), dtype=object))
    return vector_top_k(corpus, dict(enumerate(vectors)), k, parent)


def title_search(catalogue: DataFrame, query: str, limit: int = 5, image_base: str = "") -> DataFrame:
    """The most popular titles containing the query, as trimmed rows."""
    if not query or not query.strip():
        raise ValueError("query must be a non-empty string")
    return (
        catalogue.where(F.contains(F.lower("title"), F.lit(query.strip().lower())))
        .orderBy(F.desc("popularity"), "movie_id")
        .limit(limit)
        .select(
            "movie_id",
            "title",
            blank_to_null(F.col("release_date").cast("string")).alias("release_date"),
            "overview",
            "vote_average",
            poster_url(F.col("poster_path"), image_base).alias("poster_url"),
        )
    )


def require_hits(hits: DataFrame, query: str) -> DataFrame:
    if hits.isEmpty():
        raise LookupError(f"no movies match {query!r}")
    return hits


def compare_titles(movies: DataFrame, ids: Iterable[int], columns: Sequence[str] = COMPARED) -> DataFrame:
    """Chosen movies side by side, ordered by id."""
    return movies.where(F.col("movie_id").isin(*ids)).select(*columns).orderBy("movie_id")
