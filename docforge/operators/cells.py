"""Exact vector top-k over vectors gathered in cells, of which only those that can hold a match are read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions.vectors import normalise, to_lists, to_matrix
from docforge.operators import search

# Centres travel to every task and bounds are kept on the driver, so their number is bounded.
MOST_CELLS = 4096
# Centres are fitted on about this many distinct vectors; they steer what is read, no result depends on them.
FIT_ROWS = 50_000
# Scores are compared at six digits, so a cell is passed over only if it stays below by more than that.
SLACK = 2 * 10.0**-search.SCORE_DIGITS


@dataclass(frozen=True)
class Cells:
    """A written index: every vector in its cell, and each cell's centre, radius and number of vectors."""

    vectors: DataFrame
    parent: str
    ids: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def write_cells(
    corpus: DataFrame,
    path: str,
    cells: int = 256,
    parent: str = "movie_id",
    vector: str = "embedding",
    fit_rows: int = FIT_ROWS,
    seed: int = 0,
) -> Cells:
    """Index all vectors of ``corpus`` under ``path``, which must not exist.

    Directions are compared, so distances are those of the vectors scaled to length 1. Rows without parent or vector,
    and vectors with a value that is null or not finite, match nothing and are left out. A cell that
    many vectors share is split into several files.
    """
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"cells must be from 1 to {MOST_CELLS}")
    spark = corpus.sparkSession
    held = corpus.where(F.col(parent).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(parent).cast("long").alias("parent"), F.col(vector).cast("array<float>").alias("embedding")
    )
    centres = _centres(held, cells, fit_rows, seed)
    dealt = held.mapInArrow(_assigner(centres), "parent BIGINT, embedding ARRAY<FLOAT>, cell INT, distance DOUBLE")
    dealt.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema("parent BIGINT, embedding ARRAY<FLOAT>, distance DOUBLE, cell INT").parquet(f"{path}/vectors")
    sizes = stored.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("vectors"))
    places = spark.createDataFrame([(i, centre.tolist()) for i, centre in enumerate(centres)], "cell INT, centre ARRAY<DOUBLE>")
    places.join(sizes, "cell").write.parquet(f"{path}/catalogue")
    return open_cells(spark, path, parent)


def open_cells(spark: SparkSession, path: str, parent: str = "movie_id") -> Cells:
    """A written index; its catalogue has at most ``MOST_CELLS`` rows."""
    catalogue = spark.read.schema("cell INT, centre ARRAY<DOUBLE>, radius DOUBLE, vectors BIGINT").parquet(f"{path}/catalogue")
    rows = catalogue.orderBy("cell").collect()
    stored = spark.read.schema("parent BIGINT, embedding ARRAY<FLOAT>, distance DOUBLE, cell INT").parquet(f"{path}/vectors")
    return Cells(
        stored,
        parent,
        np.array([row.cell for row in rows], np.int64),
        np.array([row.centre for row in rows], np.float64),
        np.array([row.radius for row in rows], np.float64),
        np.array([row.vectors for row in rows], np.int64),
    )


def _centres(held: DataFrame, cells: int, fit_rows: int, seed: int) -> np.ndarray:
    """Centres fitted on a sample by the hash of vectors, in which copies of one vector count once."""
    total = held.count()
    spread = 2**30
    share = spread if total <= fit_rows else int(spread * fit_rows / total)
    chosen = held.select("embedding").where(F.pmod(F.xxhash64("embedding"), F.lit(spread)) < share)
    sample = chosen.mapInArrow(_units, "unit ARRAY<DOUBLE>").distinct()
    few = [row.unit for row in sample.limit(cells + 1).collect()]
    if not few and total:
        few = [row.unit for row in held.select("embedding").mapInArrow(_units, "unit ARRAY<DOUBLE>").limit(1).collect()]
    if len(few) <= cells:
        return np.array(few, np.float64)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features").fit(sample.select(array_to_vector("unit").alias("features")))
    return np.array(model.clusterCenters(), np.float64)


def _sound(lists: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = to_matrix(lists, dimensions)
    return vectors, np.isfinite(vectors).all(axis=1)


def _units(batches):
    for batch in batches:
        column = batch.column(0)
        if len(column):
            vectors, sound = _sound(column, len(column[0]))
            yield pa.RecordBatch.from_pydict({"unit": pa.array(list(normalise(vectors[sound])), pa.list_(pa.float64()))})


def _assigner(centres: np.ndarray):
    half = (centres * centres).sum(axis=1) / 2 if len(centres) else None

    def run(batches):
        for batch in batches:
            if half is None or not batch.num_rows:
                continue
            vectors, sound = _sound(batch.column(1), centres.shape[1])
            units = normalise(vectors[sound])
            cell = (units @ centres.T - half).argmax(axis=1)
            distance = np.linalg.norm(units - centres[cell], axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "parent": batch.column(0).filter(pa.array(sound)),
                    "embedding": to_lists(vectors[sound]),
                    "cell": cell.astype(np.int32),
                    "distance": distance,
                }
            )

    return run


def bounds(index: Cells, vectors: np.ndarray) -> np.ndarray:
    """The highest cosine that a vector of each cell (columns) can have with each request (rows).

    No vector of a cell is nearer to a request than the centre is, less the radius. For two vectors no longer than 1 the
    product is at most 1 less half the squared distance.
    """
    units = normalise(vectors)
    squares = (units**2).sum(axis=1)[:, None] + (index.centres**2).sum(axis=1) - 2 * units @ index.centres.T
    nearest = np.maximum(np.sqrt(np.maximum(squares, 0)) - index.radii, 0)
    return 1 - nearest**2 / 2


def pruned_top_k(index: Cells, requests: Mapping[int, Sequence[float]], k: int = 10) -> DataFrame:
    """What ``search.vector_top_k`` gives, from the cells that can matter."""
    return search_cells(index, requests, k)[0]


def search_cells(index: Cells, requests: Mapping[int, Sequence[float]], k: int = 10) -> tuple[DataFrame, int]:
    """``query_id, <parent>, score, rank`` of the nearest parents, and how many stored vectors were read.

    Cells are read in waves: each request asks for its most promising cells, twice as many in every wave, as long
    as their bound reaches its k-th score. A wave is one job over the cells' partitions. The driver holds k matches
    for each request.
    """
    if not requests:
        raise ValueError("no request vectors")
    wanted, found, read = list(requests.items()), [], 0
    for at in range(0, len(wanted), search.REQUESTS_PER_PASS):
        matches, vectors = _search_pass(index, dict(wanted[at : at + search.REQUESTS_PER_PASS]), k)
        found, read = found + matches, read + vectors
    spark = index.vectors.sparkSession
    return spark.createDataFrame(found, f"query_id BIGINT, `{index.parent}` BIGINT, score DOUBLE, rank INT"), read


def _search_pass(index, requests, k):
    ids = list(requests)
    if not len(index.ids):
        return [], 0
    highest = bounds(index, np.array([list(requests[each]) for each in ids], np.float64))
    order = np.argsort(-highest, axis=1, kind="stable")
    best: list[dict[int, float]] = [{} for _ in ids]
    done = np.zeros(len(index.ids), bool)
    width = 1
    while True:
        wave = set()
        for row, held in enumerate(best):
            floor = min(held.values()) if len(held) == k else -np.inf
            open_ones = [cell for cell in order[row] if not done[cell] and highest[row, cell] >= floor - SLACK]
            wave.update(open_ones[:width])
        if not wave:
            break
        places = sorted(wave)
        near = index.vectors.where(F.col("cell").isin([int(index.ids[place]) for place in places]))
        for row in search.vector_top_k(near, requests, k, parent="parent").collect():
            held = best[ids.index(row.query_id)]
            held[row.parent] = max(row.score, held.get(row.parent, -np.inf))
        best = [dict(sorted(held.items(), key=lambda each: (-each[1], each[0]))[:k]) for held in best]
        done[places] = True
        width *= 2
    rows = [(each, parent, score, rank) for each, held in zip(ids, best, strict=True) for rank, (parent, score) in enumerate(held.items(), 1)]
    return rows, int(index.sizes[done].sum())
