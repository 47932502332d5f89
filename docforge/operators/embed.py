"""Chunk embedding, and which documents still need it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions.vectors import HashingEmbedder, to_lists

DOCUMENT_KEY = ("movie_id", "content_hash")


def embedding(
    text: Column | str,
    open_embedder: Callable[[], Callable[[pd.Series], np.ndarray]] = HashingEmbedder,
) -> Column:
    """``array<float>`` vector of a text column.

    ``open_embedder`` runs once per task and returns a function from a Series
    of texts to a matrix, so a model is loaded once and fed whole batches. A
    null text has a null vector and never reaches it.
    """

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = open_embedder()
        for texts in batches:
            vectors = to_lists(embedder(texts.drop_null().to_pandas()))
            place = pc.subtract(pc.cumulative_sum(texts.is_valid().cast("int64")), 1)
            yield vectors.take(pc.if_else(texts.is_valid(), place, None)) if texts.null_count else vectors

    return embed(text)


def embed_chunks(
    chunks: DataFrame,
    open_embedder: Callable[[], Callable[[pd.Series], np.ndarray]] = HashingEmbedder,
) -> DataFrame:
    """Add the ``embedding`` of ``chunk_text``."""
    return chunks.withColumn("embedding", embedding("chunk_text", open_embedder))


def unembedded(documents: DataFrame, embedded: DataFrame, key: tuple[str, ...] = DOCUMENT_KEY) -> DataFrame:
    """Documents whose current text has no embedding yet.

    Both tables bucketed by document id join without a shuffle when
    ``spark.sql.requireAllClusterKeysForCoPartition`` is false.
    """
    return documents.join(embedded.select(*key), list(key), "left_anti")


def partition_of(key: Column | str, partitions: int) -> Column:
    """The partition of the vector table that holds a document's vectors."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def live_embeddings(embedded: DataFrame, documents: DataFrame, key: tuple[str, ...] = DOCUMENT_KEY) -> DataFrame:
    """Embeddings that still match their document; superseded ones drop out."""
    return embedded.join(documents.select(*key), list(key), "left_semi")
