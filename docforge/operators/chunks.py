"""Sliding-window chunks of document text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_documents(
    documents: DataFrame, text: str = "doc_text", size: int = 800, overlap: int = 100
) -> DataFrame:
    """Replace ``text`` by ``chunk_index, chunk_text``, one row per window.

    Windows of ``size`` characters start every ``size - overlap``. The last one
    holds the end of the text, so nothing is lost, and a text that fits into
    one window makes one chunk.

    The text is cut once into pieces of one step, and a chunk is a piece with
    the start of what follows. Cutting every window out of the whole text would
    scan it from the start each time, which is quadratic in its length.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    pieces_per_chunk = 1 + math.ceil(overlap / step)
    kept = [name for name in documents.columns if name != text]
    last = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int"))
    cut = documents.select(
        *kept,
        last.alias("last"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("pieces"),
    )
    chunks = F.transform(
        F.sequence(F.lit(1), F.col("last")),
        lambda i: F.left(F.array_join(F.slice("pieces", i, pieces_per_chunk), ""), F.lit(size)),
    )
    # A null text has no pieces and makes no chunk.
    return cut.select(
        *kept, F.posexplode(F.when(F.col("pieces").isNotNull(), chunks)).alias("chunk_index", "chunk_text")
    )
