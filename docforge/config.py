"""Job settings: explicit parameter, then environment, then default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    catalog: str = "spark_catalog"
    schema: str = "catalogue"
    discover_pages: int = 25
    fetch_partitions: int = 4
    fetch_waves: int = 8  # slices of a crawl, each committed as a whole
    fetch_attempts: int = 3  # of a record whose failure may pass
    max_requests_per_second: int = 40
    cast_limit: int = 10
    review_limit: int = 8
    review_char_limit: int = 4000
    chunk_size: int = 800
    chunk_overlap: int = 100
    layer_partitions: int = 64  # of each layer that refresh keeps; a changed record rewrites one
    embedding_partitions: int = 64  # of the vector table; a changed document rewrites one
    buckets: int = 0  # above 0: tables keyed by movie_id are stored in that many buckets

    @classmethod
    def resolve(
        cls,
        params: Mapping[str, object] | None = None,
        env: Mapping[str, str] | None = None,
    ) -> Settings:
        """Fill every field from ``params``, else ``env`` (upper-cased), else its default.

        An empty parameter counts as unset; an integer that does not parse
        falls back to the default.
        """
        params = params or {}
        env = os.environ if env is None else env
        chosen = {}
        for field in fields(cls):
            raw = params.get(field.name)
            if raw in (None, ""):
                raw = env.get(field.name.upper())
            if raw is None:
                continue
            if isinstance(field.default, int):
                try:
                    chosen[field.name] = int(str(raw).strip())
                except ValueError:
                    continue
            else:
                chosen[field.name] = str(raw)
        return cls(**chosen)

    def table(self, name: str) -> str:
        """Three-level table name."""
        return f"{self.catalog}.{self.schema}.{name}"
