"""Declared schemas, as DDL. Nothing is ever inferred from a sample of the data."""

# Field names and types of the external JSON payload.
PAYLOAD = """
    id BIGINT, title STRING, original_title STRING, tagline STRING, overview STRING,
    release_date STRING, runtime INT, vote_average DOUBLE, vote_count INT, popularity DOUBLE,
    original_language STRING, adult BOOLEAN, poster_path STRING, backdrop_path STRING,
    homepage STRING, imdb_id STRING,
    genres ARRAY<STRUCT<id: BIGINT, name: STRING>>,
    credits STRUCT<`cast`: ARRAY<STRUCT<id: BIGINT, name: STRING, `character`: STRING, `order`: INT>>>,
    keywords STRUCT<keywords: ARRAY<STRUCT<id: BIGINT, name: STRING>>>,
    reviews STRUCT<
        results: ARRAY<STRUCT<id: STRING, author: STRING, content: STRING, created_at: STRING>>,
        total_results: INT>,
    `watch/providers` STRUCT<results: STRUCT<US: STRUCT<
        flatrate: ARRAY<STRUCT<provider_id: BIGINT, provider_name: STRING>>>>>
"""

# Field names and types of one external listing page.
LISTING = """
    page INT, total_pages INT,
    results ARRAY<STRUCT<id: BIGINT, title: STRING, release_date: STRING, overview: STRING,
                         vote_average: DOUBLE, poster_path: STRING>>
"""

BRONZE_GENRES = (
    "genre_id BIGINT NOT NULL, name STRING NOT NULL, ingested_at TIMESTAMP NOT NULL"
)

BRONZE_PAYLOADS = (
    "movie_id BIGINT NOT NULL, payload STRING, status STRING NOT NULL, "
    "error STRING, ingested_at TIMESTAMP NOT NULL"
)

# Every request that was made: its bronze row, whether a failure may pass, and the wave.
FETCH_LEDGER = (
    "movie_id BIGINT, payload STRING, status STRING, error STRING, ingested_at TIMESTAMP, "
    "retry BOOLEAN, wave INT"
)

# Tables that groups of users write to; stored next to the catalogue, dealt by their keys.
APPLICATION_KEYS = {
    "users": ["user_id"],
    "groups": ["group_id"],
    "group_members": ["group_id", "user_id"],
    "ratings": ["user_id", "movie_id"],
    "watchlist_items": ["group_id", "movie_id"],
    "recommendations": ["group_id", "movie_id"],
}
APPLICATION = {
    "users": "user_id BIGINT, name STRING, created_at TIMESTAMP",
    "groups": "group_id BIGINT, name STRING, created_at TIMESTAMP",
    "group_members": "group_id BIGINT, user_id BIGINT",
    "ratings": "user_id BIGINT, movie_id BIGINT, rating DOUBLE, watched BOOLEAN, rated_at TIMESTAMP",
    "watchlist_items": "group_id BIGINT, movie_id BIGINT, added_by BIGINT, watched BOOLEAN, added_at TIMESTAMP",
    "recommendations": "group_id BIGINT, movie_id BIGINT, reason STRING, score DOUBLE, created_at TIMESTAMP",
}
