"""The registered queries as ANSI SQL over the base tables.

None of it reads JSON or any table written by the package, so it checks the
payload round trip as well as the operators.
"""

from __future__ import annotations

from docforge.functions.vectors import DIMENSIONS
from docforge.plans.queries import (
    COMPARED_IDS,
    IMAGE_BASE,
    REQUEST_TEXTS,
    SEARCHED_TITLE,
    TIGHT_REVIEW_CHARS,
    TIGHT_REVIEW_LIMIT,
    UPSERT_CUT,
    request_vectors,
)

SIZES = """
sizes AS (
  SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM documents) AS docs,
         greatest((SELECT count(*) FROM part) // 16, 1) AS slots
)"""

CRAWL = f"""{SIZES},
crawl AS (
  SELECT p.*, p_partkey AS movie_id,
    CASE WHEN p_partkey % 50 = 1 THEN 'not_found' WHEN p_partkey % 50 IN (2, 3) THEN 'error'
         ELSE 'success' END AS status,
    p_partkey % 50 = 7 AS broken,
    CASE WHEN p_partkey % 29 <> 0 THEN p_name END AS title,
    CASE WHEN p_partkey % 17 = 0 THEN '' ELSE d.text END AS overview
  FROM part p CROSS JOIN sizes LEFT JOIN documents d ON d.doc_id = p_partkey % docs
)"""

MOVIES = f"""{CRAWL},
movies AS (
  SELECT movie_id, title, upper(p_name) AS original_title,
    CASE WHEN p_size % 3 <> 0 THEN p_brand END AS tagline, overview,
    CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 23 <> 0
         THEN DATE '1990-01-01' + CAST(p_partkey % 12000 AS INTEGER) END AS release_date,
    CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 31 <> 0 THEN p_size + 60 END AS runtime_minutes,
    p_retailprice / 100 AS vote_average, p_size AS vote_count, p_retailprice AS popularity,
    'en' AS original_language,
    CASE WHEN p_size % 2 <> 0 THEN p_size % 7 = 0 ELSE false END AS adult,
    '/p' || p_partkey || '.jpg' AS poster_path, '/b' || p_partkey || '.jpg' AS backdrop_path,
    CASE WHEN p_size % 5 <> 1 THEN 'http://m/' || p_partkey END AS homepage,
    CASE WHEN p_size % 5 <> 2 THEN 'tt' || p_partkey END AS imdb_id,
    CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_size % 5 = 0 THEN p_type || '|ORPHAN'
         WHEN p_size % 4 = 0 THEN p_type || '|' || p_type ELSE p_type END AS genre_names,
    CASE WHEN p_size < 10 THEN 'Provider ' || p_size ELSE '' END AS provider_names,
    CASE WHEN p_partkey % 19 <> 0 THEN ascii(p_type) * 100 + length(p_type) END AS genre_id,
    p_partkey % 19 <> 0 AND p_size % 5 = 0 AS has_orphan
  FROM crawl
  WHERE status = 'success' AND NOT broken AND title IS NOT NULL AND length(overview) > 0
)"""

ENTRIES = f"""{MOVIES},
entries AS (
  SELECT DISTINCT (l_orderkey * 7 + l_partkey * 31 + l_suppkey * 17 + l_linenumber) % greatest(parts, 1) AS movie_id,
    l_suppkey AS supp, l_returnflag AS flag, l_linenumber AS line
  FROM lineitem CROSS JOIN sizes
)"""

KEYWORDS = f"""{ENTRIES},
themes AS (
  SELECT movie_id, CASE WHEN supp % 41 <> 0 THEN supp END AS keyword_id, 'theme ' || supp % 20 AS name,
    row_number() OVER (PARTITION BY movie_id ORDER BY supp, flag, line) AS place
  FROM entries SEMI JOIN movies USING (movie_id)
),
first_themes AS (
  SELECT movie_id, string_agg(name, '|' ORDER BY place) AS keyword_names,
         string_agg(name, ', ' ORDER BY place) AS theme_line, count(*) AS n
  FROM themes WHERE place <= 15 GROUP BY movie_id
)"""

CAST = f"""{KEYWORDS},
ranked_cast AS (
  SELECT movie_id, person_id, name, character_name,
    CAST(row_number() OVER (PARTITION BY movie_id
      ORDER BY billing ASC NULLS LAST, person_id, character_name ASC NULLS FIRST, name) - 1 AS INTEGER) AS billing_order
  FROM (
    SELECT movie_id, supp AS person_id, 'Performer ' || supp AS name,
      CASE WHEN flag <> 'N' THEN flag || '-' || line END AS character_name,
      CASE WHEN line <> 7 THEN line END AS billing
    FROM entries SEMI JOIN movies USING (movie_id) WHERE supp % 37 <> 0
  )
),
top_cast AS (SELECT * FROM ranked_cast WHERE billing_order < 10),
cast_lines AS (
  SELECT movie_id, string_agg(
    CASE WHEN character_name IS NULL THEN name ELSE name || ' as ' || character_name END,
    ', ' ORDER BY billing_order) AS cast_line
  FROM top_cast GROUP BY movie_id
)"""

REVIEW_LIMIT, REVIEW_CHARS = 8, 4000

REVIEWS = f"""{CAST},
turns AS (
  SELECT DISTINCT (conv_id * 13 + turn * 7) % slots + copy * slots AS movie_id, conv_id || '-' || turn AS review_id,
    CASE WHEN role <> 'system' THEN role END AS author, text AS content,
    CASE WHEN (conv_id + turn) % 23 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00'
      + to_days(CAST(conv_id % 365 AS INTEGER)) + to_minutes(turn) END AS created_at
  FROM conversations CROSS JOIN sizes CROSS JOIN range(16) AS copies(copy)
),
top_reviews AS (
  SELECT movie_id, review_id, author, left(content, {REVIEW_CHARS}) AS content, created_at,
         CAST(place - 1 AS INTEGER) AS review_rank
  FROM (
    SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY length(content) DESC, review_id) AS place
    FROM turns SEMI JOIN movies USING (movie_id) WHERE length(content) > 100
  ) WHERE place <= {REVIEW_LIMIT}
),
blocks AS (
  SELECT movie_id, string_agg('Review by ' || coalesce(author, 'anonymous') || ':' || chr(10) || content,
           chr(10) || chr(10) ORDER BY review_rank) AS reviews_block,
         CAST(count(*) AS INTEGER) AS review_count
  FROM top_reviews GROUP BY movie_id
)"""

GOLD = f"""{REVIEWS},
texts AS (
  SELECT movie_id, title, coalesce(review_count, 0) AS review_count,
    concat_ws(chr(10) || chr(10),
      title || coalesce(' (' || year(release_date) || ')', ''),
      'Tagline: ' || tagline,
      'Genres: ' || replace(genre_names, '|', ', '),
      'Runtime: ' || runtime_minutes || ' minutes',
      'Overview: ' || overview,
      'Themes: ' || theme_line,
      'Cast: ' || cast_line,
      'What viewers said:' || chr(10) || reviews_block) AS doc_text
  FROM movies LEFT JOIN first_themes USING (movie_id) LEFT JOIN cast_lines USING (movie_id)
    LEFT JOIN blocks USING (movie_id)
),
gold AS (
  SELECT movie_id, title, doc_text, sha256(doc_text) AS content_hash, review_count,
         CAST(length(doc_text) AS INTEGER) AS char_length
  FROM texts
)"""

LINKS = f"""{MOVIES},
links AS (
  SELECT genre_id, movie_id FROM movies WHERE genre_id IS NOT NULL
  UNION SELECT 999, movie_id FROM movies WHERE has_orphan
),
genres AS (SELECT DISTINCT ascii(p_type) * 100 + length(p_type) AS genre_id, p_type AS name FROM part)"""

PAGE_STATUS = """
SELECT page_id, url, html, CASE page_id % 20 WHEN 3 THEN 'not_found' WHEN 7 THEN 'error' ELSE 'success' END AS status
FROM pages"""

CATALOGUE = """
SELECT p_partkey AS movie_id, p_name AS title, p_retailprice AS popularity, p_size * 10 AS vote_count,
  p_size % 7 = 0 AS adult, p_brand AS overview, p_size / 10 AS vote_average,
  CASE WHEN p_size % 2 = 0 THEN '/' || p_partkey || '.jpg' END AS poster_path
FROM part"""

CHUNKS = """
chunks AS (
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(1 + 700 * i AS BIGINT), 800) AS chunk_text
  FROM (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 100) / 700)) AS BIGINT))) AS i
        FROM documents)
)"""


# Every white-space character of Unicode.
WHITE_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\pZ]+"


def _hashed(table: str, keys: str, text: str) -> str:
    """Signed word hashing of a text column: keys, dim, weight."""
    return f"""
  SELECT {keys}, CAST(h % {DIMENSIONS} AS INTEGER) AS dim,
         sum(CASE WHEN h // {DIMENSIONS} % 2 = 0 THEN 1 ELSE -1 END) AS weight
  FROM (SELECT {keys}, CAST('0x' || left(md5(word), 7) AS BIGINT) AS h
        FROM (SELECT {keys}, unnest(regexp_split_to_array(lower({text}), '{WHITE_SPACE}')) AS word FROM {table})
        WHERE word <> '')
  GROUP BY {keys}, dim HAVING weight <> 0"""


EMBEDDED = f"""{CHUNKS},
weights AS ({_hashed("chunks", "doc_id, chunk_index", "chunk_text")}),
norms AS (SELECT doc_id, chunk_index, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY ALL)"""


def _requests() -> str:
    rows = ", ".join(f"({q}, {vector}::DOUBLE[])" for q, vector in request_vectors().items())
    return f"requests(query_id, q) AS (VALUES {rows})"


def _top_k(parent: str, k: int = 10, where: str = "true") -> str:
    return f"""
WITH {_requests()},
scored AS (
  SELECT query_id, {parent} AS parent,
         max(round(list_cosine_similarity(embedding::DOUBLE[], q), 6)) AS score
  FROM embeddings CROSS JOIN requests WHERE {where} GROUP BY ALL
)"""


def _ranked(name: str, k: int = 10) -> str:
    return f"""
SELECT CAST(query_id AS BIGINT) AS query_id, parent AS {name}, score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent) AS rank FROM scored)
WHERE rank <= {k}"""


def _request_texts() -> str:
    rows = ", ".join(f"({i}, '{text}')" for i, text in enumerate(REQUEST_TEXTS))
    return f"asked(query_id, body) AS (VALUES {rows})"


LATEST = """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r
  FROM events WHERE {where}) WHERE r = 1"""

NULL_KEYED = LATEST.replace("FROM events", "FROM (SELECT * REPLACE (nullif(user_id % 17, 0) AS user_id) FROM events)")

FINGERPRINTED = """
hashed AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
embedded AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN content_hash ELSE 'old' END AS content_hash
  FROM hashed JOIN labels USING (doc_id)
)"""

_MOVIE_COLUMNS = (
    "movie_id, title, original_title, tagline, overview, runtime_minutes, vote_average, vote_count, popularity, "
    "original_language, adult, poster_path, backdrop_path, homepage, imdb_id"
)


def _null_counts() -> str:
    names = [name.strip() for name in _MOVIE_COLUMNS.split(",")]
    nullable = [*names, "release_date", "genre_names"]
    counts = [f"count(*) FILTER ({name} IS NULL) AS {name}" for name in nullable]
    never = [f"0::BIGINT AS {name}" for name in ("keyword_names", "provider_names", "ingested_at")]
    return f"WITH {MOVIES} SELECT {', '.join(counts + never)} FROM movies"


ORACLES: dict[str, str] = {
    "crawl_to_bronze": f"""
SELECT page_id AS movie_id, status,
  CASE status WHEN 'not_found' THEN 'gone' WHEN 'error' THEN 'unavailable' END AS error,
  CASE WHEN status = 'success' THEN url END AS url,
  CASE WHEN status = 'success' THEN sha256(html) END AS html_hash
FROM ({PAGE_STATUS})""",
    "fetch_status_summary": f"SELECT status, count(*) AS rows FROM ({PAGE_STATUS}) GROUP BY status",
    "fetch_failures": f"""
SELECT status, count(*) AS rows FROM ({PAGE_STATUS}) WHERE status <> 'success' GROUP BY status""",
    "success_ratio": f"""
WITH {CRAWL} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS succeeded,
  round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM crawl""",
    "pages_first_seen_ids": """
WITH items AS (
  SELECT event_id // 20 + 1 AS page, user_id, event_id % 20 = 9 AS odd,
         row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id % 20, user_id) - 1 AS position
  FROM (SELECT DISTINCT event_id, user_id FROM events)
),
stop AS (SELECT max(page) * 9 // 10 AS page FROM items)
SELECT user_id AS movie_id, min(page) AS page,
  CAST(min(page * 1000 + position) % 1000 AS INTEGER) AS position
FROM items WHERE page < (SELECT page FROM stop) AND NOT odd GROUP BY user_id""",
    "listing_filters": f"""
SELECT movie_id, title, popularity, vote_count FROM ({CATALOGUE})
WHERE NOT adult AND vote_count >= 50 AND popularity <= 1000.0
ORDER BY popularity DESC, movie_id LIMIT 20 OFFSET 20""",
    "bronze_reference_list": "SELECT ascii(p_type) * 100 + length(p_type) AS genre_id, p_type AS name FROM part",
    "parse_props_json": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "parse_yield": f"""
WITH {CRAWL} SELECT outcome, count(*) AS rows FROM (
  SELECT CASE WHEN status <> 'success' THEN 'fetch_' || status WHEN broken THEN 'bad_json'
    WHEN title IS NOT NULL AND length(overview) > 0 THEN 'parsed'
    WHEN title IS NULL THEN 'no_title' ELSE 'no_overview' END AS outcome FROM crawl
) GROUP BY outcome""",
    "silver_movies": f"""
WITH {KEYWORDS} SELECT {_MOVIE_COLUMNS}, CAST(release_date AS VARCHAR) AS release_date, genre_names,
  coalesce(keyword_names, '') AS keyword_names, provider_names,
  CAST(coalesce(n, 0) AS INTEGER) AS n_keyword_names,
  CASE WHEN provider_names = '' THEN 0 ELSE 1 END AS n_provider_names
FROM movies LEFT JOIN first_themes USING (movie_id)""",
    "silver_null_counts": _null_counts(),
    "silver_genres": f"WITH {LINKS} SELECT genre_id, name FROM genres",
    "silver_links": f"WITH {LINKS} SELECT genre_id, movie_id FROM links SEMI JOIN genres USING (genre_id)",
    "orphan_links": f"WITH {LINKS} SELECT genre_id, movie_id FROM links ANTI JOIN genres USING (genre_id)",
    "silver_cast": f"WITH {CAST} SELECT * FROM top_cast",
    "silver_cast_merged": f"WITH {CAST} SELECT * FROM top_cast",
    "silver_keywords": f"""
WITH {KEYWORDS} SELECT DISTINCT movie_id, keyword_id, name FROM themes WHERE keyword_id IS NOT NULL""",
    "silver_reviews": f"""
WITH {REVIEWS} SELECT movie_id, review_id, author, content,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, review_rank FROM top_reviews""",
    "silver_reviews_tight": f"""
WITH {REVIEWS} SELECT movie_id, review_id, author, left(content, {TIGHT_REVIEW_CHARS}) AS content,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, review_rank FROM top_reviews
WHERE review_rank < {TIGHT_REVIEW_LIMIT}""",
    "cast_line": f"WITH {CAST} SELECT * FROM cast_lines",
    "review_block": f"WITH {REVIEWS} SELECT * FROM blocks",
    "gold_documents": f"WITH {GOLD} SELECT * FROM gold",
    "gold_documents_joined": f"WITH {GOLD} SELECT * FROM gold",
    "gold_profile": f"""
WITH {GOLD} SELECT count(*) AS documents, round(avg(char_length)) AS avg_chars,
  quantile_disc(char_length, 0.5) AS median_chars, max(char_length) AS max_chars,
  round(avg(review_count), 2) AS avg_reviews, count(*) FILTER (review_count > 0) AS with_reviews,
  count(DISTINCT content_hash) AS distinct_hashes FROM gold""",
    "document_fingerprint_dups": """
SELECT sha256(text) AS content_hash, count(*) AS documents FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "table_counts": f"""
WITH {REVIEWS},
links AS (
  SELECT genre_id, movie_id FROM movies WHERE genre_id IS NOT NULL
)
SELECT 'bronze_payloads' AS table_name, count(*) AS rows FROM crawl
UNION ALL SELECT 'parsed', count(*) FROM movies
UNION ALL SELECT 'silver_genres', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'silver_movie_genres', count(*) FROM links
UNION ALL SELECT 'silver_cast', count(*) FROM top_cast
UNION ALL SELECT 'silver_keywords', count(*) FROM (
  SELECT DISTINCT movie_id, keyword_id, name FROM themes WHERE keyword_id IS NOT NULL)
UNION ALL SELECT 'silver_reviews', count(*) FROM top_reviews""",
    "chunk_documents": f"WITH {CHUNKS} SELECT * FROM chunks",
    "embed_chunks": f"""
WITH {EMBEDDED}, shown AS (
  SELECT doc_id, chunk_index, string_agg(
    dim || ':' || CAST(round(CAST(CAST(weight / norm AS FLOAT) AS DOUBLE) * 1e6) AS INTEGER), ' ' ORDER BY dim) AS vector
  FROM weights JOIN norms USING (doc_id, chunk_index) GROUP BY ALL
)
SELECT doc_id, chunk_index, coalesce(vector, '') AS vector FROM chunks LEFT JOIN shown USING (doc_id, chunk_index)""",
    "semantic_search": f"""
WITH {_request_texts()}, {EMBEDDED},
vectors AS (
  SELECT doc_id, chunk_index, dim, CAST(CAST(weight / norm AS FLOAT) AS DOUBLE) AS value
  FROM weights JOIN norms USING (doc_id, chunk_index)
),
lengths AS (SELECT doc_id, chunk_index, sqrt(sum(value * value)) AS length FROM vectors GROUP BY ALL),
asked_weights AS ({_hashed("asked", "query_id", "body")}),
asked_vectors AS (
  SELECT query_id, dim, CAST(CAST(weight / sqrt(sum(weight * weight) OVER (PARTITION BY query_id)) AS FLOAT) AS DOUBLE) AS value
  FROM asked_weights
),
asked_lengths AS (SELECT query_id, sqrt(sum(value * value)) AS length FROM asked_vectors GROUP BY ALL),
dots AS (
  SELECT query_id, doc_id, chunk_index, sum(a.value * v.value) AS dot
  FROM vectors v JOIN asked_vectors a USING (dim) GROUP BY ALL
),
scored AS (
  SELECT query_id, doc_id AS parent, max(round(coalesce(dot / (v.length * a.length), 0), 6)) AS score
  FROM chunks CROSS JOIN asked_lengths a LEFT JOIN dots USING (query_id, doc_id, chunk_index)
    LEFT JOIN lengths v USING (doc_id, chunk_index)
  GROUP BY ALL
)
{_ranked("doc_id")}""",
    "vector_top_k": _top_k("vec_id") + _ranked("vec_id"),
    "vector_top_k_parents": _top_k("vec_id // 4") + _ranked("movie_id"),
    "labelled_vector_top_k": _top_k("vec_id", where="label < 5") + _ranked("vec_id"),
    "constrained_top_k": _top_k(
        "vec_id // 4",
        where=f"""vec_id // 4 IN (WITH {MOVIES} SELECT movie_id FROM movies
      WHERE runtime_minutes < 100 AND genre_names LIKE '%ECONOMY%')""",
    )
    + _ranked("movie_id", 5),
    "unembedded_documents": f"""
WITH {FINGERPRINTED} SELECT * FROM hashed ANTI JOIN embedded USING (doc_id, content_hash)""",
    "live_embeddings": f"""
WITH {FINGERPRINTED} SELECT * FROM embedded SEMI JOIN hashed USING (doc_id, content_hash)""",
    "latest_ratings": LATEST.format(where="true"),
    "upsert_snapshot": f"""
WITH old AS ({LATEST.format(where=f"ts < TIMESTAMP '{UPSERT_CUT}'")}),
new AS ({LATEST.format(where=f"ts >= TIMESTAMP '{UPSERT_CUT}'")})
SELECT * FROM old ANTI JOIN new USING (user_id, event_type) UNION ALL SELECT * FROM new""",
    "upsert_null_keys": f"""
WITH old AS ({NULL_KEYED.format(where=f"ts < TIMESTAMP '{UPSERT_CUT}'")}),
new AS ({NULL_KEYED.format(where=f"ts >= TIMESTAMP '{UPSERT_CUT}'")})
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.user_id IS NOT DISTINCT FROM old.user_id
  AND new.event_type = old.event_type) UNION ALL SELECT * FROM new""",
    "late_records": NULL_KEYED.format(where="true"),
    "group_exclusion": f"""
WITH {SIZES},
acts AS (SELECT user_id, user_id % 10 AS group_id, event_id % greatest(parts, 1) AS movie_id, event_type
         FROM events CROSS JOIN sizes),
avoided AS (SELECT group_id, movie_id FROM acts WHERE event_type IN ('view', 'purchase', 'error'))
SELECT DISTINCT group_id, movie_id FROM acts ANTI JOIN avoided USING (group_id, movie_id)
WHERE event_type IN ('click', 'signup')""",
    "compare_titles": f"""
WITH {MOVIES} SELECT movie_id, title, CAST(release_date AS VARCHAR) AS release_date, runtime_minutes,
  vote_average, vote_count, popularity, genre_names, provider_names
FROM movies WHERE movie_id IN {COMPARED_IDS}""",
    "title_search": f"""
SELECT movie_id, title, CAST(NULL AS VARCHAR) AS release_date, overview, vote_average,
  '{IMAGE_BASE}/w342' || poster_path AS poster_url
FROM ({CATALOGUE}) WHERE contains(lower(title), '{SEARCHED_TITLE.strip().lower()}')
ORDER BY popularity DESC, movie_id LIMIT 5""",
    "poster_urls": f"""
SELECT page_id, CASE WHEN page_id % 4 > 1 THEN '{IMAGE_BASE}/w342/' || url END AS poster_url FROM pages""",
}

ORACLES |= {"pruned_top_k": ORACLES["vector_top_k"], "title_search_indexed": ORACLES["title_search"]}
ORACLES["merged_profile"] = f"SELECT * EXCLUDE (median_chars, distinct_hashes) FROM ({ORACLES['gold_profile']})"

#: Plans for repeated ids give what the narrow ones give.
ORACLES |= {f"{name}_merged": ORACLES[name] for name in ("silver_keywords", "silver_links", "silver_reviews")}


def _repeated(query: str) -> str:
    """A query in which neighbouring records share an id."""
    shared = ORACLES[query].replace("PARTITION BY movie_id", "PARTITION BY movie_id // 2 * 2")
    return f"SELECT * REPLACE (movie_id // 2 * 2 AS movie_id) FROM ({shared})"


_CHANGED = f"""
WITH {CRAWL} SELECT p_partkey AS movie_id, CASE WHEN p_partkey % 9 = 4 THEN 'added' ELSE 'changed' END AS change FROM crawl
WHERE status = 'success' AND (p_partkey % 9 = 4 OR p_partkey % 7 = 2 AND NOT broken AND title IS NOT NULL)
UNION ALL SELECT p_partkey + 1000000000, 'removed' FROM crawl WHERE status = 'success' AND p_partkey % 11 = 5"""

_HELD = NULL_KEYED.format(where=f"ts < TIMESTAMP '{UPSERT_CUT}'")
_WANTED = NULL_KEYED.format(where="event_type <> 'error'")

ORACLES |= {
    "silver_links_repeated": f"SELECT DISTINCT * FROM ({_repeated('silver_links')})",
    "silver_cast_repeated": _repeated("silver_cast"),
    "silver_keywords_repeated": f"SELECT DISTINCT * FROM ({_repeated('silver_keywords')})",
    "silver_reviews_repeated": _repeated("silver_reviews"),
    "changed_records": _CHANGED,
    **{f"refreshed_{name}": ORACLES[query] for name, query in (
        ("links", "silver_links"), ("cast", "silver_cast"), ("keywords", "silver_keywords"), ("reviews", "silver_reviews"), ("documents", "gold_documents"))},
    "resumed_crawl": """
SELECT page_id AS movie_id, CASE WHEN turn = 3 THEN 'not_found' WHEN turn IN (7, 13) THEN 'error' ELSE 'success' END AS status,
  CASE turn WHEN 3 THEN 'gone' WHEN 7 THEN 'unavailable' WHEN 13 THEN 'busy' END AS error,
  CASE WHEN turn NOT IN (3, 7, 13) THEN url END AS url, CASE turn WHEN 11 THEN 2 WHEN 13 THEN 3 ELSE 1 END AS requests
FROM (SELECT *, page_id % 20 AS turn FROM pages)""",
    "listing_source_ids": ORACLES["pages_first_seen_ids"],
    "listing_requests": """
WITH last AS (SELECT max(event_id // 20 + 1) AS page FROM events),
stop AS (SELECT page AS last, page * 9 // 10 AS stop FROM last)
SELECT least(last, CAST(2 ** ceil(log2(stop)) AS BIGINT)) AS requested, stop AS used FROM stop""",
    "publish_change_set": f"""
SELECT coalesce(w.user_id, h.user_id) AS user_id, coalesce(w.event_type, h.event_type) AS event_type, w.event_id, w.value,
  CASE WHEN h.event_id IS NULL THEN 'added' WHEN w.event_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM ({_WANTED}) w FULL JOIN ({_HELD}) h ON w.user_id IS NOT DISTINCT FROM h.user_id AND w.event_type = h.event_type
WHERE w.event_id IS DISTINCT FROM h.event_id OR w.value IS DISTINCT FROM h.value""",
    "published_rows": _WANTED,
    "recorded_by_part": ORACLES["late_records"],
}

_MISSING = {
    "title": ("string", "title IS NULL"),
    "overview": ("string", "overview IS NULL"),
    "runtime": ("integer", "p_partkey % 13 = 0"),
    "adult": ("boolean", "p_size % 2 = 0"),
    "genres": ("array", "p_partkey % 19 = 0"),
    "watch/providers": ("object", "p_size >= 10"),
}

ORACLES |= {
    "group_exclusion_bitmaps": ORACLES["group_exclusion"],
    "payload_drift": f"""
WITH {CRAWL}, sent AS (SELECT * FROM crawl WHERE status = 'success' AND NOT broken)
SELECT * FROM (
  SELECT '$.runtime' AS path, 'wrong type' AS finding, 'integer' AS expected, 'string' AS found, count(*) AS occurrences
  FROM sent WHERE p_partkey % 31 = 0 AND p_partkey % 13 <> 0
  """
    + "\n  ".join(f"UNION ALL SELECT '$.{name}', 'missing', '{kind}', NULL, count(*) FROM sent WHERE {gone}" for name, (kind, gone) in _MISSING.items())
    + "\n) WHERE occurrences > 0",
}
