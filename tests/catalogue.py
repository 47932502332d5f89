"""Literal payloads covering the edge cases of the parse, and their bronze rows."""

import json
from datetime import datetime, timezone

from docforge.schemas import BRONZE_GENRES, BRONZE_PAYLOADS

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)
LONG = "x" * 101


def review(id, content=LONG, author="ann", created_at="2024-01-02T03:04:05.678Z"):
    return {"id": id, "author": author, "content": content, "created_at": created_at}


def person(id, name="P", order=0, character="role"):
    return {"id": id, "name": name, "order": order, "character": character}


def payload(id, **fields):
    return {"id": id, "title": f"T{id}", "overview": f"about {id}", **fields}


FULL = payload(
    1,
    tagline="Go",
    release_date="1999-03-31",
    runtime=136,
    adult=True,
    vote_average=8.2,
    vote_count=25000,
    popularity=90.5,
    homepage="http://h",
    imdb_id="tt1",
    genres=[{"id": 1, "name": "Action"}, {"id": 2, "name": "Drama"}, {"id": 1, "name": "Action"}, {"id": 77, "name": "Odd"}],
    credits={"cast": [person(11, "Ann", 1, "Neo"), person(10, "Bob", 0, "")]},
    keywords={"keywords": [{"id": 5, "name": "slow"}, {"id": 6, "name": "burn"}, {"id": 5, "name": "slow"}]},
    reviews={"results": [review("b", "y" * 150), review("a", "z" * 200, None)], "total_results": 2},
    **{"watch/providers": {"results": {"US": {"flatrate": [{"provider_id": 3, "provider_name": "Flix"}]}}}},
)


def bronze(spark, payloads, extra=()):
    """``payloads`` maps id to a dict or raw text; ``extra`` adds (id, status) failures."""
    found = [
        (key, body if isinstance(body, str) or body is None else json.dumps(body), "success", None, NOW)
        for key, body in payloads
    ]
    failed = [(key, None, status, "msg", NOW) for key, status in extra]
    return spark.createDataFrame(found + failed, BRONZE_PAYLOADS)


def genre_list(spark, *entries):
    return spark.createDataFrame([(key, name, NOW) for key, name in entries], BRONZE_GENRES)
