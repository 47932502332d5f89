"""Fetchers: ``fetch(request) -> JSON-serialisable record`` for one keyed request.

A request is a dict of the request row's columns. Operators take a function
that opens a fetcher; it is called once per task, on the executor, so sessions
and credentials captured in it never have to be pickled as live objects.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from typing import Any, Protocol

# Retry policy of the external service.
RETRY_STATUS = (429, 500, 502, 503, 504)
RETRY_WAITS = (0.0, 2.0, 4.0)
TIMEOUT_SECONDS = 30

# Paths and request parameters of the external service.
DETAIL_PATH = "/movie/{movie_id}"
LISTING_PATH = "/discover/movie"
GENRE_PATH = "/genre/movie/list"
LANGUAGE = {"language": "en-US"}
DETAIL_BLOCKS = {"append_to_response": "credits,keywords,reviews,watch/providers"}
LISTING_DEFAULTS = {
    "sort_by": "popularity.desc",
    "include_adult": "false",
    "include_video": "false",
    "vote_count.gte": 50,
}


class FetchError(RuntimeError):
    """The service failed: network, status code or malformed body."""


class TransientError(FetchError):
    """The service failed in a way that may pass: overload, a lost connection, a timeout."""


class NotFoundError(LookupError):
    """The service answered that the key does not exist."""


class Fetcher(Protocol):
    def fetch(self, request: Mapping[str, Any]) -> Any: ...


class RecordedFetcher:
    """Answers from recorded responses; a recorded exception is raised."""

    def __init__(self, responses: Mapping[Any, Any], key: str = "movie_id"):
        self._responses = responses
        self._key = key

    def fetch(self, request: Mapping[str, Any]) -> Any:
        wanted = request[self._key]
        if wanted not in self._responses:
            raise NotFoundError(f"no recording for {wanted}")
        answer = self._responses[wanted]
        if isinstance(answer, Exception):
            raise answer
        return answer


class HttpJsonFetcher:
    """GET ``base_url + path`` with the request's columns filled into path and parameters."""

    def __init__(
        self,
        base_url: str,
        path: str,
        token: str,
        params: Mapping[str, Any] | None = None,
        send: Callable[..., Any] = urllib.request.urlopen,
        sleep: Callable[[float], None] = time.sleep,
    ):
        self._url = base_url.rstrip("/") + path
        self._params = dict(params or {})
        self._headers = {"Authorization": f"Bearer {token}", "Accept": "application/json"}
        self._send = send
        self._sleep = sleep

    def fetch(self, request: Mapping[str, Any]) -> Any:
        url = self._url.format_map(request)
        params = {
            name: value.format_map(request) if isinstance(value, str) else value
            for name, value in self._params.items()
        }
        if params:
            url += "?" + urllib.parse.urlencode(params)
        message = urllib.request.Request(url, headers=self._headers)
        for wait in (*RETRY_WAITS, None):
            try:
                with self._send(message, timeout=TIMEOUT_SECONDS) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as failed:
                if failed.code == 404:
                    raise NotFoundError(f"no resource at {self._url.format_map(request)}") from failed
                if failed.code == 401:
                    raise FetchError("the service rejected the credential (401)") from failed
                if failed.code not in RETRY_STATUS:
                    raise FetchError(f"status {failed.code}") from failed
                if wait is None:
                    raise TransientError(f"status {failed.code}") from failed
                self._sleep(_retry_after(failed, wait))
            except ValueError as failed:
                raise FetchError(f"malformed JSON: {failed}") from failed
            except (OSError, http.client.HTTPException) as failed:  # lost connections, timeouts, truncated answers
                if wait is None:
                    raise TransientError(f"request failed: {failed!r}") from failed
                self._sleep(wait)
        raise AssertionError("unreachable")


def _retry_after(failed: urllib.error.HTTPError, wait: float) -> float:
    try:
        return float(failed.headers["Retry-After"])
    except (TypeError, ValueError, KeyError):
        return wait


def listing_params(**filters: Any) -> dict[str, Any]:
    """Listing request parameters; a name that ends in ``_gte`` or ``_lte`` is sent with a dot there."""
    sent = {**LISTING_DEFAULTS, "page": "{page}"}
    for name, value in filters.items():
        column, _, side = name.rpartition("_")
        sent[f"{column}.{side}" if side in ("gte", "lte") else name] = value
    return sent


def listing_over_http(base_url: str, token: str, **filters: Any) -> Fetcher:
    """One listing page per ``page``. Wrap in ``functools.partial`` to open it in tasks."""
    return HttpJsonFetcher(base_url, LISTING_PATH, token, {**LANGUAGE, **listing_params(**filters)})


def details_over_http(base_url: str, token: str) -> Fetcher:
    """One record per ``movie_id`` with its cast, keywords, reviews and providers."""
    return HttpJsonFetcher(base_url, DETAIL_PATH, token, {**LANGUAGE, **DETAIL_BLOCKS})


def genres_over_http(base_url: str, token: str) -> list[dict[str, Any]]:
    """The short reference list of genres; empty when the answer holds none."""
    return HttpJsonFetcher(base_url, GENRE_PATH, token, LANGUAGE).fetch({}).get("genres") or []
