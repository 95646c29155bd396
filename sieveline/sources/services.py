"""Searches of bibliographic services: requests, paging, retries.

``fetch(url, params) -> dict`` is the only effect. ``http_fetch`` sends
requests; ``recorded_fetch`` answers from a table of recordings, for tests and
runs without a network. ``scan.py`` makes a Spark data source of them.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

Fetch = Callable[[str, dict], dict]
Years = tuple[int | None, int | None]

# Addresses, and the fields of each service that the columns of a paper come from.
CROSSREF_URL = "https://api.crossref.org/works"
SEMANTIC_SCHOLAR_URL = "https://api.semanticscholar.org/graph/v1/paper/search/bulk"
EUROPE_PMC_URL = "https://www.ebi.ac.uk/europepmc/webservices/rest/search"
SELECTED = {
    "crossref": {
        "doi": ["DOI"], "title": ["title"], "abstract": ["abstract"], "authors": ["author"], "year": ["published", "published-online", "published-print"], "publication_date": ["published", "published-online", "published-print"],
        "venue": ["container-title"], "work_type": ["type"], "citation_count": ["is-referenced-by-count"], "landing_page_url": ["URL"], "open_access_pdf_url": ["link"], "open_access_license": ["license"], "source_relevance": ["score"],
    },
    "semantic_scholar": {
        "title": ["title"], "abstract": ["abstract"], "year": ["year"], "authors": ["authors"], "venue": ["venue"], "citation_count": ["citationCount"], "influential_citation_count": ["influentialCitationCount"], "publication_date": ["publicationDate"],
        "work_type": ["publicationTypes"], "doi": ["externalIds"], "landing_page_url": ["url"], "open_access_pdf_url": ["openAccessPdf"], "topics": ["fieldsOfStudy"],
    },
}
#: Columns without which no record can be made.
NEEDED = ("doi", "title", "year")


class ServiceError(RuntimeError):
    def __init__(self, status: int, retry_after: float = 0):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def with_retries(fetch: Fetch, *, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """Four attempts; after 429 the asked pause (20 s at most), after others a doubling one (8 s at most)."""

    def get(url: str, params: dict) -> dict:
        for n in range(attempts):
            try:
                got = fetch(url, params)
                if not isinstance(got, dict):
                    raise ServiceError(0)
                return got
            except Exception as e:
                if n + 1 == attempts:
                    raise
                asked = isinstance(e, ServiceError) and e.status == 429
                sleep(min(e.retry_after, 20) if asked else min(2**n, 8))
        raise AssertionError

    return get


def request_key(url: str, params: dict) -> str:
    """A request as one string, the same whatever the order of its parameters."""
    return f"{url}?{urllib.parse.urlencode(sorted((k, str(v)) for k, v in params.items()))}"


def http_fetch(url: str, params: dict) -> dict:
    try:
        with urllib.request.urlopen(urllib.request.Request(request_key(url, params), headers={"Accept": "application/json"}), timeout=45) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        after = e.headers.get("retry-after", "2")
        raise ServiceError(e.code, float(after) if after.replace(".", "", 1).isdigit() else 2) from e


def recorded_fetch(path: str) -> Fetch:
    """Answers from Parquet files at ``path`` (request, answer); a request that isn't there is an error 404."""

    def get(url: str, params: dict) -> dict:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)
        found = ds.dataset(folder, format="parquet", filesystem=store).to_table(columns=["answer"], filter=ds.field("request") == request_key(url, params))
        if not found.num_rows:
            raise ServiceError(404)
        return json.loads(found.column("answer")[0].as_py())

    return get


def first_text(value: object) -> str | None:
    if isinstance(value, list):
        return next((t for t in map(first_text, value) if t), None)
    return value.strip() or None if isinstance(value, str) else None


def is_record(source: str, item: object) -> bool:
    """Whether an item has what its parser needs; only such items count towards limits and ranks."""
    own = {"crossref": None, "semantic_scholar": "paperId", "europe_pmc": "id"}[source]
    return isinstance(item, dict) and first_text(item.get("title")) is not None and (own is None or first_text(item.get(own)) is not None)


def selected(source: str, columns: list[str] | None) -> str:
    """The service's own fields for the columns asked for (None: all), as it wants them listed."""
    known = SELECTED[source]
    wanted = known if columns is None else [c for c in known if c in columns or c in NEEDED]
    return ",".join(dict.fromkeys(f for c in wanted for f in known[c]))


def crossref_request(query: str, limit: int, years: Years, columns: list[str] | None = None) -> dict:
    bounds = [f"from-pub-date:{years[0]}-01-01" if years[0] else "", f"until-pub-date:{years[1]}-12-31" if years[1] else ""]
    asked = {"query.bibliographic": query, "rows": min(limit, 1000), "select": selected("crossref", columns)}
    return asked | ({"filter": ",".join(b for b in bounds if b)} if any(years) else {})


def crossref_items(fetch: Fetch, query: str, limit: int, years: Years, columns: list[str] | None = None) -> Iterator[tuple[int, dict]]:
    message = fetch(CROSSREF_URL, crossref_request(query, limit, years, columns)).get("message")
    yield from enumerate((message.get("items") or []) if isinstance(message, dict) else [])


def semantic_scholar_items(fetch: Fetch, query: str, limit: int, years: Years, columns: list[str] | None = None) -> Iterator[tuple[int, dict]]:
    token, n = None, 0
    while n < limit:
        params = {"query": query, "fields": selected("semantic_scholar", columns), "limit": min(1000, limit - n)}
        params |= {"year": f"{years[0] or ''}-{years[1] or ''}"} if any(years) else {}
        got = fetch(SEMANTIC_SCHOLAR_URL, params | ({"token": token} if token else {}))
        data = got.get("data")
        if not isinstance(data, list) or not data:
            return
        for rank, item in enumerate(data, n):
            n += is_record("semantic_scholar", item)
            yield rank, item
        token = got.get("token")
        if not token:
            return


def europe_pmc_items(fetch: Fetch, query: str, limit: int, years: Years, columns: list[str] | None = None) -> Iterator[tuple[int, dict]]:
    cursor, n = "*", 0
    asked = f"({query})" + (f" AND FIRST_PDATE:[{years[0] or 1800}-01-01 TO {years[1] or 2100}-12-31]" if any(years) else "")
    while n < limit:
        size = min(1000, limit - n)
        got = fetch(EUROPE_PMC_URL, {"query": asked, "format": "json", "resultType": "core", "pageSize": size, "cursorMark": cursor})
        listed = got.get("resultList")
        items = listed.get("result") if isinstance(listed, dict) else None
        if not isinstance(items, list) or not items:
            return
        for rank, item in enumerate(items, n):
            n += is_record("europe_pmc", item)
            yield rank, item
        after = got.get("nextCursorMark")
        if not after or after == cursor or len(items) < size:
            return
        cursor = str(after)


def openalex_items(fetch: Fetch, query: str, limit: int, years: Years, columns: list[str] | None = None) -> Iterator[tuple[int, dict]]:
    raise ServiceError(403)  # this service is switched off


ITEMS = {"crossref": crossref_items, "semantic_scholar": semantic_scholar_items, "europe_pmc": europe_pmc_items, "openalex": openalex_items}


def records_of(fetch: Fetch, source: str, query: str, limit: int, years: Years, columns: list[str] | None = None) -> list[tuple[int, dict]]:
    """(rank, item) of a query's first ``limit`` records."""
    found = []
    for rank, item in ITEMS[source](fetch, query, limit, years, columns):
        if len(found) == limit:
            break
        if is_record(source, item):
            found.append((rank, item))
    return found
