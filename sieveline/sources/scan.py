"""Service searches as a Spark data source.

``format("scholarly_search")`` has a partition for each source and query, so
queries run in tasks of their own and a failed one is a row that tells so,
beside the records of the others. Filters of year, source and query are
pushed: bounds of years become the services' own parameters, other sources
and queries are never asked. The columns asked for are the ``select`` of the services
that have one.

Rows have ``ord``, which orders them by source, query and rank as listed. A
record's row has ``rank``, ``year`` and ``item``, its JSON; each query has one row more,
with ``status`` and ``error``, whose rank, year and item are null (a filter of year drops it, as any null).

Options: ``sources`` (comma-separated), ``queries`` (a JSON list), ``limit`` of records a query, ``yearFrom``, ``yearTo``,
``columns`` (comma-separated), ``recordings`` (a table that answers instead of the services).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from sieveline.operators.components import written
from sieveline.sources import services
from sieveline.sources.records import PARSERS

#: Bits of ``ord`` for the rank and for the query.
RANK_BITS, QUERY_BITS = 20, 24
SCHEMA = "ord long, source string, query string, rank int, year int, item string, status string, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def item_year(source: str, item: dict) -> int | None:
    """The year of an item, as its parser will read it; null where there is none."""
    whole = lambda x: int(x) if str(x).strip().lstrip("+-").isdigit() else 0
    if source != "crossref":
        return whole(item.get({"semantic_scholar": "year", "europe_pmc": "pubYear"}[source])) or None
    for name in ("published", "published-print", "published-online"):
        dated = item.get(name)
        parts = dated.get("date-parts") if isinstance(dated, dict) else None
        numbers = [whole(n) for n in parts[0] if whole(n)] if isinstance(parts, list) and parts and isinstance(parts[0], list) else []
        if numbers:
            return numbers[0]
    return None


@dataclass
class QueryPartition(InputPartition):
    source_at: int
    source: str
    query_at: int
    query: str


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: services.Fetch):
        self.sources = [s for s in options["sources"].split(",") if s]
        self.queries = json.loads(options["queries"])
        self.limit = int(options.get("limit", "500"))
        self.low, self.high = (int(options[k]) if options.get(k) else None for k in ("yearfrom", "yearto"))
        self.columns = options["columns"].split(",") if options.get("columns") else None
        self.fetch = services.recorded_fetch(options["recordings"]) if options.get("recordings") else fetch
        self.year_known = False
        self.only: dict[str, set[str]] = {}

    def partitions(self) -> list[QueryPartition]:
        wanted = lambda kind, value: kind not in self.only or value in self.only[kind]
        found = [QueryPartition(i, s, j, q) for i, s in enumerate(self.sources) for j, q in enumerate(self.queries) if wanted("source", s) and wanted("query", q)]
        return found or [QueryPartition(-1, "", 0, "")]

    def within(self, year: int | None) -> bool:
        """Services bound dates of publication loosely; a pushed filter holds for the year exactly."""
        return not self.year_known or year is not None and (self.low is None or year >= self.low) and (self.high is None or year <= self.high)

    def read(self, partition: QueryPartition) -> Iterator[tuple]:
        p = partition
        if p.source_at < 0:
            return
        first = p.source_at << RANK_BITS + QUERY_BITS | p.query_at << RANK_BITS
        status, error, found = "ok", None, []
        try:
            found = services.records_of(self.fetch, p.source, p.query, self.limit, (self.low, self.high), self.columns)
        except Exception as e:  # noqa: BLE001 - a failed query is a row, not the end of the scan
            status, error = "failed", f"{type(e).__name__}: {e}"[:300]
        for n, (rank, item) in enumerate(found):
            year = item_year(p.source, item)
            if self.within(year):
                yield first | n, p.source, p.query, rank, year, json.dumps(item), None, None
        if not self.year_known:
            yield first | (1 << RANK_BITS) - 1, p.source, p.query, None, None, None, status, error


class PushedSearchReader(SearchReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "year" and isinstance(f, IsNotNull | EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.year_known = True
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) else None
                high = f.value - isinstance(f, LessThan) if isinstance(f, EqualTo | LessThan | LessThanOrEqual) else None
                self.low = max((x for x in (self.low, low) if x is not None), default=None)
                self.high = min((x for x in (self.high, high) if x is not None), default=None)
            elif name in ("source", "query") and isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.only[name] = self.only.get(name, values) & values
            elif not (name in ("source", "query", "ord") and isinstance(f, IsNotNull)):
                yield f


class ScholarlySearch(DataSource):
    #: What a request is sent with; ``over`` gives another.
    fetch = staticmethod(services.with_retries(services.http_fetch))

    @classmethod
    def name(cls) -> str:
        return "scholarly_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SearchReader:
        options = {k.lower(): v for k, v in self.options.items()}
        kind = PushedSearchReader if options.get("pushdown") == "true" else SearchReader
        return kind(options, type(self).fetch)


def scan(spark: SparkSession, sources: list[str], queries: list[str], *, fetch: services.Fetch | None = None, limit: int = 500, years: services.Years = (None, None), columns: list[str] | None = None, recordings: str | None = None) -> DataFrame:
    """The rows of ``sources`` for ``queries``, lazily: each action sends the requests again."""
    source = ScholarlySearch if fetch is None else type("ScholarlySearch", (ScholarlySearch,), {"fetch": staticmethod(fetch)})
    if fetch is not None:
        # A source of its own: later reads by the common name aren't answered by this fetch.
        name = f"scholarly_search_{uuid.uuid4().hex}"
        source.name = classmethod(lambda cls: name)
    spark.dataSource.register(source)
    options = {"sources": ",".join(sources), "queries": json.dumps(queries), "limit": str(limit), "yearFrom": str(years[0] or ""), "yearTo": str(years[1] or ""), "columns": ",".join(columns or []), "recordings": recordings or "", "pushdown": spark.conf.get(PUSHDOWN, "false")}
    return spark.read.format(source.name()).options(**options).load()


def parsed(rows: DataFrame, sources: list[str]) -> DataFrame:
    """The papers of a scan's rows, with ``ord``."""
    papers = None
    for source in sources:
        if source in PARSERS:
            # Parsers see rank and item; ord is kept beside them.
            part = PARSERS[source](rows.where((F.col("source") == source) & F.col("item").isNotNull()), kept=("ord",))
            papers = part if papers is None else papers.unionByName(part)
    return papers


def search(spark: SparkSession, sources: list[str], queries: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """(papers with ``ord``, log): all queries at all sources, asked once.

    The rows are written before anything reads them, so papers, log and
    whatever follows send no request again. Options as ``scan`` has them.
    """
    got = written(scan(spark, sources, queries, **options), "search")
    counted = got.groupBy("source", "query").agg(F.max("status").alias("status"), F.max("error").alias("error"), F.count("item").alias("records"), F.min("ord").alias("__first"))
    log = counted.orderBy("__first").drop("__first")
    return parsed(got, list(sources)), log
