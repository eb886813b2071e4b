"""Paged JSON API: query text, row normalisation and a Python data source.

Pages are independent offsets, so runs of pages are input partitions read by executors.
How many there are is asked of the server first; a server that does not count is read
by one task that follows the pages to their end.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict
from urllib.error import URLError
from urllib.parse import parse_qsl, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import ServiceRequestFilter, SocrataConfig
from .requests import normalize_requests, validated

FIELDS = ("unique_key", "created_date", "closed_date", "complaint_type", "descriptor", "borough",
          "community_district", "resolution_description", "latitude", "longitude")
OPTIONAL = ("closed_date", "resolution_description", "latitude", "longitude")
SELECT = ("unique_key", "created_date", "closed_date", "complaint_type", "descriptor", "borough",
          "community_board", "resolution_description", "latitude", "longitude")
ATTEMPTS = 4


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def where_clauses(filters: ServiceRequestFilter) -> list[str]:
    """Predicates the server evaluates."""
    out = []
    if filters.start_date:
        out.append(f"created_date >= '{filters.start_date.isoformat()}T00:00:00'")
    if filters.end_date:
        out.append(f"created_date <= '{filters.end_date.isoformat()}T23:59:59'")
    if filters.geography:
        field = {"community_district": "community_board"}.get(filters.geography.geography, filters.geography.geography)
        out.append(f"{field} = {_quoted(filters.geography.value)}")
    if filters.complaint_types:
        out.append(f"complaint_type IN ({', '.join(map(_quoted, filters.complaint_types))})")
    return out


def page_url(config: SocrataConfig, filters: ServiceRequestFilter, page: int) -> str:
    way = config.created_date_sort.upper()
    query = {"$select": ", ".join(SELECT), "$limit": config.page_size, "$offset": page * config.page_size,
             "$order": f"created_date {way}, unique_key {way}"}
    if clauses := [*where_clauses(filters), *config.extra_where_clauses]:
        query["$where"] = " AND ".join(clauses)
    return f"{config.base_url.rstrip('/')}/{config.dataset_identifier}.json?{urlencode(query)}"


def normalize_row(raw: dict) -> dict[str, str | None]:
    """Canonical field names as text; a missing descriptor is empty, a missing required field an error."""
    out: dict[str, str | None] = {}
    for field in FIELDS:
        names = ("community_district", "community_board") if field == "community_district" else (field,)
        value = next((raw[n] for n in names if raw.get(n) not in (None, "")), None)
        out[field] = None if value is None else str(value)
    out["descriptor"] = out["descriptor"] or ""
    if missing := sorted(f for f, v in out.items() if v is None and f not in OPTIONAL):
        raise ValueError(f"API row lacks required fields: {', '.join(missing)}.")
    return out


def fetch_page(url: str, config: SocrataConfig, opener: Callable = urlopen, sleep: Callable = time.sleep) -> list[dict]:
    """One page; time-outs and connection errors are tried again after 1, 2 and 4 seconds (8 at most)."""
    headers = {"Accept": "application/json"} | ({"X-App-Token": config.app_token} if config.app_token else {})
    for attempt in range(ATTEMPTS):
        try:
            with opener(Request(url, headers=headers), timeout=config.request_timeout_seconds) as reply:
                payload = json.load(reply)
            break
        except (TimeoutError, URLError):
            if attempt == ATTEMPTS - 1:
                raise
            sleep(min(8, 2**attempt))
    if not isinstance(payload, list):
        raise ValueError("API payload is not a list.")
    return payload


def count_rows(url: str, config: SocrataConfig, opener: Callable = urlopen) -> int | None:
    """Number of rows behind the first page's address, null if the server does not say."""
    address, query = url.split("?", 1)
    where = {k: v for k, v in parse_qsl(query) if k == "$where"}
    try:
        reply = fetch_page(f"{address}?{urlencode({'$select': 'count(*) AS n'} | where)}", config, opener)
    except (OSError, ValueError):
        return None
    if len(reply) != 1 or not isinstance(reply[0], dict) or set(reply[0]) != {"n"} or not str(reply[0]["n"]).isdigit():
        return None
    return int(reply[0]["n"])


def iter_rows(config: SocrataConfig, filters: ServiceRequestFilter, opener: Callable = urlopen) -> Iterator[dict[str, str | None]]:
    """Driver-side paging: ends at an empty or short page or after ``max_pages``."""
    page = 0
    while config.max_pages is None or page < config.max_pages:
        rows = fetch_page(page_url(config, filters, page), config, opener)
        yield from map(normalize_row, rows)
        if len(rows) < config.page_size:
            return
        page += 1


class _Page(InputPartition):
    def __init__(self, first: int, stop: int | None) -> None:
        super().__init__((first, stop))
        self.first, self.stop = first, stop


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.config = SocrataConfig(**json.loads(options["config"]))
        self.template = options["template"]
        self.pages_per_partition = int(options.get("pages_per_partition", "20"))

    def partitions(self) -> list[InputPartition]:
        step, pages = self.pages_per_partition, self.config.max_pages
        if pages is None:
            rows = count_rows(self.template, self.config)
            if rows is None:
                return [_Page(0, None)]
            # the last task goes on to the end: rows may arrive while others read
            pages = max(1, -(-rows // self.config.page_size))
            return [_Page(i, i + step if i + step < pages else None) for i in range(0, pages, step)]
        return [_Page(i, min(i + step, pages)) for i in range(0, pages, step)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        page = partition.first
        while partition.stop is None or page < partition.stop:
            rows = fetch_page(self.template.replace("%24offset=0", f"%24offset={page * self.config.page_size}"), self.config)
            for row in map(normalize_row, rows):
                yield tuple(row[f] for f in FIELDS)
            if len(rows) < self.config.page_size:
                return
            page += 1


class RequestApi(DataSource):
    """``spark.read.format("request_api")`` with options ``config`` and ``template``."""

    @classmethod
    def name(cls) -> str:
        return "request_api"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def load_service_requests_from_socrata(spark: SparkSession, config: SocrataConfig, filters: ServiceRequestFilter | None = None,
                                       mode: str = "strict") -> DataFrame:
    """Requests of the API: predicates go to the server and are checked again here."""
    filters = filters or ServiceRequestFilter()
    spark.dataSource.register(RequestApi)
    raw = (
        spark.read.format("request_api")
        .option("config", json.dumps(asdict(config) | {"extra_where_clauses": list(config.extra_where_clauses)}))
        .option("template", page_url(config, filters, 0))
        .load()
    )
    return validated(normalize_requests(raw), mode).where(filters.condition())
