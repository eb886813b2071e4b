"""Snapshots of fetched requests: Parquet with a sidecar, and dispatch by source."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GeographyFilter, ServiceRequestFilter, SocrataConfig, is_address
from ..functions.constants import BOROUGHS
from .files import exists, folder_sha256, write_text
from .requests import REQUEST_SCHEMA, load_service_requests_from_csv
from .socrata import load_service_requests_from_socrata


def _jsonable(value) -> str:
    return json.dumps(value, default=str, sort_keys=True)


def slug(value: str) -> str:
    """Readable part of a folder name: lower case, other characters than letters and digits as ``_``."""
    return "".join(c if c.isalnum() else "_" for c in value.lower())[:40]


def cache_path(config: SocrataConfig, filters: ServiceRequestFilter, cache_dir: str | Path, max_records: int | None = None) -> Path | str:
    """Deterministic folder: a readable part and a hash of everything that changes the rows."""
    shape = asdict(config) | {"app_token": None}
    key = hashlib.sha256(_jsonable([shape, asdict(filters), max_records]).encode()).hexdigest()[:16]
    place = filters.geography.value if filters.geography else "all"
    name = f"{slug(place)}_{filters.start_date or 'none'}_{filters.end_date or 'none'}_{key}.parquet"
    return f"{str(cache_dir).rstrip('/')}/{name}" if is_address(cache_dir) else Path(cache_dir) / name


def meta_path(path: Path | str) -> Path | str:
    """The sidecar beside a snapshot."""
    return path.removesuffix(".parquet") + ".meta.json" if isinstance(path, str) else path.with_suffix(".meta.json")


def cached_fetch(spark: SparkSession, config: SocrataConfig, filters: ServiceRequestFilter, cache_dir: str | Path,
                 refresh: bool = False, max_records: int | None = None, on_page: Callable[[int, int], None] | None = None) -> DataFrame:
    """Rows of the snapshot, fetched only where it is absent or to be refreshed.

    The folder may lie on any file system that Spark knows.  The commit protocol of the
    writer publishes all rows or none; a folder without ``_SUCCESS`` counts as absent.
    The sidecar holds the number of rows, a SHA-256 over the data files, an order-free hash
    of the rows and the filters.  ``on_page(index, rows)`` is told the pages once they are stored.
    """
    path = cache_path(config, filters, cache_dir, max_records)
    if refresh or not exists(spark, f"{path}/_SUCCESS"):
        rows = load_service_requests_from_socrata(spark, config, filters)
        if max_records is not None:
            rows = rows.limit(max_records)
        rows.write.mode("overwrite").parquet(str(path))
        written = spark.read.schema(REQUEST_SCHEMA).parquet(str(path))
        counted = written.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*REQUEST_SCHEMA.names).cast("decimal(38,0)")).alias("h")).first()
        borough = filters.geography.value if filters.geography and filters.geography.geography == "borough" else None
        meta = {"record_count": counted["n"], "sha256": folder_sha256(spark, path), "content_hash": str(counted["h"]),
                "fetched_at": datetime.now(UTC).isoformat(), "start_date": filters.start_date, "end_date": filters.end_date, "borough": borough,
                "complaint_types": list(filters.complaint_types), "page_size": config.page_size,
                "filters": json.loads(_jsonable(asdict(filters)))}
        write_text(spark, meta_path(path), json.dumps(meta, indent=2, sort_keys=True, default=str) + "\n")
        if on_page is not None:
            for page, first in enumerate(range(0, counted["n"], config.page_size)):
                on_page(page, min(config.page_size, counted["n"] - first))
    return spark.read.schema(REQUEST_SCHEMA).parquet(str(path))


def load_service_requests(spark: SparkSession, source: str | Path | SocrataConfig, filters: ServiceRequestFilter | None = None,
                          cache_dir: str | Path | None = None, refresh: bool = False, max_cached_records: int | None = None) -> DataFrame:
    """Dispatch: an API configuration (cached if a folder is given), a Parquet snapshot or CSV."""
    filters = filters or ServiceRequestFilter()
    if isinstance(source, SocrataConfig):
        if cache_dir is None:
            return load_service_requests_from_socrata(spark, source, filters)
        return cached_fetch(spark, source, filters, cache_dir, refresh, max_cached_records)
    if str(source).rstrip("/").endswith(".parquet"):
        return spark.read.parquet(str(source)).where(filters.condition())
    return load_service_requests_from_csv(spark, str(source), filters)


def bulk_fetch(spark: SparkSession, config: SocrataConfig, cache_dir: str | Path, filters: ServiceRequestFilter | None = None,
               boroughs: tuple[str, ...] = BOROUGHS, refresh: bool = False,
               on_progress: Callable[[str, int, int], None] | None = None) -> DataFrame:
    """One snapshot per borough, read back as one frame; boroughs whose snapshot is there are not fetched.

    ``on_progress(borough, page, rows)`` is called for every page of a fetched borough.
    """
    filters = filters or ServiceRequestFilter()

    def one(borough: str) -> DataFrame:
        place = ServiceRequestFilter(filters.start_date, filters.end_date, GeographyFilter("borough", borough), filters.complaint_types)
        told = (lambda page, rows: on_progress(borough, page, rows)) if on_progress else None
        return cached_fetch(spark, config, place, cache_dir, refresh, on_page=told)

    return reduce(DataFrame.unionByName, map(one, boroughs))
