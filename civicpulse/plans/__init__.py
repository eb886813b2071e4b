"""Whole plans: from a source to one sink in a single lazy plan."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import sinks
from ..config import ExportTarget, ServiceRequestFilter, SocrataConfig, TopicQuery
from ..operators.aggregate import aggregate_by_geography
from ..operators.topics import extract_topics
from ..sources.boundaries import load_boundaries
from ..sources.cache import load_service_requests


def topic_summaries(spark: SparkSession, source: str | SocrataConfig, complaint_type: str, geography: str = "community_district",
                    filters: ServiceRequestFilter | None = None, top_n: int = 20, custom_rules=None) -> DataFrame:
    """Filter, topics, counts, shares and ranks."""
    filters = replace(filters or ServiceRequestFilter(), complaint_types=(complaint_type,))
    requests = load_service_requests(spark, source, filters)
    return aggregate_by_geography(extract_topics(requests, TopicQuery(complaint_type, top_n), custom_rules), geography)


def run_topic_pipeline(spark: SparkSession, source: str | SocrataConfig, complaint_type: str, target: ExportTarget,
                       geography: str = "community_district", filters: ServiceRequestFilter | None = None, top_n: int = 20,
                       boundaries: str | None = None, custom_rules=None) -> Path:
    """Summaries to a CSV table or, with boundaries, to GeoJSON."""
    if target.format == "geojson" and boundaries is None:
        raise ValueError("GeoJSON exports need boundaries.")
    summaries = topic_summaries(spark, source, complaint_type, geography, filters, top_n, custom_rules)
    if target.format == "geojson":
        return sinks.export_geojson(load_boundaries(spark, boundaries), summaries, target)
    return sinks.export_topic_table(summaries, target)


def fetch_service_requests(spark: SparkSession, source: str | SocrataConfig, filters: ServiceRequestFilter | None = None,
                           target: ExportTarget | None = None, single_file: bool = True) -> DataFrame:
    """Requests of a source, also written as a CSV snapshot if a target is given.

    A plan's extract is one file, as its users open it; ``single_file=False`` writes part files.
    """
    requests = load_service_requests(spark, source, filters)
    if target is not None:
        sinks.export_service_requests_csv(requests, target, single_file)
    return requests
