"""Command line: ``topics`` and ``fetch``."""

from __future__ import annotations

import argparse
from datetime import date

from .config import ExportTarget, GeographyFilter, ServiceRequestFilter, SocrataConfig

_DEFAULT = SocrataConfig()


def _filters(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--start-date", type=date.fromisoformat)
    parser.add_argument("--end-date", type=date.fromisoformat)
    parser.add_argument("--geography", choices=("borough", "community_district"), default="community_district")
    parser.add_argument("--geography-value")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="civicpulse")
    commands = parser.add_subparsers(dest="command", required=True)
    topics = commands.add_parser("topics", help="Summarise topics of a request file.")
    topics.add_argument("--source", required=True)
    topics.add_argument("--output", required=True)
    topics.add_argument("--complaint-type", required=True)
    topics.add_argument("--top-n", type=int, default=20)
    topics.add_argument("--format", choices=("csv", "geojson"), default="csv")
    topics.add_argument("--boundaries")
    _filters(topics)
    fetch = commands.add_parser("fetch", help="Write a filtered slice of the API as CSV.")
    fetch.add_argument("--output", required=True)
    fetch.add_argument("--complaint-type", action="append", default=[])
    fetch.add_argument("--dataset-identifier", default=_DEFAULT.dataset_identifier)
    fetch.add_argument("--base-url", default=_DEFAULT.base_url)
    fetch.add_argument("--app-token")
    fetch.add_argument("--page-size", type=int, default=_DEFAULT.page_size)
    fetch.add_argument("--max-pages", type=int)
    fetch.add_argument("--request-timeout-seconds", type=float, default=_DEFAULT.request_timeout_seconds)
    fetch.add_argument("--where", action="append", default=[])
    _filters(fetch)
    return parser


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession

    from . import plans

    args = build_parser().parse_args(argv)
    place = GeographyFilter(args.geography, args.geography_value) if args.geography_value else None
    types = (args.complaint_type,) if isinstance(args.complaint_type, str) else tuple(args.complaint_type)
    filters = ServiceRequestFilter(args.start_date, args.end_date, place, types)
    spark = spark or SparkSession.builder.appName("civicpulse").getOrCreate()
    if args.command == "topics":
        plans.run_topic_pipeline(spark, args.source, args.complaint_type, ExportTarget(args.format, args.output), args.geography,
                                 filters, args.top_n, args.boundaries)
    else:
        config = SocrataConfig(args.dataset_identifier, args.base_url, args.app_token, args.page_size, args.request_timeout_seconds,
                               args.max_pages, extra_where_clauses=tuple(args.where))
        plans.fetch_service_requests(spark, config, filters, ExportTarget("csv", args.output))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
