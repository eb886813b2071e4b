"""Small built-in samples, made by rule: requests over four districts and their rectangles."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..functions.constants import TOPIC_RULES
from .boundaries import BOUNDARY_SCHEMA
from .requests import REQUEST_SCHEMA

#: district, borough, west, south, width, height
DISTRICTS = (
    ("BROOKLYN 01", "BROOKLYN", -73.97, 40.70, 0.03, 0.03),
    ("BRONX 05", "BRONX", -73.92, 40.84, 0.03, 0.03),
    ("MANHATTAN 10", "MANHATTAN", -73.96, 40.79, 0.02, 0.03),
    ("QUEENS 02", "QUEENS", -73.94, 40.73, 0.04, 0.03),
)
SIZE = 72


def load_sample_service_requests(spark: SparkSession) -> DataFrame:
    """``SIZE`` requests that go round the districts, topics and half a year."""
    topics = [(kind, keywords[0]) for kind, rules in TOPIC_RULES.items() for _, keywords in rules]
    rows = []
    for i in range(SIZE):
        kind, word = topics[i % len(topics)]
        district, borough, west, south, width, height = DISTRICTS[i % len(DISTRICTS)]
        created = date(2025, 1, 1) + timedelta(days=5 * i % 180)
        solved = i % 3 != 0
        rows.append((str(1000 + i), created, kind, f"Report of {word}", borough, district, "Closed" if solved else None,
                     created + timedelta(days=i % 14) if solved else None, south + height * (i % 7 + 1) / 9, west + width * (i % 5 + 1) / 7))
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def load_sample_boundaries(spark: SparkSession) -> DataFrame:
    rows = []
    for district, borough, x, y, w, h in DISTRICTS:
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        rows.append(("community_district", district, {"borough": borough, "name": district.title()}, "Polygon", [[ring]]))
    return spark.createDataFrame(rows, BOUNDARY_SCHEMA)
