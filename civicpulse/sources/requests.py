"""Service requests from CSV files and pandas frames into the canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ServiceRequestFilter
from ..functions import normalize as N

REQUEST_SCHEMA = T.StructType([
    T.StructField("service_request_id", T.StringType()), T.StructField("created_date", T.DateType()),
    T.StructField("complaint_type", T.StringType()), T.StructField("descriptor", T.StringType()),
    T.StructField("borough", T.StringType()), T.StructField("community_district", T.StringType()),
    T.StructField("resolution_description", T.StringType()), T.StructField("closed_date", T.DateType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
])
REQUIRED_COLUMNS = ("unique_key", "created_date", "complaint_type", "descriptor", "borough")
DISTRICT_COLUMNS = ("community_district", "community_board")
EXPORT_COLUMNS = ("unique_key", "created_date", "complaint_type", "descriptor", "borough", "community_district",
                  "resolution_description", "closed_date", "latitude", "longitude")


def check_columns(columns: list[str]) -> str:
    """Name of the district column; raises for a missing required column."""
    missing = [c for c in REQUIRED_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}.")
    for c in DISTRICT_COLUMNS:
        if c in columns:
            return c
    raise ValueError(f"One of {', '.join(DISTRICT_COLUMNS)} is required.")


def normalize_requests(raw: DataFrame, key: str = "unique_key", district: str = "community_district") -> DataFrame:
    """Canonical columns plus ``_errors``, the list of what is wrong with a row."""

    def optional(name: str) -> Column:
        return F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")

    lat, lon, pair_error = N.coordinate_pair(optional("latitude"), optional("longitude"))
    created, closed_raw = N.iso_date(F.col("created_date").cast("string")), N.optional_text(optional("closed_date"))
    closed = N.iso_date(closed_raw)
    texts = {
        "service_request_id": N.collapse_space(F.col(key).cast("string")),
        "complaint_type": N.collapse_space(F.col("complaint_type")),
        "borough": N.borough(F.col("borough")),
        "community_district": N.community_district(F.col(district)),
    }
    errors = [F.when(F.coalesce(c, F.lit("")) == "", f"{name} must not be empty") for name, c in texts.items()]
    errors += [F.when(created.isNull(), "created_date is not a date"), pair_error]
    errors += [F.when(closed_raw.isNotNull() & closed.isNull(), "closed_date is not a date")]
    extra = [F.col(c) for c in raw.columns if c.startswith("_keep_")]
    return raw.select(
        texts["service_request_id"].alias("service_request_id"), created.alias("created_date"),
        texts["complaint_type"].alias("complaint_type"),
        F.coalesce(N.collapse_space(F.col("descriptor")), F.lit("")).alias("descriptor"),
        texts["borough"].alias("borough"), texts["community_district"].alias("community_district"),
        N.optional_text(optional("resolution_description")).alias("resolution_description"), closed.alias("closed_date"),
        lat.alias("latitude"), lon.alias("longitude"), F.array_compact(F.array(*errors)).alias("_errors"), *extra,
    )


def validated(df: DataFrame, mode: str = "strict") -> DataFrame:
    """``strict``: any bad row fails every job on the result, whatever its columns and filters;
    ``quarantine``: bad rows are left out.

    The strict check is a filter that column pruning cannot drop.  It is not
    deterministic for the optimizer, so later filters stay above it and no bad row
    is filtered away unseen; in ``quarantine`` mode they reach the scan.
    """
    sound = F.size("_errors") == 0
    if mode == "quarantine":
        return df.where(sound).drop("_errors")
    if mode != "strict":
        raise ValueError(f"Unknown mode: {mode!r}.")
    message = F.concat(F.lit("Invalid request row: "), F.array_join("_errors", "; "))
    return df.where(F.when(sound, F.rand(0) >= 0).otherwise(F.raise_error(message).cast("boolean"))).drop("_errors")


def quarantined(df: DataFrame) -> DataFrame:
    return df.where(F.size("_errors") > 0)


def read_raw_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """All columns as text; a header is required and nothing is inferred.

    Files are split among tasks; only files whose quoted values hold line breaks
    need ``multi_line``, which reads a file in one task.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.csv([str(p) for p in paths], header=True, inferSchema=False, multiLine=multi_line, escape='"')


def load_service_requests_from_csv(spark: SparkSession, path: str | list[str], filters: ServiceRequestFilter | None = None,
                                   mode: str = "strict", multi_line: bool = False) -> DataFrame:
    raw = read_raw_csv(spark, path, multi_line)
    df = validated(normalize_requests(raw, district=check_columns(raw.columns)), mode)
    return df.where(filters.condition()) if filters else df


def requests_from_pandas(spark: SparkSession, pdf, mode: str = "strict") -> DataFrame:
    """Requests from a pandas frame with the canonical column names; NaN and NaT become null."""
    missing = [c for c in ("service_request_id", *REQUIRED_COLUMNS[1:], "community_district") if c not in pdf.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}.")
    text = pdf.astype(object).where(pdf.notna(), None)
    rows = [tuple(None if v is None else str(v) for v in row) for row in text.itertuples(index=False)]
    raw = spark.createDataFrame(rows, T.StructType([T.StructField(str(c), T.StringType()) for c in text.columns]))
    return validated(normalize_requests(raw, key="service_request_id"), mode)


def load_resolution_data(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("resolution_description").isNotNull())


def points(requests: DataFrame) -> DataFrame:
    """Requests with both coordinates."""
    return requests.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def in_bbox(requests: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    return requests.where(F.col("longitude").between(min_lon, max_lon) & F.col("latitude").between(min_lat, max_lat))
