"""Sinks: CSV tables, request snapshots, GeoJSON and report cards.

Results written as one file are aggregates; snapshots of requests are written in
as many part files as the data has partitions.  Paths may lie on any file system
that Spark knows.
"""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ExportTarget
from ..sources.files import open_text, write_text
from ..sources.requests import EXPORT_COLUMNS


def _path(target: ExportTarget, *formats: str) -> Path | str:
    if target.format not in formats:
        raise ValueError(f"Format {target.format!r} is not supported here; one of {', '.join(formats)}.")
    return target.output_path


def _write_rows(df: DataFrame, path: Path | str, floats: tuple[str, ...] = ()) -> Path | str:
    """One file; ``floats`` with six decimals.

    Python rounds the exact value of a double, as C and SQL do; Java's formatter (Spark's
    ``format_string``) rounds its shortest digits and halves up, so 1/128 would end in 3, not 2.
    """
    six = [name in floats for name in df.columns]
    with open_text(df.sparkSession, path) as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else f"{v:.6f}" if s else v for v, s in zip(row, six, strict=True)])
    return path


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(name).cast("string") if kind == "boolean" else F.col(name) for name, kind in df.dtypes])


def export_topic_table(summaries: DataFrame, target: ExportTarget) -> Path | str:
    """One CSV file, ordered by geography, type and rank; shares with six decimals."""
    df = summaries.orderBy("geography_value", "complaint_type", "topic_rank")
    return _write_rows(_as_text(df), _path(target, "csv"), ("share_of_geography",))


def export_anomalies(anomalies: DataFrame, target: ExportTarget) -> Path | str:
    df = anomalies.orderBy(F.desc(F.abs("z_score")), "geography_value", "complaint_type", "topic_rank")
    return _write_rows(_as_text(df), _path(target, "csv"), ("share_of_geography", "z_score", "anomaly_threshold"))


def export_service_requests_csv(requests: DataFrame, target: ExportTarget, single_file: bool = False) -> Path | str:
    """CSV snapshot with the file column names: a folder of part files written in parallel.

    ``single_file=True`` streams all rows through the driver into one file; for small extracts.
    """
    path = _path(target, "csv")
    df = requests.withColumnRenamed("service_request_id", "unique_key").select(*EXPORT_COLUMNS)
    if single_file:
        return _write_rows(df, path)
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(str(path))
    return path


def export_panel(panel: DataFrame, target: ExportTarget) -> Path | str:
    """A panel as Parquet, its maps and dates typed as they are."""
    path = _path(target, "parquet")
    panel.write.mode("overwrite").parquet(str(path))
    return path


def feature_collection(boundaries: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Features as JSON text, boundaries with their dominant topic if they have one.

    With several complaint types the one with most requests is taken, ties by name.
    """
    ring = lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"]))
    polygons = F.transform("polygons", lambda p: F.transform(p, ring))
    geometry = F.when(F.col("geometry_type") == "Polygon", F.to_json(F.named_struct(F.lit("type"), F.lit("Polygon"), F.lit("coordinates"), polygons[0]))).otherwise(
        F.to_json(F.named_struct(F.lit("type"), F.lit("MultiPolygon"), F.lit("coordinates"), polygons))
    )
    df = boundaries.select("geography", "geography_value", "properties", geometry.alias("geometry"))
    extra = ("complaint_type", "dominant_topic", "topic_count", "geography_total_count", "share_of_geography")
    if summaries is None:
        return df
    order = Window.partitionBy("geography_value").orderBy(F.desc("geography_total_count"), "complaint_type")
    top = summaries.where("is_dominant_topic").withColumn("_k", F.row_number().over(order)).where("_k = 1").select(
        "geography_value", "complaint_type", F.col("topic").alias("dominant_topic"), F.col("complaint_count").alias("topic_count"),
        "geography_total_count", F.round("share_of_geography", 6).alias("share_of_geography"),
    )
    return df.join(top, "geography_value", "left").select(*df.columns, F.struct(*extra).alias("topic"))


def boundaries_to_geojson(boundaries: DataFrame, summaries: DataFrame | None = None) -> dict:
    """A collection as a driver-side object: layers are small."""
    features = []
    for r in feature_collection(boundaries, summaries).orderBy("geography", "geography_value").collect():
        properties = {"geography": r["geography"], "geography_value": r["geography_value"], **(r["properties"] or {})}
        if summaries is not None and r["topic"]["dominant_topic"] is not None:
            properties |= r["topic"].asDict()
        features.append({"type": "Feature", "geometry": json.loads(r["geometry"]), "properties": properties})
    return {"type": "FeatureCollection", "features": features}


def export_geojson(boundaries: DataFrame, summaries: DataFrame, target: ExportTarget) -> Path | str:
    path = _path(target, "geojson")
    write_text(boundaries.sparkSession, path, json.dumps(boundaries_to_geojson(boundaries, summaries), indent=2, sort_keys=True))
    return path


def _top(df: DataFrame, order: list, n: int = 5) -> dict[str, list]:
    w = Window.partitionBy("geography_value").orderBy(*order)
    out: dict[str, list] = {}
    for r in df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).orderBy("geography_value", "_k").collect():
        out.setdefault(r["geography_value"], []).append(r)
    return out


def export_report_card(target: ExportTarget, summaries: DataFrame | None = None, gaps: DataFrame | None = None,
                       anomalies: DataFrame | None = None) -> Path | str:
    """Markdown by geography: at most five dominant topics, gaps and flagged anomalies each."""
    path = _path(target, "md", "markdown")
    topics = _top(summaries.where("is_dominant_topic"), [F.desc("geography_total_count"), "complaint_type"]) if summaries is not None else {}
    rates = _top(gaps, [F.desc("total_request_count"), "complaint_type"]) if gaps is not None else {}
    flags = _top(anomalies.where("is_anomaly"), [F.desc(F.abs("z_score")), "topic_rank", "topic"]) if anomalies is not None else {}
    places: set[str] = set()
    for df in (summaries, gaps, anomalies):
        if df is not None:
            places |= {r[0] for r in df.select("geography_value").distinct().collect()}
    parts = [
        ("Dominant topic", topics, "No topic summaries available.",
         lambda r: f"{r.complaint_type}: {r.topic} ({r.complaint_count}/{r.geography_total_count}, {r.share_of_geography:.1%})"),
        ("Resolution overview", rates, "No resolution gap summaries available.",
         lambda r: f"{r.complaint_type}: resolution rate {r.resolution_rate:.1%}, unresolved {r.unresolved_request_count}/{r.total_request_count}"),
        ("Anomaly flags", flags, "No anomaly flags above the configured threshold.",
         lambda r: f"{r.complaint_type} / {r.topic}: count={r.complaint_count}, z={r.z_score:.2f}"),
    ]
    lines = ["# Report Card", ""]
    for place in sorted(places):
        lines += [f"## {place}", ""]
        for title, rows, none, render in parts:
            lines.append(title)
            lines += [f"- {render(r)}" for r in rows.get(place, [])] or [f"- {none}"]
            lines.append("")
    session = next((df.sparkSession for df in (summaries, gaps, anomalies) if df is not None), None) or SparkSession.active()
    write_text(session, path, "\n".join(lines).rstrip() + "\n")
    return path
