"""Counts, shares and ranks by geography; resolution gaps; anomalies; reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AnalysisWindow, geography_column


def aggregate_by_geography(assigned: DataFrame, geography: str) -> DataFrame:
    """Topic counts by (geography value, complaint type) with totals, shares and ranks.

    The windows run on grouped counts and share one partitioning, so the input is
    shuffled once, pre-aggregated.
    """
    counts = assigned.groupBy(geography_column(geography).alias("geography_value"), "complaint_type", "topic").agg(
        F.count("*").alias("complaint_count")
    )
    group = Window.partitionBy("geography_value", "complaint_type")
    total = F.sum("complaint_count").over(group)
    rank = F.row_number().over(group.orderBy(F.desc("complaint_count"), "topic"))
    out = counts.withColumns({"geography_total_count": total, "topic_rank": rank.cast("long")})
    return out.select(
        F.lit(geography).alias("geography"), "geography_value", "complaint_type", "topic", "complaint_count", "geography_total_count",
        (F.col("complaint_count") / F.col("geography_total_count")).alias("share_of_geography"), "topic_rank",
        (F.col("topic_rank") == 1).alias("is_dominant_topic"),
    )


def analyze_resolution_gaps(requests: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Resolved and unresolved requests by (borough, type).

    A request is resolved if it has a description of its own or its id is among
    the ``resolved`` requests that have one.
    """
    rows = requests.withColumn("_own", F.col("resolution_description").isNotNull())
    if resolved is not None:
        ids = resolved.where(F.col("resolution_description").isNotNull()).select(F.col("service_request_id").alias("_id")).distinct()
        rows = rows.join(ids.withColumn("_also", F.lit(True)), F.col("service_request_id") == F.col("_id"), "left")
        rows = rows.withColumn("_own", F.col("_own") | F.coalesce("_also", F.lit(False)))
    out = rows.groupBy(F.col("borough").alias("geography_value"), "complaint_type").agg(
        F.count("*").alias("total_request_count"), F.sum(F.col("_own").cast("long")).alias("resolved_request_count")
    )
    unresolved = F.col("total_request_count") - F.col("resolved_request_count")
    return out.select(
        F.lit("borough").alias("geography"), "geography_value", "complaint_type", "total_request_count", "resolved_request_count",
        unresolved.alias("unresolved_request_count"), (unresolved / F.col("total_request_count")).alias("unresolved_share"),
        (F.col("resolved_request_count") / F.col("total_request_count")).alias("resolution_rate"),
    )


def order_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(F.desc("unresolved_share"), F.desc("total_request_count"), "geography_value", "complaint_type")


def detect_anomalies(summaries: DataFrame, window: AnalysisWindow, z_threshold: float = 2.0) -> DataFrame:
    """Population z-scores of topic counts within (geography, complaint type).

    The window's days are a label; a group of one or without spread scores 0.
    """
    if z_threshold <= 0:
        raise ValueError("z_threshold must be positive.")
    group = Window.partitionBy("geography", "complaint_type")
    # moments of whole numbers, summed exactly: equal counts have a spread of exactly 0
    n, s1 = F.count("*").over(group), F.sum("complaint_count").over(group)
    s2 = F.sum((F.col("complaint_count") * F.col("complaint_count")).cast("decimal(38,0)")).over(group)
    out = summaries.withColumns({"_n": n, "_s1": s1, "_s2": s2})
    spread = (F.col("_n") * F.col("_s2") - (F.col("_s1") * F.col("_s1")).cast("decimal(38,0)")).cast("double")
    z = (F.col("complaint_count") * F.col("_n") - F.col("_s1")) / F.sqrt(spread)
    out = out.withColumn("z_score", F.when(spread > 0, z).otherwise(0.0))
    return out.select(
        *summaries.columns[:8], "z_score", (F.abs("z_score") >= z_threshold).alias("is_anomaly"),
        F.lit(window.days).cast("long").alias("window_days"), F.lit(float(z_threshold)).alias("anomaly_threshold"),
    )


def top_counts(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent combinations of ``keys``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def dominant_topics(summaries: DataFrame) -> DataFrame:
    return summaries.where("is_dominant_topic")


def resolution_rates(requests: DataFrame, geography: str, min_count: int = 1) -> DataFrame:
    """Share of resolved requests per geography value with at least ``min_count`` requests."""
    out = requests.groupBy(geography_column(geography).alias("geography_value")).agg(
        F.count("*").alias("n"), F.avg(F.col("resolution_description").isNotNull().cast("double")).alias("resolution_rate")
    )
    return out.where(F.col("n") >= min_count)


def catalogue(requests: DataFrame, geography: str = "borough") -> DataFrame:
    """Rows, types, date span and filled coordinates per geography value in one pass."""
    return requests.groupBy(geography_column(geography).alias("geography_value")).agg(
        F.count("*").alias("n"), F.countDistinct("complaint_type").alias("n_types"), F.min("created_date").alias("first_date"),
        F.max("created_date").alias("last_date"), F.count("latitude").alias("n_latitude"),
        F.count("resolution_description").alias("n_resolved"),
    )


def half_change(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Mean of the first and second half of each key's series and the change in percent."""
    w = Window.partitionBy(key).orderBy(order)
    rows = series.withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(key))})
    first = F.col("_k") <= F.floor(F.col("_n") / 2)
    out = rows.groupBy(key).agg(F.avg(F.when(first, F.col(value))).alias("first_mean"), F.avg(F.when(~first, F.col(value))).alias("second_mean"))
    return out.withColumn("change_pct", F.when(F.col("first_mean") != 0, 100 * (F.col("second_mean") - F.col("first_mean")) / F.col("first_mean")))
