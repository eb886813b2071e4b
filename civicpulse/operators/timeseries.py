"""Counts over calendar periods: long, wide, resampled, rolling and heat maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import normalize_frequency, period_end


def period_counts(rows: DataFrame, freq: str, keys: list[str]) -> DataFrame:
    """Counts per period end and key, observed cells only: ``(period, *keys, n)``."""
    return rows.groupBy(period_end(F.col("created_date"), freq).alias("period"), *keys).agg(F.count("*").alias("n"))


def to_timeseries(rows: DataFrame, freq: str = "ME", values: list[str] | None = None, column: str = "complaint_type") -> DataFrame:
    """Wide counts per observed period, a column per value, 0 where a cell is empty.

    Values are looked up with one grouped job unless they are given.
    """
    return _wide(rows, freq, [], column, values)


def to_panel(rows: DataFrame, freq: str = "ME", geography: str = "community_district", values: list[str] | None = None) -> DataFrame:
    return _wide(rows, freq, [geography], "complaint_type", values)


def to_topic_timeseries(assigned: DataFrame, freq: str = "ME", values: list[str] | None = None) -> DataFrame:
    return _wide(assigned, freq, [], "topic", values)


def _wide(rows: DataFrame, freq: str, keys: list[str], column: str, values: list[str] | None) -> DataFrame:
    grouped = rows.groupBy(period_end(F.col("created_date"), freq).alias("period"), *keys)
    out = grouped.pivot(column, values).agg(F.count(F.lit(1)))
    return out.na.fill(0, [c for c in out.columns if c not in ("period", *keys)])


def calendar(bounds: DataFrame, freq: str) -> DataFrame:
    """All period ends between the first and last ``period`` of ``bounds`` (one row of lo, hi)."""
    f = normalize_frequency(freq)
    step = {"D": "interval 1 day", "W": "interval 7 day", "M": "interval 1 month", "Q": "interval 3 month", "Y": "interval 1 year"}[f]
    start = "lo" if f in ("D", "W") else "trunc(lo, 'month')"
    end = "hi" if f in ("D", "W") else "trunc(hi, 'month')"
    days = bounds.select(F.explode(F.expr(f"sequence({start}, {end}, {step})")).alias("d"))
    return days.select((F.col("d") if f in ("D", "W") else F.last_day("d")).alias("period"))


def resample_and_fill(series: DataFrame, freq: str, value: str = "n", method: str = "zero", date: str = "period") -> DataFrame:
    """Sums per calendar period, every period between the first and the last.

    ``zero``: an empty period is 0, which is also what sums of nothing are for
    ``ffill`` and ``bfill`` of the classic resampling; ``carry_forward`` and
    ``carry_back`` take the neighbour's value instead.
    """
    sums = series.groupBy(period_end(F.col(date), freq).alias("period")).agg(F.sum(value).alias(value))
    bounds = sums.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).where("lo is not null")
    out = calendar(bounds, freq).join(sums, "period", "left")
    if method in ("zero", "ffill", "bfill"):
        return out.na.fill(0, [value])
    # one row per calendar period: a small series by construction
    order = Window.orderBy("period")
    if method == "carry_forward":
        return out.withColumn(value, F.last(value, ignorenulls=True).over(order))
    if method == "carry_back":
        return out.withColumn(value, F.first(value, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    raise ValueError(f"Unknown fill method: {method!r}.")


def rolling_mean(series: DataFrame, keys: list[str], order: str, value: str, rows: int = 7) -> DataFrame:
    """Mean of the last ``rows`` rows, fewer at the begin."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return series.withColumn(f"rolling_{value}", F.avg(value).over(w))


def heatmap(rows: DataFrame, timestamp: str) -> DataFrame:
    """Dense 7 x 24 grid of counts by weekday (0 is Monday) and hour."""
    counts = rows.groupBy(F.weekday(timestamp).cast("long").alias("weekday"), F.hour(timestamp).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(168).select(F.floor(F.col("id") / 24).alias("weekday"), (F.col("id") % 24).alias("hour"))
    return grid.join(F.broadcast(counts), ["weekday", "hour"], "left").na.fill(0, ["n"])  # at most 168 rows


def top_categories(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def period_shares(rows: DataFrame, freq: str, column: str) -> DataFrame:
    """Share of each value within its period."""
    counts = period_counts(rows, freq, [column])
    total = F.sum("n").over(Window.partitionBy("period"))
    return counts.withColumn("share", F.col("n") / total)
