"""Balanced unit-by-period panels and their selections."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import geography_column
from ..functions.periods import normalize_frequency, period_end, period_label, period_start


@dataclass(frozen=True, slots=True)
class TreatmentEvent:
    name: str
    treated_units: tuple[str, ...]
    treatment_date: date

    def __post_init__(self) -> None:
        if not self.name.strip() or not self.treated_units:
            raise ValueError("A treatment event needs a name and treated units.")


def treatment_dates(spark, events: list[TreatmentEvent]) -> DataFrame:
    """Earliest treatment date per unit: driver-given, hence small."""
    rows = [(u, e.treatment_date) for e in events for u in e.treated_units]
    return spark.createDataFrame(rows, "unit_id string, treatment_date date").groupBy("unit_id").agg(F.min("treatment_date").alias("treatment_date"))


def complaint_cells(requests: DataFrame, geography: str, freq: str) -> DataFrame:
    """One row per observed cell.

    Requests are counted once by cell, type and days to the period's end; counts,
    rates, weighted medians and type maps all come from that small table, whose
    one exchange the branches reuse.
    """
    unit, day = geography_column(geography), F.col("created_date")
    f = normalize_frequency(freq)
    days = F.when(F.col("resolution_description").isNotNull(), F.greatest(F.datediff(period_end(day, f), day), F.lit(0)))
    keys = [unit.alias("unit_id"), period_label(day, f).alias("period"), period_start(day, f).alias("period_start")]
    counts = requests.groupBy(*keys, "complaint_type", days.alias("days")).agg(F.count("*").alias("n"))
    by_type = counts.groupBy("unit_id", "period", "complaint_type").agg(F.sum("n").alias("n"))
    types = by_type.groupBy("unit_id", "period").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("complaint_type", "n")))).alias("complaint_counts_by_type"))
    cells = counts.groupBy("unit_id", "period", "period_start").agg(
        F.sum("n").alias("complaint_count"),
        (F.coalesce(F.sum(F.when(F.col("days").isNotNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("resolution_rate"),
        F.percentile("days", F.lit(0.5), F.col("n")).alias("median_resolution_days"),
    )
    return cells.join(types, ["unit_id", "period"])


def build_complaint_panel(requests: DataFrame, geography: str = "community_district", freq: str = "ME",
                          events: list[TreatmentEvent] | None = None, population: DataFrame | None = None,
                          covariates: DataFrame | None = None) -> DataFrame:
    """Every observed unit in every observed period; empty cells count 0.

    Units and periods are small dimensions taken from the cells; their product is
    the panel itself.  ``population(unit_id, population)`` and ``covariates(unit_id,
    covariates map)`` are looked up per unit.
    """
    cells = complaint_cells(requests, geography, freq)
    observed = cells.select("unit_id", "period", "period_start")
    grid = observed.select("unit_id").distinct().crossJoin(F.broadcast(observed.select("period", "period_start").distinct()))
    out = grid.join(cells.drop("period_start"), ["unit_id", "period"], "left")
    out = out.withColumns({
        "complaint_count": F.coalesce("complaint_count", F.lit(0)).cast("long"),
        "resolution_rate": F.coalesce("resolution_rate", F.lit(0.0)),
        "complaint_counts_by_type": F.coalesce("complaint_counts_by_type", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))),
    })
    if events:
        out = out.join(F.broadcast(treatment_dates(requests.sparkSession, events)), "unit_id", "left")
    else:
        out = out.withColumn("treatment_date", F.lit(None).cast("date"))
    out = out.withColumn("treatment", F.coalesce(F.col("period_start") >= F.col("treatment_date"), F.lit(False)))
    for frame, column, kind in ((population, "population", "long"), (covariates, "covariates", "map<string,double>")):
        out = out.join(frame.select("unit_id", column), "unit_id", "left") if frame is not None else out.withColumn(column, F.lit(None).cast(kind))
    return out.drop("period_start")


def treatment_group(panel: DataFrame) -> DataFrame:
    return panel.join(panel.where("treatment").select("unit_id").distinct(), "unit_id", "left_semi")


def control_group(panel: DataFrame) -> DataFrame:
    return panel.join(panel.where("treatment").select("unit_id").distinct(), "unit_id", "left_anti")


def filter_periods(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range of labels."""
    if start is not None:
        panel = panel.where(F.col("period") >= start)
    return panel.where(F.col("period") <= end) if end is not None else panel


def unit_ids(panel: DataFrame) -> DataFrame:
    return panel.select("unit_id").distinct().orderBy("unit_id")


def panel_wide(panel: DataFrame, types: list[str]) -> DataFrame:
    """``complaints_<type>`` columns, null where a cell has none of the type."""
    return panel.select("*", *[F.element_at("complaint_counts_by_type", F.lit(t)).alias(f"complaints_{t}") for t in types]).drop("complaint_counts_by_type")


def estimation_frame(panel: DataFrame, outcome: str) -> DataFrame:
    """Tidy columns for an estimator: unit, period, outcome, treatment as 0/1."""
    if outcome not in panel.columns:
        raise ValueError(f"Panel has no column {outcome!r}.")
    return panel.select("unit_id", "period", F.col(outcome).cast("double").alias("outcome"), F.col("treatment").cast("int").alias("treatment"), "treatment_date")


def cross_section(panel: DataFrame, columns: list[str], period: str | None = None) -> DataFrame:
    """One period, or each unit's means; units with a null are left out."""
    if period is not None:
        out = panel.where(F.col("period") == period).select("unit_id", *[F.col(c).cast("double").alias(c) for c in columns])
    else:
        out = panel.groupBy("unit_id").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    return out.dropna(subset=columns)


def with_demographics(panel: DataFrame, demographics: DataFrame, key: str = "unit_id") -> DataFrame:
    """The panel's rows of the units that ``demographics`` knows, with its columns in place of the panel's own."""
    own = [c for c in panel.columns if c == key or c not in demographics.columns]
    return panel.select(*own).join(demographics, key)


def regroup_panel(panel: DataFrame, by_period: bool = True) -> DataFrame:
    """Sums by borough (the unit label without its last word) and period."""
    borough = F.regexp_replace("unit_id", " [^ ]+$", "").alias("borough")
    keys = [borough, "period"] if by_period else [borough]
    return panel.groupBy(*keys).agg(F.sum("complaint_count").alias("complaint_count"))


def split_at_median(units: DataFrame, column: str) -> DataFrame:
    """Adds ``upper``: at or above the median of ``column``; rows without it are left out."""
    rows = units.where(F.col(column).isNotNull())
    middle = rows.agg(F.percentile(column, F.lit(0.5)).alias("_median"))  # one row
    return rows.join(F.broadcast(middle)).withColumn("upper", F.col(column) >= F.col("_median")).drop("_median")


def equity_ratios(panel: DataFrame, top: int = 5) -> DataFrame:
    """Units with the largest median of cell medians relative to the median over all cells."""
    value = F.col("median_resolution_days")
    overall = panel.agg(F.percentile(value, F.lit(0.5)).alias("_all"))  # one row
    units = panel.groupBy("unit_id").agg(F.percentile(value, F.lit(0.5)).alias("median_days")).where("median_days is not null")
    out = units.join(F.broadcast(overall)).select("unit_id", "median_days", (F.col("median_days") / F.col("_all")).alias("equity_ratio"))
    return out.orderBy(F.desc("equity_ratio"), "unit_id").limit(top)


def month_means(series: DataFrame, period: str, value: str) -> DataFrame:
    """Mean by month number of labels ``yyyy-MM``."""
    return series.groupBy(F.substring(period, 6, 2).cast("int").alias("month")).agg(F.avg(value).alias("mean"))


def outcome_variance(panel: DataFrame, column: str) -> DataFrame:
    """Sample variance of an outcome and the mean of its ``log1p``."""
    return panel.agg(F.var_samp(column).alias("variance"), F.avg(F.log1p(column)).alias("mean_log1p"))
