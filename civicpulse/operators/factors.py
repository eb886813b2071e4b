"""Per-area factors: all of a pipeline run in one aggregation.

A factor is a set of aggregate Columns over the requests of a context and an
expression on their results.  The requests of all contexts are read and shuffled
once, counted by every column that the pipeline's factors need; factors over days,
types or places read that table of counts (Spark reuses its shuffle).  A factor of
one's own without ``pre`` aggregates the requests themselves, a second reading.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

#: columns of a context besides its key
WINDOW = ("window_start", "window_end", "population")


@dataclass(frozen=True)
class Factor:
    """``partial`` aggregates requests; ``result`` combines them and the context's columns."""

    name: str
    result: Callable[[], Column]
    partial: Callable[[], tuple[Column, ...]] = tuple
    pre: str | None = None  # "day", "type" or "place": aggregate counts (n) of that grouping instead


def _days() -> Column:
    return F.when(F.col("_solved"), F.greatest(F.datediff("window_end", "created_date"), F.lit(0)))


def _median_days() -> Column:
    return F.percentile(_days(), F.lit(0.5), F.col("n"))


def _mean_days() -> Column:
    return F.sum(_days() * F.col("n")) / F.sum(F.when(F.col("_solved"), F.col("n")))


def complaint_volume(per_capita: bool = False, strict: bool = False) -> Factor:
    """Count, or count per 10 000 people; without a population the raw count (null if strict)."""

    def result() -> Column:
        n = F.col("_n").cast("double")
        if not per_capita:
            return n
        return F.when(F.col("population") > 0, n / F.col("population") * 10_000).otherwise(F.lit(None) if strict else n)

    return Factor("complaint_volume", result)


def resolution_time(method: str = "median") -> Factor:
    """Days from creation to the end of the window over resolved requests; -1 without any."""
    if method not in ("median", "mean"):
        raise ValueError(f"Unknown method: {method!r}.")
    agg = _median_days if method == "median" else _mean_days
    return Factor("resolution_time", lambda: F.coalesce("_days", F.lit(-1.0)), lambda: (agg().alias("_days"),), "day")


def topic_concentration() -> Factor:
    """Herfindahl index of complaint types."""
    squares = lambda: (F.sum((F.col("n") * F.col("n")).cast("double")).alias("_sq_type"),)
    return Factor("topic_concentration", lambda: F.coalesce(F.col("_sq_type") / (F.col("_n") * F.col("_n")), F.lit(0.0)), squares, "type")


def seasonality(baseline: dict[int, float]) -> Factor:
    """Relative excess over the expected count of the window's first month."""

    def result() -> Column:
        table = F.create_map(*[F.lit(x) for m, v in baseline.items() for x in (int(m), float(v))])
        expected = F.element_at(table, F.month("window_start"))
        return F.when(expected > 0, (F.col("_n") - expected) / expected).otherwise(0.0)

    return Factor("seasonality", result)


def anomaly_score(mean: float, std: float) -> Factor:
    return Factor("anomaly_score", lambda: (F.col("_n") - mean) / std if std else F.lit(0.0))


def response_rate() -> Factor:
    rate = lambda: (F.sum(F.when(F.col("_solved"), F.col("n")).otherwise(0)) / F.sum("n")).alias("_rate")
    return Factor("response_rate", lambda: F.coalesce("_rate", F.lit(0.0)), lambda: (rate(),), "day")


def recurrence() -> Factor:
    """Share of distinct places (four decimals) with more than one request."""
    again = lambda: (F.avg((F.col("n") > 1).cast("double")).alias("_again"),)
    return Factor("recurrence", lambda: F.coalesce("_again", F.lit(0.0)), again, "place")


def equity_gap(citywide_median_days: float) -> Factor:
    """Median days of the context over the city's; 0 where either is missing."""

    def result() -> Column:
        return F.coalesce(F.col("_gap_days") / citywide_median_days, F.lit(0.0)) if citywide_median_days > 0 else F.lit(0.0)

    return Factor("equity_gap", result, lambda: (_median_days().alias("_gap_days"),), "day")


def spatial_lag(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of neighbours' values per unit; a missing value and no neighbour count 0.

    ``values(unit_id, value)``, ``weights(unit_a, unit_b, w)``.
    """
    lag = weights.join(values.withColumnRenamed("unit_id", "unit_b"), "unit_b", "left").groupBy(F.col("unit_a").alias("unit_id")).agg(
        F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("spatial_lag")
    )
    return values.select("unit_id").join(lag, "unit_id", "left").na.fill(0.0, ["spatial_lag"])


@dataclass(frozen=True)
class Pipeline:
    """Immutable list of factors."""

    factors: tuple[Factor, ...] = ()

    def add(self, factor: Factor) -> Pipeline:
        if factor.name in {f.name for f in self.factors}:
            raise ValueError(f"Factor {factor.name!r} is there already.")
        return Pipeline((*self.factors, factor))

    def run(self, requests: DataFrame, contexts: DataFrame, geography: str) -> DataFrame:
        """One row per context ``(geography_id, window_start, window_end, population)``, one column per factor.

        Requests are matched to contexts by geography and date; contexts are
        small and every context comes back, also an empty one and one that is given twice.
        """
        if not self.factors:
            raise ValueError("A pipeline needs a factor.")
        keys = ["geography_id", *WINDOW]
        inside = F.col("created_date").between(F.col("window_start"), F.col("window_end"))
        rows = requests.join(contexts.select(*keys).distinct(), (F.col(geography) == F.col("geography_id")) & inside)

        def attach(found: DataFrame, part: DataFrame) -> DataFrame:
            part = part.withColumnsRenamed({k: f"_k_{k}" for k in keys})
            same = N.all_of([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
            return found.join(part, same, "left").drop(*[f"_k_{k}" for k in keys])

        columns = {
            "day": {"created_date": F.col("created_date"), "_solved": F.col("resolution_description").isNotNull()},
            "type": {"complaint_type": F.col("complaint_type")},
            "place": {"_lat": F.round("latitude", 4), "_lon": F.round("longitude", 4)},
        }
        wanted = {pre: [c for f in self.factors if f.pre == pre for c in f.partial()] for pre in (None, *columns)}
        by = {name: c for pre, own in columns.items() if wanted[pre] for name, c in own.items()}
        counts = rows.select(*keys, *[c.alias(n) for n, c in by.items()]).groupBy(*keys, *by).agg(F.count("*").alias("n"))
        found = attach(contexts.select(*keys), counts.groupBy(*keys).agg(F.sum("n").alias("_n"), *wanted["day"]))
        for pre in ("type", "place"):
            if wanted[pre]:
                own = counts.where("_lat is not null and _lon is not null") if pre == "place" else counts
                found = attach(found, own.groupBy(*keys, *columns[pre]).agg(F.sum("n").alias("n")).groupBy(*keys).agg(*wanted[pre]))
        if wanted[None]:
            found = attach(found, rows.groupBy(*keys).agg(*wanted[None]))
        found = found.na.fill(0, ["_n"])
        return found.select(*keys, *[f.result().alias(f.name) for f in self.factors])


def run_pandas_factor(requests: DataFrame, contexts: DataFrame, geography: str, name: str, compute) -> DataFrame:
    """Escape hatch for factors that no aggregate expresses: ``compute(pandas frame) -> float``.

    One task holds the requests of a context at a time; prefer a :class:`Factor`
    wherever its value can be aggregated.  Contexts without requests are absent.
    """
    import pandas as pd

    keys = ["geography_id", "window_start", "window_end"]
    inside = F.col("created_date").between(F.col("window_start"), F.col("window_end"))
    rows = requests.join(contexts, (F.col(geography) == F.col("geography_id")) & inside).select(*keys, *requests.columns)

    def apply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, float(compute(pdf)))], columns=[*keys, name])

    return rows.groupBy(*keys).applyInPandas(apply, f"geography_id string, window_start date, window_end date, {name} double")
