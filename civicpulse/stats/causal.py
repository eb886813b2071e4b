"""Difference in differences, event studies, synthetic control and power."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dist import NORMAL, f_sf, normal_p
from .regression import small_panel


def _cohorts(panel: DataFrame) -> DataFrame:
    """Panel with ``cohort``: the month label of the treatment date, null for never treated."""
    return panel.withColumn("cohort", F.date_format("treatment_date", "yyyy-MM"))


def check_monthly(panel: DataFrame) -> None:
    if panel.where(~F.col("period").rlike("^[0-9]{4}-[0-9]{2}$")).limit(1).count():
        raise ValueError("Group-time effects compare month labels; build the panel with freq='M'.")


def group_time_effects(panel: DataFrame, outcome: str) -> DataFrame:
    """Mean of a cohort minus mean of the never treated per period, with error and p-value."""
    y = F.col(outcome).cast("double")
    cells = _cohorts(panel).groupBy("cohort", "period").agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v")).where("n > 0")
    control = cells.where("cohort is null").select("period", F.col("n").alias("nc"), F.col("m").alias("mc"), F.col("v").alias("vc"))
    out = cells.where("cohort is not null").join(control, "period")
    se = F.sqrt(F.coalesce(F.col("v"), F.lit(0.0)) / F.col("n") + F.coalesce(F.col("vc"), F.lit(0.0)) / F.col("nc"))
    return out.select(F.col("cohort").alias("group"), "period", (F.col("m") - F.col("mc")).alias("att"), F.greatest(se, F.lit(1e-10)).alias("se"))


def staggered_did(panel: DataFrame, outcome: str) -> dict:
    """Group-time effects and their inverse-variance pool over all periods."""
    cells = group_time_effects(panel, outcome)
    w = 1 / F.greatest(F.col("se") * F.col("se"), F.lit(1e-20))
    r = cells.agg(F.sum(w).alias("w"), F.sum(w * F.col("att")).alias("wa"), F.countDistinct("group").alias("g"), F.countDistinct("period").alias("t")).first()
    if not r["w"]:
        return {"aggregated_att": 0.0, "aggregated_se": 0.0, "aggregated_p_value": 1.0, "aggregated_ci_lower": 0.0, "aggregated_ci_upper": 0.0, "n_groups": 0, "n_periods": 0}
    att, se = r["wa"] / r["w"], 1 / math.sqrt(r["w"])
    return {"aggregated_att": att, "aggregated_se": se, "aggregated_p_value": normal_p(att / max(se, 1e-10)), "aggregated_ci_lower": att - 1.96 * se,
            "aggregated_ci_upper": att + 1.96 * se, "n_groups": r["g"], "n_periods": r["t"]}


def att_gt(panel: DataFrame, outcome: str) -> DataFrame:
    """Group-time effects against the last period before treatment (proper differencing)."""
    own = _cohorts(panel).select("unit_id", "period", "cohort", F.col(outcome).cast("double").alias("y"))
    before = own.where(F.col("cohort").isNotNull() & (F.col("period") < F.col("cohort"))).groupBy("cohort").agg(F.max("period").alias("base"))
    cells = own.groupBy("cohort", "period").agg(F.avg("y").alias("m"))
    control = cells.where("cohort is null").select("period", F.col("m").alias("mc"))
    gap = cells.where("cohort is not null").join(control, "period").select("cohort", "period", (F.col("m") - F.col("mc")).alias("gap"))
    base = gap.join(before, "cohort").where(F.col("period") == F.col("base")).select("cohort", F.col("gap").alias("gap0"))
    return gap.join(base, "cohort").select(F.col("cohort").alias("group"), "period", (F.col("gap") - F.col("gap0")).alias("att"))


def event_study_effects(panel: DataFrame, outcome: str, pre: int = 5, post: int = 5, reference: int = -1) -> DataFrame:
    """Mean gap to the untreated by relative period, less the reference period's."""
    own = _cohorts(panel).select("unit_id", "period", "cohort", F.col(outcome).cast("double").alias("y"))
    # the periods of a panel are a small dimension: their rank is taken over all of them
    order = own.select("period").distinct().withColumn("k", F.row_number().over(Window.orderBy("period")))
    control = own.where("cohort is null").groupBy("period").agg(F.avg("y").alias("mc"))
    start = order.select(F.col("period").alias("cohort"), F.col("k").alias("k0"))
    gaps = own.where("cohort is not null").join(F.broadcast(order), "period").join(F.broadcast(start), "cohort").join(F.broadcast(control), "period")
    gaps = gaps.select((F.col("k") - F.col("k0")).alias("rel"), (F.col("y") - F.col("mc")).alias("gap")).where(F.col("rel").between(-pre, post) & F.col("gap").isNotNull())
    found = gaps.groupBy("rel").agg(F.avg("gap").alias("c"), F.count("*").alias("n"), F.stddev_samp("gap").alias("sd"))
    grid = panel.sparkSession.range(-pre, post + 1).select(F.col("id").cast("int").alias("rel"))
    out = grid.join(F.broadcast(found), "rel", "left").select("rel", F.coalesce("c", F.lit(0.0)).alias("c"),
        F.coalesce(F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n")), F.lit(0.0)).alias("std_error"))
    at = reference if -pre <= reference <= post else -pre
    ref = out.where(F.col("rel") == at).select(F.col("c").alias("c0"))
    out = out.join(F.broadcast(ref)).select(F.col("rel").cast("long").alias("relative_period"), (F.col("c") - F.col("c0")).alias("coefficient"), "std_error")
    half = 1.96 * F.col("std_error")
    return out.withColumns({"ci_lower": F.col("coefficient") - half, "ci_upper": F.col("coefficient") + half})


def pre_trend_test(effects: list, reference: int = -1) -> tuple[float | None, float | None]:
    """F statistic and p-value over collected pre-period effects."""
    pre = [r for r in effects if r["relative_period"] < 0 and r["relative_period"] != reference]
    if not pre or not any(r["std_error"] > 0 for r in pre):
        return None, None
    f = float(np.mean([(r["coefficient"] / max(r["std_error"], 1e-10)) ** 2 for r in pre]))
    return f, f_sf(f, len(pre), max(len(pre), 1))


def _to_simplex(v: np.ndarray) -> np.ndarray:
    s = np.sort(v)[::-1]
    c = np.cumsum(s) - 1
    k = np.nonzero(s - c / np.arange(1, len(v) + 1) > 0)[0][-1]
    return np.maximum(v - c[k] / (k + 1), 0)


def simplex_weights(target: np.ndarray, donors: np.ndarray, rounds: int = 20000) -> np.ndarray:
    """Least-squares weights on the simplex by accelerated projected gradient."""
    n = donors.shape[1]
    w = z = np.ones(n) / n
    gram, lin = donors.T @ donors, donors.T @ target
    lip = max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    t = 1.0
    for _ in range(rounds):
        new = _to_simplex(z - (gram @ z - lin) / lip)
        if (new - w) @ (z - new) > 0:
            t = 1.0  # restart when the step turns back
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        done = np.abs(new - w).max() < 1e-13
        w, t = new, t2
        if done:
            break
    return w


def _gap(wide: np.ndarray, unit: int, donors: list[int], pre: int) -> tuple[np.ndarray, np.ndarray]:
    w = simplex_weights(wide[:pre, unit], wide[:pre, donors])
    return w, wide[:, unit] - wide[:, donors] @ w


def _mspe_ratio(effect: np.ndarray, pre: int) -> float:
    before = float(np.mean(effect[:pre] ** 2))
    return float(np.mean(effect[pre:] ** 2)) / before if before > 1e-10 else math.inf


def synthetic_control(panel: DataFrame, unit: str, outcome: str, n_placebo_runs: int = 0) -> dict:
    """Donor weights, counterfactual and placebo test; placebos run as Spark tasks.

    Donors are the units outside the unit's own event (equal treatment date) with
    full pre-periods.
    """
    own = panel.where(F.col("unit_id") == unit).select("treatment_date").first()
    if own is None:
        raise ValueError(f"Unit {unit!r} is not in the panel.")
    if own["treatment_date"] is None:
        raise ValueError(f"Unit {unit!r} has no treatment event.")
    date = own["treatment_date"]
    pdf = small_panel(panel.select("unit_id", "period", "treatment_date", F.col(outcome).cast("double").alias("y")))
    wide = pdf.pivot_table(index="period", columns="unit_id", values="y", aggfunc="mean").sort_index()
    pre = int((wide.index < date.isoformat()[:7]).sum())
    same = set(pdf.loc[pdf["treatment_date"] == date, "unit_id"])
    donors = [u for u in wide.columns if u != unit and u not in same and not wide[u].iloc[:pre].isna().any()]
    values, names = wide.to_numpy(), list(wide.columns)
    w, effect = _gap(values, names.index(unit), [names.index(u) for u in donors], pre)
    p = None
    if n_placebo_runs and donors:
        ratio, some = _mspe_ratio(effect, pre), donors[:n_placebo_runs]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(u, _mspe_ratio(_gap(values, names.index(u), [names.index(d) for d in donors if d != u], pre)[1], pre)) for u in b["unit_id"]]
                yield pd.DataFrame(rows, columns=["unit_id", "ratio"])

        spark = panel.sparkSession
        frame = spark.createDataFrame([(u,) for u in some], "unit_id string").repartition(min(len(some), 32))
        ratios = frame.mapInPandas(run, "unit_id string, ratio double").collect()
        p = (sum(r["ratio"] >= ratio for r in ratios) + 1) / (n_placebo_runs + 1)
    return {"treated_unit": unit, "donor_weights": {u: float(x) for u, x in zip(donors, w, strict=True) if x > 1e-4}, "periods": tuple(wide.index),
            "observed": tuple(values[:, names.index(unit)]), "treatment_effect": tuple(effect), "counterfactual": tuple(values[:, names.index(unit)] - effect),
            "att": float(np.mean(effect[pre:])), "pre_treatment_mspe": float(np.mean(effect[:pre] ** 2)), "placebo_p_value": p}


def _sdid(wide: np.ndarray, treated: list[int], donors: list[int], pre: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Effect, unit weights and time weights of synthetic difference in differences."""
    y, target = wide[:, donors], wide[:, treated].mean(axis=1)
    post = len(wide) - pre
    noise = float(np.std(np.diff(y[:pre], axis=0), ddof=1)) if pre > 2 else 0.0
    ridge = (len(treated) * post) ** 0.25 * noise

    def weights(columns: np.ndarray, goal: np.ndarray, penalty: float) -> np.ndarray:
        """On the simplex, a constant free: both sides without their means, the penalty as further rows."""
        size = columns.shape[1]
        a = np.vstack([columns - columns.mean(axis=0), np.sqrt(penalty) * np.eye(size)])
        return simplex_weights(np.r_[goal - goal.mean(), np.zeros(size)], a)

    units = weights(y[:pre], target[:pre], ridge**2 * pre)
    times = weights(y[:pre].T, y[pre:].mean(axis=0), 1e-6 * noise**2 * len(donors))
    change = lambda v: v[pre:].mean(axis=0) - times @ v[:pre]
    return float(change(target) - change(y) @ units), units, times


def synthetic_did(panel: DataFrame, outcome: str, n_placebo_runs: int = 0) -> dict:
    """Synthetic difference in differences for the units of the first treatment date.

    Controls are the never-treated units with a value in every period.  With
    ``n_placebo_runs`` the standard error is that of as many controls that are each taken
    for treated, run as Spark tasks.
    """
    pdf = small_panel(panel.select("unit_id", "period", "treatment_date", F.col(outcome).cast("double").alias("y")))
    dates = pdf["treatment_date"].dropna()
    if dates.empty:
        raise ValueError("No unit of the panel is treated.")
    date = dates.min()
    wide = pdf.pivot_table(index="period", columns="unit_id", values="y", aggfunc="mean").sort_index()
    pre = int((wide.index < date.isoformat()[:7]).sum())
    own, ever = set(pdf.loc[pdf["treatment_date"] == date, "unit_id"]), set(pdf.loc[pdf["treatment_date"].notna(), "unit_id"])
    whole = ~wide.isna().any()
    treated, donors = ([k for k, u in enumerate(wide.columns) if ok(u) and whole[u]] for ok in (own.__contains__, lambda u: u not in ever))
    if pre < 2 or pre >= len(wide) or not treated or len(donors) < 2:
        raise ValueError("Need two periods before and one after the treatment, a treated unit and two controls.")
    values, names = wide.to_numpy(), list(wide.columns)
    effect, units, times = _sdid(values, treated, donors, pre)
    error = None
    if n_placebo_runs > 1 and len(donors) > 2:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"effect": [_sdid(values, [int(k)], [d for d in donors if d != k], pre)[0] for k in b["k"]]})

        some = donors[:n_placebo_runs]
        frame = panel.sparkSession.createDataFrame([(k,) for k in some], "k long").repartition(min(len(some), 32))
        error = float(np.std([r["effect"] for r in frame.mapInPandas(run, "effect double").collect()]))
    return {"method": "sdid", "att": effect, "std_error": error, "p_value": normal_p(effect / error) if error else None,
            "treated_units": tuple(names[k] for k in treated), "unit_weights": {names[k]: float(w) for k, w in zip(donors, units, strict=True) if w > 1e-4},
            "time_weights": {p: float(w) for p, w in zip(wide.index[:pre], times, strict=True) if w > 1e-4}, "n_periods": len(wide)}


def minimum_detectable_effect(n_units: int, n_periods: int, proportion_treated: float = 0.5, alpha: float = 0.05, power: float = 0.8,
                              icc: float = 0.05, variance: float = 1.0, r_squared: float = 0.0) -> float:
    """Closed form for a clustered panel with a design effect of the intra-class correlation."""
    if n_units < 2 or n_periods < 1 or not 0 < proportion_treated < 1:
        raise ValueError("Need two units, one period and a share between 0 and 1.")
    design = 1 + (n_periods - 1) * icc
    z = NORMAL.inv_cdf(1 - alpha / 2) + NORMAL.inv_cdf(power)
    return z * math.sqrt(2 * variance * (1 - r_squared) * design / (n_units * proportion_treated * n_periods))
