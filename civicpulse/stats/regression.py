"""Linear models from cross-products: OLS by group, interrupted series, Oaxaca-Blinder,
panel fixed effects, regression discontinuity; random effects and mixed models on small panels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dist import normal_p, t_p


def _cross_products(xs: list[Column], y: Column) -> list[Column]:
    terms = [*xs, y]
    return [F.sum(terms[i] * terms[j]).alias(f"_m{i}_{j}") for i in range(len(terms)) for j in range(i + 1)]


def _moments(row, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    get = lambda i, j: float(row[f"_m{max(i, j)}_{min(i, j)}"])
    xx = np.array([[get(i, j) for j in range(k)] for i in range(k)])
    return xx, np.array([get(k, i) for i in range(k)]), get(k, k)


def ols(df: DataFrame, y: str, xs: list[str], keys: list[str] | None = None) -> DataFrame:
    """OLS with a constant per group: one row per coefficient with its error, t-test and fit.

    A group is reduced to its cross-products in one aggregation; only these are solved.
    """
    keys = keys or []
    names = ["const", *xs]
    columns = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    sums = df.dropna(subset=[y, *xs]).groupBy(*keys).agg(F.count("*").alias("_n"), *_cross_products(columns, F.col(y).cast("double")))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                n, k = int(row["_n"]), len(names)
                if n <= k:
                    continue
                xx, xy, yy = _moments(row, k)
                beta = np.linalg.solve(xx, xy)
                rss = max(yy - float(beta @ xy), 0.0)
                tss = yy - xy[0] ** 2 / n
                se = np.sqrt(np.maximum(np.diag(np.linalg.inv(xx)) * rss / (n - k), 0))
                for i, name in enumerate(names):
                    t = beta[i] / se[i] if se[i] > 0 else math.inf
                    out.append([*[row[c] for c in keys], name, beta[i], se[i], t_p(t, n - k), 1 - rss / tss if tss > 0 else 0.0, n])
            yield pd.DataFrame(out, columns=[*keys, "name", "coefficient", "std_error", "p_value", "r_squared", "n"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.select(*keys).schema) if keys else ""
    return sums.mapInPandas(solve, schema + "name string, coefficient double, std_error double, p_value double, r_squared double, n long")


def interrupted_time_series(series: DataFrame, value: str, order: str, cut, keys: list[str] | None = None, covariates: list[str] | None = None) -> DataFrame:
    """``y ~ 1 + t + D + t D`` (+ covariates) per series: pre-trend, level and trend change."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.partitionBy(F.lit(0)).orderBy(order)
    rows = series.withColumn("t", (F.row_number().over(w) - 1).cast("double"))
    rows = rows.withColumn("after", (F.col(order) >= F.lit(cut)).cast("double")).withColumn("time_after", F.col("t") * F.col("after"))
    fit = ols(rows, value, ["t", "after", "time_after", *(covariates or [])], keys)
    pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    return fit.groupBy(*keys).agg(
        pick("t", "coefficient").alias("pre_trend"), (pick("t", "coefficient") + pick("time_after", "coefficient")).alias("post_trend"),
        pick("after", "coefficient").alias("level_change"), pick("time_after", "coefficient").alias("trend_change"),
        pick("after", "p_value").alias("p_value_level"), pick("time_after", "p_value").alias("p_value_trend"),
    )


def _fit(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    columns = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    row = df.dropna(subset=[y, *xs]).agg(F.count("*").alias("_n"), *_cross_products(columns, F.col(y).cast("double"))).first()
    xx, xy, _ = _moments(row, len(xs) + 1)
    n = row["_n"]
    return np.linalg.solve(xx, xy), xx[0] / n, xy[0] / n, n


def oaxaca_blinder(a: DataFrame, b: DataFrame, outcome: str, regressors: list[str]) -> dict:
    """Gap of group means split in endowments (at b's coefficients) and coefficients."""
    beta_a, x_a, y_a, n_a = _fit(a, outcome, regressors)
    beta_b, x_b, y_b, n_b = _fit(b, outcome, regressors)
    parts = (x_a - x_b) * beta_b
    return {
        "mean_group_a": y_a, "mean_group_b": y_b, "total_gap": y_a - y_b, "explained": float(parts.sum()),
        "unexplained": float(x_a @ (beta_a - beta_b)), "component_contributions": dict(zip(regressors, parts[1:].tolist(), strict=True)),
        "n_group_a": n_a, "n_group_b": n_b,
    }


def within(panel: DataFrame, columns: list[str], time_effects: bool = False) -> DataFrame:
    """Deviations from unit (and, for a balanced panel, period) means."""
    unit, period, everything = Window.partitionBy("unit_id"), Window.partitionBy("period"), None
    out = panel.dropna(subset=columns)
    if time_effects:
        everything = out.agg(*[F.avg(F.col(c).cast("double")).alias(f"_all_{c}") for c in columns])
        out = out.join(F.broadcast(everything))  # one row of means
    for c in columns:
        v = F.col(c).cast("double")
        d = v - F.avg(v).over(unit)
        out = out.withColumn(f"d_{c}", d - F.avg(v).over(period) + F.col(f"_all_{c}") if time_effects else d)
    return out


def panel_fixed_effects(panel: DataFrame, outcome: str, regressors: list[str], time_effects: bool = False, cluster: str | None = "entity") -> dict:
    """Within estimator with unadjusted or entity-, time- or two-way-clustered errors (no small-sample factor)."""
    rows = within(panel, [outcome, *regressors], time_effects)
    k = len(regressors)
    xs, y = [F.col(f"d_{x}") for x in regressors], F.col(f"d_{outcome}")
    row = rows.agg(F.count("*").alias("_n"), F.countDistinct("unit_id").alias("_e"), F.countDistinct("period").alias("_t"), *_cross_products(xs, y)).first()
    xx, xy, yy = _moments(row, k)
    beta = np.linalg.solve(xx, xy)
    resid = y - reduce(lambda a, b: a + b, [x * float(c) for x, c in zip(xs, beta, strict=True)])
    scores = rows.withColumns({f"_s{i}": x * resid for i, x in enumerate(xs)})

    def meat(by: list[str]) -> np.ndarray:
        g = scores.groupBy(*by).agg(*[F.sum(f"_s{i}").alias(f"g{i}") for i in range(k)])
        m = g.agg(*[F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
        return np.array([[m[f"m{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])

    bread = np.linalg.inv(xx)
    rss = max(yy - float(beta @ xy), 0.0)
    if cluster in ("entity", "time"):
        v = bread @ meat(["unit_id" if cluster == "entity" else "period"]) @ bread
    elif cluster == "both":
        v = bread @ (meat(["unit_id"]) + meat(["period"]) - meat(["unit_id", "period"])) @ bread
    else:
        lost = row["_e"] + (row["_t"] - 1 if time_effects else 0)
        v = bread * rss / max(row["_n"] - k - lost, 1)
    se = np.sqrt(np.maximum(np.diag(v), 0))
    return {
        "coefficients": dict(zip(regressors, beta.tolist(), strict=True)), "std_errors": dict(zip(regressors, se.tolist(), strict=True)),
        "p_values": {r: normal_p(b / s) if s > 0 else 0.0 for r, b, s in zip(regressors, beta, se, strict=True)},
        "r_squared": 1 - rss / yy if yy > 0 else 0.0, "n_observations": row["_n"], "n_entities": row["_e"], "n_periods": row["_t"],
    }


#: rows of a panel that an estimator on the driver takes
PANEL_LIMIT = 2_000_000


def small_panel(panel: DataFrame) -> pd.DataFrame:
    """A unit-by-period panel on the driver; more than ``PANEL_LIMIT`` rows are an error."""
    pdf = panel.limit(PANEL_LIMIT + 1).toPandas()
    if len(pdf) > PANEL_LIMIT:
        raise ValueError(f"Panels of more than {PANEL_LIMIT} rows do not fit this estimator.")
    return pdf


def panel_random_effects(panel: pd.DataFrame, outcome: str, regressors: list[str]) -> dict:
    """Random effects by quasi-demeaning with variance components from the within and
    between regressions; no constant is added.  ``panel`` is small (unit by period)."""
    df = panel.dropna(subset=[outcome, *regressors])
    y, x = df[outcome].to_numpy(float), df[regressors].to_numpy(float)
    code, units = pd.factorize(df["unit_id"])
    t = np.bincount(code)
    mean = lambda v: np.stack([np.bincount(code, c) for c in np.atleast_2d(v.T)], -1) / t[:, None]
    ym, xm = mean(y[:, None]), mean(x)
    yd, xd = y - ym[code, 0], x - xm[code]
    b = np.linalg.lstsq(xd, yd, rcond=None)[0]
    s2e = float(((yd - xd @ b) ** 2).sum()) / max(len(y) - len(units) - x.shape[1], 1)
    bb = np.linalg.lstsq(xm, ym[:, 0], rcond=None)[0]
    s2b = float(((ym[:, 0] - xm @ bb) ** 2).sum()) / max(len(units) - x.shape[1], 1)
    t_bar = len(units) / (1 / t).sum()
    s2u = max(s2b - s2e / t_bar, 0.0)
    theta = 1 - np.sqrt(s2e / (t * s2u + s2e)) if s2e > 0 else np.ones(len(t))
    yq, xq = y - theta[code] * ym[code, 0], x - theta[code, None] * xm[code]
    xx = np.linalg.inv(xq.T @ xq)
    beta = xx @ xq.T @ yq
    resid = yq - xq @ beta
    se = np.sqrt(np.diag(xx) * (resid @ resid) / len(y))
    return {
        "coefficients": dict(zip(regressors, beta.tolist(), strict=True)), "std_errors": dict(zip(regressors, se.tolist(), strict=True)),
        "p_values": {r: normal_p(c / s) if s > 0 else 0.0 for r, c, s in zip(regressors, beta, se, strict=True)},
        "r_squared": 1 - float(resid @ resid) / float(yq @ yq) if float(yq @ yq) > 0 else 0.0,
        "n_observations": len(y), "n_entities": len(units), "n_periods": int(df["period"].nunique()), "theta": theta.tolist(),
    }


def reporting_rate_adjustment(panel: pd.DataFrame, outcome: str, covariates: list[str] | None = None) -> dict:
    """Random-intercept model by restricted likelihood: shrunken unit effects are taken off the raw means."""
    covariates = covariates or []
    df = panel.dropna(subset=[outcome, *covariates])
    y = df[outcome].to_numpy(float)
    x = np.column_stack([np.ones(len(df)), *[df[c].to_numpy(float) for c in covariates]])
    code, units = pd.factorize(df["unit_id"], sort=True)
    n = np.bincount(code).astype(float)
    xs = np.stack([np.bincount(code, c) for c in x.T], -1)
    ys = np.bincount(code, y)

    def reml(log_ratio: float):
        ratio = math.exp(log_ratio)
        shrink = ratio / (1 + n * ratio)
        xx = x.T @ x - (xs * shrink[:, None]).T @ xs
        xy = x.T @ y - xs.T @ (shrink * ys)
        beta = np.linalg.solve(xx, xy)
        r = y - x @ beta
        rs = np.bincount(code, r)
        q = float(r @ r - (shrink * rs * rs).sum())
        df_r = len(y) - x.shape[1]
        ll = -0.5 * (df_r * math.log(max(q, 1e-300) / df_r) + np.log1p(n * ratio).sum() + np.linalg.slogdet(xx)[1])
        return ll, beta, shrink * rs, q / df_r, ratio

    grid = np.linspace(-14, 10, 97)
    best = max(grid, key=lambda g: reml(g)[0])
    lo, hi = best - 0.25, best + 0.25
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        if reml(a)[0] >= reml(b)[0]:
            hi = b
        else:
            lo = a
    _, _, effects, s2e, ratio = reml((lo + hi) / 2)
    raw = ys / n
    adjusted = raw - effects
    return {
        "raw_rates": dict(zip(units, raw.tolist(), strict=True)), "adjusted_rates": dict(zip(units, adjusted.tolist(), strict=True)),
        "adjustment_factors": {u: float(a / r) if r else 1.0 for u, a, r in zip(units, adjusted, raw, strict=True)},
        "covariates_used": tuple(covariates), "icc": ratio / (1 + ratio), "residual_variance": s2e,
    }


def rd_bandwidth(df: DataFrame, x: str, y: str) -> float:
    """Normal-reference rule on the outcome's spread, at least 5 % of the range of ``x``."""
    r = df.agg(F.count("*").alias("n"), F.stddev_pop(y).alias("s"), (F.max(x) - F.min(x)).alias("w")).first()
    return max(1.84 * r["s"] * r["n"] ** -0.2, 0.05 * r["w"])


def regression_discontinuity(df: DataFrame, x: str, y: str, cutoff: float = 0.0, kernel: str = "triangular", bandwidth: float | None = None, order: int = 1) -> dict:
    """Jump at the cutoff from kernel-weighted polynomials on both sides, from weighted moments."""
    rows = df.select((F.col(x).cast("double") - cutoff).alias("x"), F.col(y).cast("double").alias("y")).dropna()
    sides = rows.agg(F.sum((F.col("x") < 0).cast("long")).alias("l"), F.sum((F.col("x") >= 0).cast("long")).alias("r")).first()
    if min(sides["l"] or 0, sides["r"] or 0) < 3:
        raise ValueError("The cutoff needs three rows or more below it and as many at or above it.")
    h = rd_bandwidth(rows, "x", "y") if bandwidth is None else bandwidth
    u = F.abs(F.col("x") / h)
    weight = {"triangular": F.greatest(1 - u, F.lit(0.0)), "epanechnikov": F.greatest(0.75 * (1 - u * u), F.lit(0.0))}.get(kernel, F.lit(1.0))
    rows = rows.where(F.abs("x") <= h).withColumn("w", weight).withColumn("side", (F.col("x") >= 0).cast("int"))
    k = order + 1
    powers = [F.pow("x", F.lit(float(p))) for p in range(2 * order + 1)]
    first = rows.groupBy("side").agg(F.count("*").alias("n"), *[F.sum(F.col("w") * p).alias(f"a{i}") for i, p in enumerate(powers)],
                                     *[F.sum(F.col("w") * powers[i] * F.col("y")).alias(f"b{i}") for i in range(k)]).collect()
    got = {r["side"]: r for r in first}
    if any(s not in got or got[s]["n"] < 2 for s in (0, 1)):
        raise ValueError("The bandwidth leaves too few rows to fit both lines.")
    beta, bread = {}, {}
    for s, r in got.items():
        a = np.array([[r[f"a{i + j}"] for j in range(k)] for i in range(k)])
        bread[s] = np.linalg.inv(a)
        beta[s] = np.linalg.solve(a, np.array([r[f"b{i}"] for i in range(k)]))
    fitted = F.when(F.col("side") == 1, reduce(lambda p, q: p + q, [powers[i] * float(beta[1][i]) for i in range(k)])).otherwise(
        reduce(lambda p, q: p + q, [powers[i] * float(beta[0][i]) for i in range(k)])
    )
    e2 = F.pow(F.col("w") * (F.col("y") - fitted), F.lit(2.0))
    meats = {r["side"]: r for r in rows.groupBy("side").agg(*[F.sum(e2 * p).alias(f"m{i}") for i, p in enumerate(powers)]).collect()}
    var = 0.0
    for s in (0, 1):
        m = np.array([[meats[s][f"m{i + j}"] for j in range(k)] for i in range(k)])
        var += (bread[s] @ m @ bread[s])[0, 0]
    tau, se = float(beta[1][0] - beta[0][0]), max(math.sqrt(max(var, 0.0)), 1e-10)
    return {"treatment_effect": tau, "se_robust": se, "p_value": normal_p(tau / se), "ci_lower": tau - 1.96 * se, "ci_upper": tau + 1.96 * se,
            "bandwidth_left": h, "bandwidth_right": h, "n_effective_left": got[0]["n"], "n_effective_right": got[1]["n"], "kernel": kernel}
