"""Theil decomposition in SQL form and latent reporting rates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def theil(units: DataFrame) -> DataFrame:
    """One row ``(total, between_group, within_group, n_units)`` of ``units(value, population, grp)``.

    Units weigh by population; zero values add nothing; without groups everything is within.
    """
    mean = units.agg((F.sum(F.col("value") * F.col("population")) / F.sum("population")).alias("mu"), F.sum("population").alias("pop"))
    rows = units.join(F.broadcast(mean))  # one row of totals
    ratio = F.col("value") / F.col("mu")
    share = F.col("population") / F.col("pop")
    term = F.when(ratio > 0, share * ratio * F.log(ratio)).otherwise(0.0)
    grouped = rows.groupBy("grp", "mu", "pop").agg(
        F.sum(term).alias("t"), F.count("*").alias("n"), F.sum("population").alias("gp"),
        (F.sum(F.col("value") * F.col("population")) / F.sum("population")).alias("gm"),
    )
    gr = F.col("gm") / F.col("mu")
    between = F.when(F.col("grp").isNotNull() & (gr > 0), F.col("gp") / F.col("pop") * gr * F.log(gr)).otherwise(0.0)
    out = grouped.agg(F.sum("t").alias("total"), F.sum(between).alias("between_group"), F.sum("n").alias("n_units"))
    return out.select("total", "between_group", (F.col("total") - F.col("between_group")).alias("within_group"), "n_units")


def theil_contributions(units: DataFrame) -> DataFrame:
    """Term of each unit: ``(unit_id, contribution)``."""
    mean = units.agg((F.sum(F.col("value") * F.col("population")) / F.sum("population")).alias("mu"), F.sum("population").alias("pop"))
    ratio = F.col("value") / F.col("mu")
    term = F.when(ratio > 0, F.col("population") / F.col("pop") * ratio * F.log(ratio)).otherwise(0.0)
    return units.join(F.broadcast(mean)).select("unit_id", term.alias("contribution"))


#: least reporting probability of a unit without a report, when nothing else is known of it
SILENT = 0.01
_FLOOR = 1e-10


def _poisson(y: np.ndarray, mean: np.ndarray) -> float:
    return float(np.sum(y * np.log(np.maximum(mean, _FLOOR)) - mean))


def _refit(design: np.ndarray, beta: np.ndarray, target: np.ndarray, passes: int = 5) -> np.ndarray:
    """Logistic regression of ``target`` (shares) by reweighted least squares, from ``beta``."""
    for _ in range(passes):
        score = np.clip(design @ beta, -700, 700)
        p = 1 / (1 + np.exp(-score))
        root = np.sqrt(np.maximum(p * (1 - p), 1e-300))
        # weighted least squares on the working response, by QR of the weighted design
        beta = np.linalg.lstsq(design * root[:, None], root * score + (target - p) / root, rcond=None)[0]
    return beta


def latent_reporting_em(counts: dict[str, float], populations: dict[str, float], covariates: dict[str, dict[str, float]] | None = None,
                        max_iter: int = 200, tol: float = 1e-6) -> dict:
    """True rates and reporting probabilities of areas whose reports are ``Poisson(rate * population * probability)``.

    Given the probabilities the rates that explain the counts are ``observed / probability``,
    and given these rates the expected reported share of an area is its probability again, or 0
    where nothing was reported.  So without covariates the start (one half) already is the
    solution, ``SILENT`` for areas without a report, and two rounds show it.  With covariates
    a round refits a logistic model of the probabilities to those shares.
    """
    units = sorted(counts)
    y = np.array([counts[u] for u in units], float)
    people = np.maximum(np.array([populations[u] for u in units], float), 1.0)
    heard, trace, converged = y > 0, [], False
    if covariates is None:
        steps = iter([np.where(heard, 0.5, SILENT)] * max_iter)
    else:
        names = sorted(covariates[units[0]])
        design = np.array([[1.0, *(covariates[u][c] for c in names)] for u in units], float)

        def fitted():
            beta, own = np.zeros(design.shape[1]), np.full(len(units), 0.5)
            for _ in range(max_iter):
                beta = _refit(design, beta, np.where(heard, own, 0.0))
                own = 1 / (1 + np.exp(-np.clip(design @ beta, -700, 700)))
                yield own

        steps = fitted()
    probability, before = np.full(len(units), 0.5), None
    for after in steps:
        rate = np.maximum(y / (np.maximum(probability, _FLOOR) * people), _FLOOR)
        probability = after
        trace.append(_poisson(y, rate * people * probability))
        converged = before is not None and abs(trace[-1] - before) < tol
        if converged:
            break
        before = trace[-1]
    by_unit = lambda v: {u: float(x) for u, x in zip(units, v, strict=True)}
    return {"estimated_true_rates": by_unit(rate), "reporting_probabilities": by_unit(probability), "observed_rates": by_unit(y / people),
            "n_iterations": len(trace), "converged": converged, "log_likelihood_trace": tuple(trace)}
