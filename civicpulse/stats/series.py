"""Estimators on one series as NumPy, and their distributed form over many series."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: events of a series that one task fits
EVENT_LIMIT = 5_000_000
PERIODS = {"D": 7, "W": 52, "M": 12, "ME": 12, "Q": 4, "QE": 4}


def per_series(df: DataFrame, keys: list[str], order: str, value: str, run: Callable[[np.ndarray], list[tuple]], schema: str,
               limit: int | None = None) -> DataFrame:
    """Run ``run(values)`` on every series; one task per key group, rows in order.

    ``run`` returns rows without the keys.  A series is one group and one task: its length is
    the number of periods or events of a unit.  With ``limit`` the lengths are counted
    first, and a series beyond it is an error rather than a task out of memory.
    """
    if limit is not None:
        longest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        if longest > limit:
            raise ValueError(f"A series has {longest} values; at most {limit} fit a task. Split it by period.")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    names = [c.strip().split()[0] for c in schema.split(",")]

    def apply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame([(*key, *row) for row in run(values)], columns=[*keys, *names])

    return df.select(*dict.fromkeys([*keys, order, value])).groupBy(*keys).applyInPandas(apply, f"{own}, {schema}")


def changepoints(y: np.ndarray, method: str = "pelt", penalty: float | None = None, min_size: int = 5, jump: int = 5) -> list[int]:
    """Ends of segments but the last, for the squared-error cost.

    ``pelt`` is the exact minimum of cost plus penalty per segment over breaks at
    multiples of ``jump``; ``binseg`` splits greedily while a split gains more
    than the penalty.  The default penalty is ``ln(n) * variance``.
    """
    n = len(y)
    if n < 2 * min_size:
        return []
    if penalty is None:
        penalty = math.log(n) * float(np.var(y))
    s1, s2 = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(y * y)]
    cost = lambda a, b: s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)
    if method == "binseg":
        breaks: list[int] = []
        while True:
            ends, best = [0, *sorted(breaks), n], (penalty, None)
            for a, b in zip(ends, ends[1:], strict=False):
                for k in range(a + min_size, b - min_size + 1):
                    if k % jump == 0 and (gain := cost(a, b) - cost(a, k) - cost(k, b)) > best[0]:
                        best = (gain, k)
            if best[1] is None:
                return sorted(breaks)
            breaks.append(best[1])
    if method != "pelt":
        raise ValueError(f"Unknown method: {method!r}.")
    spots = [k for k in range(0, n, jump) if k == 0 or k >= min_size] + [n]
    total, last, alive = {0: -penalty}, {}, [0]
    for b in spots[1:]:
        options = [(total[a] + cost(a, b) + penalty, a) for a in alive if b - a >= min_size]
        if not options:
            total[b] = math.inf
            continue
        total[b], last[b] = min(options)
        # a start that already costs more than the best can never win later
        alive = [a for a in alive if b - a < min_size or total[a] + cost(a, b) <= total[b]] + [b]
    out, at = [], last.get(n, 0)
    while at > 0:
        out.append(at)
        at = last[at]
    return sorted(out)


def _loess(y: np.ndarray, x: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Local linear fit with tricube weights over the ``span`` nearest points."""
    n, out = len(x), np.empty(len(at))
    for k, p in enumerate(at):
        d = np.abs(x - p)
        if span >= n:
            h, near = d.max() * 1.0, np.arange(n)
            h += (span - n) / 2
        else:
            lo = min(max(int(np.searchsorted(x, p)) - span // 2, 0), n - span)
            while lo > 0 and p - x[lo - 1] < x[lo + span - 1] - p:
                lo -= 1
            while lo + span < n and x[lo + span] - p < p - x[lo]:
                lo += 1
            near = np.arange(lo, lo + span)
            h = d[near].max()
        r = d[near] / h if h > 0 else np.zeros(len(near))
        w = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - r**3) ** 3, 0.0))
        w = w / w.sum()
        mean = float(w @ x[near])
        spread = float(w @ (x[near] - mean) ** 2)
        if math.sqrt(spread) > 0.001 * (x[-1] - x[0]):
            w = w * (1 + (p - mean) * (x[near] - mean) / spread)
        out[k] = w @ y[near]
    return out


def _odd(v: float) -> int:
    k = math.ceil(v)
    return k + (k % 2 == 0)


def stl(y: np.ndarray, period: int, seasonal: int = 7, inner: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and residual part by seasonal-trend decomposition with LOESS (not robust)."""
    n = len(y)
    if period < 2:
        raise ValueError("A seasonal period of at least 2 is needed.")
    if n < 2 * period:
        raise ValueError("Need two full periods.")
    trend_span, low_span = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1)
    trend, x = np.zeros(n), np.arange(1, n + 1, dtype=float)
    moving = lambda v, k: np.convolve(v, np.ones(k) / k, "valid")
    for _ in range(inner):
        cycle = np.empty(n + 2 * period)
        for s in range(period):
            part = (y - trend)[s::period]
            px = np.arange(1, len(part) + 1, dtype=float)
            cycle[s::period][: len(part) + 2] = _loess(part, px, np.arange(0, len(part) + 2, dtype=float), seasonal)
        low = _loess(moving(moving(moving(cycle, period), period), 3), x, x, low_span)
        season = cycle[period : period + n] - low
        trend = _loess(y - season, x, x, trend_span)
    return trend, season, y - trend - season


def stl_anomalies(y: np.ndarray, period: int, threshold: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions and z-scores (sample deviation) of residuals strictly beyond the threshold."""
    resid = stl(y, period)[2]
    sd = float(np.std(resid, ddof=1))
    if sd == 0:
        return np.zeros(0, int), np.zeros(0)
    z = (resid - resid.mean()) / sd
    at = np.flatnonzero(np.abs(z) > threshold)
    return at, z[at]


def fit_hawkes(times: np.ndarray, rounds: int = 1000) -> dict:
    """Self-exciting process with an exponential kernel by expectation-maximisation.

    Sums over earlier events follow a recursion along the events, run in blocks of cumulative
    sums, so a round is linear in their number.  ``branching_ratio`` is alpha over beta;
    ``mean_offspring`` (alpha) is the expected number of events one triggers.
    """
    t = np.sort(np.asarray(times, float))
    n = len(t)
    if n < 3:
        raise ValueError("Need at least 3 events.")
    t = t - t[0]
    span = float(t[-1])
    if span <= 0:
        raise ValueError("Events must not all be at one time.")
    mu, alpha, beta = n / (2 * span), 0.1, 1.0

    def sums(beta: float) -> tuple[np.ndarray, np.ndarray]:
        """Sum of decays, and of decays times distance, over the events before each."""
        a, b = np.empty(n), np.empty(n)
        start, count, moment = 0, 0.0, 0.0  # decayed to the block's first event: events before it, their distances
        while start < n:
            # within a block the weights of its events stay in the range of a double
            stop = max(start + 1, int(np.searchsorted(t, t[start] + 300.0 / beta))) if beta > 0 else n
            own = t[start:stop] - t[start]
            grow, fade = np.exp(beta * own), np.exp(-beta * own)
            before = np.cumsum(grow) - grow
            far = np.cumsum(grow * own) - grow * own
            a[start:stop] = fade * (count + before)
            b[start:stop] = fade * (moment + count * own + own * before - far)
            if stop < n:
                gap = float(t[stop] - t[start])
                last, decay = own[-1], float(np.exp(-beta * (gap - own[-1])))
                at_last = a[stop - 1] + 1.0
                count, moment = decay * at_last, decay * (b[stop - 1] + at_last * (gap - last))
            start = stop
        return a, b

    for _ in range(rounds):
        a, b = sums(beta)
        lam = mu + alpha * beta * a
        background = float((mu / lam).sum())
        triggered = n - background
        weighted = float((alpha * beta * b / lam).sum())
        new = (background / span, triggered / n, triggered / weighted if triggered > 0 and weighted > 0 else beta)
        done = max(abs(new[0] - mu), abs(new[1] - alpha), abs(new[2] - beta)) < 1e-8
        mu, alpha, beta = new
        if done:
            break
    a, _ = sums(beta)
    ll = float(np.log(np.maximum(mu + alpha * beta * a, 1e-10)).sum() - mu * span + (alpha * (np.exp(-beta * (span - t)) - 1)).sum())
    return {"background_rate": mu, "triggering_kernel_alpha": alpha, "triggering_kernel_beta": beta,
            "branching_ratio": alpha / beta if beta > 0 else math.inf, "mean_offspring": alpha, "n_events": n, "log_likelihood": ll}
