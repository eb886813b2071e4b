"""Estimators by family name.

Families whose estimators come from third-party engines elsewhere (mediation,
survival, heterogeneous effects, double machine learning, climate, diffusion) are not
built here and raise.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from . import causal, inequality, regression, series, spatial_models

ESTIMATORS: dict[str, dict[str, Callable[..., Any]]] = {
    "did": {"pooled": causal.staggered_did, "group_time": causal.group_time_effects, "att_gt": causal.att_gt},
    "event_study": {"default": causal.event_study_effects},
    "scm": {"default": causal.synthetic_control},
    "sdid": {"sdid": causal.synthetic_did},
    "rdd": {"default": regression.regression_discontinuity},
    "panel_reg": {"fe": regression.panel_fixed_effects, "re": regression.panel_random_effects},
    "changepoint": {"pelt": series.changepoints},
    "stl": {"default": series.stl, "anomalies": series.stl_anomalies},
    "hawkes": {"default": series.fit_hawkes},
    "inequality": {"theil": inequality.theil, "oaxaca": regression.oaxaca_blinder},
    "spatial": {"moran": spatial_models.moran_test, "lisa": spatial_models.local_moran_test, "regression": spatial_models.spatial_regression, "gwr": spatial_models.gwr, "bym2": spatial_models.bym2_smooth},
    "reporting_bias": {"mixed": regression.reporting_rate_adjustment, "em": inequality.latent_reporting_em},
}
UNSUPPORTED = ("mediation", "survival", "het_te", "dml", "climate", "diffusion")


def estimate(family: str, method: str | None = None, /, *args: Any, **kw: Any) -> Any:
    """Call an estimator; the first method of a family is its default."""
    if family in UNSUPPORTED:
        raise NotImplementedError(f"Family {family!r} has no estimator here.")
    if family not in ESTIMATORS:
        raise ValueError(f"Unknown family {family!r}; one of {', '.join(ESTIMATORS)}.")
    methods = ESTIMATORS[family]
    if method is not None and method not in methods:
        raise ValueError(f"Unknown method {method!r} of {family!r}; one of {', '.join(methods)}.")
    return methods[method or next(iter(methods))](*args, **kw)
