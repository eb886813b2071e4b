from datetime import date

import numpy as np
import pytest

from civicpulse.operators import factors as FA
from civicpulse.operators import spatial as S
from civicpulse.sources import samples
from civicpulse.stats.dispatch import ESTIMATORS, UNSUPPORTED, estimate


def test_samples_fit_each_other(spark):
    requests, bounds = samples.load_sample_service_requests(spark), samples.load_sample_boundaries(spark)
    joined = S.spatial_join(requests, bounds).collect()
    assert len(joined) == samples.SIZE and all(r.boundary_geography_value == r.community_district for r in joined)
    check = {r.geography_value: (r.n_inside, r.n_differ) for r in S.location_check(requests, bounds).collect()}
    assert check == {d[0]: (18, 0) for d in samples.DISTRICTS}


def test_dispatch():
    assert estimate("changepoint", None, np.r_[np.zeros(20), np.ones(20) * 9]) == [20]
    assert not set(ESTIMATORS) & set(UNSUPPORTED) and len(ESTIMATORS) + len(UNSUPPORTED) == 18
    for args in (("dml",), ("nothing",), ("stl", "nothing")):
        with pytest.raises((ValueError, NotImplementedError)):
            estimate(*args)


def test_pandas_factor(spark):
    ctx = spark.createDataFrame([("BRONX 05", date(2025, 1, 1), date(2025, 12, 31), None)], "geography_id string, window_start date, window_end date, population long")
    got = FA.run_pandas_factor(samples.load_sample_service_requests(spark), ctx, "community_district", "longest", lambda p: p["descriptor"].str.len().max())
    assert [(r.geography_id, r.longest > 10) for r in got.collect()] == [("BRONX 05", True)]
