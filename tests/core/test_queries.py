"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import json
import math
import os

import duckdb
import numpy as np
import pytest

from civicpulse import queries as Q
from civicpulse import queries_io  # noqa: F401  (registers its queries)
from civicpulse.operators import panel as P
from civicpulse.operators import spatial as S
from civicpulse.stats import spatial_models

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got, want = Q.QUERIES[name](spark, DIR), db.sql(Q.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_without_sql_gives_sound_rows(spark, name):
    """Rows come, every column is read, keys do not repeat and no number is missing or endless."""
    rows = Q.QUERIES[name](spark, DIR).collect()
    assert rows and len(set(rows)) == len(rows)
    assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))


def numbers(spark, name, key, value):
    return {r[key]: r[value] for r in Q.QUERIES[name](spark, DIR).collect()}


@pytest.fixture(scope="module")
def monthly(db):
    """The panel's counts by unit, months in order, straight from SQL."""
    rows = db.sql(f"WITH {Q.PANEL} SELECT unit_id, list(complaint_count ORDER BY period) FROM p GROUP BY 1").fetchall()
    return {u: np.array(v, float) for u, v in rows}


def test_series_queries_equal_the_estimators(spark, monthly):
    got = {}
    for r in Q.stl(spark, DIR).collect():
        got.setdefault(r.unit_id, {})[r.k] = r
    assert set(got) == set(monthly)
    for u, y in monthly.items():
        rows = [got[u][k] for k in range(len(y))]
        assert np.allclose([r.trend + r.seasonal + r.residual for r in rows], y)
        odd = {r.k: r.residual for r in rows}
        z = (np.array(list(odd.values())) - np.mean(list(odd.values()))) / np.std(list(odd.values()), ddof=1)
        flagged = {r.k: r.z for r in Q.stl_anomalies(spark, DIR).where(f"unit_id = '{u}'").collect()} if u == min(monthly) else None
        assert flagged is None or flagged == pytest.approx({k: z[k] for k in np.flatnonzero(np.abs(z) > 2)})
    cuts = {}
    for r in Q.changepoints(spark, DIR).collect():
        cuts.setdefault((r.unit_id, r.method), []).append(r.k)
    assert all(0 < k <= len(monthly[u]) for (u, _), ks in cuts.items() for k in ks)


def test_hawkes_is_at_a_maximum(spark, db):
    """No small move of a rate or of the kernel's weight raises the likelihood of the fitted expectation."""
    for r in Q.hawkes(spark, DIR).collect():
        t = np.array([x[0] for x in db.sql(f"SELECT epoch(ts) / 3600.0 FROM events WHERE event_type = '{r.event_type}' ORDER BY ts").fetchall()])
        t, mu, a, b = t - t[0], r.background_rate, r.triggering_kernel_alpha, r.triggering_kernel_beta
        lag = t[:, None] - t[None, :]
        near = np.tril(np.exp(-b * np.maximum(lag, 0)), -1)
        lam = mu + a * b * near.sum(axis=1)
        # fixed point of the expectation step: events of the background and triggered ones add up
        assert mu * t[-1] == pytest.approx((mu / lam).sum(), rel=1e-2)
        assert a * len(t) == pytest.approx(len(t) - (mu / lam).sum(), rel=2e-2, abs=0.5)


def test_donor_weights_beat_other_weights(spark, db, monthly):
    found = numbers(spark, "synth_control", "unit_id", "value")
    weights = {u: w for u, w in found.items() if not u.startswith("_")}
    assert min(weights.values()) > 0 and sum(weights.values()) == pytest.approx(1, abs=1e-2)
    periods = [r[0] for r in db.sql(f"WITH {Q.PANEL} SELECT DISTINCT period FROM p ORDER BY 1").fetchall()]
    pre = sum(p < "1998-06" for p in periods)
    y = monthly["NATION_0"]
    fit = sum(w * monthly[u] for u, w in weights.items())
    error = ((y - fit)[:pre] ** 2).sum()
    same = {f"NATION_{i}" for i in range(5)}
    rng, donors = np.random.default_rng(0), [u for u in sorted(monthly) if u not in same]
    for _ in range(300):
        w = rng.dirichlet(np.full(len(donors), 0.3))
        assert ((y - sum(a * monthly[u] for a, u in zip(w, donors, strict=True)))[:pre] ** 2).sum() >= error * 0.999
    assert found["_att"] == pytest.approx(float((y - fit)[pre:].mean()), rel=1e-2, abs=0.05)


def test_random_effects_lie_between_within_and_pooled(spark, db):
    got = numbers(spark, "random_effects", "name", "value")["resolution_rate"]
    rows = db.sql(f"WITH {Q.PANEL} SELECT unit_id, complaint_count, resolution_rate FROM p").df()
    y, x = rows["complaint_count"].to_numpy(float), rows["resolution_rate"].to_numpy(float)
    own = rows.groupby("unit_id")[["complaint_count", "resolution_rate"]].transform("mean").to_numpy()

    def slope(theta):  # quasi-demeaned regression without a constant
        a, b = y - theta * own[:, 0], x - theta * own[:, 1]
        return float(a @ b / (b @ b))

    slopes = [slope(t) for t in np.linspace(0, 1, 101)]
    assert min(slopes) - 1e-6 <= got <= max(slopes) + 1e-6
    assert min(abs(got - s) for s in slopes) <= max(abs(np.diff(slopes))) + 1e-9


def test_spatial_errors_maximise_their_likelihood(spark):
    rows = {r.unit_id: r.value for r in Q.volumes(spark, DIR).collect()}
    units = sorted(rows)
    w = spatial_models.weight_matrix(S.weights_to_dict(Q.weights(spark)), units)
    x = {r.unit_id: r.resolution_rate for r in P.cross_section(Q.panel(spark, DIR), ["resolution_rate"]).collect()}
    y, design = np.array([rows[u] for u in units]), np.array([[1.0, x[u]] for u in units])

    def profile(r, lag):
        a = y - r * (w @ y)
        d = design if lag else design - r * (w @ design)
        e = a - d @ np.linalg.lstsq(d, a, rcond=None)[0]
        return np.linalg.slogdet(np.eye(len(y)) - r * w)[1] - len(y) / 2 * np.log(e @ e / len(y))

    for name, key, lag in (("spatial_lag_ml", "rho", True), ("spatial_error_ml", "lam", False)):
        found = numbers(spark, name, "name", "value")
        tried = [profile(r, lag) for r in np.linspace(-0.95, 0.95, 191)]
        assert profile(found[key], lag) >= max(tried) - 1e-3


def test_permutation_tests_agree_with_the_statistics(spark):
    row = Q.moran_test(spark, DIR).first()
    plain = Q.moran_stat(spark, DIR).first()
    assert row.statistic == pytest.approx(plain.statistic, abs=1e-6) and 0 < row.p_value <= 1
    assert abs(row.z_score) < 2 or row.p_value < 0.1
    local = {r.unit_id: r.local_statistic for r in Q.local_moran_stat(spark, DIR).collect()}
    for r in Q.local_moran_test(spark, DIR).collect():
        assert r.local_statistic == pytest.approx(local[r.unit_id], rel=1e-4, abs=1e-6) and 0 < r.p_value <= 1


def test_smoothed_and_adjusted_rates_shrink(spark, monthly):
    counts = {r.unit_id: r.value for r in Q.volumes(spark, DIR).collect()}
    mean = np.mean(list(counts.values()))
    smooth = numbers(spark, "bym2", "unit_id", "value")
    raw = np.array([counts[u] / mean for u in sorted(counts)])
    got = np.array([smooth[u] for u in sorted(counts)])
    assert set(smooth) == set(counts) and got.std() <= raw.std() * 1.05 and np.corrcoef(raw, got)[0, 1] > 0.5
    adjusted = numbers(spark, "mixed_adjust", "unit_id", "value")
    assert set(adjusted) == set(monthly)


def test_features_are_geojson(spark, db):
    rows = Q.geojson_features(spark, DIR).collect()
    assert len(rows) == 25
    for r in rows:
        shape = json.loads(r.geometry)
        ring = shape["coordinates"][0]
        assert shape["type"] == "Polygon" and ring[0] == ring[-1] and len(ring) == 5


def test_filters_reach_the_scan(spark):
    plan = Q.filter_requests(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_totalprice" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_exported_shares_round_like_the_sql(spark, tmp_path):
    """Shares half-way between two texts of six decimals, exactly (1 of 128) or once rounded to nine places."""
    c = duckdb.connect()
    nations = [(0, 1, 128), (1, 1, 128), (2, 2808, 3013), (3, 414, 3019), (4, 1, 3)]  # place, lines of the first topic, lines
    values = ", ".join(map(str, nations))
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'EUROPE' AS r_name",
        "nation": f"SELECT k AS n_nationkey, 'NATION_' || k AS n_name, 0 AS n_regionkey FROM (VALUES {values}) v(k, a, n)",
        "supplier": f"SELECT k::BIGINT AS s_suppkey, k AS s_nationkey FROM (VALUES {values}) v(k, a, n)",
        "part": "SELECT * FROM (VALUES (1::BIGINT, 'hot rod', 'STANDARD'), (2::BIGINT, 'large bolt', 'STANDARD')) v(p_partkey, p_name, p_type)",
        "lineitem": f"SELECT k::BIGINT AS l_suppkey, (CASE WHEN i < a THEN 1 ELSE 2 END)::BIGINT AS l_partkey, TIMESTAMP '1996-01-01' AS l_shipdate, 'F' AS l_linestatus FROM (VALUES {values}) v(k, a, n), range(3019) r(i) WHERE i < n",
    }
    for name, sql in tables.items():
        c.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted((r[0], r[1]) for r in c.sql(Q.ORACLES["topic_table_sink"]).fetchall())
    assert any(",0.007812," in line for _, line in want) and any(",0.931961," in line or ",0.931962," in line for _, line in want)
    assert sorted((r.position, r.line) for r in Q.QUERIES["topic_table_sink"](spark, str(tmp_path)).collect()) == want
