import json
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from civicpulse import cli, plans, sinks, streaming
from civicpulse.config import AnalysisWindow, ExportTarget, TopicQuery
from civicpulse.operators import aggregate as A
from civicpulse.operators import factors as FA
from civicpulse.operators import panel as P
from civicpulse.operators import spatial as S
from civicpulse.operators import timeseries as TS
from civicpulse.operators import topics as T
from civicpulse.sources import boundaries as B
from civicpulse.sources.requests import REQUEST_SCHEMA


def frame(spark, rows):
    """Rows (id, day, type, descriptor, borough, district, resolution, lat, lon)."""
    return spark.createDataFrame([(i, d, t, x, b, c, r, None, la, lo) for i, d, t, x, b, c, r, la, lo in rows], REQUEST_SCHEMA)


def noise(spark):
    texts = ["Loud music", "banging on wall", "dog barking", "PARTY!", "hammering & drilling", "something", "", "Partying"]
    rows = [(str(i), date(2024, 1 + i % 3, 5), "Noise - Residential", t, "BROOKLYN", "BROOKLYN 01" if i < 5 else "BROOKLYN 03", "done" if i % 2 else None, 40.7, -74.0)
            for i, t in enumerate(texts)]
    return frame(spark, rows)


def test_rules_first_match_wins(spark):
    got = {r.service_request_id: (r.topic, r.normalized_text) for r in T.extract_topics(noise(spark), TopicQuery("Noise - Residential")).collect()}
    assert [got[str(i)][0] for i in range(8)] == ["party_music", "banging", "pet_noise", "party_music", "construction", "other", "other", "other"]
    assert got["6"][1] == "unspecified"
    assert T.extract_topics(noise(spark), TopicQuery("noise - residential")).count() == 0  # compared as written


def test_custom_rules_fallback_and_limit(spark):
    q = TopicQuery("Noise - Residential", 2)
    custom = {"Noise - Residential": [("bus", ["bus stop"]), ("m", ["music"])]}
    df = frame(spark, [(str(i), date(2024, 1, 1), "Noise - Residential", t, "B", "B 01", None, None, None) for i, t in enumerate(["bus stopped", "music", "musical", "x", "x"])])
    assert [r.topic for r in T.extract_topics(df, TopicQuery("Noise - Residential", 9), custom).orderBy("service_request_id").collect()] == ["bus", "m", "other", "other", "other"]
    fallback = T.extract_topics(df, q, {"Noise - Residential": []})
    assert [r.topic for r in fallback.orderBy("service_request_id").collect()] == ["bus stopped", "other", "other", "x", "x"]
    with pytest.raises(ValueError):
        T.check_rules([("x", [" "])])
    rules = T.TopicRules({})
    rules.register("Noise - Residential", [("only", ["music"])])
    assert T.extract_topics(df, TopicQuery("Noise - Residential", 9), registry=rules).where("topic = 'only'").count() == 1


def test_aggregate_coverage_gaps_anomalies(spark):
    df = noise(spark)
    assigned = T.extract_topics(df, TopicQuery("Noise - Residential"))
    summary = A.aggregate_by_geography(assigned, "community_district").orderBy("geography_value", "topic_rank").collect()
    assert [(r.topic, r.complaint_count, r.topic_rank, r.is_dominant_topic) for r in summary[:2]] == [("party_music", 2, 1, True), ("banging", 1, 2, False)]
    assert math.isclose(sum(r.share_of_geography for r in summary if r.geography_value == "BROOKLYN 01"), 1.0)
    cover = T.topic_coverage(df, TopicQuery("Noise - Residential"), top_unmatched_n=2).first()
    assert (cover.total_records, cover.matched_records, cover.other_records) == (8, 5, 3) and cover.coverage_rate == 5 / 8
    assert [(x.descriptor, x.n) for x in cover.top_unmatched_descriptors] == [("something", 1), ("", 1)]
    empty = T.topic_coverage(df.limit(0), TopicQuery("Noise - Residential")).first()
    assert (empty.total_records, empty.coverage_rate, empty.top_unmatched_descriptors) == (0, 0.0, [])
    gap = A.analyze_resolution_gaps(df, df.where("service_request_id = '0'").withColumn("resolution_description", F.lit("x"))).first()
    assert (gap.total_request_count, gap.resolved_request_count, gap.unresolved_request_count) == (8, 5, 3)
    flat = spark.createDataFrame([("g", f"v{i}", "t", f"k{i}", n, 9, 0.1, 1, True) for i, n in enumerate([1] * 7 + [2])],
        "geography string, geography_value string, complaint_type string, topic string, complaint_count long, geography_total_count long, share_of_geography double, topic_rank long, is_dominant_topic boolean")
    z = {r.complaint_count: (round(r.z_score, 7), r.is_anomaly) for r in A.detect_anomalies(flat, AnalysisWindow(30)).collect()}
    assert z == {1: (-0.3779645, False), 2: (2.6457513, True)}
    assert all(r.z_score == 0 for r in A.detect_anomalies(flat.where("complaint_count = 1"), AnalysisWindow(7)).collect())


def test_time(spark):
    df = noise(spark)
    wide = TS.to_timeseries(df, "ME").orderBy("period").collect()
    assert [tuple(r) for r in wide] == [(date(2024, 1, 31), 3), (date(2024, 2, 29), 3), (date(2024, 3, 31), 2)]
    gaps = spark.createDataFrame([(date(2024, 1, 31), 2), (date(2024, 4, 30), 5)], "period date, n long")
    assert [r.n for r in TS.resample_and_fill(gaps, "M").orderBy("period").collect()] == [2, 0, 0, 5]
    assert [r.n for r in TS.resample_and_fill(gaps, "M", method="carry_forward").orderBy("period").collect()] == [2, 2, 2, 5]
    assert [r.n for r in TS.resample_and_fill(gaps, "M", method="carry_back").orderBy("period").collect()] == [2, 5, 5, 5]
    assert TS.heatmap(df.withColumn("ts", F.col("created_date").cast("timestamp")), "ts").count() == 168


def test_panel(spark):
    rows = [(str(i), date(2024, m, 10), "A" if i % 2 else "B", "", "X", u, "r" if i % 2 else None, None, None) for i, (u, m) in enumerate([("U1", 4), ("U1", 4), ("U2", 5), ("U2", 6)])]
    panel = P.build_complaint_panel(frame(spark, rows), events=[P.TreatmentEvent("e", ("U1",), date(2024, 5, 15))]).orderBy("unit_id", "period")
    got = [(r.unit_id, r.period, r.complaint_count, r.treatment) for r in panel.collect()]
    assert got == [("U1", "2024-04", 2, False), ("U1", "2024-05", 0, False), ("U1", "2024-06", 0, True), ("U2", "2024-04", 0, False), ("U2", "2024-05", 1, False), ("U2", "2024-06", 1, False)]
    first = panel.first()
    assert first.complaint_counts_by_type == {"A": 1, "B": 1} and first.resolution_rate == 0.5 and first.median_resolution_days == 20.0
    assert [r.unit_id for r in P.unit_ids(P.treatment_group(panel)).collect()] == ["U1"] and P.control_group(panel).count() == 3
    wide = P.panel_wide(panel, ["A", "B"]).orderBy("unit_id", "period").collect()
    assert [r.complaints_A for r in wide] == [1, None, None, None, None, 1]
    with pytest.raises(ValueError):
        P.TreatmentEvent("", ("x",), date(2024, 1, 1))


def test_factors(spark):
    rows = [(str(i), date(2024, 6, 15), f"T{i % 4}", "", "BROOKLYN", "BROOKLYN 01", "r" if i < 10 else None, 40.6782 if i < 19 else 40.7, -73.9442) for i in range(20)]
    ctx = spark.createDataFrame([("BROOKLYN 01", date(2024, 6, 1), date(2024, 6, 30), 100_000), ("EMPTY 01", date(2024, 6, 1), date(2024, 6, 30), None)],
                                "geography_id string, window_start date, window_end date, population long")
    pipe = FA.Pipeline()
    for f in (FA.complaint_volume(True), FA.resolution_time(), FA.topic_concentration(), FA.seasonality({6: 10}), FA.anomaly_score(10, 5), FA.response_rate(), FA.recurrence(), FA.equity_gap(7.5)):
        pipe = pipe.add(f)
    got = {r.geography_id: r.asDict() for r in pipe.run(frame(spark, rows), ctx, "community_district").collect()}
    a, b = got["BROOKLYN 01"], got["EMPTY 01"]
    assert (a["complaint_volume"], a["resolution_time"], a["topic_concentration"], a["seasonality"]) == (2.0, 15.0, 0.25, 1.0)
    assert (a["anomaly_score"], a["response_rate"], a["recurrence"], a["equity_gap"]) == (2.0, 0.5, 0.5, 2.0)
    assert (b["complaint_volume"], b["resolution_time"], b["topic_concentration"], b["seasonality"], b["response_rate"], b["recurrence"]) == (0.0, -1.0, 0.0, -1.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        pipe.add(FA.recurrence())


def layer(tmp_path):
    square = lambda x, y, s=0.02: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    features = [
        ("BROOKLYN 01", "Polygon", [square(-73.97, 40.72)]),
        ("HOLE", "Polygon", [square(-73.90, 40.60, 0.04), square(-73.89, 40.61, 0.01)]),
        ("TWO", "MultiPolygon", [[square(-73.80, 40.70)], [square(-73.70, 40.80)]]),
        ("OVER", "Polygon", [square(-73.96, 40.73)]),
        ("L", "Polygon", [[[-74.1, 40.5], [-74.06, 40.5], [-74.06, 40.52], [-74.08, 40.52], [-74.08, 40.54], [-74.1, 40.54], [-74.1, 40.5]]]),
    ]
    out = [{"type": "Feature", "properties": {"geography": "community_district", "geography_value": v, "name": v.title()}, "geometry": {"type": k, "coordinates": c}} for v, k, c in features]
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": out}, indent=1))
    return str(path)


def test_spatial(spark, tmp_path):
    bounds = B.load_boundaries(spark, layer(tmp_path))
    assert [r[0] for r in B.list_boundary_values(bounds, "cd").collect()] == ["BROOKLYN 01", "HOLE", "L", "OVER", "TWO"]
    spots = {"in": (40.725, -73.965), "both": (40.735, -73.955), "edge": (40.72, -73.965), "hole": (40.615, -73.885), "ring": (40.605, -73.895),
             "second": (40.81, -73.69), "notch": (40.53, -74.07), "leg": (40.53, -74.09), "none": (None, None), "far": (41.0, -73.6)}
    df = frame(spark, [(k, date(2024, 1, 1), "t", "", "B", "BROOKLYN 01", None, la, lo) for k, (la, lo) in spots.items()])
    got: dict = {}
    for r in S.spatial_join(df, bounds).collect():
        got.setdefault(r.service_request_id, []).append(r.boundary_geography_value)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {"in": ["BROOKLYN 01"], "both": ["BROOKLYN 01", "OVER"], "edge": [None], "hole": [None], "ring": ["HOLE"],
        "second": ["TWO"], "notch": [None], "leg": ["L"], "none": [None], "far": [None]}
    area = {r.geography_value: r.area for r in S.areas(bounds).collect()}
    assert math.isclose(area["HOLE"], 0.0015, rel_tol=1e-9) and math.isclose(area["TWO"], 0.0008, rel_tol=1e-6) and math.isclose(area["L"], 0.0012, rel_tol=1e-6)
    clipped = S.clip_to_bbox(bounds, -73.965, 40.70, -73.955, 40.725)
    assert {r.geography_value: round(r.area, 9) for r in S.areas(clipped).collect()} == {"BROOKLYN 01": 0.00005}
    out = sinks.boundaries_to_geojson(bounds)
    assert len(out["features"]) == 5 and out["features"][0]["geometry"]["type"] == "Polygon" and out["features"][0]["properties"]["name"] == "Brooklyn 01"


def test_distance_weights(spark):
    units = spark.createDataFrame([("A", 40.70, -74.0), ("B", 40.71, -74.0), ("C", 40.80, -74.0)], "unit_id string, latitude double, longitude double")
    got = {(r.unit_a, r.unit_b): 1 / r.w for r in S.distance_weights(units, 2000.0).collect()}
    assert set(got) == {("A", "B"), ("B", "A")} and math.isclose(got["A", "B"], 1111.949, abs_tol=1e-3)
    rows = S.distance_weights(units, 50_000.0, row_standardize=True).groupBy("unit_a").agg(F.sum("w").alias("s")).collect()
    assert len(rows) == 3 and all(math.isclose(r.s, 1.0) for r in rows)


def test_moran_on_a_grid(spark):
    n = 6
    values = spark.createDataFrame([(f"{i}_{j}", 10.0 if j < 3 else 1.0) for i in range(n) for j in range(n)], "unit_id string, value double")
    edges = [(f"{i}_{j}", f"{i + a}_{j + b}", 1.0) for i in range(n) for j in range(n) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < n and 0 <= j + b < n]
    r = S.morans_i(values, spark.createDataFrame(edges, "unit_a string, unit_b string, w double")).first()
    assert math.isclose(r.statistic, 0.8148148148, abs_tol=1e-9) and math.isclose(r.expected, -1 / 35)


def test_sinks_plan_and_cli(spark, tmp_path):
    source = tmp_path / "in.csv"
    lines = ["unique_key,created_date,complaint_type,descriptor,borough,community_district"]
    lines += [f"{i},2024-01-0{i + 1},Rodent,{t},bk,BROOKLYN 01" for i, t in enumerate(["rats in trash", "mouse", "Rat"])]
    source.write_text("\n".join(lines) + "\n")
    out = plans.run_topic_pipeline(spark, str(source), "Rodent", ExportTarget("CSV", tmp_path / "o" / "t.csv"))
    rows = out.read_text().splitlines()
    assert rows[1] == "community_district,BROOKLYN 01,Rodent,rats_seen,2,3,0.666667,1,true" and rows[2].endswith("0.333333,2,false")
    geo = tmp_path / "t.geojson"
    assert cli.main(["topics", "--source", str(source), "--output", str(geo), "--complaint-type", "Rodent", "--format", "geojson", "--boundaries", layer(tmp_path)], spark) == 0
    by = {f["properties"]["geography_value"]: f["properties"] for f in json.loads(geo.read_text())["features"]}
    assert by["BROOKLYN 01"]["dominant_topic"] == "rats_seen" and by["BROOKLYN 01"]["share_of_geography"] == 0.666667 and "dominant_topic" not in by["HOLE"]
    with pytest.raises(ValueError):
        plans.run_topic_pipeline(spark, str(source), "Rodent", ExportTarget("geojson", geo))
    requests = plans.fetch_service_requests(spark, str(source), target=ExportTarget("csv", tmp_path / "snap.csv"))
    assert (tmp_path / "snap.csv").read_text().splitlines()[1].startswith("0,2024-01-01,Rodent,rats in trash,BROOKLYN,BROOKLYN 01,,")
    summary = plans.topic_summaries(spark, str(source), "Rodent")
    card = sinks.export_report_card(ExportTarget("md", tmp_path / "r.md"), summary, A.analyze_resolution_gaps(requests))
    text = card.read_text()
    assert "- Rodent: rats_seen (2/3, 66.7%)" in text and "- Rodent: resolution rate 0.0%, unresolved 3/3" in text and "- No anomaly flags" in text


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    rows = [(f"2024-01-0{1 + i % 4} 10:00:00", "ab"[i % 2]) for i in range(40)] + [("2024-03-01 00:00:00", "a")]
    df = spark.createDataFrame(rows, "ts string, kind string").select(F.to_timestamp("ts").alias("ts"), "kind")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = streaming.start_windowed_counts(stream, "ts", ["kind"], str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((str(r.window_start), r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((str(r.window_start), r.kind, r.n) for r in streaming.windowed_counts(df, "ts", ["kind"]).where("window_start < '2024-02-01'").collect())
    assert got == want and len(got) == 4


def test_contexts_given_twice_and_one_reading(spark):
    rows = [(str(i), date(2024, 1, 1 + i), ("a", "b")[i % 2], "x", "P", "Q", None if i % 3 else "done", 40.7, -74.0 + i % 2) for i in range(10)]
    schema = "service_request_id string, created_date date, complaint_type string, descriptor string, borough string, community_district string, resolution_description string, latitude double, longitude double"
    requests = spark.createDataFrame(rows, schema)
    context = ("Q", date(2024, 1, 1), date(2024, 1, 31), 100)
    contexts = spark.createDataFrame([context, context], "geography_id string, window_start date, window_end date, population long")
    pipe = FA.Pipeline((FA.complaint_volume(), FA.resolution_time("mean"), FA.topic_concentration(), FA.response_rate(), FA.recurrence()))
    out = pipe.run(requests, contexts, "community_district")
    got = out.collect()
    assert len(got) == 2 and got[0] == got[1]
    r = got[0]
    assert (r.complaint_volume, r.topic_concentration, r.response_rate, r.recurrence) == (10.0, 0.5, 0.4, 1.0)
    assert r.resolution_time == sum((date(2024, 1, 31) - date(2024, 1, 1 + i)).days for i in (0, 3, 6, 9)) / 4
    own = FA.Pipeline((FA.complaint_volume(), FA.Factor("last", lambda: F.col("_last"), lambda: (F.max("service_request_id").alias("_last"),))))
    assert own.run(requests, contexts, "community_district").first().last == "9"
