"""Registered queries over the driver's tables and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, streaming
from .config import AnalysisWindow, GeographyFilter, ServiceRequestFilter, TopicQuery
from .functions import normalize as N
from .functions.constants import BOROUGH_ALIASES
from .operators import aggregate as A
from .operators import factors as FA
from .operators import panel as P
from .operators import spatial as S
from .operators import timeseries as TS
from .operators import topics as T
from .sources import requests as R
from .sources.files import stored
from .sources.tables import requests_lines, requests_orders, table
from .stats import causal, inequality, regression, series, spatial_models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, days: tuple[str, ...] = ()):
    """Register a query under its name, with its SQL if there is one.

    The columns named in ``days`` come back as ISO text, which reads the same from any engine.
    """

    def add(f):
        key = name or f.__name__
        QUERIES[key] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("date").cast("string") for c in days})) if days else f
        if sql is not None:
            text = ", ".join(f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in days)
            ORACLES[key] = f"SELECT * REPLACE ({text}) FROM ({sql})" if days else sql
        return f

    return add


# -- shared SQL -------------------------------------------------------------
REQ = """req AS (SELECT CAST(o_orderkey AS VARCHAR) AS service_request_id, CAST(o_orderdate AS DATE) AS created_date,
  o_orderpriority AS complaint_type, c_mktsegment AS descriptor, r_name AS borough, n_name AS community_district,
  CASE WHEN o_orderstatus = 'F' THEN 'F' END AS resolution_description,
  40.5::DOUBLE + (o_custkey % 400) / 1000.0::DOUBLE AS latitude, -74.2::DOUBLE + (o_custkey % 500) / 1000.0::DOUBLE AS longitude
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LINES = """lines AS (SELECT CAST(l_shipdate AS DATE) AS created_date, p_type AS complaint_type, p_name AS descriptor, r_name AS borough,
  n_name AS community_district FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
RULES = {"STANDARD": (("rods", ("hot rod", "rod")), ("warm", ("red", "hot")), ("fasteners", ("bolt", "gear")), ("large_things", ("large",)))}
QUERY = TopicQuery("STANDARD")
TOPICS = f"""WITH {LINES}, t AS (SELECT *, CASE WHEN contains(descriptor, 'hot rod') OR contains(' ' || descriptor || ' ', ' rod ') THEN 'rods'
  WHEN regexp_matches(descriptor, '\\b(red|hot)\\b') THEN 'warm' WHEN regexp_matches(descriptor, '\\b(bolt|gear)\\b') THEN 'fasteners'
  WHEN regexp_matches(descriptor, '\\blarge\\b') THEN 'large_things' ELSE 'other' END AS topic FROM lines WHERE complaint_type = 'STANDARD')"""


def summary_sql(geography: str) -> str:
    return f"""{TOPICS}, c AS (SELECT {geography} AS geography_value, complaint_type, topic, count(*) AS complaint_count FROM t GROUP BY ALL),
  s AS (SELECT '{geography}' AS geography, *, CAST(sum(complaint_count) OVER (PARTITION BY geography_value, complaint_type) AS BIGINT) AS geography_total_count,
    row_number() OVER (PARTITION BY geography_value, complaint_type ORDER BY complaint_count DESC, topic) AS topic_rank FROM c)
  SELECT geography, geography_value, complaint_type, topic, complaint_count, geography_total_count,
    round(complaint_count / geography_total_count, 9) AS share_of_geography, topic_rank, topic_rank = 1 AS is_dominant_topic FROM s"""


def assigned_lines(spark, d) -> DataFrame:
    return T.extract_topics(requests_lines(spark, d), QUERY, RULES)


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles to a fixed number of places, whole numbers to long: comparable with SQL."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = F.round(c, places) + F.lit(0.0)
        elif kind in ("int", "smallint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def one_row(spark: SparkSession, values: dict, names: list[str]) -> DataFrame:
    """Scalars of a driver-side result as a row."""
    return spark.createDataFrame([tuple(float(values[n]) if values[n] is not None else None for n in names)], ", ".join(f"{n} double" for n in names))


def long_rows(spark: SparkSession, values: dict[str, float], key: str = "unit_id", value: str = "value") -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], f"{key} string, {value} double")


# -- sources, filters and normalisers ---------------------------------------
@query(f"""WITH {REQ} SELECT service_request_id, created_date, complaint_type, borough FROM req
WHERE created_date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28' AND borough = 'ASIA' AND lower(complaint_type) IN ('1-urgent', '2-high')""", days=('created_date',))
def filter_requests(spark, d):
    f = ServiceRequestFilter(date(1996, 3, 1), date(1998, 2, 28), GeographyFilter("borough", "asia"), ("1-URGENT", "2-high"))
    return requests_orders(spark, d).where(f.condition()).select("service_request_id", "created_date", "complaint_type", "borough")


@query(f"""WITH {REQ} SELECT service_request_id, latitude, longitude FROM req WHERE longitude BETWEEN -74.1505 AND -74.0005 AND latitude BETWEEN 40.6005 AND 40.7005""")
def bbox_slice(spark, d):
    return R.in_bbox(requests_orders(spark, d), -74.1505, 40.6005, -74.0005, 40.7005).select("service_request_id", "latitude", "longitude")


@query("""WITH x AS (SELECT p_partkey, '  ' || upper(p_name) || '!! ' || p_type || '#' || p_size AS raw FROM part)
SELECT p_partkey, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS text, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS collapsed FROM x""")
def normalize_text(spark, d):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("!! "), F.col("p_type"), F.lit("#"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", N.topic_text(raw).alias("text"), N.collapse_space(raw).alias("collapsed"))


_ALIAS_SQL = "CASE lower(s) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BOROUGH_ALIASES.items()) + " END"
_RAW_BORO = "CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN ' bk ' WHEN 1 THEN 'Kings' WHEN 2 THEN 'new  york' WHEN 3 THEN 'SI' WHEN 4 THEN 'Queens' WHEN 5 THEN 'the  Bronx' ELSE c_mktsegment END"


@query(f"""WITH x AS (SELECT c_custkey, trim(regexp_replace({_RAW_BORO}, '\\s+', ' ', 'g')) AS s FROM customer)
SELECT c_custkey, coalesce({_ALIAS_SQL}, upper(s)) AS borough FROM x""")
def normalize_borough(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.borough(F.expr(_RAW_BORO)).alias("borough"))


_RAW_CD = "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN concat(CAST(c_custkey % 18 AS STRING), ' bk') WHEN 1 THEN concat('Queens  ', CAST(c_custkey % 15 AS STRING)) WHEN 2 THEN '3 nowhere' WHEN 3 THEN 'Unspecified' ELSE concat('new york 0', CAST(c_custkey % 10 AS STRING)) END"


@query(f"""WITH x AS (SELECT c_custkey, trim(regexp_replace({_RAW_CD.replace('STRING', 'VARCHAR')}, '\\s+', ' ', 'g')) AS v FROM customer),
y AS (SELECT *, regexp_extract(v, '^([0-9]{{1,2}}) (.+)$', 1) AS n1, regexp_extract(v, '^([0-9]{{1,2}}) (.+)$', 2) AS b1,
  regexp_extract(v, '^(.+) ([0-9]{{1,2}})$', 2) AS n2, regexp_extract(v, '^(.+) ([0-9]{{1,2}})$', 1) AS b2 FROM x),
z AS (SELECT *, CASE WHEN n1 <> '' THEN n1 ELSE n2 END AS n, CASE WHEN n1 <> '' THEN b1 ELSE b2 END AS s FROM y)
SELECT c_custkey, CASE WHEN n <> '' AND {_ALIAS_SQL} IS NOT NULL THEN {_ALIAS_SQL} || ' ' || lpad(CAST(CAST(n AS INT) AS VARCHAR), 2, '0') ELSE v END AS district FROM z""")
def normalize_district(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.community_district(F.expr(_RAW_CD)).alias("district"))


_LAT = "CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'NaN' WHEN 2 THEN '0' WHEN 3 THEN '39.5' ELSE CAST(40.5 + (c_custkey % 400) / 1000.0 AS STRING) END"
_LON = "CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '' WHEN 1 THEN '-74.0' WHEN 2 THEN '0' ELSE '-74.0' END"


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 > 3 THEN round(40.5 + (c_custkey % 400) / 1000.0, 6)::DOUBLE END AS latitude,
CASE WHEN c_custkey % 6 > 3 THEN -74.0::DOUBLE END AS longitude,
CASE c_custkey % 6 WHEN 1 THEN 'latitude and longitude must come together' WHEN 3 THEN 'latitude out of range' END AS error FROM customer""")
def coordinate_pairs(spark, d):
    lat, lon, error = N.coordinate_pair(F.expr(_LAT), F.expr(_LON))
    return table(spark, d, "customer").select("c_custkey", F.round(lat, 6).alias("latitude"), lon.alias("longitude"), error.alias("error"))


# -- topics -----------------------------------------------------------------
@query(f"{TOPICS} SELECT topic, descriptor, count(*) AS n FROM t GROUP BY ALL")
def topics_rules(spark, d):
    return assigned_lines(spark, d).groupBy("topic", "descriptor").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT descriptor AS topic, count(*) AS n FROM lines WHERE complaint_type = 'PROMO' GROUP BY ALL")
def topics_fallback(spark, d):
    rows = T.extract_topics(requests_lines(spark, d), TopicQuery("PROMO", 1000))
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


@query(f"""WITH {REQ}, t AS (SELECT lower(descriptor) AS topic, service_request_id FROM req WHERE complaint_type = '5-LOW'),
k AS (SELECT topic FROM t GROUP BY topic ORDER BY count(*) DESC, min(service_request_id), topic LIMIT 3)
SELECT CASE WHEN topic IN (SELECT topic FROM k) THEN topic ELSE 'other' END AS topic, count(*) AS n FROM t GROUP BY 1""")
def topics_topn(spark, d):
    rows = T.extract_topics(requests_orders(spark, d), TopicQuery("5-LOW", 3))
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


@query(summary_sql("community_district"))
def agg_district(spark, d):
    return rounded(A.aggregate_by_geography(assigned_lines(spark, d), "community_district"))


@query(summary_sql("borough"))
def agg_borough(spark, d):
    return rounded(A.aggregate_by_geography(assigned_lines(spark, d), "borough"))


@query(f"""{TOPICS} SELECT 'STANDARD' AS complaint_type, count(*) AS total_records, count(*) FILTER (topic <> 'other') AS matched_records,
count(*) FILTER (topic = 'other') AS other_records, round(count(*) FILTER (topic <> 'other') / count(*), 9) AS coverage_rate FROM t""")
def topic_coverage(spark, d):
    return rounded(T.topic_coverage(requests_lines(spark, d), QUERY, RULES).drop("top_unmatched_descriptors"))


@query(f"{TOPICS} SELECT descriptor, count(*) AS n FROM t WHERE topic = 'other' GROUP BY 1 ORDER BY n DESC, descriptor LIMIT 10")
def unmatched_topk(spark, d):
    return T.unmatched_descriptors(assigned_lines(spark, d), 10).select("descriptor", "n")


@query(f"""WITH {REQ}, i AS (SELECT DISTINCT service_request_id AS id FROM req WHERE resolution_description IS NOT NULL AND complaint_type = '1-URGENT'),
f AS (SELECT req.*, resolution_description IS NOT NULL AND CAST(service_request_id AS BIGINT) % 3 > 0 OR i.id IS NOT NULL AS ok FROM req LEFT JOIN i ON id = service_request_id)
SELECT 'borough' AS geography, borough AS geography_value, complaint_type, count(*) AS total_request_count, count(*) FILTER (ok) AS resolved_request_count,
count(*) FILTER (NOT ok) AS unresolved_request_count, round(count(*) FILTER (NOT ok) / count(*), 9) AS unresolved_share,
round(count(*) FILTER (ok) / count(*), 9) AS resolution_rate FROM f GROUP BY ALL""")
def resolution_gaps(spark, d):
    rows = requests_orders(spark, d)
    hidden = rows.withColumn("resolution_description", F.when(F.col("service_request_id").cast("long") % 3 > 0, F.col("resolution_description")))
    return rounded(A.analyze_resolution_gaps(hidden, rows.where("complaint_type = '1-URGENT'")))


@query(f"""WITH s AS ({summary_sql('community_district')}), z AS (SELECT *, avg(complaint_count) OVER w AS m, stddev_pop(complaint_count) OVER w AS sd FROM s WINDOW w AS (PARTITION BY geography, complaint_type))
SELECT geography, geography_value, complaint_type, topic, complaint_count, geography_total_count, share_of_geography, topic_rank,
round(CASE WHEN sd > 0 THEN (complaint_count - m) / sd ELSE 0 END, 6) AS z_score, sd > 0 AND abs(complaint_count - m) / sd >= 2 AS is_anomaly,
CAST(30 AS BIGINT) AS window_days, CAST(2 AS DOUBLE) AS anomaly_threshold FROM z""")
def anomalies(spark, d):
    out = A.detect_anomalies(A.aggregate_by_geography(assigned_lines(spark, d), "community_district"), AnalysisWindow(30))
    return rounded(out.withColumn("z_score", F.round("z_score", 6)))


@query(f"WITH {REQ} SELECT borough AS geography_value, complaint_type, count(*) AS n FROM req GROUP BY ALL ORDER BY n DESC, borough, complaint_type LIMIT 10")
def top_types(spark, d):
    return A.top_counts(requests_orders(spark, d), ["borough", "complaint_type"], 10).withColumnRenamed("borough", "geography_value")


@query(f"""WITH {REQ} SELECT community_district AS geography_value, count(*) AS n, round(avg(CASE WHEN resolution_description IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS resolution_rate
FROM req GROUP BY ALL HAVING count(*) >= 500""")
def resolution_rates(spark, d):
    return rounded(A.resolution_rates(requests_orders(spark, d), "community_district", 500))


@query(f"""WITH {REQ} SELECT borough AS geography_value, count(*) AS n, count(DISTINCT complaint_type) AS n_types, min(created_date) AS first_date,
max(created_date) AS last_date, count(latitude) AS n_latitude, count(resolution_description) AS n_resolved FROM req GROUP BY ALL""", days=('first_date', 'last_date'))
def catalogue(spark, d):
    return A.catalogue(requests_orders(spark, d))


# -- time -------------------------------------------------------------------
_ENDS = {
    "d": "created_date", "w": "CAST(date_trunc('week', created_date) AS DATE) + 6", "m": "last_day(created_date)",
    "q": "CAST(date_trunc('quarter', created_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)", "y": "make_date(year(created_date), 12, 31)",
}
for _f, _end in _ENDS.items():
    query(f"WITH {REQ} SELECT CAST({_end} AS DATE) AS period, complaint_type, count(*) AS n FROM req GROUP BY ALL", f"timeseries_{_f}", ("period",))(
        lambda spark, d, f=_f: TS.period_counts(requests_orders(spark, d), f, ["complaint_type"])
    )


@query(f"""WITH {REQ} SELECT last_day(created_date) AS period, community_district, count(*) FILTER (complaint_type = '1-URGENT') AS "1-URGENT",
count(*) FILTER (complaint_type = '5-LOW') AS "5-LOW" FROM req GROUP BY ALL""", days=('period',))
def panel_counts(spark, d):
    return TS.to_panel(requests_orders(spark, d), "ME", "community_district", ["1-URGENT", "5-LOW"])


@query(f"{TOPICS} SELECT last_day(created_date) AS period, topic, count(*) AS n FROM t GROUP BY ALL", days=('period',))
def topic_timeseries(spark, d):
    return TS.period_counts(assigned_lines(spark, d), "M", ["topic"])


@query(f"""WITH {REQ}, s AS (SELECT created_date AS day, count(*) AS n FROM req WHERE borough = 'ASIA' GROUP BY ALL),
g AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS period FROM s)
SELECT period, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN s ON day = period""", days=('period',))
def resample_zero(spark, d):
    counts = TS.period_counts(requests_orders(spark, d).where("borough = 'ASIA'"), "D", [])
    return TS.resample_and_fill(counts, "D")


@query(f"""WITH {REQ}, s AS (SELECT borough, created_date AS period, count(*) AS n FROM req GROUP BY ALL)
SELECT *, round(avg(n) OVER (PARTITION BY borough ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 9) AS rolling_n FROM s""", days=('period',))
def rolling7(spark, d):
    counts = TS.period_counts(requests_orders(spark, d), "D", ["borough"])
    return rounded(TS.rolling_mean(counts, ["borough"], "period", "n"))


@query("""WITH g AS (SELECT w.range AS weekday, h.range AS hour FROM range(7) w, range(24) h), c AS (SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL)
SELECT g.weekday, g.hour, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (weekday, hour)""")
def heatmap(spark, d):
    return TS.heatmap(table(spark, d, "events"), "ts")


@query(f"""WITH {REQ}, c AS (SELECT last_day(created_date) AS period, borough, count(*) AS n FROM req GROUP BY ALL)
SELECT period, borough, n, round(n / sum(n) OVER (PARTITION BY period), 9) AS share FROM c""", days=('period',))
def monthly_share(spark, d):
    return rounded(TS.period_shares(requests_orders(spark, d), "M", "borough"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def top_categories(spark, d):
    return TS.top_categories(table(spark, d, "events"), "event_type", 3)


@query("""SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL""", days=('window_start', 'window_end'))
def streaming_windows(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed_counts(events, "ts", ["event_type"])


@query(f"""WITH {REQ}, c AS (SELECT borough, last_day(created_date) AS period, count(*) AS n FROM req GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY borough ORDER BY period) <= floor(count(*) OVER (PARTITION BY borough) / 2) AS first FROM c),
m AS (SELECT borough, avg(n) FILTER (first) AS a, avg(n) FILTER (NOT first) AS b FROM k GROUP BY 1)
SELECT borough, round(a, 9) AS first_mean, round(b, 9) AS second_mean, round(100 * (b - a) / a, 9) AS change_pct FROM m""")
def half_change(spark, d):
    counts = TS.period_counts(requests_orders(spark, d), "M", ["borough"])
    return rounded(A.half_change(counts, "borough", "period", "n"))


# -- panels -----------------------------------------------------------------
EVENTS = [
    P.TreatmentEvent("first", tuple(f"NATION_{i}" for i in range(5)), date(1998, 6, 15)),
    P.TreatmentEvent("second", ("NATION_4", "NATION_5", "NATION_6", "NATION_7"), date(1999, 3, 10)),
]
PANEL = f"""{REQ}, cell AS (SELECT community_district AS unit_id, strftime(created_date, '%Y-%m') AS period, count(*) AS complaint_count,
  avg(CASE WHEN resolution_description IS NOT NULL THEN 1.0 ELSE 0 END) AS resolution_rate,
  median(CASE WHEN resolution_description IS NOT NULL THEN last_day(created_date) - created_date END) AS median_resolution_days FROM req GROUP BY ALL),
grid AS (SELECT unit_id, period FROM (SELECT DISTINCT unit_id FROM cell), (SELECT DISTINCT period FROM cell)),
ev AS (SELECT 'NATION_' || i AS unit_id, CASE WHEN i < 5 THEN DATE '1998-06-15' ELSE DATE '1999-03-10' END AS treatment_date FROM range(8) AS r(i)),
p AS (SELECT unit_id, period, CAST(coalesce(complaint_count, 0) AS BIGINT) AS complaint_count, coalesce(resolution_rate, 0) AS resolution_rate,
  median_resolution_days, treatment_date, coalesce(CAST(period || '-01' AS DATE) >= treatment_date, false) AS treatment
  FROM grid LEFT JOIN cell USING (unit_id, period) LEFT JOIN ev USING (unit_id))"""


def panel(spark, d) -> DataFrame:
    return P.build_complaint_panel(requests_orders(spark, d), "community_district", "ME", EVENTS)


def stored_panel(spark, d) -> DataFrame:
    """The panel without its map, stored: estimators read it many times."""
    return stored(panel(spark, d).drop("complaint_counts_by_type"), "panel")


PANEL_COLUMNS = ("unit_id", "period", "complaint_count", "resolution_rate", "median_resolution_days", "treatment", "treatment_date")
_PANEL_OUT = "unit_id, period, complaint_count, round(resolution_rate, 9) AS resolution_rate, median_resolution_days, treatment, treatment_date"


@query(f"WITH {PANEL} SELECT {_PANEL_OUT} FROM p", days=('treatment_date',))
def balanced_panel(spark, d):
    return rounded(panel(spark, d).select(*PANEL_COLUMNS))


@query(f"WITH {REQ} SELECT community_district AS unit_id, strftime(created_date, '%Y-%m') AS period, complaint_type, count(*) AS n FROM req GROUP BY ALL")
def panel_type_counts(spark, d):
    return panel(spark, d).select("unit_id", "period", F.explode("complaint_counts_by_type").alias("complaint_type", "n"))


@query(f"WITH {PANEL} SELECT {_PANEL_OUT} FROM p WHERE unit_id IN (SELECT unit_id FROM p WHERE treatment)", days=('treatment_date',))
def treatment_group(spark, d):
    return rounded(P.treatment_group(panel(spark, d)).select(*PANEL_COLUMNS))


@query(f"WITH {PANEL} SELECT {_PANEL_OUT} FROM p WHERE unit_id NOT IN (SELECT unit_id FROM p WHERE treatment)", days=('treatment_date',))
def control_group(spark, d):
    return rounded(P.control_group(panel(spark, d)).select(*PANEL_COLUMNS))


@query(f"WITH {PANEL} SELECT {_PANEL_OUT} FROM p WHERE period BETWEEN '1997-01' AND '1997-12'", days=('treatment_date',))
def filter_periods(spark, d):
    return rounded(P.filter_periods(panel(spark, d), "1997-01", "1997-12").select(*PANEL_COLUMNS))


@query(f"WITH {PANEL} SELECT unit_id, round(avg(complaint_count), 9) AS complaint_count, round(avg(resolution_rate), 9) AS resolution_rate FROM p GROUP BY 1")
def cross_section(spark, d):
    return rounded(P.cross_section(panel(spark, d), ["complaint_count", "resolution_rate"]))


@query(f"WITH {PANEL} SELECT split_part(unit_id, '_', 1) AS borough, period, CAST(sum(complaint_count) AS BIGINT) AS complaint_count FROM p GROUP BY ALL")
def regroup_panel(spark, d):
    return P.regroup_panel(panel(spark, d).withColumn("unit_id", F.translate("unit_id", "_", " ")))


@query(f"""WITH {PANEL}, c AS (SELECT unit_id, avg(complaint_count) AS m FROM p GROUP BY 1)
SELECT unit_id, round(m, 9) AS complaint_count, m >= (SELECT median(m) FROM c) AS upper FROM c""")
def split_at_median(spark, d):
    return rounded(P.split_at_median(P.cross_section(panel(spark, d), ["complaint_count"]), "complaint_count"))


@query(f"""WITH {PANEL}, u AS (SELECT unit_id, median(median_resolution_days) AS m FROM p GROUP BY 1)
SELECT unit_id, m AS median_days, round(m / (SELECT median(median_resolution_days) FROM p), 9) AS equity_ratio FROM u ORDER BY equity_ratio DESC, unit_id LIMIT 5""")
def equity_ratios(spark, d):
    return rounded(P.equity_ratios(panel(spark, d)))


@query(f"WITH {PANEL} SELECT CAST(substr(period, 6, 2) AS BIGINT) AS month, round(avg(complaint_count), 9) AS mean FROM p GROUP BY 1")
def month_means(spark, d):
    return rounded(P.month_means(panel(spark, d), "period", "complaint_count"))


@query(f"WITH {PANEL} SELECT round(var_samp(complaint_count), 6) AS variance, round(avg(ln(1 + complaint_count)), 6) AS mean_log1p FROM p")
def outcome_variance(spark, d):
    return rounded(P.outcome_variance(panel(spark, d), "complaint_count"), 6)


# -- factors ----------------------------------------------------------------
FACTORS = [
    FA.complaint_volume(), FA.resolution_time(), FA.topic_concentration(), FA.seasonality({m: 20.0 + m for m in range(1, 12)}),
    FA.anomaly_score(150.0, 25.0), FA.response_rate(), FA.recurrence(), FA.equity_gap(200.0),
]


def contexts(spark, d) -> DataFrame:
    years = spark.range(1996, 2000).withColumnRenamed("id", "y")
    places = table(spark, d, "nation").select(F.col("n_name").alias("geography_id"), (F.col("n_nationkey") * 1000).cast("long").alias("population"))
    return places.crossJoin(years).select(
        "geography_id", F.make_date(F.col("y").cast("int"), F.lit(1), F.lit(1)).alias("window_start"),
        F.make_date(F.col("y").cast("int"), F.lit(12), F.lit(31)).alias("window_end"), "population",
    )


_SEASON = "CASE month(window_start) " + " ".join(f"WHEN {m} THEN {20.0 + m}" for m in range(1, 12)) + " END"
_FACTOR_SQL = {
    "complaint_volume": "CAST(n AS DOUBLE)", "resolution_time": "round(coalesce(days, -1), 9)", "topic_concentration": "round(coalesce(sq / (n * n), 0), 9)",
    "seasonality": f"round(CASE WHEN {_SEASON} > 0 THEN (n - {_SEASON}) / {_SEASON} ELSE 0 END, 9)", "anomaly_score": "round((n - 150.0) / 25.0, 9)",
    "response_rate": "round(coalesce(rate, 0), 9)", "recurrence": "round(coalesce(again, 0), 9)", "equity_gap": "round(coalesce(days / 200.0, 0), 9)",
}
_FACTOR_BASE = f"""WITH {REQ}, ctx AS (SELECT n_name AS geography_id, make_date(y, 1, 1) AS window_start, make_date(y, 12, 31) AS window_end,
  CAST(n_nationkey * 1000 AS BIGINT) AS population FROM nation, (SELECT CAST(unnest(range(1996, 2000)) AS INT) AS y)),
j AS (SELECT ctx.*, req.* FROM ctx JOIN req ON community_district = geography_id AND created_date BETWEEN window_start AND window_end),
a AS (SELECT geography_id, window_start, count(*) AS n, avg(CASE WHEN resolution_description IS NOT NULL THEN 1.0 ELSE 0 END) AS rate,
  median(CASE WHEN resolution_description IS NOT NULL THEN greatest(window_end - created_date, 0) END) AS days FROM j GROUP BY ALL),
b AS (SELECT geography_id, window_start, CAST(sum(k * k) AS DOUBLE) AS sq FROM (SELECT geography_id, window_start, complaint_type, count(*) AS k FROM j GROUP BY ALL) GROUP BY ALL),
c AS (SELECT geography_id, window_start, avg(CASE WHEN k > 1 THEN 1.0 ELSE 0 END) AS again FROM
  (SELECT geography_id, window_start, round(latitude, 4) AS la, round(longitude, 4) AS lo, count(*) AS k FROM j GROUP BY ALL) GROUP BY ALL),
f AS (SELECT geography_id, window_start, window_end, population, CAST(coalesce(n, 0) AS BIGINT) AS n, rate, days, sq, again FROM ctx LEFT JOIN a USING (geography_id, window_start)
  LEFT JOIN b USING (geography_id, window_start) LEFT JOIN c USING (geography_id, window_start))"""


def _factor_sql(names) -> str:
    return f"{_FACTOR_BASE} SELECT geography_id, window_start, window_end, population, {', '.join(f'{_FACTOR_SQL[n]} AS {n}' for n in names)} FROM f"


@query(_factor_sql(_FACTOR_SQL), days=('window_start', 'window_end'))
def factors_fused(spark, d):
    pipe = FA.Pipeline()
    for f in FACTORS:
        pipe = pipe.add(f)
    return rounded(pipe.run(requests_orders(spark, d), contexts(spark, d), "community_district"))


for _factor in FACTORS:
    query(_factor_sql([_factor.name]), f"factor_{_factor.name}", ("window_start", "window_end"))(
        lambda spark, d, f=_factor: rounded(FA.Pipeline((f,)).run(requests_orders(spark, d), contexts(spark, d), "community_district"))
    )


@query(f"""{_FACTOR_BASE} SELECT geography_id, window_start, window_end, population, round(CASE WHEN population > 0 THEN n / population * 10000.0 ELSE n END, 9) AS complaint_volume FROM f""", days=('window_start', 'window_end'))
def factor_per_capita(spark, d):
    return rounded(FA.Pipeline((FA.complaint_volume(per_capita=True),)).run(requests_orders(spark, d), contexts(spark, d), "community_district"))


# -- space ------------------------------------------------------------------
def grid_boundaries(spark) -> DataFrame:
    """25 rectangles whose edges no request lies on."""
    k = spark.range(25)
    x, y = F.lit(-74.2005) + F.col("id") % 5 * 0.1, F.lit(40.5005) + F.floor(F.col("id") / 5) * 0.06
    point = lambda a, b: F.struct((x + a).alias("lon"), (y + b).alias("lat"))
    ring = F.array(point(0.0, 0.0), point(0.1, 0.0), point(0.1, 0.06), point(0.0, 0.06), point(0.0, 0.0))
    return k.select(
        F.lit("community_district").alias("geography"), F.concat(F.lit("NATION_"), F.col("id").cast("string")).alias("geography_value"),
        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("properties"), F.lit("Polygon").alias("geometry_type"),
        F.array(F.array(ring)).alias("polygons"),
    )


GRID = """g AS (SELECT 'NATION_' || i AS v, -74.2005 + (i % 5) * 0.1 AS x, 40.5005 + (i // 5) * 0.06 AS y FROM range(25) AS r(i))"""
JOINED = f"""WITH {REQ}, {GRID}, j AS (SELECT req.*, v FROM req LEFT JOIN g ON longitude > x AND longitude < x + 0.1 AND latitude > y AND latitude < y + 0.06)"""


@query(f"{JOINED} SELECT service_request_id, v AS boundary_geography_value FROM j")
def spatial_join(spark, d):
    return S.spatial_join(requests_orders(spark, d), grid_boundaries(spark)).select("service_request_id", "boundary_geography_value")


@query(f"""{JOINED}, c AS (SELECT v, count(*) AS n_inside, count(*) FILTER (community_district = v) AS n_agree FROM j WHERE v IS NOT NULL GROUP BY v)
SELECT g.v AS geography_value, CAST(coalesce(n_inside, 0) AS BIGINT) AS n_inside, CAST(coalesce(n_agree, 0) AS BIGINT) AS n_agree,
CAST(coalesce(n_inside - n_agree, 0) AS BIGINT) AS n_differ FROM g LEFT JOIN c USING (v)""")
def spatial_qa(spark, d):
    return S.location_check(requests_orders(spark, d), grid_boundaries(spark))


@query(f"""WITH s AS ({summary_sql('community_district')}), {GRID} SELECT v AS geography_value, topic, complaint_count, topic_rank FROM g LEFT JOIN s ON v = s.geography_value""")
def summaries_on_boundaries(spark, d):
    summaries = A.aggregate_by_geography(assigned_lines(spark, d), "community_district")
    out = S.summaries_on_boundaries(grid_boundaries(spark), summaries)
    return rounded(out.select("geography_value", "topic", "complaint_count", "topic_rank"))


@query(f"{JOINED} SELECT 'stated' AS \"view\", community_district AS place, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'located', v, count(*) FROM j WHERE v IS NOT NULL GROUP BY ALL")
def two_views(spark, d):
    rows = S.spatial_join(requests_orders(spark, d), grid_boundaries(spark))
    stated = rows.groupBy(F.col("community_district").alias("place")).agg(F.count("*").alias("n"))
    located = rows.where("boundary_geography_value is not null").groupBy(F.col("boundary_geography_value").alias("place")).agg(F.count("*").alias("n"))
    return S.two_views(stated, located, ("stated", "located"))


@query(f"WITH {GRID} SELECT v AS unit_id, round((2 * (y + 0.06) + 3 * y) / 5, 9) AS latitude, round((2 * (x + 0.1) + 3 * x) / 5, 9) AS longitude FROM g")
def centroids(spark, d):
    return rounded(S.centroids(grid_boundaries(spark)))


@query(f"""{JOINED}, c AS (SELECT v, count(*) AS n FROM j WHERE v IS NOT NULL GROUP BY v) SELECT g.v AS geography_value, round(0.006::DOUBLE, 9) AS area, CAST(coalesce(n, 0) AS BIGINT) AS n,
round(coalesce(n, 0) / (0.006 + 1e-9), 2) AS density FROM g LEFT JOIN c USING (v)""")
def density(spark, d):
    rows = S.spatial_join(requests_orders(spark, d), grid_boundaries(spark))
    counts = rows.groupBy(F.col("boundary_geography_value").alias("geography_value")).agg(F.count("*").alias("n"))
    out = S.density(counts.where("geography_value is not null"), grid_boundaries(spark))
    return rounded(out.withColumn("density", F.round("density", 2)))


@query(f"WITH {GRID} SELECT v AS geography_value FROM g WHERE x < -74.05 AND x + 0.1 > -74.15 AND y < 40.6 AND y + 0.06 > 40.52")
def clip_boundaries(spark, d):
    return S.clip_to_bbox(grid_boundaries(spark), -74.15, 40.52, -74.05, 40.6).select("geography_value")


_UNITS = "u AS (SELECT v AS unit_id, (2 * (y + 0.06) + 3 * y) / 5 AS la, (2 * (x + 0.1) + 3 * x) / 5 AS lo FROM g)"
_HAV = """2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2))))"""
WEIGHTS = f"""{GRID}, {_UNITS}, e AS (SELECT a.unit_id AS unit_a, b.unit_id AS unit_b, {_HAV} AS d FROM u a, u b WHERE a.unit_id <> b.unit_id),
w AS (SELECT unit_a, unit_b, (1 / d) / sum(1 / d) OVER (PARTITION BY unit_a) AS w FROM e WHERE d > 0 AND d <= 9000)"""


def weights(spark) -> DataFrame:
    return S.distance_weights(S.centroids(grid_boundaries(spark)), 9000.0, row_standardize=True)


@query(f"WITH {WEIGHTS} SELECT unit_a, unit_b, round(w, 9) AS w FROM w")
def distance_weights(spark, d):
    return rounded(weights(spark))


def volumes(spark, d) -> DataFrame:
    return requests_orders(spark, d).groupBy(F.col("community_district").alias("unit_id")).agg(F.count("*").cast("double").alias("value"))


VOLUMES = f"{REQ}, {WEIGHTS}, v AS (SELECT community_district AS unit_id, CAST(count(*) AS DOUBLE) AS value FROM req GROUP BY ALL)"


@query(f"WITH {VOLUMES} SELECT v.unit_id, round(coalesce(sum(w * b.value), 0), 9) AS spatial_lag FROM v LEFT JOIN w ON unit_a = v.unit_id LEFT JOIN v b ON b.unit_id = unit_b GROUP BY 1")
def factor_spatial_lag(spark, d):
    return rounded(FA.spatial_lag(volumes(spark, d), weights(spark)))


_MORAN = f"WITH {VOLUMES}, m AS (SELECT *, value - avg(value) OVER () AS z, stddev_pop(value) OVER () AS sd, count(*) OVER () AS n FROM v)"


@query(f"""{_MORAN} SELECT round((SELECT sum(w * a.z * b.z) / sum(w) FROM w JOIN m a ON a.unit_id = unit_a JOIN m b ON b.unit_id = unit_b) / (SELECT avg(z * z) FROM m), 9) AS statistic,
round(-1 / (count(*) - 1), 9) AS expected FROM m""")
def moran_stat(spark, d):
    return rounded(S.morans_i(volumes(spark, d), weights(spark)))


@query(f"""{_MORAN}, l AS (SELECT unit_a AS unit_id, sum(w * z / sd) AS lag FROM w JOIN m ON unit_id = unit_b GROUP BY 1)
SELECT unit_id, round((n - 1) / n * z / sd * coalesce(lag, 0), 9) AS local_statistic,
CASE WHEN z > 0 AND coalesce(lag, 0) > 0 THEN 'HH' WHEN z <= 0 AND coalesce(lag, 0) > 0 THEN 'LH' WHEN z <= 0 THEN 'LL' ELSE 'HL' END AS quadrant FROM m LEFT JOIN l USING (unit_id)""")
def local_moran_stat(spark, d):
    return rounded(S.local_morans_i(volumes(spark, d), weights(spark)))


@query(f"""WITH {GRID}, {_UNITS}, s AS (SELECT CASE WHEN unit_id IN ('NATION_0', 'NATION_1', 'NATION_6') THEN -1 ELSE 1 END *
  (SELECT {_HAV.replace('a.', 'c.').replace('b.', 'u.')} FROM (SELECT u.la AS la, u.lo AS lo) c0, (SELECT 40.62 AS la, -74.0 AS lo) c) / 1000 AS d FROM u)
SELECT CAST(floor((d + 15) / 0.5) AS BIGINT) AS band, count(*) AS n FROM s WHERE d >= -15 AND d < 15 GROUP BY 1""")
def distance_bands(spark, d):
    return S.distance_bands(S.centroids(grid_boundaries(spark)), 40.62, -74.0, ["NATION_0", "NATION_1", "NATION_6"])


@query()
def geojson_features(spark, d):
    summaries = A.aggregate_by_geography(assigned_lines(spark, d), "community_district")
    return sinks.feature_collection(grid_boundaries(spark), summaries).select("geography_value", "geometry", "topic.*")


# -- statistics in SQL form --------------------------------------------------
@query(f"""WITH {REQ}, u AS (SELECT community_district, borough, count(*) * 1000.0 / (1 + count(DISTINCT latitude)) AS value, CAST(1000 + 10 * count(DISTINCT latitude) AS DOUBLE) AS population FROM req GROUP BY ALL),
m AS (SELECT sum(value * population) / sum(population) AS mu, sum(population) AS pop FROM u),
b AS (SELECT borough, sum(population) AS gp, sum(value * population) / sum(population) AS gm FROM u GROUP BY 1),
r AS (SELECT (SELECT sum(population / pop * value / mu * ln(value / mu)) FROM u, m) AS t, (SELECT sum(gp / pop * gm / mu * ln(gm / mu)) FROM b, m) AS g, (SELECT count(*) FROM u) AS n)
SELECT round(t, 9) AS total, round(g, 9) AS between_group, round(t - g, 9) AS within_group, n AS n_units FROM r""")
def theil(spark, d):
    units = requests_orders(spark, d).groupBy("community_district", F.col("borough").alias("grp")).agg(
        F.count("*").alias("n"), F.countDistinct("latitude").alias("k")
    )
    units = units.select("grp", (F.col("n") * 1000.0 / (1 + F.col("k"))).alias("value"), (1000 + 10 * F.col("k")).cast("double").alias("population"))
    return rounded(inequality.theil(units))


_CELLS = f"""WITH {PANEL}, c AS (SELECT strftime(treatment_date, '%Y-%m') AS cohort, period, count(*) AS n, avg(complaint_count) AS m, var_samp(complaint_count) AS v FROM p GROUP BY ALL),
gt AS (SELECT t.cohort AS "group", t.period, t.m - k.m AS att, greatest(sqrt(coalesce(t.v, 0) / t.n + coalesce(k.v, 0) / k.n), 1e-10) AS se FROM c t JOIN c k ON t.period = k.period AND k.cohort IS NULL WHERE t.cohort IS NOT NULL)"""


@query(f'{_CELLS} SELECT "group", period, round(att, 9) AS att, round(se, 9) AS se FROM gt')
def did_att_gt(spark, d):
    return rounded(causal.group_time_effects(stored_panel(spark, d), "complaint_count"))


@query(f"""{_CELLS} SELECT round(sum(att / greatest(se * se, 1e-20)) / sum(1 / greatest(se * se, 1e-20)), 6) AS aggregated_att, round(1 / sqrt(sum(1 / greatest(se * se, 1e-20))), 6) AS aggregated_se,
CAST(count(DISTINCT "group") AS DOUBLE) AS n_groups, CAST(count(DISTINCT period) AS DOUBLE) AS n_periods FROM gt""")
def did_aggregate(spark, d):
    found = causal.staggered_did(stored_panel(spark, d), "complaint_count")
    return rounded(one_row(spark, found, ["aggregated_att", "aggregated_se", "n_groups", "n_periods"]), 6)


@query(f"""{_CELLS}, b AS (SELECT "group", max(period) AS base FROM gt WHERE period < "group" GROUP BY 1), z AS (SELECT gt."group", att AS att0 FROM gt JOIN b ON gt."group" = b."group" AND period = base)
SELECT gt."group", period, round(att - att0, 9) + 0.0 AS att FROM gt JOIN z ON gt."group" = z."group" """)
def att_gt(spark, d):
    return rounded(causal.att_gt(stored_panel(spark, d), "complaint_count"))


@query(f"""WITH {PANEL}, o AS (SELECT period, row_number() OVER (ORDER BY period) AS k FROM (SELECT DISTINCT period FROM p)),
m AS (SELECT period, avg(complaint_count) AS mc FROM p WHERE treatment_date IS NULL GROUP BY 1),
x AS (SELECT o.k - s.k AS rel, complaint_count - mc AS gap FROM p JOIN o USING (period) JOIN m USING (period) JOIN o s ON s.period = strftime(treatment_date, '%Y-%m')),
c AS (SELECT rel, avg(gap) AS c, CASE WHEN count(*) > 1 THEN stddev_samp(gap) / sqrt(count(*)) ELSE 0 END AS se FROM x WHERE rel BETWEEN -5 AND 5 GROUP BY 1),
r AS (SELECT rel, c - (SELECT c FROM c WHERE rel = -1) AS c, se FROM c)
SELECT rel AS relative_period, round(c, 9) AS coefficient, round(se, 9) AS std_error, round(c - 1.96 * se, 9) AS ci_lower, round(c + 1.96 * se, 9) AS ci_upper FROM r""")
def event_study(spark, d):
    return rounded(causal.event_study_effects(stored_panel(spark, d), "complaint_count"))


@query(f"""WITH {PANEL}, w AS (SELECT complaint_count - avg(complaint_count) OVER (PARTITION BY unit_id) - avg(complaint_count) OVER (PARTITION BY period) + avg(complaint_count) OVER () AS y,
resolution_rate - avg(resolution_rate) OVER (PARTITION BY unit_id) - avg(resolution_rate) OVER (PARTITION BY period) + avg(resolution_rate) OVER () AS x, unit_id FROM p),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx FROM w), g AS (SELECT unit_id, sum(x * (y - b * x)) AS s FROM w, b GROUP BY 1)
SELECT round(b, 6) AS coefficient, round(sqrt((SELECT sum(s * s) FROM g)) / xx, 6) AS std_error FROM b""")
def panel_fe(spark, d):
    found = regression.panel_fixed_effects(stored_panel(spark, d), "complaint_count", ["resolution_rate"], time_effects=True)
    values = {"coefficient": found["coefficients"]["resolution_rate"], "std_error": found["std_errors"]["resolution_rate"]}
    return rounded(one_row(spark, values, list(values)), 6)


@query(f"""WITH {PANEL}, s AS (SELECT unit_id, period, complaint_count AS y, row_number() OVER (PARTITION BY unit_id ORDER BY period) - 1 AS t FROM p),
a AS (SELECT unit_id, regr_slope(y, t) AS b, regr_intercept(y, t) AS i FROM s WHERE period < '1998-06' GROUP BY 1), z AS (SELECT unit_id, regr_slope(y, t) AS b, regr_intercept(y, t) AS i FROM s WHERE period >= '1998-06' GROUP BY 1)
SELECT unit_id, round(a.b, 6) + 0.0 AS pre_trend, round(z.b, 6) + 0.0 AS post_trend, round(z.i - a.i, 6) + 0.0 AS level_change, round(z.b - a.b, 6) + 0.0 AS trend_change FROM a JOIN z USING (unit_id)""")
def its(spark, d):
    found = regression.interrupted_time_series(panel(spark, d), "complaint_count", "period", "1998-06", ["unit_id"])
    return rounded(found.drop("p_value_level", "p_value_trend"), 6)




@query("""WITH a AS (SELECT o_custkey % 100 AS x, o_totalprice AS y FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey % 100 AS x, o_totalprice AS y FROM orders WHERE o_orderstatus = 'O'),
m AS (SELECT (SELECT avg(y) FROM a) AS ya, (SELECT avg(y) FROM b) AS yb, (SELECT avg(x) FROM a) AS xa, (SELECT avg(x) FROM b) AS xb, (SELECT regr_slope(y, x) FROM b) AS bb)
SELECT round(ya - yb, 4) AS total_gap, round((xa - xb) * bb, 4) AS explained, round(ya - yb - (xa - xb) * bb, 4) AS unexplained FROM m""")
def oaxaca(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("x"), F.col("o_totalprice").alias("y"), "o_orderstatus")
    found = regression.oaxaca_blinder(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), "y", ["x"])
    return rounded(one_row(spark, found, ["total_gap", "explained", "unexplained"]), 4)


@query("""WITH r AS (SELECT (o_custkey * 919 % 1000) - 500 + 0.5 AS x, o_totalprice / 1000 AS y FROM orders), w AS (SELECT *, 1 - abs(x) / 200 AS w, x >= 0 AS s FROM r WHERE abs(x) <= 200),
m AS (SELECT s, sum(w) AS a, sum(w * x) AS b, sum(w * x * x) AS c, sum(w * y) AS p, sum(w * x * y) AS q FROM w GROUP BY 1), i AS (SELECT s, (c * p - b * q) / (a * c - b * b) AS i FROM m)
SELECT round((SELECT i FROM i WHERE s) - (SELECT i FROM i WHERE NOT s), 6) AS treatment_effect, CAST((SELECT count(*) FROM w WHERE NOT s) AS DOUBLE) AS n_effective_left,
CAST((SELECT count(*) FROM w WHERE s) AS DOUBLE) AS n_effective_right""")
def rdd(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") * 919 % 1000 - 500 + 0.5).alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    found = regression.regression_discontinuity(rows, "x", "y", bandwidth=200.0)
    return rounded(one_row(spark, found, ["treatment_effect", "n_effective_left", "n_effective_right"]), 6)


@query("""SELECT CAST(n AS BIGINT) AS n_units, round((1.959963984540054 + 0.8416212335729143) * sqrt(2 * (1 + 11 * 0.05) / (n * 0.5 * 12)), 9) AS mde FROM (VALUES (10), (50), (100)) t(n)""")
def mde(spark, d):
    rows = [(n, causal.minimum_detectable_effect(n, 12)) for n in (10, 50, 100)]
    return rounded(spark.createDataFrame(rows, "n_units long, mde double"))


# -- statistics on small panels and series (rows only) -----------------------
def monthly(spark, d) -> DataFrame:
    return panel(spark, d).select("unit_id", "period", F.col("complaint_count").cast("double").alias("y"))


@query()
def stl(spark, d):
    run = lambda y: [(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(*series.stl(y, 12), strict=True))]
    return series.per_series(monthly(spark, d), ["unit_id"], "period", "y", run, "k long, trend double, seasonal double, residual double")


@query()
def stl_anomalies(spark, d):
    run = lambda y: [(int(k), float(z)) for k, z in zip(*series.stl_anomalies(y, 12), strict=True)]
    return series.per_series(monthly(spark, d), ["unit_id"], "period", "y", run, "k long, z double")


@query()
def changepoints(spark, d):
    run = lambda y: [(m, int(k)) for m in ("pelt", "binseg") for k in series.changepoints(y, m)]
    return series.per_series(monthly(spark, d), ["unit_id"], "period", "y", run, "method string, k long")


@query()
def hawkes(spark, d):
    events = table(spark, d, "events").select("event_type", "event_id", (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600.0).alias("t"))
    names = ("background_rate", "triggering_kernel_alpha", "triggering_kernel_beta", "log_likelihood")
    run = lambda t: [tuple(float(found[n]) for n in names) for found in [series.fit_hawkes(t)]] if len(set(t)) > 2 else []
    return series.per_series(events, ["event_type"], "t", "t", run, ", ".join(f"{n} double" for n in names), series.EVENT_LIMIT)


@query()
def synth_control(spark, d):
    found = causal.synthetic_control(stored_panel(spark, d), "NATION_0", "complaint_count", 25)
    return long_rows(spark, found["donor_weights"] | {"_att": found["att"], "_p": found["placebo_p_value"]})


@query()
def sdid(spark, d):
    found = causal.synthetic_did(stored_panel(spark, d), "complaint_count", 25)
    return long_rows(spark, found["unit_weights"] | {"_att": found["att"], "_se": found["std_error"]})


def _values(spark, d) -> dict[str, float]:
    return {r["unit_id"]: r["value"] for r in volumes(spark, d).collect()}


@query()
def moran_test(spark, d):
    found = spatial_models.moran_test(_values(spark, d), S.weights_to_dict(weights(spark)))
    return one_row(spark, found, ["statistic", "expected", "p_value", "z_score"])


@query()
def local_moran_test(spark, d):
    found = spatial_models.local_moran_test(_values(spark, d), S.weights_to_dict(weights(spark)))
    return spark.createDataFrame([(r["unit_id"], float(r["local_statistic"]), float(r["p_value"]), r["label"]) for r in found], "unit_id string, local_statistic double, p_value double, label string")


_GWR = f"""WITH {PANEL}, {GRID}, v AS (SELECT community_district AS unit_id, CAST(count(*) AS DOUBLE) AS y FROM req GROUP BY 1),
u AS (SELECT v.unit_id, v.y AS o, r.x AS x, g.x + 0.04 AS lon, g.y + 0.024 AS lat FROM v JOIN g ON g.v = v.unit_id JOIN (SELECT unit_id, avg(resolution_rate) AS x FROM p GROUP BY 1) r USING (unit_id)),
d AS (SELECT a.unit_id AS i, b.unit_id AS j, a.x AS xi, a.o AS oi, b.x AS x, b.o AS o, sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) AS d FROM u a, u b),
q AS (SELECT unnest(quantile_cont(d, [0.25, 0.5, 0.75, 0.9])) AS h FROM d WHERE d > 0),
w AS (SELECT q.h, d.*, exp(-0.5 * (d / q.h) ** 2) AS w FROM d, q),
s AS (SELECT h, i, i = j AS own, xi, oi, w, x, o FROM w),
l AS (SELECT h, i, any_value(xi) AS xi, any_value(oi) AS oi, sum(w) AS n, sum(w * x) AS sx, sum(w * o) AS sy, sum(w * x * x) AS sxx, sum(w * x * o) AS sxy FROM s WHERE NOT own GROUP BY h, i),
e AS (SELECT h, sum((oi - ((sy - b * sx) / n + b * xi)) ** 2) AS error FROM (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM l) GROUP BY h),
k AS (SELECT h FROM e ORDER BY error, h LIMIT 1),
f AS (SELECT i, h, sum(w) AS n, sum(w * x) AS sx, sum(w * o) AS sy, sum(w * x * x) AS sxx, sum(w * x * o) AS sxy FROM s JOIN k USING (h) GROUP BY i, h),
c AS (SELECT *, (sy - b * sx) / n AS a FROM (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM f)),
r AS (SELECT c.i, 1 - sum(w * (o - a - b * x) ** 2) / sum(w * (o - sy / n) ** 2) AS r2 FROM c JOIN s ON s.i = c.i AND s.h = c.h GROUP BY c.i)
SELECT i AS unit_id, unnest(['CONSTANT', 'resolution_rate']) AS name, round(unnest([a, b]), 4) AS coefficient, round(r2, 6) AS local_r_squared, round(h, 6) AS bandwidth FROM c JOIN r USING (i)"""


@query(_GWR)
def gwr(spark, d):
    units = volumes(spark, d).join(S.centroids(grid_boundaries(spark)), "unit_id").join(P.cross_section(panel(spark, d), ["resolution_rate"]), "unit_id")
    found = spatial_models.gwr(units, "value", ["resolution_rate"], kernel="gaussian")
    return rounded(found.withColumn("coefficient", F.round("coefficient", 4)), 6)


def _spatial(spark, d, model: str) -> DataFrame:
    rows = volumes(spark, d).join(P.cross_section(panel(spark, d), ["resolution_rate"]), "unit_id").orderBy("unit_id").collect()
    w = spatial_models.weight_matrix(S.weights_to_dict(weights(spark)), [r["unit_id"] for r in rows])
    y, x = np.array([r["value"] for r in rows]), np.array([[r["resolution_rate"]] for r in rows])
    found = spatial_models.spatial_regression(y, x, w, ["resolution_rate"], model)
    return long_rows(spark, found["coefficients"] | {("rho" if model == "lag" else "lam"): found["rho" if model == "lag" else "lam"], "aic": found["aic"]}, "name")


query(name="spatial_lag_ml")(lambda spark, d: _spatial(spark, d, "lag"))
query(name="spatial_error_ml")(lambda spark, d: _spatial(spark, d, "error"))


@query()
def random_effects(spark, d):
    rows = panel(spark, d).select("unit_id", "period", F.col("complaint_count").cast("double").alias("y"), "resolution_rate")
    return long_rows(spark, regression.panel_random_effects(regression.small_panel(rows), "y", ["resolution_rate"])["coefficients"], "name")


@query()
def mixed_adjust(spark, d):
    return long_rows(spark, regression.reporting_rate_adjustment(regression.small_panel(monthly(spark, d)), "y")["adjusted_rates"])


@query(f"""WITH {REQ}, c AS (SELECT community_district AS unit_id, count(*) AS n FROM req GROUP BY 1) SELECT unit_id, round(2 * n / 10000.0, 9)::DOUBLE AS value FROM c""")
def latent_em(spark, d):
    counts = _values(spark, d)
    found = inequality.latent_reporting_em(counts, dict.fromkeys(counts, 10_000.0))
    return rounded(long_rows(spark, found["estimated_true_rates"]))


@query()
def bym2(spark, d):
    counts = _values(spark, d)
    mean = sum(counts.values()) / len(counts)
    found = spatial_models.bym2_smooth(counts, dict.fromkeys(counts, mean), S.weights_to_dict(weights(spark)))
    return long_rows(spark, found["smoothed_rates"])


@query(f"""{_CELLS} SELECT unit_id, CAST(sum(CASE WHEN period < '1998-06' THEN complaint_count ELSE 0 END) AS DOUBLE) AS before, CAST(sum(CASE WHEN period >= '1998-06' THEN complaint_count ELSE 0 END) AS DOUBLE) AS after FROM p GROUP BY 1""")
def panel_totals(spark, d):
    p = panel(spark, d)
    part = lambda c: F.sum(F.when(c, F.col("complaint_count")).otherwise(0)).cast("double")
    return p.groupBy("unit_id").agg(part(F.col("period") < "1998-06").alias("before"), part(F.col("period") >= "1998-06").alias("after"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Filter, topics, counts, shares and ranks by district."""
    return agg_district(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_io  # noqa: F401  (adds its queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_io  # noqa: F401

    return dict(ORACLES)
