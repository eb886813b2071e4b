"""Registered queries over sources, sinks and catalogs: round trips through files and the SQL of what must come back."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sinks
from .config import (
    AnalysisWindow,
    ExportTarget,
    GeographyFilter,
    ServiceRequestFilter,
    SocrataConfig,
    TopicQuery,
    brooklyn_borough_filter,
    large_socrata_config,
    manhattan_borough_filter,
    small_socrata_config,
    smoke_socrata_config,
)
from .functions import normalize as N
from .functions.constants import BOUNDARY_LAYERS, TOPIC_RULES
from .operators import aggregate as A
from .operators import panel as P
from .operators import spatial as S
from .operators import topics as TO
from .queries import (
    GRID,
    JOINED,
    PANEL,
    REQ,
    TOPICS,
    assigned_lines,
    grid_boundaries,
    panel,
    query,
    rounded,
    summary_sql,
)
from .sources import boundaries as B
from .sources import cache, requests, samples, socrata
from .sources.files import read_text, shared_folder
from .sources.tables import requests_orders, table

_RAW = """raw AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS unique_key, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS kind, c_mktsegment AS descriptor,
  r_name AS borough, n_name AS district, o_orderstatus AS status, 40.5::DOUBLE + (o_custkey % 400) / 1000.0::DOUBLE AS lat, -74.2::DOUBLE + (o_custkey % 500) / 1000.0::DOUBLE AS lon
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
#: what is wrong with a row of the messy file
_BAD = "CASE WHEN k % 97 = 0 THEN 'date' WHEN k % 89 = 0 THEN 'type' WHEN k % 83 = 0 THEN 'latitude' END"


def messy_csv(spark, d, bad: bool) -> str:
    """Requests as a CSV folder with untidy spelling; with ``bad`` some rows cannot be read."""
    rows = requests_orders(spark, d).withColumn("k", F.col("service_request_id").cast("long"))
    flaw = lambda m: (F.col("k") % m == 0) if bad else F.lit(False)
    text = rows.select(
        F.concat(F.lit(" "), "service_request_id").alias("unique_key"),
        F.when(flaw(97), "yesterday").when(F.col("k") % 2 == 0, F.concat(F.col("created_date").cast("string"), F.lit("T08:30:00Z")))
        .otherwise(F.col("created_date").cast("string")).alias("created_date"),
        F.when(flaw(89), " ").otherwise(F.concat(F.col("complaint_type"), F.lit("  "))).alias("complaint_type"),
        F.when(F.col("k") % 5 == 0, F.concat(F.col("descriptor"), F.lit(',  "so"  called'))).otherwise(F.col("descriptor")).alias("descriptor"),
        F.when(F.col("borough") == "ASIA", " kings ").otherwise(F.lower("borough")).alias("borough"),
        F.when(F.col("k") % 3 == 0, "7  bk").otherwise(F.col("community_district")).alias("community_board"),
        F.col("resolution_description"), F.when(flaw(83), "41.7").otherwise(F.col("latitude").cast("string")).alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"),
    )
    path = shared_folder(spark, "requests-csv")
    text.write.option("header", True).option("escape", '"').csv(path)
    return path


_CLEAN = f"""WITH {_RAW}, ok AS (SELECT *, {_BAD} AS flaw FROM raw)
SELECT unique_key AS service_request_id, CAST(day AS VARCHAR) AS created_date, kind AS complaint_type, descriptor || CASE WHEN k % 5 = 0 THEN ', "so" called' ELSE '' END AS descriptor,
CASE WHEN borough = 'ASIA' THEN 'BROOKLYN' ELSE borough END AS borough, CASE WHEN k % 3 = 0 THEN 'BROOKLYN 07' ELSE district END AS community_district,
CASE WHEN status = 'F' THEN 'F' END AS resolution_description, round(lat, 9) AS latitude, round(lon, 9) AS longitude FROM ok"""
_CLEAN_COLUMNS = ("service_request_id", "created_date", "complaint_type", "descriptor", "borough", "community_district", "resolution_description", "latitude", "longitude")


@query(_CLEAN, days=("created_date",))
def csv_strict(spark, d):
    """Untidy CSV files, normalised and checked (load, column check, row normaliser)."""
    return rounded(requests.load_service_requests_from_csv(spark, messy_csv(spark, d, False)).select(*_CLEAN_COLUMNS))


@query(f"{_CLEAN} WHERE flaw IS NULL", days=("created_date",))
def csv_quarantine(spark, d):
    path = messy_csv(spark, d, True)
    return rounded(requests.load_service_requests_from_csv(spark, path, mode="quarantine").select(*_CLEAN_COLUMNS))


@query(f"""WITH {_RAW}, f AS (SELECT k % 97 = 0 AS a, k % 89 = 0 AS b, k % 83 = 0 AS c FROM raw)
SELECT CASE WHEN b THEN 'complaint_type must not be empty; ' ELSE '' END || CASE WHEN a THEN 'created_date is not a date; ' ELSE '' END ||
CASE WHEN c THEN 'latitude out of range; ' ELSE '' END AS errors, count(*) AS n FROM f WHERE a OR b OR c GROUP BY 1""")
def csv_rejected(spark, d):
    """What is wrong with the rows that a strict load would refuse."""
    raw = requests.read_raw_csv(spark, messy_csv(spark, d, True))
    bad = requests.quarantined(requests.normalize_requests(raw, district=requests.check_columns(raw.columns)))
    return bad.groupBy(F.concat(F.array_join("_errors", "; "), F.lit("; ")).alias("errors")).agg(F.count("*").alias("n"))


@query(f"{_CLEAN} WHERE k % 3 = 0 AND day >= DATE '1996-03-01'", days=("created_date",))
def csv_filtered(spark, d):
    """Dispatch by source with a filter; the district is named in another spelling than the file's."""
    f = ServiceRequestFilter(date(1996, 3, 1), None, GeographyFilter("community_district", "Kings 7"))
    return rounded(cache.load_service_requests(spark, messy_csv(spark, d, False), f).select(*_CLEAN_COLUMNS))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS service_request_id, '2024-02-29' AS created_date, s_name AS complaint_type, CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '' END AS descriptor,
CASE WHEN s_suppkey % 4 = 0 THEN 40.5 END::DOUBLE AS latitude FROM supplier""", days=("created_date",))
def pandas_requests(spark, d):
    """Requests from a pandas frame: NaN, NaT and None are missing values."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name").toPandas()  # pandas is the source here
    even, fourth = rows["s_suppkey"] % 2 == 0, rows["s_suppkey"] % 4 == 0
    frame = rows.assign(
        service_request_id=rows["s_suppkey"], complaint_type=rows["s_name"], created_date="2024-02-29", borough="SI", community_district="SI 3",
        descriptor=rows["s_name"].where(~even, "x").where(even, None), latitude=fourth.map({True: 40.5, False: float("nan")}),
        longitude=fourth.map({True: -74.0, False: float("nan")}),
    ).drop(columns=["s_suppkey", "s_name"])
    return requests.requests_from_pandas(spark, frame).select("service_request_id", "created_date", "complaint_type", "descriptor", "latitude")


@query(f"WITH {REQ} SELECT service_request_id, created_date, borough, round(latitude, 9) AS latitude FROM req WHERE borough = 'EUROPE' AND created_date <= DATE '1997-12-31'", days=("created_date",))
def parquet_snapshot(spark, d):
    """A snapshot written as Parquet and read back by dispatch, the filter pushed to its scan."""
    path = shared_folder(spark, "snapshot") + "/requests.parquet"
    requests_orders(spark, d).write.parquet(path)
    f = ServiceRequestFilter(None, date(1997, 12, 31), GeographyFilter("borough", "europe"))
    return rounded(cache.load_service_requests(spark, path, f).select("service_request_id", "created_date", "borough", "latitude"))


@query(f"WITH {REQ} SELECT service_request_id, complaint_type FROM req WHERE resolution_description IS NOT NULL")
def resolved_requests(spark, d):
    return requests.load_resolution_data(requests_orders(spark, d)).select("service_request_id", "complaint_type")


@query(f"WITH {REQ} SELECT service_request_id, CAST(created_date AS VARCHAR) AS created_date, complaint_type, descriptor, borough, community_district, resolution_description, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude FROM req", days=("created_date",))
def request_csv_sink(spark, d):
    """The CSV snapshot of requests, read back by the CSV source."""
    path = shared_folder(spark, "export") + "/requests.csv"
    sinks.export_service_requests_csv(requests_orders(spark, d), ExportTarget("csv", path))
    return rounded(requests.load_service_requests_from_csv(spark, path).select(*_CLEAN_COLUMNS))


def _positions(spark, path: str) -> DataFrame:
    """Lines of a one-file table with their place in it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")))
    return lines.select(F.col("pos").cast("long").alias("position"), F.col("col").alias("line"))


@query(f"""WITH s AS ({summary_sql('community_district')}), o AS (SELECT *, row_number() OVER (ORDER BY geography_value, complaint_type, topic_rank) AS position FROM s)
SELECT position, concat_ws(',', geography, geography_value, complaint_type, topic, complaint_count, geography_total_count, printf('%.6f', share_of_geography), topic_rank, is_dominant_topic) AS line FROM o
UNION ALL SELECT 0, 'geography,geography_value,complaint_type,topic,complaint_count,geography_total_count,share_of_geography,topic_rank,is_dominant_topic'""")
def topic_table_sink(spark, d):
    """The exported topic table, line by line in its final order; its shares are rounded to nine places first, as everywhere."""
    path = shared_folder(spark, "export") + "/topics.csv"
    sinks.export_topic_table(rounded(A.aggregate_by_geography(assigned_lines(spark, d), "community_district")), ExportTarget("csv", path))
    return _positions(spark, path)


@query(f"""WITH s AS ({summary_sql('borough')}), z AS (SELECT *, avg(complaint_count) OVER w AS m, stddev_pop(complaint_count) OVER w AS sd FROM s WINDOW w AS (PARTITION BY geography, complaint_type)),
y AS (SELECT *, CASE WHEN sd > 0 THEN (complaint_count - m) / sd ELSE 0 END AS z_score FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY abs(z_score) DESC, geography_value, complaint_type, topic_rank) AS position FROM y)
SELECT position, geography_value || ',' || topic || ',' || printf('%.6f', z_score) AS line FROM o""")
def anomaly_table_sink(spark, d):
    """The exported anomalies in their final order, three of their columns."""
    path = shared_folder(spark, "export") + "/anomalies.csv"
    found = A.detect_anomalies(A.aggregate_by_geography(assigned_lines(spark, d), "borough"), AnalysisWindow(30), 1.0)
    sinks.export_anomalies(found, ExportTarget("csv", path))
    lines = _positions(spark, path).withColumn("v", F.split("line", ","))
    at = {name: k for k, name in enumerate(found.columns)}
    return lines.where("position > 0").select("position", F.concat_ws(",", *[F.col("v")[at[c]] for c in ("geography_value", "topic", "z_score")]).alias("line"))


@query(f"""WITH s AS ({summary_sql('community_district')}) SELECT geography_value, 'STANDARD: ' || topic || ' (' || complaint_count || '/' || geography_total_count || ', ' ||
printf('%.1f', floor(1000 * complaint_count / geography_total_count + 0.5) / 10) || '%)' AS line FROM s WHERE topic_rank = 1""")
def report_card_sink(spark, d):
    """Dominant topics of the report card, at most five a geography, ties and order as in its text."""
    path = shared_folder(spark, "export") + "/card.md"
    sinks.export_report_card(ExportTarget("md", path), A.aggregate_by_geography(assigned_lines(spark, d), "community_district"))
    place, rows = None, []
    for line in read_text(spark, path).split("\n"):
        place = line[3:] if line.startswith("## ") else place
        if m := re.fullmatch(r"- (STANDARD: .* \()([0-9]+)/([0-9]+), [0-9.]+%\)", line):
            n, total = int(m[2]), int(m[3])
            rows.append((place, f"{m[1]}{n}/{total}, {int(1000 * n / total + 0.5) / 10:.1f}%)"))  # SQL rounds halves up
    return spark.createDataFrame(rows, "geography_value string, line string")


@query(f"""WITH {GRID}, s AS ({summary_sql('community_district')})
SELECT v AS geography_value, 5::BIGINT AS n_points, round(x, 6) AS west, round(y, 6) AS south, round(x + 0.1, 6) AS east, round(y + 0.06, 6) AS north, topic AS dominant_topic
FROM g LEFT JOIN s ON s.geography_value = v AND topic_rank = 1 WHERE v <> 'NATION_3'""")
def geojson_sink(spark, d):
    """Boundaries with their dominant topics as GeoJSON, read back by layer and values."""
    path = shared_folder(spark, "export") + "/map.geojson"
    summaries = A.aggregate_by_geography(assigned_lines(spark, d), "community_district")
    sinks.export_geojson(grid_boundaries(spark), summaries, ExportTarget("geojson", path))
    wanted = [f"nation_{k}" for k in range(25) if k != 3]
    found = S.with_bbox(B.load_boundaries(spark, path, "community districts", wanted))
    return rounded(found.select(
        "geography_value", F.size(F.col("polygons")[0][0]).cast("long").alias("n_points"), F.col("min_lon").alias("west"), F.col("min_lat").alias("south"),
        F.col("max_lon").alias("east"), F.col("max_lat").alias("north"), F.element_at("properties", F.lit("dominant_topic")).alias("dominant_topic"),
    ), 6)


@query(f"WITH {GRID} SELECT 'community_district' AS geography, v AS geography_value FROM g")
def layer_values(spark, d):
    layers = B.list_boundary_layers(grid_boundaries(spark))
    return layers.join(B.list_boundary_values(grid_boundaries(spark), "cd"))


_VALUES = {
    "council district": [f"District {k:02d}" for k in range(1, 52)], "zip": [f"zip {k}" for k in range(501, 560)], "boroughs": ["mn", "New  York", "kings", "si", "Elsewhere"],
    "tract": [f"{k}0{k}0100" for k in range(1, 6)] + ["36061000100"], "cd": ["3 bk", "Queens 12", "12 nowhere"], "nta": [" bk0101", "qn 02"],
}


@query("""SELECT 'council district' AS layer, 'District ' || printf('%02d', k) AS value, CAST(k AS VARCHAR) AS normal FROM range(1, 52) r(k)
UNION ALL SELECT 'zip', 'zip ' || k, '00' || k FROM range(501, 560) r(k)
UNION ALL SELECT * FROM (VALUES ('boroughs', 'mn', 'MANHATTAN'), ('boroughs', 'New  York', 'MANHATTAN'), ('boroughs', 'kings', 'BROOKLYN'), ('boroughs', 'si', 'STATEN ISLAND'),
('boroughs', 'Elsewhere', 'ELSEWHERE'), ('cd', '3 bk', 'BROOKLYN 03'), ('cd', 'Queens 12', 'QUEENS 12'), ('cd', '12 nowhere', '12 NOWHERE'), ('nta', ' bk0101', 'BK0101'), ('nta', 'qn 02', 'QN 02'), ('tract', '36061000100', '36061000100'))
UNION ALL SELECT 'tract', k || '0' || k || '0100', '36' || ['061', '005', '047', '081', '085'][k] || '0' || k || '0100' FROM range(1, 6) r(k)""")
def boundary_names(spark, d):
    """Values of all kinds of layers in their canonical form."""
    rows = [(layer, v, B.normalize_boundary_value(layer, v)) for layer, values in _VALUES.items() for v in values]
    return spark.createDataFrame(rows, "layer string, value string, normal string")


_RULES_SQL = ", ".join(
    f"({i}, '{kind}', 'Report of {words[0]}')" for i, (kind, words) in enumerate((k, w) for k, rules in TOPIC_RULES.items() for _, w in rules)
)


@query(f"""WITH r(i, kind, descriptor) AS (VALUES {_RULES_SQL}), n AS (SELECT count(*) AS n FROM r)
SELECT r.kind AS complaint_type, r.descriptor, count(*) AS n FROM range(72) k(i), n, r WHERE k.i % n.n = r.i GROUP BY ALL""")
def sample_requests(spark, d):
    return samples.load_sample_service_requests(spark).groupBy("complaint_type", "descriptor").agg(F.count("*").alias("n"))


@query("""SELECT geography_value, CAST(count(*) AS BIGINT) AS n FROM (SELECT ['BROOKLYN 01', 'BRONX 05', 'MANHATTAN 10', 'QUEENS 02'][1 + i % 4] AS geography_value FROM range(72) k(i)) GROUP BY 1""")
def sample_join(spark, d):
    """The sample's requests lie in the sample's boundaries."""
    joined = S.spatial_join(samples.load_sample_service_requests(spark), samples.load_sample_boundaries(spark))
    return joined.groupBy(F.col("boundary_geography_value").alias("geography_value")).agg(F.count("*").alias("n"))


def _default_topic_sql() -> str:
    """The default rules over texts made of every pair of their keywords."""
    out = []
    for kind, rules in TOPIC_RULES.items():
        branches = ""
        for label, words in rules:
            hits = [f"contains(t, '{w}')" if " " in w else f"contains(' ' || t || ' ', ' {w} ')" for w in words]
            branches += f" WHEN {' OR '.join(hits)} THEN '{label}'"
        names = ", ".join(f"('{w}')" for _, words in rules for w in words)
        texts = f"SELECT a.w || ' and ' || b.w AS t FROM (VALUES {names}, ('else')) a(w), (VALUES {names}, ('else')) b(w)"
        out.append(f"SELECT '{kind}' AS complaint_type, t AS descriptor, CASE{branches} ELSE 'other' END AS topic FROM ({texts})")
    return " UNION ALL ".join(out)


@query(_default_topic_sql())
def default_topics(spark, d):
    """The built-in topic rules, order of rules and whole words included."""
    out = None
    for kind, rules in TOPIC_RULES.items():
        words = [w for _, some in rules for w in some] + ["else"]
        texts = spark.createDataFrame([(f"{a.upper()} and {b}", kind, f"{i}") for i, (a, b) in enumerate((a, b) for a in words for b in words)], "descriptor string, complaint_type string, service_request_id string")
        found = TO.extract_topics(texts, TopicQuery(kind, 1000)).select("complaint_type", F.lower("descriptor").alias("descriptor"), "topic")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""{TOPICS} SELECT 'custom' AS rules, topic, count(*) AS n FROM t GROUP BY ALL
UNION ALL SELECT 'registered', CASE WHEN contains(' ' || descriptor || ' ', ' blue ') THEN 'blue' ELSE 'other' END, count(*) FROM lines WHERE complaint_type = 'PROMO' GROUP BY 2
UNION ALL SELECT 'fallback', descriptor, count(*) FROM lines WHERE complaint_type = 'ECONOMY' GROUP BY 2""")
def topic_registry(spark, d):
    """Custom rules before registered ones, and topics by text where there are none."""
    from .queries import RULES
    from .sources.tables import requests_lines

    registry, lines, out = TO.TopicRules({}), requests_lines(spark, d), None
    registry.register("PROMO", [("blue", ["blue"])])
    for name, kind in (("custom", "STANDARD"), ("registered", "PROMO"), ("fallback", "ECONOMY")):
        chosen = registry.select(kind, RULES if name == "custom" else None)
        found = TO.extract_topics(lines, TopicQuery(kind, 10_000), {kind: chosen}).groupBy("topic").agg(F.count("*").alias("n"))
        found = found.select(F.lit(name).alias("rules"), "topic", "n")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {REQ} SELECT service_request_id FROM req WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def point_requests(spark, d):
    return requests.points(requests_orders(spark, d)).select("service_request_id")


@query(f"WITH {PANEL} SELECT DISTINCT unit_id FROM p")
def unit_ids(spark, d):
    return P.unit_ids(panel(spark, d))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""")
def iso_dates(spark, d):
    """ISO dates and date-times with and without a zone mark; other text is no date."""
    day = F.col("o_orderdate").cast("date").cast("string")
    form = F.expr("CAST(o_orderkey % 6 AS INT)")
    text = F.when(form == 0, day).when(form == 1, F.concat(day, F.lit("T10:11:12"))).when(form == 2, F.concat(F.lit(" "), day, F.lit("T10:11:12.500Z"))).when(
        form == 3, F.concat(day, F.lit(" 23:59:59"))).when(form == 4, F.regexp_replace(day, "-", "/")).otherwise(F.concat(F.substring(day, 1, 7), F.lit("-41")))
    return table(spark, d, "orders").select("o_orderkey", N.iso_date(text).cast("string").alias("day"))


@query("""SELECT 'a_' || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g')) || '_2024-01-01_none' AS name FROM nation""")
def cache_names(spark, d):
    """The readable part of snapshot names."""
    names = [r[0] for r in table(spark, d, "nation").select("n_name").collect()]  # 25 nations
    paths = [cache.cache_path(SocrataConfig(), ServiceRequestFilter(date(2024, 1, 1), None, GeographyFilter("borough", f"a {n}")), "/x").name for n in names]
    return spark.createDataFrame([(p.rsplit("_", 1)[0],) for p in paths], "name string")


@query("""SELECT n_name, 'created_date >= ''2024-01-01T00:00:00'' AND created_date <= ''2024-02-01T23:59:59'' AND community_board = ''' || replace(n_name || '''s', '''', '''''') || ''' AND complaint_type IN (''A'', ''B c'')' AS clause FROM nation""")
def api_clauses(spark, d):
    """The predicates that the API's server evaluates."""
    rows = []
    for r in table(spark, d, "nation").select("n_name").collect():  # 25 nations
        f = ServiceRequestFilter(date(2024, 1, 1), date(2024, 2, 1), GeographyFilter("community_district", r[0] + "'s"), ("A", "B  c"))
        rows.append((r[0], " AND ".join(socrata.where_clauses(f))))
    return spark.createDataFrame(rows, "n_name string, clause string")


@query("""SELECT * FROM (VALUES ('small', 500, 30.0::DOUBLE, 1, 'asc'), ('large', 5000, 300.0::DOUBLE, NULL, 'asc'), ('smoke', 5000, 120.0::DOUBLE, NULL, 'desc'), ('default', 1000, 30.0::DOUBLE, NULL, 'asc'))
t(name, page_size, timeout, max_pages, sort)""")
def presets(spark, d):
    makers = {"small": small_socrata_config, "large": large_socrata_config, "smoke": smoke_socrata_config, "default": SocrataConfig}
    rows = [(n, c.page_size, float(c.request_timeout_seconds), c.max_pages, c.created_date_sort) for n, make in makers.items() for c in [make()]]
    return spark.createDataFrame(rows, "name string, page_size int, timeout double, max_pages int, sort string")


@query(f"""WITH {_RAW} SELECT CASE WHEN borough = 'ASIA' THEN 'BROOKLYN' ELSE 'MANHATTAN' END AS borough, count(*) AS n FROM raw
WHERE day >= DATE '1997-01-01' AND borough IN ('ASIA', 'AFRICA') GROUP BY 1""")
def preset_filters(spark, d):
    """Filters of two boroughs over requests that are placed in them."""
    place = F.when(F.col("borough") == "ASIA", "BROOKLYN").when(F.col("borough") == "AFRICA", "MANHATTAN").otherwise(F.col("borough"))
    rows = requests_orders(spark, d).withColumn("borough", place)
    parts = [rows.where(f(start_date=date(1997, 1, 1)).condition()) for f in (brooklyn_borough_filter, manhattan_borough_filter)]
    return parts[0].unionByName(parts[1]).groupBy("borough").agg(F.count("*").alias("n"))


@query(f"{JOINED} SELECT service_request_id, v AS boundary_geography_value, 'NATION_' || (CAST(substr(v, 8) AS BIGINT)) AS label FROM j")
def enriched_requests(spark, d):
    """Points with the attributes of the boundary they lie in, the layer read from a folder of files."""
    folder = shared_folder(spark, "layers")
    summaries = A.aggregate_by_geography(assigned_lines(spark, d), "community_district")
    sinks.export_geojson(grid_boundaries(spark), summaries.limit(0), ExportTarget("geojson", f"{folder}/community_district.geojson"))
    found = S.enrich_requests(requests_orders(spark, d), B.resolve_boundaries(spark, layer="cd", folder=folder))
    label = F.concat(F.lit("NATION_"), F.element_at("boundary_properties", F.lit("k")))
    return found.select("service_request_id", "boundary_geography_value", label.alias("label"))


@query(f"""WITH {PANEL}, demo AS (SELECT n_name AS unit_id, count(*) AS population, round(avg(s_acctbal), 6) AS income FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey <> 4 GROUP BY 1)
SELECT p.unit_id, period, complaint_count, demo.population, income FROM p JOIN demo USING (unit_id)""")
def panel_demographics(spark, d):
    """A panel with its units' demographics; units that only one side has are left out."""
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("n_nationkey <> 4")
    demo = places.groupBy(F.col("n_name").alias("unit_id")).agg(F.count("*").alias("population"), F.round(F.avg("s_acctbal"), 6).alias("income"))
    return P.with_demographics(panel(spark, d), demo).select("unit_id", "period", "complaint_count", "population", "income")


@query(f"""WITH s AS ({summary_sql('community_district')}) SELECT geography_value, topic, geography_total_count FROM s WHERE topic_rank = 1 AND complaint_count > 0
ORDER BY geography_total_count DESC, share_of_geography, geography_value LIMIT 8""")
def label_rows(spark, d):
    """The dominant topics that a map of eight labels shows."""
    summaries = A.aggregate_by_geography(assigned_lines(spark, d), "community_district")
    return TO.label_rows(summaries, 8).select("geography_value", "topic", "geography_total_count")


@query(f"WITH {PANEL} SELECT unit_id, period, complaint_count, round(resolution_rate, 9) AS resolution_rate, treatment, CAST(treatment_date AS VARCHAR) AS treatment_date FROM p", days=("treatment_date",))
def panel_parquet_sink(spark, d):
    path = shared_folder(spark, "export") + "/panel.parquet"
    sinks.export_panel(panel(spark, d), ExportTarget("parquet", path))
    return rounded(spark.read.parquet(path).select("unit_id", "period", "complaint_count", "resolution_rate", "treatment", "treatment_date"))


@query(f"""WITH {PANEL} SELECT unit_id, period, CAST(complaint_count AS DOUBLE) AS outcome, CAST(treatment AS INT) AS treatment FROM p""")
def estimation_rows(spark, d):
    return P.estimation_frame(panel(spark, d), "complaint_count").select("unit_id", "period", "outcome", "treatment")


@query(f"""WITH {REQ}, g AS (SELECT borough AS geography_value, complaint_type, count(*) AS total, count(*) FILTER (resolution_description IS NULL) AS open FROM req GROUP BY ALL)
SELECT geography_value, complaint_type, row_number() OVER (ORDER BY open / total DESC, total DESC, geography_value, complaint_type) AS position FROM g""")
def gap_order(spark, d):
    """Resolution gaps in their final order."""
    rows = requests_orders(spark, d)
    ordered = A.order_gaps(A.analyze_resolution_gaps(rows, rows)).select("geography_value", "complaint_type", F.monotonically_increasing_id().alias("at"))
    return ordered.select("geography_value", "complaint_type", F.row_number().over(Window.orderBy("at")).cast("long").alias("position"))


@query("SELECT unnest(['borough', 'community_district', 'council_district', 'neighborhood_tabulation_area', 'census_tract', 'zcta']) AS layer")
def layer_catalog(spark, d):
    return spark.createDataFrame([(B.normalize_boundary_layer(x.replace("_", " ")),) for x in BOUNDARY_LAYERS], "layer string")
