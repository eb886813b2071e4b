import io
import json
from contextlib import contextmanager
from datetime import date
from urllib.error import URLError

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicpulse.config import ExportTarget, GeographyFilter, ServiceRequestFilter, SocrataConfig, TopicQuery
from civicpulse import sinks
from civicpulse.functions import normalize as N
from civicpulse.functions.periods import period_end, period_label
from civicpulse.sources import boundaries as B
from civicpulse.sources import cache, requests, socrata

HEADER = "unique_key,created_date,complaint_type,descriptor,borough,community_board,resolution_description,latitude,longitude,closed_date\n"
ROWS = """1,2024-05-15T10:00:00Z,Noise  - Residential,Loud  music,bk,01 BROOKLYN,Closed,40.73,-73.96,2024-05-16
2,2024-05-16,Rodent,Rat sighting,MANHATTAN,10 MANHATTAN,,,,
3,2024-05-17 08:30:00,Rodent,,Kings,Unspecified,  ,0,0,
"""


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(HEADER + ROWS)
    return str(path)


def test_csv_is_normalised(spark, csv_file):
    rows = requests.load_service_requests_from_csv(spark, csv_file).orderBy("service_request_id").collect()
    assert [r.created_date for r in rows] == [date(2024, 5, 15), date(2024, 5, 16), date(2024, 5, 17)]
    assert [r.borough for r in rows] == ["BROOKLYN", "MANHATTAN", "BROOKLYN"]
    assert [r.community_district for r in rows] == ["BROOKLYN 01", "MANHATTAN 10", "Unspecified"]
    assert rows[0].complaint_type == "Noise - Residential" and rows[0].descriptor == "Loud music" and rows[2].descriptor == ""
    assert (rows[0].latitude, rows[0].longitude, rows[0].closed_date) == (40.73, -73.96, date(2024, 5, 16))
    assert rows[2].latitude is None and rows[2].resolution_description is None
    f = ServiceRequestFilter(date(2024, 5, 16), None, GeographyFilter("community_district", "10 manhattan"), ("RODENT",))
    assert [r.service_request_id for r in requests.load_service_requests_from_csv(spark, csv_file, f).collect()] == ["2"]


def test_bad_rows_fail_or_are_set_apart(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(HEADER + ROWS + "4,nonsense,Rodent,x,bk,x,,40.7,,\n5,2024-01-01,,x,bk,x,,10,10,\n")
    with pytest.raises(Exception, match="Invalid request row"):
        requests.load_service_requests_from_csv(spark, str(path)).collect()
    strict = requests.load_service_requests_from_csv(spark, str(path))
    rodent = ServiceRequestFilter(complaint_types=("Rodent",))
    some = requests.load_service_requests_from_csv(spark, str(path), rodent)
    for job in (strict.count, strict.groupBy("borough").count().collect, strict.select("borough").collect, strict.where("borough = 'none'").collect,
                strict.where("complaint_type = 'Rodent'").count, some.count, strict.limit(100).count):
        with pytest.raises(Exception, match="Invalid request row"):
            job()
    assert requests.load_service_requests_from_csv(spark, str(path), mode="quarantine").count() == 3
    raw = requests.read_raw_csv(spark, str(path))
    bad = requests.quarantined(requests.normalize_requests(raw, district="community_board")).orderBy("service_request_id").collect()
    assert [len(r._errors) for r in bad] == [2, 2]
    with pytest.raises(ValueError, match="Missing required"):
        requests.check_columns(["unique_key"])
    with pytest.raises(ValueError, match="community_district"):
        requests.check_columns(list(requests.REQUIRED_COLUMNS))


def test_pandas_and_normalisers(spark):
    pdf = pd.DataFrame({"service_request_id": [1], "created_date": [pd.Timestamp("2024-01-02")], "complaint_type": ["x"], "descriptor": [None],
                        "borough": ["SI"], "community_district": ["3 si"], "latitude": [float("nan")], "longitude": [None]})
    row = requests.requests_from_pandas(spark, pdf).first()
    assert (row.community_district, row.created_date, row.latitude) == ("STATEN ISLAND 03", date(2024, 1, 2), None)
    assert N.normalize_borough_name(" new  york ") == "MANHATTAN"
    with pytest.raises(ValueError):
        N.normalize_borough_name("nowhere")
    day = F.lit(date(2024, 5, 15))
    got = spark.range(1).select(*[period_end(day, f).alias(f) for f in "DWMQY"], *[period_label(day, f).alias("l" + f) for f in "DWMQY"]).first()
    assert list(got[:5]) == [date(2024, 5, 15), date(2024, 5, 19), date(2024, 5, 31), date(2024, 6, 30), date(2024, 12, 31)]
    assert list(got[5:]) == ["2024-05-15", "2024-05-13/2024-05-19", "2024-05", "2024Q2", "2024"]


def fake_api(pages, fail=0):
    state = {"fail": fail, "urls": []}

    @contextmanager
    def opener(request, timeout):
        if state["fail"]:
            state["fail"] -= 1
            raise URLError("down")
        state["urls"].append(request.full_url)
        offset = int(request.full_url.split("%24offset=")[1].split("&")[0])
        yield io.BytesIO(json.dumps(pages.get(offset, [])).encode())

    return opener, state


API_ROW = {"unique_key": "9", "created_date": "2024-01-01T00:00:00.000", "complaint_type": "Rodent", "borough": "BRONX", "community_board": "05 BRONX"}


def test_paging_retries_and_query_text():
    config = SocrataConfig(page_size=2, app_token="t")
    opener, state = fake_api({0: [API_ROW] * 2, 2: [API_ROW]})
    f = ServiceRequestFilter(date(2024, 1, 1), date(2024, 2, 1), GeographyFilter("community_district", "BRONX 05"), ("O'Neil",))
    rows = list(socrata.iter_rows(config, f, opener))
    assert len(rows) == 3 and rows[0]["descriptor"] == "" and rows[0]["community_district"] == "05 BRONX" and rows[0]["latitude"] is None
    url = state["urls"][0]
    for part in ("created_date+%3E%3D+%272024-01-01T00%3A00%3A00%27", "T23%3A59%3A59", "community_board+%3D+%27BRONX+05%27", "O%27%27Neil", "created_date+ASC%2C+unique_key+ASC"):
        assert part in url
    waits = []
    opener, _ = fake_api({0: [API_ROW]}, fail=3)
    assert socrata.fetch_page(socrata.page_url(config, ServiceRequestFilter(), 0), config, opener, waits.append) == [API_ROW]
    assert waits == [1, 2, 4]
    with pytest.raises(ValueError, match="lacks required"):
        socrata.normalize_row({"unique_key": "1"})


def test_reader_partitions_and_rows(monkeypatch):
    config = SocrataConfig(page_size=1, max_pages=45)
    opener, _ = fake_api({k: [API_ROW] for k in range(30)})
    monkeypatch.setattr(socrata, "fetch_page", lambda url, c, o=opener: [API_ROW] if int(url.split("%24offset=")[1].split("&")[0]) < 30 else [])
    reader = socrata._Reader({"config": json.dumps({"page_size": 1, "max_pages": 45}), "template": socrata.page_url(config, ServiceRequestFilter(), 0)})
    parts = reader.partitions()
    assert [(p.first, p.stop) for p in parts] == [(0, 20), (20, 40), (40, 45)]
    assert [len(list(reader.read(p))) for p in parts] == [20, 10, 0]


def test_api_data_source_and_snapshot(spark, tmp_path):
    """A local HTTP server stands in for the API; rows travel through the executors."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append(self.path)
            offset = int(self.path.split("%24offset=")[1].split("&")[0])
            rows = [API_ROW | {"unique_key": str(offset + k)} for k in range(2)] if offset < 4 else []
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(rows).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = SocrataConfig(base_url=f"http://127.0.0.1:{server.server_port}", page_size=2)
    f = ServiceRequestFilter(geography=GeographyFilter("borough", "bronx"))
    got = cache.load_service_requests(spark, config, f, cache_dir=tmp_path)
    assert sorted(r.service_request_id for r in got.collect()) == ["0", "1", "2", "3"]
    n = len(calls)
    assert cache.cached_fetch(spark, config, f, tmp_path).count() == 4 and len(calls) == n
    assert cache.cached_fetch(spark, config, f, tmp_path, max_records=3).count() == 3
    meta = json.loads(cache.cache_path(config, f, tmp_path).with_suffix(".meta.json").read_text())
    assert meta["record_count"] == 4
    other = ServiceRequestFilter(geography=GeographyFilter("community_district", "BRONX 05"))
    assert cache.cache_path(config, f, tmp_path) != cache.cache_path(config, other, tmp_path)
    assert cache.bulk_fetch(spark, config, tmp_path, boroughs=("BRONX", "QUEENS")).count() == 4
    server.shutdown()


def test_boundary_names():
    assert B.normalize_boundary_layer("zip") == "zcta" and B.normalize_boundary_value("zip", "MODZCTA 10001") == "10001"
    assert B.normalize_boundary_value("nta", "bk0101") == "BK0101" and B.normalize_boundary_value("council_district", "district 33") == "33"
    assert B.normalize_boundary_value("census_tract", "1000100") == "36061000100"
    with pytest.raises(ValueError):
        B.normalize_boundary_layer("planet")


def test_settings_are_checked():
    for bad in (lambda: ServiceRequestFilter(date(2024, 2, 1), date(2024, 1, 1)), lambda: SocrataConfig(page_size=0), lambda: SocrataConfig(created_date_sort="up"),
                lambda: GeographyFilter("zcta", "x"), lambda: TopicQuery("", 1), lambda: TopicQuery("x", 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        sinks._path(ExportTarget("xml", "/tmp/x"), "csv")


@pytest.fixture
def counting_api():
    """A local API that counts its rows when asked; 5 rows a borough."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            calls.append(query)
            if query["$select"].startswith("count"):
                rows = [{"n": "5"}]
            else:
                first, size = int(query["$offset"]), int(query["$limit"])
                rows = [API_ROW | {"unique_key": str(k), "borough": query["$where"].split("'")[1]} for k in range(first, min(first + size, 5))]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(rows).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", calls
    server.shutdown()


def test_pages_are_dealt_by_the_servers_count(spark, counting_api):
    url, calls = counting_api
    config = SocrataConfig(base_url=url, page_size=2)
    f = ServiceRequestFilter(geography=GeographyFilter("borough", "BRONX"))
    options = {"config": json.dumps({"base_url": url, "page_size": 2}), "template": socrata.page_url(config, f, 0), "pages_per_partition": "1"}
    reader = socrata._Reader(options)
    parts = reader.partitions()
    assert [(p.first, p.stop) for p in parts] == [(0, 1), (1, 2), (2, None)] and calls[0]["$where"] == "borough = 'BRONX'"
    assert [[r[0] for r in reader.read(p)] for p in parts] == [["0", "1"], ["2", "3"], ["4"]]
    config = SocrataConfig(base_url="http://127.0.0.1:1", page_size=2)  # nobody there: no count
    assert socrata.count_rows(socrata.page_url(config, f, 0), config, opener=fake_api({}, fail=99)[0]) is None


def test_bulk_fetch_reports_pages_and_skips_stored_boroughs(spark, tmp_path, counting_api):
    url, calls = counting_api
    config, told = SocrataConfig(base_url=url, page_size=2), []
    got = cache.bulk_fetch(spark, config, tmp_path, boroughs=("BRONX", "QUEENS"), on_progress=lambda *x: told.append(x))
    assert sorted((r.borough, r.service_request_id) for r in got.collect()) == [(b, str(k)) for b in ("BRONX", "QUEENS") for k in range(5)]
    assert told == [(b, page, n) for b in ("BRONX", "QUEENS") for page, n in enumerate((2, 2, 1))]
    before = len(calls)
    cache.bulk_fetch(spark, config, str(tmp_path), boroughs=("BRONX", "BROOKLYN"), on_progress=lambda *x: told.append(x))
    assert {t[0] for t in told[6:]} == {"BROOKLYN"} and all("BROOKLYN" in c["$where"] for c in calls[before:])
    f = ServiceRequestFilter(geography=GeographyFilter("borough", "BRONX"))
    meta = json.loads(cache.meta_path(cache.cache_path(config, f, tmp_path)).read_text())
    assert (meta["record_count"], meta["borough"], meta["page_size"], meta["start_date"]) == (5, "BRONX", 2, None) and len(meta["sha256"]) == 64


def test_files_on_any_file_system(spark, tmp_path):
    from civicpulse.sources import files

    folder = files.shared_folder(spark, "x")
    assert folder.startswith("file:/")
    with files.open_text(spark, f"{folder}/deep/a.txt") as f:
        for _ in range(3):
            f.write("é\n" * 600_000)
    assert files.exists(spark, f"{folder}/deep/a.txt") and not files.exists(spark, tmp_path / "b.txt")
    assert files.read_text(spark, f"{folder}/deep/a.txt") == "é\n" * 1_800_000
    files.write_text(spark, tmp_path / "b.txt", "x")
    assert (tmp_path / "b.txt").read_text() == "x"
    target = ExportTarget("csv", f"{folder}/o.csv")
    assert target.output_path == f"{folder}/o.csv" and sinks._path(target, "csv") == f"{folder}/o.csv"
