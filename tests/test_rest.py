import json
import os
import random
import threading
import time
from datetime import UTC, date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tidemark import exceptions as X
from tidemark.sources import rest


def told(message):
    return json.dumps({"error_message": message})


@pytest.mark.parametrize("status,body,kind", [
    (429, told("slow down"), X.RateLimitError), (500, "oops", X.TransientIngestionError), (503, told("api_key"), X.TransientIngestionError),
    (400, told("what you sent as api_key is unknown to us"), X.AuthenticationError), (400, told("no API key came along"), X.AuthenticationError),
    (400, told("this one does not exist"), X.SeriesNotFoundError), (400, told("series_id is too long"), X.SeriesNotFoundError),
    (400, told("limit is too large"), X.PermanentIngestionError), (404, "", X.PermanentIngestionError)])
def test_errors_by_status(status, body, kind):
    assert type(rest.classify(status, body)) is kind


@pytest.mark.parametrize("body", ["<html>", "[1]", "7"])
def test_answers_that_are_no_object(body):
    with pytest.raises(X.ResponseValidationError):
        rest.body_of(200, body)


def test_keys():
    assert rest.check_key("k1" * 16) == "k1" * 16
    for bad in ("", "k" * 31, "k" * 31 + "-", "é" * 32):
        with pytest.raises(X.ConfigurationError):
            rest.check_key(bad)


def test_pages_and_retry():
    answers = [(503, ""), (200, json.dumps({"count": 3, "observations": [1, 2]})), (200, json.dumps({"count": 3, "observations": [3]}))]
    asked = []

    def get(endpoint, params):
        asked.append(params["offset"])
        return answers.pop(0)

    waits = []
    assert list(rest.pages(get, "x", "observations", {}, 2, sleep=waits.append, rng=random.Random(1))) == [1, 2, 3]
    assert asked == [0, 0, 2] and len(waits) == 1 and 0 <= waits[0] <= 0.5


def test_permanent_errors_are_not_tried_again():
    calls = []

    def call():
        calls.append(1)
        raise X.AuthenticationError("no")

    with pytest.raises(X.AuthenticationError):
        rest.with_retry(call, sleep=lambda _: None)
    assert len(calls) == 1


def test_rows():
    now = datetime(2019, 3, 9, tzinfo=UTC)
    row = {"date": "2018-11-01", "value": ".", "realtime_start": "2018-12-12", "realtime_end": "2019-01-20"}
    assert rest.observation(row, "Q", "s", now, True) == ("Q", date(2018, 11, 1), date(2018, 12, 12), date(2019, 1, 20), None, "s", now)
    assert rest.observation(row, "Q", "s", now, False)[3] == date(9999, 12, 31)
    for gone in row:
        with pytest.raises(X.ResponseValidationError):
            rest.observation({k: v for k, v in row.items() if k != gone}, "Q", "s", now, True)
    for key, bad in (("value", "n/a"), ("date", "2018-13-01"), ("realtime_start", None)):
        with pytest.raises(X.ResponseValidationError):
            rest.observation(row | {key: bad}, "Q", "s", now, True)
    assert rest.redacted({"api_key": "k", "a": 1}) == {"a": 1}


class Server(BaseHTTPRequestHandler):
    """Two series in pages, one that fails, and release dates."""

    asked: list = []
    times: list = []
    today: set = set()

    def do_GET(self):
        path, query = urlparse(self.path).path, {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Server.asked.append((path, query))
        Server.times.append(time.monotonic())
        if query.get("series_id") == "CCSA":
            return self.answer(400, {"error_message": "CCSA does not exist"})
        if query.get("series_id", "").startswith("echo"):
            return self.answer(400, {"error_message": f"you sent {query}"})
        if path == "/release/dates":
            rows = [{"date": f"{2012 + m // 12}-{m % 12 + 1:02d}-04"} for m in range(1, 100)]
            return self.answer(200, {"count": len(rows), "release_dates": rows})
        rows = []
        for m in range(96):
            day, known = (f"{2012 + (m + k) // 12}-{(m + k) % 12 + 1:02d}-{d:02d}" for k, d in ((0, 1), (1, 4)))
            rows.append({"date": day, "value": "." if m == 90 else str(1000.0 * (m * 7 % 13) + 40000 * m), "realtime_start": known, "realtime_end": "9999-12-31"})
        if query["series_id"] in Server.today:
            rows = [r | {"realtime_start": datetime.now(UTC).date().isoformat()} for r in rows]
        rows = [r for r in rows if r["date"] >= query.get("observation_start", "")]
        at, limit = int(query["offset"]), min(40, int(query["limit"]))
        self.answer(200, {"count": len(rows), "observations": rows[at : at + limit]})

    def answer(self, status, body):
        raw = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    os.environ["VINTAGE_API_KEY"] = "0a" * 16
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_reader_over_http(url):
    reader = rest.VintageReader({"base_url": url, "keys": "ICSA,UNRATE"})
    assert [p.pages for p in reader.partitions()] == [[("ICSA", None)], [("UNRATE", None)]]
    Server.asked.clear()
    rows = list(reader.read(reader.partitions()[0]))
    assert len(rows) == 96 and rows[90][4] is None and [int(q["offset"]) for _, q in Server.asked] == [0, 40, 80]
    assert {q["realtime_start"] for _, q in Server.asked} == {"1776-07-04"} and {q["api_key"] for _, q in Server.asked} == {"0a" * 16}
    assert len(list(rest.VintageReader({"base_url": url, "keys": "194", "table": "release_dates"}).read(rest._Of([("194", None)])))) == 99
    with pytest.raises(X.SeriesNotFoundError):
        list(reader.read(rest._Of([("CCSA", None)])))


def test_pace():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    pace = rest.Pace(2.0, 0.5, clock=lambda: now[0], sleep=sleep)
    pace()
    pace()
    now[0] += 9.0
    pace()
    pace()
    assert waits == [0.5, 2.0, 2.0]


@pytest.fixture
def vintages(spark, url):
    spark.dataSource.register(rest.VintageSource)
    Server.asked.clear()
    Server.times.clear()
    return lambda **o: spark.read.format("vintages").options(base_url=url, **o).load()


def test_pages_of_a_series_are_read_by_many_tasks_at_the_stated_rate(vintages):
    rate = 600  # requests a minute: one every tenth of a second
    plan = vintages(keys="ICSA", readers=4, page=10, requests_per_minute=rate)
    assert plan.rdd.getNumPartitions() == 4
    Server.asked.clear()
    Server.times.clear()
    rows = plan.collect()
    assert len({r["obs_date"] for r in rows}) == len(rows) == 96
    offsets = sorted(int(q["offset"]) for _, q in Server.asked if q["limit"] == "10")
    assert offsets == list(range(0, 100, 10))  # each page once
    t = sorted(Server.times)
    assert t[-1] - t[0] >= 0.5
    assert all(sum(a <= x < a + 1 for x in t) <= rate / 60 + 4 for a in t)  # no second has more than its share and one of each task


def test_readers_find_failing_series(vintages):
    with pytest.raises(Exception, match="does not exist"):
        vintages(keys="ICSA,CCSA", readers=2).collect()


def test_filters_reach_the_request(spark, vintages):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = vintages(keys="ICSA,UNRATE,CCSA", filters="push").filter("series_id = 'UNRATE' and obs_date >= date'2018-03-01'").collect()
        assert len(got) == 22 and {r["series_id"] for r in got} == {"UNRATE"}
        assert {(q["series_id"], q["observation_start"]) for _, q in Server.asked} == {("UNRATE", "2018-03-01")}
        Server.asked.clear()
        got = vintages(start="2016-01-01", filters="push").filter("series_id in ('ICSA', 'UNRATE') and obs_date > date'2019-10-01' and value > 0").collect()
        assert len(got) == 4 and {(q["series_id"], q["observation_start"]) for _, q in Server.asked} == {("ICSA", "2019-10-01"), ("UNRATE", "2019-10-01")}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_errors_as_rows_keep_other_series_and_no_key(vintages):
    got = vintages(keys="ICSA,CCSA", errors="rows").collect()
    bad = [r for r in got if r["error"]]
    assert len(got) == 97 and [(r["series_id"], r["error"]) for r in bad] == [("CCSA", "SeriesNotFoundError: CCSA does not exist")]
    assert all(r["obs_date"] is None for r in bad)
    secret = "0a" * 16
    echoed = vintages(keys=f"echo {secret}", errors="rows").collect()
    assert echoed[0]["error"] and secret not in echoed[0]["error"]


def test_one_read_and_one_commit_for_all_series(spark, url, tmp_path):
    from tidemark import app
    from tidemark.operators.store import Store

    store = Store(spark, str(tmp_path / "store"))
    Server.asked.clear()
    done = app.ingest(spark, store, url, ["ICSA", "CCSA", "UNRATE"])
    assert done["CCSA"].startswith("failed: SeriesNotFoundError") and done["ICSA"] == "96 rows through 2019-12-01" == done["UNRATE"]
    assert store.manifests() == [1, 2] and store.observations().count() == 192  # observations, then release dates
    assert sum(q.get("series_id") == "UNRATE" for _, q in Server.asked) == 3


def test_a_series_that_shows_today_only_is_refused_alone(spark, url, tmp_path):
    from tidemark import app
    from tidemark.operators.store import Store

    Server.today = {"UNRATE"}
    try:
        done = app.ingest(spark, Store(spark, str(tmp_path / "store")), url, ["ICSA", "UNRATE"])
    finally:
        Server.today = set()
    assert done["ICSA"].startswith("96 rows") and "display-only" in done["UNRATE"]


def test_command_line(spark, url, tmp_path, capfd):
    from tidemark import app

    store = str(tmp_path / "store")
    assert app.main(["--store", store, "history"], spark) == 1 and "no store" in capfd.readouterr().err
    Server.asked.clear()
    assert app.main(["--store", store, "ingest", "--base-url", url], spark) == 1  # CCSA fails, the others are stored
    out = capfd.readouterr().out
    assert "CCSA: failed" in out and "ICSA: 96 rows" in out and "99 dates" in out and "1 series failed" in out
    assert sum(q.get("series_id") == "ICSA" for _, q in Server.asked) == 3  # each page once
    assert app.main(["--store", store, "history", "-n", "3", "--today", "2019-06-01"], spark) == 0
    lines = capfd.readouterr().out.strip().splitlines()
    assert len(lines) == 4 and lines[-1].startswith("2019-04-01")
    assert app.main(["--store", store, "forecast", "-m", "mean_3m", "--json", "--with-accuracy", "--today", "2018-06-01"], spark) == 0
    body = json.loads(capfd.readouterr().out)
    assert body["model"] == "mean_3m" and body["month"] == "2018-05-01" and "mean 6m" in body["caveats"][0]
    assert app.main(["--store", store, "forecast", "--today", "2018-06-01"], spark) == 1  # a term has no series: no ridge
    assert app.main(["--store", store, "backtest", "--scorecard", "vintage", "--interval-level", "0.9", "--today", "2016-01-01"], spark) == 0
    out = capfd.readouterr().out
    assert "origins attempted: " in out and "scored by all models: 0" in out and "ridge could not forecast" in out
    for bad in (["history", "-n", "0"], ["forecast", "-m", "magic"], ["backtest", "--interval-level", "1.5"], ["ingest", "--base-url", url, "--series", "NONE"]):
        with pytest.raises(SystemExit) as e:
            app.main(["--store", store, *bad], spark)
        assert e.value.code == 2


def test_payload_files(spark, tmp_path):
    body = {"count": 1, "observations": [{"realtime_start": "2017-02-11", "realtime_end": "2017-03-10", "date": "2017-01-01", "value": "1.5"}, {"realtime_start": "2017-02-11", "realtime_end": "2017-03-10", "date": "2017-02-01", "value": "."}]}
    (tmp_path / "a.json").write_text(json.dumps(body, indent=1))
    got = sorted(r["value"] or 0 for r in rest.from_payloads(spark, str(tmp_path / "a.json"), "A", "2017-05-05 00:00:00").collect())
    assert got == [0, 1.5]


def test_rows_of_payloads_that_are_none_are_listed_with_reasons(spark, tmp_path):
    row = {"realtime_start": "2017-02-11", "realtime_end": "2017-03-10", "date": "2017-01-01", "value": "1.5"}
    rows = [row, row | {"date": "2017-13-01"}, row | {"value": "n/a"}, row | {"value": " . "}, row | {"realtime_end": None}, {k: v for k, v in row.items() if k != "realtime_start"}, row | {"value": None}]
    (tmp_path / "a.json").write_text(json.dumps({"observations": rows}))
    good, bad = rest.parsed_payloads(spark, str(tmp_path / "a.json"), "A", "2017-05-05 00:00:00")
    assert [(str(r["obs_date"]), r["value"]) for r in good.collect()] == [("2017-01-01", 1.5), ("2017-01-01", None), ("2017-01-01", None)]
    assert sorted(r["reason"] for r in bad.collect()) == ["no date: date is 2017-13-01", "no date: realtime_end is missing", "no date: realtime_start is missing", "no number: n/a"]
    good, bad = rest.parsed_payloads(spark, str(tmp_path / "a.json"), "A", "2017-05-05 00:00:00", all_vintages=False)
    assert good.count() == 4 and bad.count() == 3
