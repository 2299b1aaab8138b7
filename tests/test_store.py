import random
import threading
import time
from datetime import date, datetime, timedelta

import pytest

from tidemark.exceptions import StorageError
from tidemark.functions.columns import known_on
from tidemark.operators import store
from tidemark.schemas import OBSERVATIONS

NOW = datetime(2026, 7, 30, 12)
OPEN = date(9999, 12, 31)


def row(start, end, value, day=date(2026, 4, 1), series="A", fetched=NOW):
    return series, day, start, end, value, "test", fetched


@pytest.fixture
def three(spark):
    rows = [row(date(2026, 5, 8), date(2026, 6, 4), 811.0), row(date(2026, 6, 5), date(2026, 7, 1), 814.5), row(date(2026, 7, 2), OPEN, 809.25)]
    return spark.createDataFrame(rows, OBSERVATIONS)


@pytest.mark.parametrize("day,value", [("2026-05-07", None), ("2026-05-08", 811.0), ("2026-06-04", 811.0), ("2026-06-05", 814.5), ("2026-07-02", 809.25)])
def test_both_ends_of_a_window_count(three, day, value):
    from pyspark.sql import functions as F

    got = [r["value"] for r in three.filter(known_on(F.lit(day).cast("date"))).collect()]
    assert got == ([] if value is None else [value])


def test_upsert_closes_the_open_window_and_is_idempotent(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    first = spark.createDataFrame([row(date(2026, 5, 8), OPEN, 1.0)], OBSERVATIONS)
    second = spark.createDataFrame([row(date(2026, 5, 8), date(2026, 6, 4), 1.0), row(date(2026, 6, 5), OPEN, 2.0), row(date(2026, 5, 8), OPEN, 9.0, series="B")], OBSERVATIONS)
    assert s.upsert(first) == 1
    assert s.upsert(second) == 3
    once = sorted(map(tuple, s.observations().select("series_id", "realtime_start", "realtime_end", "value").collect()))
    s.upsert(second)
    assert sorted(map(tuple, s.observations().select("series_id", "realtime_start", "realtime_end", "value").collect())) == once
    assert once == [("A", date(2026, 5, 8), date(2026, 6, 4), 1.0), ("A", date(2026, 6, 5), OPEN, 2.0), ("B", date(2026, 5, 8), OPEN, 9.0)]
    assert s.observations("A", as_of="2026-06-01").count() == 1


def test_guards(spark):
    shown = spark.createDataFrame([row(NOW.date(), OPEN, 1.0)], OBSERVATIONS)
    with pytest.raises(StorageError):
        store.check_batch(shown)
    assert store.check_batch(shown.union(spark.createDataFrame([row(date(2026, 1, 1), OPEN, 1.0)], OBSERVATIONS))) == 2
    with pytest.raises(StorageError):
        store.check_batch(spark.createDataFrame([row(date(2026, 2, 1), date(2026, 1, 1), 1.0)], OBSERVATIONS))
    assert store.check_batch(spark.createDataFrame([], OBSERVATIONS)) == 0


def test_release_dates_are_a_set(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    days = spark.createDataFrame([(194, date(2026, 1, 7)), (194, date(2026, 2, 4))], "release_id int, release_date date")
    s.upsert_releases(days)
    s.upsert_releases(days)
    assert s.releases(194).count() == 2
    assert s.releases(194, "2026-01-31").count() == 1


def test_a_write_that_fails_leaves_what_was_there(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert not s.exists() and s.observations().count() == 0 and s.upsert(spark.createDataFrame([], OBSERVATIONS)) == 0
    s.upsert(spark.createDataFrame([row(date(2026, 5, 8), OPEN, 1.0), row(date(2026, 5, 8), OPEN, 5.0, series="B/x y")], OBSERVATIONS))
    real = s._commit
    s._commit = lambda was, added: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        s.upsert(spark.createDataFrame([row(date(2026, 5, 8), OPEN, 2.0)], OBSERVATIONS))
    s._commit = real
    assert s.observations("A").first()["value"] == 1.0 and s.observations("B/x y").first()["value"] == 5.0
    for v in (2.0, 3.0, 4.0):
        s.upsert(spark.createDataFrame([row(date(2026, 5, 8), OPEN, v)], OBSERVATIONS))
    assert s.observations("A").first()["value"] == 4.0 and s.observations("B/x y").first()["value"] == 5.0 and s.observations().count() == 2


DAYS = [date(2024 + k // 12, k % 12 + 1, 1) for k in range(24)]


def batch(spark, version, days=DAYS, series=("A", "B", "C"), start=date(2026, 5, 8)):
    return spark.createDataFrame([row(start, OPEN, float(version), day=d, series=x) for d in days for x in series], OBSERVATIONS)


def values(rows):
    return {(r["series_id"], r["obs_date"]): r["value"] for r in rows.collect()}


def test_an_upsert_adds_to_the_buckets_it_touches_and_rewrites_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 4, 4)
    s.upsert(batch(spark, 1))
    before = s.manifest()
    few = DAYS[3:5]
    s.upsert(batch(spark, 2, few, ["B"]))
    after = s.manifest()
    touched = {b for b in after["segments"] if after["segments"][b] != before["segments"].get(b)}
    assert 1 <= len(touched) <= 2
    for b, segments in before["segments"].items():
        assert after["segments"][b][: len(segments)] == segments  # files of before are there as they were
    assert values(s.observations()) == {(x, d): 2.0 if x == "B" and d in few else 1.0 for x in "ABC" for d in DAYS}


def test_a_series_is_dealt_to_many_buckets_and_read_from_its_own(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 4, 8)
    s.upsert(batch(spark, 1))
    own = set(s._buckets_of(["A"], [4, 8]))
    held = {int(b) for b in s.manifest()["segments"]} & own
    assert len(own) == 8 and len(held) >= 6
    plan = s.observations("A", start="2024-06-01")
    assert {int(f.split("_b=")[1].split("/")[0]) for f in plan.inputFiles()} == held
    assert values(plan) == {("A", d): 1.0 for d in DAYS if d >= date(2024, 6, 1)}
    assert values(s.observations(["A", "C"])) == {(x, d): 1.0 for x in "AC" for d in DAYS}
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scan and "GreaterThanOrEqual(obs_date" in scan and "Exchange" not in scan


def test_filters_reach_the_scan_below_the_merge(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 1, 1)
    for v in (1, 2):
        s.upsert(batch(spark, v))
    plan = s.observations("A", as_of="2026-06-01", start="2024-06-01")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    scan = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(obs_date,2024-06-01)" in scan and "LessThanOrEqual(realtime_start,2026-06-01)" in scan
    assert set(values(plan).values()) == {2.0}


def test_a_window_that_a_later_segment_closes_is_not_seen_open(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 1, 1)
    s.upsert(spark.createDataFrame([row(date(2026, 5, 8), OPEN, 1.0)], OBSERVATIONS))
    s.upsert(spark.createDataFrame([row(date(2026, 5, 8), date(2026, 6, 4), 1.0), row(date(2026, 6, 5), OPEN, 2.0)], OBSERVATIONS))
    assert [r["value"] for r in s.observations("A", as_of="2026-07-01").collect()] == [2.0]
    assert [r["value"] for r in s.observations("A", as_of="2026-06-04").collect()] == [1.0]


def test_of_repeated_keys_in_a_batch_the_last_fetched_counts(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = [row(date(2026, 5, 8), OPEN, float(h), fetched=datetime(2026, 7, 30, h)) for h in (9, 23, 11)] + [row(date(2026, 5, 8), OPEN, 0.0, fetched=None)]
    assert s.upsert(spark.createDataFrame(rows, OBSERVATIONS)) == 4
    assert values(s.observations()) == {("A", date(2026, 4, 1)): 23.0}


def test_merges_keep_what_counts_and_touch_due_buckets_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 2, 2, most_segments=3)
    expected = {}
    for v in range(1, 9):
        days = DAYS if v == 1 else DAYS[v : v + 2]
        s.upsert(batch(spark, v, days, ["A"] if v > 1 else "ABC"))
        expected |= {(x, d): float(v) for x in (["A"] if v > 1 else "ABC") for d in days}
        assert values(s.observations()) == expected
        assert max(len(x) for x in s.manifest()["segments"].values()) <= 3
    assert s.compact() == []
    before = s.manifest()
    due = s.compact(1)
    after = s.manifest()
    assert due == sorted(int(b) for b, x in before["segments"].items() if len(x) > 1)
    assert all(after["segments"][b] == x for b, x in before["segments"].items() if int(b) not in due)
    assert values(s.observations()) == expected


@pytest.mark.parametrize("sizes,most,n", [([], 2, 0), ([9, 1], 2, 0), ([100, 1, 1], 2, 2), ([100, 4, 1, 1], 2, 3), ([9, 4, 1, 1], 2, 4), ([1000, 100, 9, 4, 1], 3, 3)])
def test_which_segments_merge(sizes, most, n):
    assert store.segments_to_merge(sizes, most) == n


def test_readers_of_an_earlier_manifest_keep_their_files(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 1, 2, most_segments=2)
    s.upsert(batch(spark, 1))
    first, early = s.manifests()[-1], s.observations()
    for v in (2, 3, 4):
        s.upsert(batch(spark, v))
    assert set(values(early).values()) == {1.0} == set(values(s.observations(manifest=first)).values())
    assert set(values(s.observations()).values()) == {4.0}


def test_what_is_older_than_the_time_that_is_kept_goes(spark, tmp_path):
    import os

    s = store.Store(spark, str(tmp_path / "s"), 1, 2, most_segments=2, keep_hours=0.0)
    stray = tmp_path / "s" / "versions" / "0f" / "_b=0"
    for v in (1, 2, 3, 4, 5):
        s.upsert(batch(spark, v))
        stray.mkdir(parents=True, exist_ok=True)  # of a job that failed before its commit
        os.utime(stray.parent, (0, 0))
    s.upsert(batch(spark, 6))
    named = {f.split("/")[0] for x in s.manifest()["segments"].values() for f, _ in x} | {f.split("/")[0] for f in s.manifest()["replaced"]}
    assert {f.getPath().getName() for f in s._list(f"{s.path}/versions")} == named and "0f" not in named
    assert len(s.manifests()) <= 2
    with pytest.raises(StorageError, match="not kept"):
        s.observations(manifest=1)
    assert set(values(s.observations()).values()) == {6.0}


def test_a_second_writer_is_refused(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.upsert(batch(spark, 1))
    was = s.manifest()
    s.upsert(batch(spark, 2))
    with pytest.raises(StorageError, match="another writer"):
        s._commit(was, {"0": ("lost/_b=0", 1, 0)})
    assert set(values(s.observations()).values()) == {2.0}


def test_buckets_of_a_store_are_its_own(spark, tmp_path):
    store.Store(spark, str(tmp_path / "s"), 2, 3).upsert(batch(spark, 1))
    s = store.Store(spark, str(tmp_path / "s"), 8, 8)
    s.upsert(batch(spark, 2, DAYS[:3]))
    assert s.manifest()["parts"] == [2, 3] and values(s.observations("B"))[("B", DAYS[0])] == 2.0


def test_releases_and_observations_share_a_manifest(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), most_segments=1)
    for k in (1, 2, 3):
        s.upsert_releases(spark.createDataFrame([(194, date(2026, k, 7))], "release_id int, release_date date"))
        s.upsert(batch(spark, k))
    assert s.releases(194).count() == 3 and set(values(s.observations()).values()) == {3.0}


def test_snapshots_of_origins_are_those_of_each_day(spark):
    """Windows of a day, of years and without end; origins in bins, between bins, before and after all windows."""
    rng = random.Random(4)
    rows = []
    for day in DAYS[:12]:
        start = date(2025, 1, 1) + timedelta(rng.randint(0, 200))
        for _ in range(rng.randint(1, 6)):
            end = start + timedelta(rng.choice([0, 1, 9, 40, 400]))
            rows.append(("A", day, start, end, rng.random()))
            start = end + timedelta(1)
        rows.append(("A", day, start, OPEN, rng.random()))
    observed = spark.createDataFrame(rows, "series_id string, obs_date date, realtime_start date, realtime_end date, value double")
    days = [date(2024, 1, 1), date(2030, 1, 1), *(date(2025, 1, 1) + timedelta(rng.randint(0, 900)) for _ in range(40))]
    expected = sorted((d, r[1], r[4]) for d in set(days) for r in rows if r[2] <= d <= r[3])
    origins = spark.createDataFrame([(d,) for d in set(days)], "as_of date")
    for most in (store.MOST_ORIGINS, 0):
        store.MOST_ORIGINS, kept = most, store.MOST_ORIGINS
        try:
            plan = store.at_origins(observed, origins)
            assert sorted((r["as_of"], r["obs_date"], r["value"]) for r in plan.collect()) == expected
            assert "NestedLoop" not in plan._jdf.queryExecution().toString()
        finally:
            store.MOST_ORIGINS = kept
    one = spark.createDataFrame([(days[2],)], "as_of date")
    assert store.at_origins(observed, one).count() == sum(r[2] <= days[2] <= r[3] for r in rows)
    assert store.at_origins(observed, origins.limit(0)).collect() == []


def test_tables_of_two_threads_do_not_mix(spark):
    """A scope that ends in one thread leaves the tables that another wrote meanwhile."""
    from tidemark.tables import durable, scratch

    opened, written, read = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            opened.set()
            assert written.wait(60)
            read.append(durable(spark.range(3), "other").count())

    thread = threading.Thread(target=other)
    with scratch(spark):
        thread.start()
        assert opened.wait(60)
        mine = durable(spark.range(7), "mine")
        written.set()
        thread.join(120)
        assert read == [3] and mine.count() == 7


def test_a_stream_beside_a_query(spark, tmp_path):
    """Batches that a stream writes in its own thread, while this thread has a scope open."""
    from tidemark.streaming import upsert_stream
    from tidemark.tables import durable, scratch

    s = store.Store(spark, str(tmp_path / "s"))
    batch(spark, 1).write.parquet(str(tmp_path / "in"))
    with scratch(spark):
        mine = durable(spark.range(5), "mine")
        query = upsert_stream(spark.readStream.schema(OBSERVATIONS).parquet(str(tmp_path / "in")), s, str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert mine.count() == 5
    assert len(values(s.observations())) == 72


def test_stream_of_batches(spark, tmp_path):
    from tidemark.streaming import upsert_stream

    s = store.Store(spark, str(tmp_path / "s"))
    for i, v in enumerate((1.0, 2.0)):
        spark.createDataFrame([row(date(2026, 5, 8 + i), OPEN, v)], OBSERVATIONS).write.mode("append").parquet(str(tmp_path / "in"))
        query = upsert_stream(spark.readStream.schema(OBSERVATIONS).parquet(str(tmp_path / "in")), s, str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(r["value"] for r in s.observations().collect()) == [1.0, 2.0]


@pytest.fixture
def state_store(spark):
    from tidemark.streaming import STATE_STORE

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_shuffled_repeated_stream_of_revisions_gives_the_batch_table(spark, tmp_path, state_store):
    """Late, out of order, twice, corrected, without values; over many batches and a restart."""
    from tidemark.operators.revisions import REVISIONS, windows
    from tidemark.streaming import upsert_stream, windows_stream

    rng = random.Random(11)
    rows = []
    for x in "AB":
        for day in DAYS[:5]:
            for k in range(rng.randint(1, 5)):
                rows.append((x, day, date(2026, 1, 1) + timedelta(11 * k), None if rng.random() < 0.1 else float(k), "test", datetime(2026, 7, 30, 9)))
    rows += [(*r[:3], 50.0, "test", datetime(2026, 7, 31, 9)) for r in rng.sample(rows, 4)]  # corrections
    rows += [(*rows[0][:3], 9.0, "old", None), ("B", DAYS[0], date(2025, 6, 1), 7.0, "late", datetime(2026, 7, 30, 9))]
    rows += rng.sample(rows, 15)
    rng.shuffle(rows)
    for i in range(0, len(rows), 12):
        spark.createDataFrame(rows[i : i + 12], REVISIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = store.Store(spark, str(tmp_path / "s"), 2, 2)

    def start(trigger):
        read = spark.readStream.schema(REVISIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return upsert_stream(windows_stream(read), s, str(tmp_path / "check"), guarded=False).trigger(**trigger).start()

    first = start({"processingTime": "0 seconds"})
    while (p := first.lastProgress) is None or p["batchId"] < 1:
        assert first.isActive, first.exception()
        time.sleep(0.2)
    first.stop()  # in the midst of its batches
    start({"availableNow": True}).awaitTermination()
    columns = ["series_id", "obs_date", "realtime_start", "realtime_end", "value", "source", "fetched_at"]
    got = sorted(map(str, s.observations().select(columns).collect()))
    assert got == sorted(map(str, windows(spark.createDataFrame(rows, REVISIONS)).select(columns).collect()))
    assert len(got) == len({r[:3] for r in rows})


def test_actuals_are_of_the_release_day(spark):
    from tidemark.plans import backtest
    from tidemark.sources.registry import registry

    d = lambda m, x=1: date(2024, m, x)
    rows = [("ADPMNUSNERSA", d(1), d(2, 3), d(3, 2), 5000.0), ("ADPMNUSNERSA", d(1), d(3, 3), OPEN, 6000.0), ("ADPMNUSNERSA", d(2), d(3, 3), OPEN, 9000.0), ("ICSA", d(2), d(3, 3), OPEN, 1.0)]
    observed = spark.createDataFrame(rows, "series_id string, obs_date date, realtime_start date, realtime_end date, value double")
    wanted = spark.createDataFrame([(d(3, 3), d(2)), (d(2, 3), d(1))], "origin date, target_month date")
    plan = backtest.actuals_at_release(observed, wanted, registry(spark), "ADPMNUSNERSA")
    assert {r["origin"]: r["actual"] for r in plan.collect()} == {d(3, 3): 3.0, d(2, 3): None}
    assert "NestedLoop" not in plan._jdf.queryExecution().toString()


def test_bounds_of_arrow_batches_come_back(spark):
    from tidemark.tables import BATCH, bytes_of, durable

    assert [bytes_of(x) for x in ("10000", "67108864b", "64MB", "16k", "1g", "-1")] == [10000, 64 << 20, 64 << 20, 16 << 10, 1 << 30, -1]
    before = {name: spark.conf.get(name) for name in BATCH}
    sizes = durable(spark.range(5000, numPartitions=1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id long"), "sizes")
    assert sizes.count() >= 3
    assert {name: spark.conf.get(name) for name in BATCH} == before
