import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sensorweave.sources import feed, files, rest
from sensorweave.streaming import live

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, folder, batches):
    schema = "station_id long, ts timestamp_ntz, value double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_hourly_stream_equals_batch(spark, tmp_path):
    rows = [(s, T0 + dt.timedelta(minutes=20 * k), float(k)) for s in (1, 2) for k in range(30)] + [(1, T0 + dt.timedelta(days=3), 0.0)]
    got = {(r.station_id, r.ts): r.value for r in _run(live.hourly(_stream(spark, tmp_path, [rows])), "hourly")}
    want = {(s, T0 + dt.timedelta(hours=h)): 3 * h + 1.0 for s in (1, 2) for h in range(10)}
    assert got == want


END = [(9, T0 + dt.timedelta(days=30), 0.0)]  # moves the watermark past all else


def test_stuck_alarm_needs_consecutive_hours(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(hours=h), 5.0) for h in range(4)] + [(2, T0 + dt.timedelta(hours=2 * h), 5.0) for h in range(4)]
    got = _run(live.stuck_alarms(_stream(spark, tmp_path, [rows, END, END]), 3), "stuck")
    assert [(r.station_id, r.ts, r.run) for r in got] == [(1, T0 + dt.timedelta(hours=2), 3)]


def test_stuck_alarms_of_late_hours_equal_the_batch(spark, tmp_path):
    import random

    rnd = random.Random(4)
    rows = [(s, T0 + dt.timedelta(hours=h), float((h // (s + 2)) % 3)) for s in (1, 2, 3) for h in range(60) if rnd.random() < 0.95]
    late = sorted(rows, key=lambda r: (r[1] - T0).total_seconds() + rnd.uniform(0, 5 * 3600))  # up to five hours out of order
    batches = [late[k : k + 20] for k in range(0, len(late), 20)]
    got = _run(live.stuck_alarms(_stream(spark, tmp_path, [*batches, END, END]), 3), "stuck_late")
    want = []
    for s in (1, 2, 3):
        last, run = None, 0
        for _, t, v in sorted(r for r in rows if r[0] == s):
            run = run + 1 if last and t - last[0] == dt.timedelta(hours=1) and v == last[1] else 1
            last = (t, v)
            if run == 3:
                want.append((s, t, v))
    assert sorted((r.station_id, r.ts, r.value) for r in got) == sorted(want) and len(want) > 10


def _feed(folder, poll, **answers):
    (folder / str(poll)).mkdir(parents=True)
    for name, answer in answers.items():
        (folder / str(poll) / f"{name.replace('_', '-')}.json").write_text(json.dumps(answer))


def test_live_feed_falls_back_and_shares_its_budget(spark, tmp_path):
    record = lambda k, v="12.5", **o: {"station": f"s{k}", "last_update": "01-02-2024 10:00:00", "avg_value": v, "pollutant_id": "PM2.5"} | o
    place = lambda aqi: {"iaqi": {"pm25": {"v": aqi}}, "time": {"iso": "2024-02-01T10:00:00+05:30"}}
    _feed(tmp_path / "r", 0, primary_0={"total": 5, "records": [record(1), record(2, "NA")]}, primary_2={"records": [record(3), record(4, pollutant_id="NO2")]}, primary_4={"error": "busy"})
    _feed(tmp_path / "r", 1, place_a=place(50), place_b=place(None), place_c={"error": "gone", "lasting": True})
    spark.dataSource.register(feed.FeedSource)
    stream = spark.readStream.format("sensor_feed").options(replay=str(tmp_path / "r"), places="a,b,c,d", page=2, calls=8, spacing=0.01).load()
    q = stream.writeStream.format("memory").queryName("feed").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("feed")
    got = {(r.poll, r.place): (r.value, r.source) for r in feed.readings(rows).collect()}
    assert got == {(0, "s1"): (12.5, "primary"), (0, "s3"): (12.5, "primary"), (1, "a"): (12.0, "fallback")}
    assert {r.ts for r in feed.readings(rows).collect()} == {dt.datetime(2024, 2, 1, 4, 30)}
    found = {r.poll: r for r in feed.status(rows, 4, F.lit("2024-02-01 09:00:00").cast("timestamp")).collect()}
    assert (found[0].ok, found[0].source, found[0].reporting) == (True, "primary", 2) and "budget" in found[0].error
    assert (found[1].ok, found[1].source, found[1].reporting) == (True, "fallback", 1) and all(x in found[1].error for x in ("primary: primary-0: no answer", "gone", "place-d: no answer"))
    late = {r.poll: r.ok for r in feed.status(rows, 4, F.lit("2024-02-02 09:00:00").cast("timestamp")).collect()}
    assert late == {0: False, 1: False}


def test_feed_plan_limits_calls_and_time(tmp_path):
    _feed(tmp_path, 0, primary_0={"total": 100, "records": [{"station": "x"}]})
    reader = feed.FeedReader({"replay": str(tmp_path), "page": "10", "calls": "6", "places": "a,b,c"}, lambda s: None, lambda: 0.0)
    parts = reader.planned(0)
    assert [p.at for p in parts if p.kind == "page"] == [10, 20, 30] and sum(p.calls for p in parts if p.kind == "page") <= 6 and len([p for p in parts if p.kind == "error"]) == 6
    now, waits = iter([0.0]), []
    reader = feed.FeedReader({"replay": str(tmp_path), "calls": "3", "places": "a,b,c", "seconds": "5", "spacing": "2"}, waits.append, lambda: next(now, 100.0))
    parts = reader.planned(7)
    assert [(p.kind, p.at) for p in parts] == [("error", None), ("place", "a"), ("place", "b"), ("error", "c")]
    assert [r[5] for p in parts for r in reader.read(p)] == ["primary: primary-0: no answer", "out of time", "out of time", "c beyond the budget of calls"]
    assert reader.latestOffset() == {"poll": 1} and reader.initialOffset() == {"poll": 0}


def test_replayed_source(spark, tmp_path):
    row = lambda h, v, **k: {"period": {"datetimeFrom": {"utc": f"2024-01-01T0{h}:00:00Z"}}, "value": v} | k
    (tmp_path / "7-0.json").write_text(json.dumps({"results": [row(1, 3.5), row(2, None, flagInfo={"hasFlags": True}), {"value": 1}]}))
    spark.dataSource.register(rest.SensorSource)
    got = spark.read.format("sensor_rest").option("pages", str(tmp_path)).load().orderBy("ts").collect()
    assert [(r.sensor_id, r.value, r.flagged) for r in got] == [(7, 3.5, False), (7, None, True)]


def test_retries_windows_and_fallback():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise rest.FeedError("busy", 7.0 if len(calls) == 1 else None)
        return {"results": [1]}

    assert rest.with_retries(call, waits.append) == {"results": [1]} and waits == [7.0, 2.0]

    def fetch(a, b):
        if b - a > dt.timedelta(days=10):
            raise rest.FeedError("too long")
        return [{"period": {"datetimeFrom": {"utc": x.isoformat()}}} for x in (a, b)]

    assert len(rest.windowed(fetch, T0, T0 + dt.timedelta(days=20))) == 3
    with pytest.raises(rest.FeedError):
        rest.windowed(lambda a, b: (_ for _ in ()).throw(rest.FeedError("x")), T0, T0 + dt.timedelta(days=20))
    assert rest.first_that_answers(lambda: 1 / 0, lambda: [5]) == ([5], "division by zero")


def test_lasting_errors_offsets_places_budget_and_spacing():
    calls = []

    def gone():
        calls.append(1)
        raise rest.FeedError("no such sensor", lasting=True)

    with pytest.raises(rest.FeedError):
        rest.with_retries(gone, lambda s: None)
    assert len(calls) == 1
    assert list(rest.by_offset(lambda at, n: list(range(at, min(at + n, 25))), 10)) == list(range(25)) and list(rest.by_offset(lambda at, n: [])) == []
    place = lambda i, lat, lon: {"id": i, "name": f"s{i}", "coordinates": {"latitude": lat, "longitude": lon}}
    found = {"results": [place(1, 5.0, 6.0), place(1, 5.1, 6.0), place(2, 9.0, 6.0), {"id": 3}]}
    assert list(rest.located(lambda page: found, (5.5, 4.5, 6.5, 5.5))) == [(1, "s1", 5.0, 6.0)]
    now = iter(range(100))
    assert rest.within_budget([1, 2, 3, 4], lambda i: [i] if i != 2 else gone(), 3, lambda: next(now)) == ([1], [2, 3, 4])
    waits, clock = [], iter([0.0, 0.4, 1.0, 5.0, 5.0])
    call = rest.spaced(lambda: None, 1.0, waits.append, lambda: next(clock))
    call(), call(), call()
    assert waits == [pytest.approx(0.6)]
    good = {"period": {"datetimeFrom": {"utc": "2024-01-01T00:00:00Z"}}, "value": "x", "flagInfo": {"hasFlags": True}}
    assert rest.parsed(1, good)[2:] == (None, True) and rest.parsed(1, {"period": {"datetimeFrom": {"utc": "soon"}}}) is None and rest.parsed(1, {}) is None


def test_artefacts_resume_and_staleness(spark, tmp_path):
    from pyspark.sql import functions as F

    ids = spark.range(1, 4).withColumnRenamed("id", "sensor_id")
    assert files.missing(spark, f"{tmp_path}/none", ids, "sensor_id").count() == 3
    files.write_partitioned(ids.where("sensor_id < 3").withColumn("v", F.lit(1)), f"{tmp_path}/parts", "sensor_id")
    assert [r[0] for r in files.missing(spark, f"{tmp_path}/parts", ids, "sensor_id").collect()] == [3]
    files.write_mask(ids, f"{tmp_path}/mask", 10)
    files.write_mask(ids.limit(1), f"{tmp_path}/mask", 20)
    assert {r.cells: r["count"] for r in spark.read.parquet(f"{tmp_path}/mask").groupBy("cells").count().collect()} == {10: 3, 20: 1}
    files.write_card(ids.limit(1), f"{tmp_path}/card")
    assert spark.read.json(f"{tmp_path}/card").first()["sensor_id"] == 1
    assert files.fingerprint(ids) == files.fingerprint(ids.orderBy(F.desc("sensor_id"))) != files.fingerprint(ids.limit(2))
    rows = spark.createDataFrame([(1, T0), (2, T0 - dt.timedelta(hours=7))], "station_id long, ts timestamp_ntz")
    assert {r.station_id: r.ok for r in live.fresh(rows, F.lit(T0).cast("timestamp_ntz")).collect()} == {1: True, 2: False}


def test_osm_and_column_arrays(spark, tmp_path):
    line = [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]
    payload = {"elements": [{"type": "way", "id": 1, "tags": {"highway": "primary_link"}, "geometry": line}, {"type": "relation", "id": 2, "tags": {}, "members": [{"type": "node"}, {"type": "way", "geometry": line}]}, {"type": "way", "id": 3, "tags": {}, "geometry": []}]}
    (tmp_path / "osm.json").write_text(json.dumps(payload))
    lines = files.osm_lines(spark, str(tmp_path / "osm.json"))
    assert sorted(r.id for r in lines.collect()) == [1, 2] and [r.id for r in files.roads(lines).collect()] == [1]
    (tmp_path / "wind.json").write_text(json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "wind_speed_10m": [36.0, 0.0], "wind_direction_10m": [10.0, 20.0]}}))
    wind = files.column_arrays(spark, str(tmp_path / "wind.json"))
    assert [round(r.speed_ms, 6) for r in wind.orderBy("ts").collect()] == [10.0, 0.0] and files.covers(wind, "2024-01-01 00:00", "2024-01-01 01:00")
    files.write_report(wind.select(F.col("speed_ms")), str(tmp_path / "r"))
    assert files.markdown(wind.select("speed_ms")).first().line == "| 10.0 |"


def test_entry_module_without_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.LLM == {} and len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], timeout=60).returncode == 0
