"""Scans, sinks and streams."""

import datetime

from pyspark.sql import functions as F

from skyloom.operators import kernels
from skyloom.sources import weather
from skyloom.streaming import causal


def test_station_csv_skips_the_preamble(spark, tmp_path):
    p = tmp_path / "station.csv"
    p.write_text("latitude,longitude,elevation\n-7.5,110.2,320\n\ntime,wind_speed_10m (km/h),cloud_cover (%),cloud_cover_low (%)\n2024-01-01T00:00,3.5,NaN,1\n2024-01-01T01:00,x,50,2\n")
    df = weather.station_csv(spark, str(p))
    assert df.columns == ["time", "wind_speed_10m", "cloud_cover", "cloud_cover_low"]
    rows = df.orderBy("time").collect()
    assert rows[0]["wind_speed_10m"] == 3.5 and rows[0]["cloud_cover"] is None and rows[1]["wind_speed_10m"] is None and rows[1]["cloud_cover"] == 50.0
    bound = weather.bind(df, {"ws": "WIND_SPEED", "cloud": "cloud_cover", "gust": "gust"}, exact=("cloud",))
    assert bound.columns == ["time", "ws", "cloud", "gust"] and bound.where("gust is not null").count() == 0 and bound.agg(F.sum("cloud")).first()[0] == 50.0
    meta = weather.station_metadata(spark, str(p)).first()
    assert (meta["latitude"], meta["elevation"]) == (-7.5, 320.0)


def test_index_scans(spark, tmp_path):
    (tmp_path / "epoch.csv").write_text("time,sst\n0.5,1.0\n7,NaN\n")
    e = weather.epoch_csv(spark, str(tmp_path / "epoch.csv"), "sst", "1978-01-01 12:00:00").orderBy("date").collect()
    assert e[0]["date"] == datetime.date(1978, 1, 2) and e[1]["value"] is None
    (tmp_path / "m.txt").write_text("1950 2026\n2000 0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8 0.9 1.0 1.1 99.90\n")
    m = weather.monthly_matrix(spark, str(tmp_path / "m.txt"))
    assert m.count() == 11 and m.where("month = date'2000-03-01'").first()["value"] == 0.3
    (tmp_path / "w.txt").write_text("2020-01-01,2020-01-07,0.5\n2020-01-08,2020-01-14,1.5\n")
    assert weather.weekly_index(spark, str(tmp_path / "w.txt")).first()["value"] == 1.0
    (tmp_path / "r.txt").write_text("# comment\n2020 1 2 0.5 -0.5 3 0.7 x\n2020 1 3 1e36 1e36 999 1e36 x\n")
    assert weather.phase_index(spark, str(tmp_path / "r.txt")).count() == 1
    (tmp_path / "r8.csv").write_text("# comment\n2020,1,2,0.5,-0.5,3,120.5,0.7,0.71\n")
    assert weather.phase_index(spark, str(tmp_path / "r8.csv")).first()["amplitude"] == 0.7
    (tmp_path / "w8.txt").write_text("20080728,20080803,0.01\n20080804,20080810,0.03\n")
    assert weather.weekly_index(spark, str(tmp_path / "w8.txt")).first()["value"] == 0.02


def test_keep_first_and_first_available(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "a")], "time int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "time int, v string")
    assert sorted(map(tuple, weather.keep_first([a, b]).collect())) == [(1, "a"), (2, "b")]
    a.write.parquet(str(tmp_path / "there"))
    assert weather.first_available(spark, [str(tmp_path / "none"), str(tmp_path / "there")], lambda s, p: s.read.parquet(p)).count() == 1


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude\n-7.5,110.2\n\ntime,ws (km/h),cloud (%)\n2024-01-01T00:00,1.0,50\n2024-01-01T01:00,2.0\n")
    (tmp_path / "b.csv").write_text("time,cloud (%),ws (km/h),rh (%)\n2024-01-02T00:00,60,3.0,80\n")
    rows = {str(r["time"]): (r["ws"], r["cloud"], r["rh"]) for r in weather.station_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert rows == {"2024-01-01 00:00:00": (1.0, 50.0, None), "2024-01-01 01:00:00": (2.0, None, None), "2024-01-02 00:00:00": (3.0, 60.0, 80.0)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    assert weather.as_json(df).first()[0] == '{"id":1,"v":[1.0,2.0]}'
    weather.write_report({"t": df.select("id")}, str(tmp_path / "out"), ("csv", "json", "parquet"))
    assert spark.read.csv(str(tmp_path / "out/csv/t"), header=True).count() == 1


def stream_of(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(t + datetime.timedelta(minutes=20 * i), i % 2, float(10 + i % 5), 90.0) for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp, station long, ws double, wd double").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("ts timestamp, station long, ws double, wd double").parquet(str(tmp_path / "in")), rows


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def test_hourly_stream_equals_batch(spark, tmp_path):
    """Every hour that the watermark has closed has the rows that a batch counts; the last hours are still open."""
    s, rows = stream_of(spark, tmp_path)
    run(causal.hourly_stream(s), "hourly_s")
    got = {(r["station"], r["hour"]): (r["n"], r["ws"], r["peak"]) for r in spark.sql("select * from hourly_s").collect()}
    want: dict = {}
    for ts, station, ws, _ in rows:
        want.setdefault((station, ts.replace(minute=0)), []).append(ws)
    last = max(ts for ts, *_ in rows)
    assert set(got) == {k for k in want if k[1] + datetime.timedelta(hours=1) <= last - datetime.timedelta(hours=2)}
    assert all(v[0] == len(want[k]) and abs(v[1] - sum(want[k]) / len(want[k])) < 1e-9 and v[2] == max(want[k]) for k, v in got.items())


def test_sessions_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    minutes = [0, 5, 9, 30, 31, 60, 600]
    spark.createDataFrame([(t + datetime.timedelta(minutes=x), 1, float(x)) for x in minutes], "ts timestamp, station long, ws double").coalesce(1).write.parquet(str(tmp_path / "in"))
    run(causal.sessions_stream(spark.readStream.schema("ts timestamp, station long, ws double").parquet(str(tmp_path / "in"))), "sessions_s")
    got = sorted((r["start"], r["n"], r["peak"]) for r in spark.sql("select * from sessions_s").collect())
    assert got == [(t, 3, 9.0), (t + datetime.timedelta(minutes=30), 2, 31.0), (t + datetime.timedelta(minutes=60), 1, 60.0)]


def test_filtered_stream_equals_batch(spark, tmp_path):
    s, rows = stream_of(spark, tmp_path)
    run(causal.filtered_stream(s), "filtered_s")
    got = {(r["station"], r["ts"]): r["level"] for r in spark.sql("select * from filtered_s").collect()}
    for station in (0, 1):
        own = [r for r in rows if r[1] == station]
        level, _ = kernels.local_trend([r[2] for r in own])
        assert all(abs(got[station, r[0]] - x) < 1e-6 for r, x in zip(own, level, strict=True))
