"""Sinks, streams and jobs over temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import daily as D
from gaugeflow.operators import totals as T
from gaugeflow.plans import jobs as J
from gaugeflow.plans import queries as Q
from gaugeflow.sources import formats as S
from gaugeflow.sources import tables as B
from gaugeflow.streaming import jobs as ST

from .compare import rows
from .conftest import SF
from .test_operators import daily, one, readings


def test_upsert_rewrites_only_touched_years(spark, tmp_path):
    path = str(tmp_path / "daily")
    B.upsert_daily(spark, path, daily(spark, ("s", "2023-01-01", 5.0, 6.0), ("s", "2024-01-01", 5.0, 6.0)))
    before = sorted(p.name for p in (tmp_path / "daily").glob("*/year=2023/*.parquet"))
    for _ in range(2):
        B.upsert_daily(spark, path, daily(spark, ("s", "2024-01-01", 1.0, 5.5), ("t", "2024-02-01", 3.0, 3.0)))
    assert one(B.read_table(spark, path), "station_id", "year", "min_v", "max_v") == [("s", 2023, 5, 6), ("s", 2024, 1, 6), ("t", 2024, 3, 3)]
    assert before == sorted(p.name for p in (tmp_path / "daily").glob("*/year=2023/*.parquet"))


def test_unreadable_table_is_not_started_anew(spark, tmp_path):
    bad = tmp_path / "snap"
    bad.mkdir()
    (bad / "x.parquet").write_text("rubbish")
    with pytest.raises(Exception):  # noqa: B017
        B.read_or_none(spark, str(bad)).count()
    assert B.read_or_none(spark, str(tmp_path / "none")) is None


def test_snapshot_table(spark, tmp_path):
    path = str(tmp_path / "snap")
    shot = lambda *r: spark.createDataFrame(list(r), "station_id string, n string, w string, day string, value double, tidal boolean").withColumn("day", F.to_date("day"))
    B.write_snapshot(spark, path, shot(("a", "A", "R", "2024-01-31", 1.0, False), ("b", "B", "R", "2024-01-31", 2.0, False)))
    B.write_snapshot(spark, path, shot(("a", "A", "R", "2024-02-01", 3.0, False)))
    B.write_snapshot(spark, path, shot(("a", "A", "R", "2024-01-31", None, False)))
    assert one(B.read_table(spark, path), "month", "station_id", "value") == [("2024-01", "a", None), ("2024-01", "b", 2), ("2024-02", "a", 3)]


def test_rerun_of_an_earlier_day_gives_the_last_names(spark, tmp_path):
    path = str(tmp_path / "snap")
    shot = lambda *r: spark.createDataFrame(list(r), "station_id string, n string, w string, day string, value double, tidal boolean").withColumn("day", F.to_date("day"))
    B.write_snapshot(spark, path, shot(("a", "A", "R", "2024-01-05", 1.0, True), ("b", "B", "R", "2024-01-05", 1.0, True)))
    B.write_snapshot(spark, path, shot(("a", "A2", "R2", "2024-01-04", 2.0, False)))
    assert one(B.read_table(spark, path), "station_id", "value", "n", "w", "tidal") == [("a", 1, "A2", "R2", False), ("a", 2, "A2", "R2", False), ("b", 1, "B", "R", True)]
    assert not list(tmp_path.glob("*aside*"))


def test_snapshot_of_another_shape_fails_and_stays(spark, tmp_path):
    path = str(tmp_path / "snap")
    row = lambda day: spark.createDataFrame([("a", "A", "R", day, 1.0, False)], "station_id string, n string, w string, day string, value double, tidal boolean").withColumn("day", F.to_date("day"))
    row("2024-02-30").fillna({"n": "x"}).withColumn("day", F.lit("2024-03-01").cast("date")).withColumn("month", F.lit("2024-02")).write.partitionBy("month").parquet(path)
    with pytest.raises(ValueError, match="has a day"):
        B.write_snapshot(spark, path, row("2024-02-03"))
    assert spark.read.parquet(path).count() == 1
    row("2024-02-03").drop("tidal").withColumn("month", F.lit("2024-02")).write.partitionBy("month").parquet(f"{path}2")
    with pytest.raises(ValueError, match="lacks"):
        B.write_snapshot(spark, f"{path}2", row("2024-02-03"))


def test_partitions_are_cut_into_files(spark, tmp_path):
    path = tmp_path / "daily"
    B.replace_partitions(daily(spark, *[(f"s{i}", "2024-01-01", 1.0, 2.0) for i in range(40)]), str(path), "year", file_rows=10)
    assert len(list(path.glob("*/year=2024/*.parquet"))) == 4 and B.read_table(spark, str(path)).count() == 40


def test_rebuild_is_deterministic_and_has_overview_and_units(spark, tmp_path):
    raw, units = Q.raw_totals(spark, SF), Q.stations(spark, SF)
    ordered = lambda d: [(str(p.relative_to(d)), p.read_bytes()) for p in sorted(d.rglob("*.parquet"))]
    for name in ("a", "b"):
        B.rebuild_totals(T.river_daily(raw.repartition(3 if name == "a" else 5)), T.river_monthly(raw), str(tmp_path / name), units)
    assert ordered(tmp_path / "a/monthly") == ordered(tmp_path / "b/monthly") and ordered(tmp_path / "a/daily") == ordered(tmp_path / "b/daily")
    assert ordered(tmp_path / "a/overview") == ordered(tmp_path / "b/overview")
    assert B.read_table(spark, str(tmp_path / "a"), "units").count() == units.count()
    o = B.read_table(spark, str(tmp_path / "a"), "overview").orderBy("river").first()
    month = T.river_monthly(raw).where(F.col("river") == o["river"]).collect()
    assert len(o["v"]) % 12 == 0 and all(o["v"][(r["year"] - o["from_year"]) * 12 + r["month"] - 1] == r["v"] for r in month)


def test_append_without_a_table_and_to_one_without_diff(spark, tmp_path):
    raw, path = Q.raw_totals(spark, SF), str(tmp_path / "totals")
    day, month = T.river_daily(raw), T.river_monthly(raw)
    month.drop("diff").repartition("year").write.partitionBy("year").parquet(f"{path}/monthly")
    day.repartition("year").write.partitionBy("year").parquet(f"{path}/daily")
    assert B.append_totals(spark, day, month, path, 2000) is True
    got = B.read_table(spark, path, "monthly")
    assert got.where("year <> 2000 and diff is not null").count() == 0 and got.where("year = 2000 and diff is not null").count() > 0
    assert got.where("v is not null").count() == month.where("v is not null").count()
    assert B.read_table(spark, path, "overview").where("exists(diff, x -> x is not null)").count() > 0
    assert B.append_totals(spark, day, month, f"{path}-new", 2000) is False
    assert rows(B.read_table(spark, f"{path}-new", "daily").select(day.columns)) == rows(day)


def test_provisional_days_become_final(spark, tmp_path):
    """A snapshot's day is flagged until the archive has it; the next append replaces its sums."""
    path, stations = str(tmp_path / "totals"), spark.createDataFrame([("s", "R", "cm")], "station_id string, river string, unit string")
    snap = spark.createDataFrame([("s", "2024-01-02", 50.0)], "station_id string, day string, value double").withColumn("day", F.to_date("day"))
    for archive, sum_, flagged in ((daily(spark, ("s", "2024-01-01", 10.0, 20.0)), 50, 1), (daily(spark, ("s", "2024-01-01", 10.0, 20.0), ("s", "2024-01-02", 20.0, 40.0)), 30, 0)):
        filled = D.fill_gaps(archive, snap, 2024)
        raw = T.river_daily_raw(filled, stations)
        B.append_totals(spark, T.river_daily(raw), T.river_monthly(raw), path, 2024)
        assert filled.where("provisional").count() == flagged
        assert B.read_table(spark, path, "daily").where("doy = 1").first()["v"] == sum_


def test_read_measurements_as_a_stream(spark, tmp_path):
    (tmp_path / "in/station_id=x").mkdir(parents=True)
    (tmp_path / "in/station_id=x/a.txt").write_text('[{"timestamp":"2024-01-01T00:00:00Z","value":-.5},{"timestamp":"2024-01-01T01:00:00Z","value":-}]\nrubbish\n')
    batch = S.read_measurements(spark, str(tmp_path / "in"))
    live = ST.run_to_files(S.read_measurements(spark, str(tmp_path / "in"), stream=True), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert one(batch, "station_id", "value") == one(live, "station_id", "value") == [("x", -0.5)]


def test_append_equals_rebuild_and_clears_stale_cells(spark, tmp_path):
    path = str(tmp_path / "totals")
    raw = Q.raw_totals(spark, SF)
    day, month = T.river_daily(raw), T.river_monthly(raw)
    assert B.append_totals(spark, day, month, path, 2000) is False
    B.rebuild_totals(day, month, path)
    less = raw.where("year <> 2000 or doy < 100")
    assert B.append_totals(spark, T.river_daily(less), T.river_monthly(less), path, 2000)
    got = B.read_table(spark, path, "monthly").where("year = 2000")
    assert got.where("month > 4 and v is not null").count() == 0 and got.where("v is not null").count() > 0
    assert B.read_table(spark, path, "daily").where("year = 2000 and doy >= 100 and v is not null").count() == 0
    cols = ["river", "year", "month", "v", "diff"]
    assert rows(B.read_table(spark, path, "monthly").where("year <> 2000").select(cols)) == rows(month.where("year <> 2000").select(cols))
    B.append_totals(spark, day, month, path, 2000)
    assert rows(B.read_table(spark, path, "monthly").where("year = 2000 and v is not null").select(cols)) == rows(month.where("year = 2000 and v is not null").select(cols))


def test_read_measurements_of_many_stations_a_file(spark, tmp_path):
    """Stations are in their lines; a line without one gives nothing."""
    body = '[{"timestamp":"2024-01-01T00:00:00Z","value":-.5}]'
    (tmp_path / "a.txt").write_text("".join(f"s{k}\t{body}\n" for k in range(3)) + body + "\n")
    got = S.read_measurements(spark, str(tmp_path), named=True).collect()
    assert sorted((r["station_id"], r["value"]) for r in got) == [(f"s{k}", -0.5) for k in range(3)]
    Q.read_measurements(spark, SF).count()
    assert all("=" not in f for f in Q.read_measurements(spark, SF).inputFiles())


def test_compact_years(spark, tmp_path):
    for station, y, body in (("s", 2020, None), ("s", 2019, None), ("bad", 2020, "{rubbish"), ("bad", 2019, None)):
        (tmp_path / "in" / station).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / station / f"{y}.json").write_text(body or json.dumps({"y": y, "min": [1.0], "max": [2.0]}))
    report = B.compact_years(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert report.where("not ok").select("station_id").collect()[0][0] == "bad"
    assert one(spark.read.parquet(str(tmp_path / "out")), "station_id", "y") == [("s", 2019), ("s", 2020)]


def test_compact_years_of_many_stations_a_file(spark, tmp_path):
    """A malformed line, or one that names no station, spoils that station in all files, and no other of its own."""
    year = '{"y":%d,"min":[1.0],"max":[2.0]}'
    texts = {"one": ["a\t" + year % 2001, "b\t" + year % 2000, "", "c\t" + year % 2001, "d"], "two": ["a\t" + year % 2000, "b\t" + (year % 2001)[:12], "c\t[]"]}
    for name, found in texts.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{name}.txt").write_text("\n".join(found))
    report = B.compact_years(spark, str(tmp_path / "in"), str(tmp_path / "out"), named=True)
    assert sorted((r["station_id"], r["file"].rsplit("/")[-1], r["ok"]) for r in report.collect()) == [
        ("a", "one.txt", True), ("a", "two.txt", True), ("b", "one.txt", True), ("b", "two.txt", False), ("c", "one.txt", True), ("c", "two.txt", False), ("d", "one.txt", False),
    ]
    assert [(r["station_id"], r["y"], r["min"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2000, [1.0]), ("a", 2001, [1.0])]



def source(spark, tmp_path):
    path = str(tmp_path / "in")
    Q.events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_condense_equals_batch(spark, tmp_path):
    stream = source(spark, tmp_path)
    ST.ingest_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = D.condense(Q.events(spark, SF)).select("station_id", "day", "min_v", "max_v")
    assert rows(B.read_table(spark, str(tmp_path / "out")).select("station_id", "day", "min_v", "max_v")) == rows(want)
    windows = ST.run_to_table(spark, ST.streaming_condense(stream, "60 days"), "windows", "complete", str(tmp_path / "cp2"))
    assert rows(windows.select("station_id", "day", "min_v", "max_v")) == rows(want)


def test_stream_state(spark, tmp_path):
    stream = source(spark, tmp_path)
    assert ST.run_to_table(spark, ST.dedupe(stream, "60 days").select("station_id", "ts"), "unique", "append", str(tmp_path / "a")).count() == Q.events(spark, SF).select("station_id", "ts").distinct().count()
    gaps = ST.run_to_table(spark, ST.stateful_gaps(stream), "gaps", "append", str(tmp_path / "b"))
    assert gaps.count() > 0 and gaps.where("hours <= 1.5").count() == 0
    base = Q.events(spark, SF).groupBy("station_id").agg(F.min("value").alias("base"))
    assert ST.run_to_table(spark, ST.enrich(stream, base), "rich", "append", str(tmp_path / "c")).where("delta < 0").count() == 0
    assert ST.run_to_table(spark, ST.sliding_trend(stream, "60 days"), "trends", "complete", str(tmp_path / "d")).where("trend is not null").count() > 0


def test_stream_snapshot_and_delta(spark, tmp_path):
    stream = source(spark, tmp_path)
    live = stream.select("station_id", "ts", "value", F.lit("n").alias("n"), F.lit("w").alias("w"), F.lit(False).alias("tidal"))
    ST.snapshot_batches(live, str(tmp_path / "snap"), str(tmp_path / "e")).awaitTermination()
    got = B.read_table(spark, str(tmp_path / "snap"))
    assert got.count() == got.select("station_id", "day").distinct().count() > 0
    points = Q.events(spark, SF)
    old = points.where("day(ts) < 15")
    assert ST.only_newer(points, old).count() == points.where("day(ts) >= 15").count()
    assert ST.drop_future(points.withColumn("ts", F.col("ts") + F.expr("INTERVAL 100 YEARS"))).count() == 0


def test_freeze_year(spark, tmp_path):
    own = daily(spark, ("s", "2024-01-01", 80.0, 300.0))
    assert J.freeze_year(spark, str(tmp_path / "x"), own, None, 2024) is False
    assert J.freeze_year(spark, str(tmp_path / "y"), own, daily(spark, ("s", "2024-01-01", 81.0, 95.0)), 2024) is True
    assert one(B.read_table(spark, str(tmp_path / "y")), "min_v", "max_v") == [(81, 95)]


def test_daily_snapshot_job(spark):
    archive = daily(spark, *[("s", f"2024-01-{i + 1:02d}", 0.0, 50.0) for i in range(20)])
    stations = spark.createDataFrame([("s", "S", "R", 5.0), ("t", "T", "R", None)], "uuid string, n string, w string, value double")
    assert one(J.daily_snapshot(stations, archive, "2024-02-01", 2024), "station_id", "tidal") == [("s", True), ("t", False)]


def test_datum_and_forecasts(spark):
    r = readings(spark, ("s", "2026-07-16T12:00:00+01:00", 10.0), ("s", "2026-07-16T13:30:00+01:00", 10.0), ("s", "2026-12-31T00:00:00Z", 10.0))
    assert D.drop_forecasts(r, "2026-07-16 12:00:00").count() == 1
    offsets = spark.createDataFrame([("s", 3.0)], "station_id string, datum_offset double")
    assert D.subtract_datum(r, offsets).select("value").distinct().collect()[0][0] == 7


def test_days_that_all_have_readings_are_not_looked_through_for_empty_years(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "daily")
    B.upsert_daily(spark, path, daily(spark, ("s", "2024-01-01", 1.0, 2.0), ("s", "2024-01-02", None, None), ("t", "2024-01-01", None, None)))
    with monkeypatch.context() as m:
        m.setattr(B, "drop_empty_years", None)
        B.upsert_daily(spark, path, daily(spark, ("u", "2024-01-01", 1.0, 2.0)))
    assert sorted((r["station_id"], r["min_v"]) for r in B.read_table(spark, path).where("min_v is not null").collect()) == [("s", 1.0), ("u", 1.0)]
    assert B.read_table(spark, path).where("station_id = 't'").isEmpty()
