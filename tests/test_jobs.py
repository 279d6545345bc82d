"""Jobs as they are composed, over small tables."""

import pytest
from pyspark.sql import functions as F

from gaugeflow.plans import jobs as J
from gaugeflow.plans import queries as Q
from gaugeflow.sources import states
from gaugeflow.sources import tables as B
from gaugeflow.streaming import jobs as ST

from .conftest import SF
from .test_operators import daily, frame, one


def test_snapshot_run(spark, tmp_path):
    path = str(tmp_path / "snap")
    archive = daily(spark, *[("s", f"2024-01-{i + 1:02d}", 0.0, 50.0) for i in range(20)])
    stations = frame(spark, "uuid string, n string, w string, value double", ("s", "S", "R", 5.0), ("t", "T", "R", None))
    run = lambda day, keep: J.snapshot_run(spark, path, stations, archive, day, 2024, keep)
    assert run("2024-02-01", 0) == {"stations": 2, "captured": 1, "flagged": 1, "pruned": []}
    assert run("2024-05-01", 0)["pruned"] == []
    assert run("2024-05-01", 2)["pruned"] == ["2024-02"]
    assert one(B.read_table(spark, path), "month", "station_id", "tidal") == [("2024-05", "s", True), ("2024-05", "t", False)]


def board(spark, live, marks):
    snap = frame(spark, "station_id string, day string, value double, tidal boolean", *[(s, "2024-01-01", 100.0, False) for s, *_ in live]).withColumn("day", F.to_date("day"))
    captures = frame(spark, "day string, captured_at string", ("2024-01-01", "2024-01-01 12:00:00")).select(F.to_date("day").alias("day"), F.to_timestamp("captured_at").alias("captured_at"))
    return J.rising_run(frame(spark, "station_id string, value double, state string", *live), [snap], captures, frame(spark, "station_id string, tidal boolean, mnw double, mhw double", *marks), "2024-01-02 12:00:00", 1)


def test_states_override_the_outlook_on_the_board(spark):
    """High and low are the source's, whatever the value; without marks there is no outlook."""
    live = [("up", 110.0, "normal"), ("down", 90.0, "normal"), ("high", 120.0, "HIGH"), ("low", 80.0, "lowest"), ("bare", 130.0, "normal"), ("slow", 101.0, "normal"), ("none", None, "normal")]
    got, counts = board(spark, live, [(s, False, *(() if s == "bare" else (50.0, 1000.0) if s == "slow" else (40.0, 210.0))) if s != "bare" else (s, False, None, None) for s, *_ in live])
    assert {r["station_id"]: (r["side"], r["eta_target"], r["eta_days"]) for r in got.collect()} == {
        "up": ("rising", "MHW", 10), "down": ("falling", "MNW", 5), "high": ("rising", "HIGH", None), "low": ("falling", "LOW", None), "bare": ("rising", None, None), "slow": ("rising", None, None),
    }
    assert one(counts, "rising", "falling", "steady", "tidal") == [(4, 2, 0, 0)]


def test_a_board_without_a_baseline(spark):
    captures = frame(spark, "day date, captured_at timestamp")
    live = frame(spark, "station_id string, value double, state string", ("a", 1.0, "highest"), ("b", 1.0, "x"))
    snap = frame(spark, "station_id string, day date, value double, tidal boolean")
    got, counts = J.rising_run(live, [snap, snap], captures, frame(spark, "station_id string, tidal boolean, mnw double, mhw double"), "2024-01-02 12:00:00", 1)
    assert got.count() == 0
    assert one(counts, "rising", "high", "low", "normal", "tidal") == [(None, 1, 0, 1, 0)]


def test_totals_run_appends_what_a_rebuild_gives(spark, tmp_path):
    a, s, snap = Q.archive(spark, SF), Q.stations(spark, SF), Q.snapshot(spark, SF)
    runs = [J.totals_run(spark, str(tmp_path / n), a, s, snap, Q.NOW, Q.RUNNING) for n in ("x", "y")]
    assert runs[0] == runs[1] and runs[0]["included"] > 0
    J.totals_run(spark, str(tmp_path / "x"), a, s, snap, Q.NOW, Q.RUNNING, append=True)
    cols = ["river", "year", "month", "v", "diff"]
    x, y = (B.read_table(spark, str(tmp_path / n), "monthly").select(cols) for n in ("x", "y"))
    assert x.exceptAll(y).count() == y.exceptAll(x).count() == 0
    assert sorted(states.current(spark, str(tmp_path / "x"))["tables"]) == ["daily", "monthly", "overview", "units"]


def test_views_read_their_inputs_once(spark, tmp_path):
    """Bars with totals join nothing, and the report's means are computed once."""
    monthly = frame(spark, "river string, year int, month int, v long, diff long", ("R", 2000, 1, 5, 1), ("S", 2000, 1, 7, None))
    plan = J.totals_explorer(monthly)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    report = J.station_report(daily(spark, ("s", "2023-01-01", 1.0, 2.0), ("s", "2024-01-01", 1.0, 2.0)), 2024)
    assert {n: f.count() for n, f in report.items()} == {"climatology": 1, "cells": 2, "overlay": 2}


def test_stream_counts(spark, tmp_path):
    path = str(tmp_path / "in")
    for k in range(3):
        frame(spark, "station_id string, ts timestamp, value double", ("s", None, 1.0), ("s", None, None)).withColumn("ts", F.lit(f"2024-01-0{k + 1}").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    live = spark.readStream.schema("station_id string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(path)
    counts = ST.StreamCounts(spark, "n")
    ST.run_to_files(counts.on(live), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert counts.get() == {"readings": 6, "skipped": 3, "missing": 3, "dropped": 0, "batches": 3}


@pytest.mark.parametrize("years", [(1999, 2001)])
def test_months_are_laid_into_the_grid(spark, years):
    from gaugeflow.operators import totals as T

    raw = frame(spark, "river string, year int, doy int, day string, v double, n long, dv double, dn long", ("R", 2000, 0, "2000-01-01", 5.5, 1, None, None)).withColumn("day", F.to_date("day"))
    got = T.river_monthly(raw, *years)
    assert got.count() == 36
    assert one(got.where("v is not null"), "river", "year", "month", "v", "diff") == [("R", 2000, 1, 6, None)]
    assert T.river_monthly(raw.limit(0), *years).count() == 0


@pytest.mark.parametrize("name", ["explorer_days", "explorer_months", "explorer_changes", "explorer_rivers"])
def test_explorer_sums_rivers_once(spark, monkeypatch, name):
    """Days and months of the written totals read the sums that are there, not each the readings."""
    seen, f = [], Q.tables.rebuild_totals
    monkeypatch.setattr(Q.tables, "rebuild_totals", lambda daily, monthly, path: seen.extend([*daily.inputFiles(), *monthly.inputFiles()]) or f(daily, monthly, path))
    assert Q.QUERIES[name](spark.newSession(), SF).count() > 0
    assert seen and all("lineitem" not in file for file in seen)


def test_an_appended_year_sums_no_other(spark, tmp_path, monkeypatch):
    """Only the running year is filled and summed; counters and rivers are those of all years, and other years stay as they are."""
    path, stations = str(tmp_path / "totals"), frame(spark, "station_id string, river string, unit string", ("a", "R", "cm"), ("b", "S", "cm"), ("c", "T", "cm"), ("d", "U", "m"))
    empty, f, years = frame(spark, "station_id string, day date, value double"), J.T.river_daily, []
    J.totals_run(spark, path, daily(spark, ("a", "2023-01-01", 1.0, 3.0)), stations, empty, "2024-02-01 12:00:00", 2024)
    monkeypatch.setattr(J.T, "river_daily", lambda raw: years.extend(r["year"] for r in raw.select("year").distinct().collect()) or f(raw))
    snap = frame(spark, "station_id string, day string, value double", ("a", "2024-01-02", 8.0), ("a", "2023-01-02", 9.0), ("a", "2024-03-01", 7.0)).withColumn("day", F.to_date("day"))
    got = J.totals_run(spark, path, daily(spark, ("a", "2023-01-01", 5.0, 5.0), ("a", "2024-01-01", 4.0, 6.0), ("b", "2023-01-05", 7.0, 9.0)), stations, snap, "2024-02-01 12:00:00", 2024, append=True)
    assert years == [2024] and got == {"included": 2, "silent": 1, "unattributed": 0, "excluded": 1, "provisional_from": 1}
    assert one(B.read_table(spark, path, "daily"), "river", "year", "doy", "v", "dv") == [("R", 2023, 0, 2, None), ("R", 2024, 0, 5, None), ("R", 2024, 1, 8, 3)]
    months = B.read_table(spark, path, "monthly")
    assert one(months.where("v is not null"), "river", "year", "month", "v", "diff") == [("R", 2023, 1, 2, None), ("R", 2024, 1, 7, 3)] and months.where("river = 'S' and year = 2024").count() == 12
