"""Operators on small hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import calendar as C
from gaugeflow.functions import values as V
from gaugeflow.operators import daily as D
from gaugeflow.operators import inventory as I
from gaugeflow.operators import river as R
from gaugeflow.operators import stats as S
from gaugeflow.operators import totals as T
from gaugeflow.sources import formats as S2


def ts(text):
    return dt.datetime.fromisoformat(text)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def readings(spark, *rows):
    return frame(spark, "station_id string, ts string, value double", *rows).withColumn("ts", F.to_timestamp("ts"))


def daily(spark, *rows):
    """station, day, min, max"""
    df = frame(spark, "station_id string, day string, min_v double, max_v double", *rows).withColumn("day", F.to_date("day"))
    return D.with_calendar(df)


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


def test_condense_days_and_sentinels(spark):
    r = readings(
        spark, ("s", "2024-03-05T00:15:00+01:00", 500.0), ("s", "2024-03-05T13:00:00+01:00", 540.0), ("s", "2024-03-05T23:45:00+01:00", 520.0), ("s", "2024-12-31T23:30:00+01:00", 300.0),
        ("s", "2025-01-01T00:15:00+01:00", 301.0), ("s", "2024-03-06T00:15:00+01:00", None), ("t", "2024-05-01T10:00:00Z", 312.0), ("t", "2024-05-01T11:00:00Z", 99999.0), ("t", "2024-05-01T12:00:00Z", -32753.0), ("t", "2024-05-01T12:30:00Z", 341.0), ("t", "2024-05-02T12:30:00Z", 65250.0),
    )
    assert one(D.condense(r), "station_id", "year", "doy", "min_v", "max_v") == [("s", 2024, 64, 500, 540), ("s", 2024, 365, 300, 300), ("s", 2025, 0, 301, 301), ("t", 2024, 121, 312, 341)]
    assert D.condense(r.limit(0)).count() == 0


def test_plausible_bounds(spark):
    df = frame(spark, "v double", (-0.87,), (0.0,), (-2000.0,), (20000.0,), (20001.0,), (float("nan"),), (None,))
    assert df.where(V.plausible(F.col("v"))).count() == 4


def test_calendar(spark):
    df = frame(spark, "t string", ("2026-03-31T23:30:00Z",), ("2026-03-31T22:30:00Z",), ("2026-12-31T23:30:00Z",)).withColumn("t", F.to_timestamp("t"))
    assert [str(r[0]) for r in df.select(C.local_day("t")).collect()] == ["2026-04-01", "2026-03-31", "2027-01-01"]
    got = spark.range(1).select(C.days_in_year(F.lit(2100)), C.days_in_year(F.lit(2024)), C.round_half_up(F.lit(-4.5)), C.round_half_up(F.lit(4.5)), C.last_begun_day(2025, "2026-07-16"), C.last_begun_day(2027, "2026-07-16"), C.last_begun_day(2026, "2026-01-01 23:30:00"))
    assert tuple(got.first()) == (365, 366, -4, 5, 364, -1, 1)


def test_merge_is_idempotent_and_commutative(spark):
    a = daily(spark, ("s", "2024-01-02", 300.0, 300.0))
    b = daily(spark, ("s", "2024-01-02", 500.0, 500.0), ("s", "2024-01-03", 200.0, 200.0))
    want = [("s", 300, 500), ("s", 200, 200)]
    for got in (D.merge_extremes(a, b), D.merge_extremes(b, a), D.merge_extremes(D.merge_extremes(a, b), a, b)):
        assert sorted(one(got, "station_id", "min_v", "max_v")) == sorted(want)


def test_overlay(spark):
    fallback = daily(spark, ("s", "2024-01-11", 80.0, 300.0), ("s", "2024-01-21", 120.0, 130.0), ("s", "2023-05-01", 1.0, 2.0))
    primary = daily(spark, ("s", "2024-01-11", 81.0, 95.0), ("s", "2022-01-01", 9.0, 9.0))
    assert one(D.overlay(primary, fallback), "year", "doy", "min_v", "max_v") == [(2023, 120, 1, 2), (2024, 10, 81, 95), (2024, 20, 120, 130)]


def test_fill_gaps(spark):
    archive = daily(spark, ("s", "2026-01-01", 100.0, 110.0))
    snap = frame(spark, "station_id string, day string, value double", ("s", "2026-01-01", 999.0), ("s", "2026-01-02", 120.0), ("s", "2026-01-04", 99999.0)).withColumn("day", F.to_date("day"))
    filled = D.fill_gaps(archive, snap, 2026)
    assert one(filled, "doy", "mid", "provisional") == [(0, 105, False), (1, 120, True)]
    assert D.provisional_from(filled, 2026).first()[0] == 1


def test_paired_deltas(spark):
    a = [("a", f"2026-01-0{i + 1}", v, v) for i, v in enumerate((100.0, 110.0, 99999.0, 130.0, 131.0))]
    b = [("b", f"2026-01-0{i + 3}", v, v) for i, v in enumerate((500.0, 510.0, 505.0))]
    stations = frame(spark, "station_id string, river string, unit string", ("a", "R", "cm"), ("b", "R", "cm"), ("c", "R", "m+NN"))
    raw = T.river_daily_raw(D.with_mid(daily(spark, *a, *b, ("c", "2026-01-01", 1.0, 1.0))), stations)
    got = {r["doy"]: (r["dv"], r["dn"]) for r in T.river_daily(raw).collect()}
    assert got == {0: (None, None), 1: (10, 1), 2: (None, None), 3: (10, 1), 4: (-4, 2)}
    assert T.river_monthly(raw, 2026, 2026).where("month = 1").first()["diff"] == 16
    assert T.river_monthly(raw, 2026, 2026).count() == 12


def test_median_span_is_upper(spark):
    days = [("s", f"2024-01-{i + 1:02d}", 0.0, v) for i, v in enumerate((4.0, 5.0, 6.0, 4.0, 5.0, 6.0, 4.0, 5.0, 6.0, 4.0, 5.0, 6.0, 4.0, 180.0))]
    wild = [("t", f"2024-01-{i + 1:02d}", 0.0, 200.0) for i in range(20)]
    few = [("u", f"2024-01-{i + 1:02d}", 0.0, 200.0) for i in range(3)]
    assert one(S.tidal_flags(daily(spark, *days, *wild, *few), 2024), "station_id", "span", "tidal") == [("s", 5, False), ("t", 200, True), ("u", None, False)]


def test_trend(spark):
    at = lambda s, m, v: (s, str(ts("2024-01-01 00:00:00") + dt.timedelta(minutes=m)), v)
    p = readings(spark, at("hour", 0, 80.0), at("hour", 60, 77.0), at("half", 0, 80.0), at("half", 30, 77.0), at("six", 0, 80.0), at("six", 360, 77.0))
    assert one(S.trend_per_hour(p), "station_id", "trend") == [("half", None), ("hour", -3.0), ("six", -0.5)]


def test_gaps(spark):
    p = readings(spark, *[("s", str(ts("2024-01-01 00:00:00") + dt.timedelta(minutes=m)), 1.0) for m in (0, 30, 120, 121, 400)])
    assert one(S.gap_counts(p, "2024-01-02"), "gaps", "longest_h") == [(1, 4.65)]


def test_thin(spark):
    p = readings(spark, *[("s", str(ts("2024-01-01 00:00:00") + dt.timedelta(minutes=15 * m)), 1.0) for m in range(13)])
    assert S.thin(p, "2024-01-21").count() == 4
    assert S.thin(p, "2024-01-02").count() == 13


def test_downsample(spark):
    values = [5, 1, 9, 4, 4, 4, 7, 2, 8, 0, 6, 3]
    p = readings(spark, *[("s", str(ts("2024-01-01 00:00:00") + dt.timedelta(hours=i)), float(v)) for i, v in enumerate(values)])
    assert one(S.downsample(p, 4), "col", "lo", "hi") == [(0, 1, 9), (1, 4, 4), (2, 2, 8), (3, 0, 6)]


def test_score(spark):
    means = frame(spark, "station_id string, day string, mean double", *[("s", str(ts("2020-01-01") + dt.timedelta(days=i))[:10], float(i + 1)) for i in range(100)]).withColumn("day", F.to_date("day"))
    clim = S.climatology(means, 2024)
    live = frame(spark, "station_id string, value double, month int", ("s", 0.5, 7), ("s", 1.0, 7), ("s", 50.0, 7), ("s", 9999.0, 7))
    assert one(S.score_unusual(live, means, clim), "value", "pct", "z") == [(0.5, 0, None), (1, 1, None), (50, 50, None), (9999, 100, None)]
    assert S.score_unusual(live, means.limit(44), clim).count() == 0


def test_baseline(spark):
    caps = frame(spark, "day string, captured_at string", *[(f"2026-01-{d:02d}", f"2026-01-{d:02d} 11:30:00") for d in range(7, 16)]).select(F.to_date("day").alias("day"), F.to_timestamp("captured_at").alias("captured_at"))
    pick = lambda c, n: [str(r["day"])[-2:] for r in I.baseline_capture(c, "2026-01-15 12:00:00", n).collect()]
    assert pick(caps, 1) == ["14"] and pick(caps, 7) == ["08"]
    assert pick(caps.where("day(day) <> 8"), 7) == ["09"] and pick(caps.where("day(day) = 12"), 7) == []


def test_snapshot_slots(spark):
    cols = "station_id string, n string, w string, day string, value double, tidal boolean"
    shot = lambda *r: frame(spark, cols, *r).withColumn("day", F.to_date("day"))
    first = I.apply_snapshot(shot().limit(0), shot(("a", "A", "R", "2024-01-04", 172.0, True), ("b", "B", "R", "2024-01-04", 140.0, False)))
    second = I.apply_snapshot(first, shot(("a", "A2", "R", "2024-01-05", 180.0, False)))
    again = I.apply_snapshot(second, shot(("a", "A2", "R", "2024-01-05", 180.0, False)))
    assert one(again, "station_id", "value", "n", "tidal") == [("a", 172, "A2", False), ("a", 180, "A2", False), ("b", 140, "B", False)]


def test_expired(spark):
    shards = frame(spark, "y int, m int", (2026, 8), (2026, 7), (2026, 6))
    assert one(I.expired(shards, "2026-08-20", 1), "m") == [(6,)] and I.expired(shards, "2026-08-20", 0).count() == 0


def test_units(spark):
    prev = frame(spark, "station_id string, unit string", ("a", "cm"), ("gone", "m+NN"))
    fresh = frame(spark, "station_id string, unit string", ("a", "m+NN"), ("b", "cm"), ("d", None))
    got = I.upsert_units(prev, fresh)
    assert one(got, "station_id", "unit") == [("a", "m+NN"), ("b", "cm"), ("gone", "m+NN")] and one(I.excluded_stations(got), "station_id") == [("a",), ("gone",)]


def test_outlook(spark):
    df = frame(spark, "v double, r double", (300.0, 10.0), (150.0, -10.0), (399.0, 0.001), (450.0, 1.0), (50.0, 1.0))
    got = [tuple(r) for r in df.select(*V.outlook(F.col("v"), F.col("r"), F.lit(100.0), F.lit(400.0))).collect()]
    assert got == [("MHW", 10), ("MNW", 5), (None, None), ("HIGH", None), ("LOW", None)]


def test_states_override_the_outlook(spark):
    df = frame(spark, "v double, r double, s string", (300.0, 10.0, "normal"), (450.0, 10.0, "high"), (90.0, -2.0, "low"), (450.0, -10.0, "normal"))
    got = [tuple(r) for r in df.select(*V.outlook(F.col("v"), F.col("r"), F.lit(100.0), F.lit(400.0), state=F.col("s"))).collect()]
    assert got == [("MHW", 10), ("HIGH", None), ("LOW", None), ("MNW", 35)]
    assert frame(spark, "v double, r double, m double", (300.0, 50.0, None)).select(*V.outlook(F.col("v"), F.col("r"), F.col("m"), F.col("m"))).first()[0] is None


def test_code_map(spark):
    shape = "station_id string, code string, retired array<string>"
    assert one(D.code_map(frame(spark, shape, ("a", "x", ["y"]), ("b", "z", None))), "code", "station_id") == [("x", "a"), ("y", "a"), ("z", "b")]
    for bad, what in (((("a", "x", ["z"]), ("b", "z", None)), "code twice: z"), ((("a", "x", None), ("a", "y", None)), "station twice: a")):
        with pytest.raises(Exception, match=what):
            D.code_map(frame(spark, shape, *bad)).collect()


def test_lookup(spark):
    names = frame(spark, "name string, kind string", ("MAGDEBURG-BUCKAU", "station"), ("MAGDEBURG-STROMBRÜCKE", "station"), ("MINDEN", "station"), ("MOSEL", "river"), ("KÖLN", "station"))
    q = frame(spark, "q string", ("MINDE",), ("MAGDEBURG",), ("osel",), ("koeln",), ("nowhere",), ("strombruecke",))
    assert one(R.lookup(q, names), "q", "name", "kind", "candidates") == [
        ("MAGDEBURG", None, None, 2), ("MINDE", "MINDEN", "station", 1), ("koeln", "KÖLN", "station", 1), ("nowhere", None, None, 0), ("osel", "MOSEL", "river", 1), ("strombruecke", "MAGDEBURG-STROMBRÜCKE", "station", 1),
    ]


def test_station_of_an_archive(spark):
    files = frame(spark, "entry string", ("levels-koeln-W-20240101-20241231.json",), ("levels-atlantis-W-20240101-20241231.json",), ("info.json",))
    names = frame(spark, "name string", ("KÖLN",), ("BONN",))
    assert one(S2.with_station(files, names, "BONN"), "station") == [("BONN",), ("BONN",), ("KÖLN",)]
    assert one(S2.with_station(files, names).where("station is not null"), "station") == [("KÖLN",)]


def test_day_bars_and_counters(spark):
    monthly = frame(spark, "river string, year int, month int, v long, diff long", *[(f"R{i}", 2025, 5, 800 - 100 * i, 0) for i in range(1, 8)])
    days = frame(spark, "river string, year int, doy int, v long", *[(f"R{i}", 2025, 130 + d, 800 - 100 * i) for i in range(1, 8) for d in (0, 1) if (i, d) != (1, 0)])
    got = {(str(r["day"])[-2:], r["band"]): (r["v"], r["total"]) for r in T.day_bars(days, monthly, 2025, 5).collect()}
    assert len(got) == 31 * 6 and got["11", "R1"] == (0, 2100) and got["12", "R1"] == (700, 2800) and got["12", "OTHER"] == (300, 2800) and got["01", "R2"] == (0, 0)
    s = frame(spark, "station_id string, river string, unit string", ("a", "R", "cm"), ("b", " ", "cm"), ("c", "R", "m"), ("d", "R", None), ("e", "R", "cm"))
    assert T.run_counters(D.with_mid(daily(spark, ("a", "2024-01-01", 1.0, 2.0), ("b", "2024-01-01", 1.0, 2.0))), s).first().asDict() == {"included": 1, "silent": 1, "unattributed": 1, "excluded": 2}


def test_magnitudes(spark):
    df = frame(spark, "v double", (4200.0,), (1e6,))
    assert [r[0] for r in df.select(V.magnitude(F.col("v"))).collect()] == ["42m", "10.0km"]
    df = frame(spark, "v double", (0.0,), (430.0,), (-25000.0,), (-1230000.0,))
    assert [r[0] for r in df.select(V.signed_magnitude(F.col("v"))).collect()] == ["+0cm", "+4.3m", "-250m", "-12.3km"]


def test_names(spark):
    names = frame(spark, "name string", ("KÖLN",), ("MÜRITZSEE",))
    q = frame(spark, "q string", ("koeln",), ("KOLN",), ("muritzsee",), ("XYZTOWN",))
    assert one(R.resolve_names(q, names), "q", "name") == [("KOLN", "KÖLN"), ("XYZTOWN", None), ("koeln", "KÖLN"), ("muritzsee", "MÜRITZSEE")]


def test_profile(spark):
    s = frame(
        spark, "station_id string, river string, km double, w double, gauge_zero double, state string",
        ("A", "R", 20.0, 250.0, 30.0, "normal"), ("B", "R", 5.0, 120.0, 35.0, "low"), ("nokm", "R", None, 1.0, 1.0, "low"), ("now", "R", 1.0, None, 1.0, "low"), ("drop", "R", 2.0, 1.0, None, "normal"), ("high", "R", 9.0, 1.0, None, "HIGHEST"),
    )
    assert [(r["station_id"], r["elevation"]) for r in R.river_profile(s).collect()] == [("B", 36.2), ("high", None), ("A", 32.5)]


def test_overview_and_records(spark):
    s = frame(spark, "river string, lat double, lon double", ("DONAU", 48.5, 10.0), ("DONAU", None, None), ("DONAU", None, 1.0), ("MOLDAU", None, None))
    assert one(R.rivers_overview(s), "river", "n", "lat") == [("DONAU", 3, 48.5), ("MOLDAU", 1, None)]
    m = frame(spark, "station_id string, shortname string, value double, occurrences array<string>, timespan_end string", ("s", "HHW", 1.0, ["1999-05-01", "2013-06-04"], None), ("s", "NNW", 1.0, None, "2010-10-31"), ("s", "MW", 1.0, None, None))
    assert one(R.record_years(m), "shortname", "record_year") == [("HHW", 2013), ("MW", None), ("NNW", 2010)]


def test_scaled(spark):
    c = frame(spark, "station_id string, day int, value double", ("a", 1, 5.0), ("a", 2, 10.0), ("a", 3, None), ("flat", 1, 7.0))
    assert one(R.scaled(c), "station_id", "day", "scaled") == [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, None), ("flat", 1, 0.5)]


def test_leading_crop(spark):
    rows = [(s, f"2024-01-{d + 1:02d}", float(d) if d >= f else None) for s, f in (("a", 1), ("b", 2), ("c", 4)) for d in range(5)]
    c = frame(spark, "station_id string, day string, value double", *rows).withColumn("day", F.to_date("day"))
    assert R.leading_crop(c).first()[0] == 2


def test_a_months_mean_is_the_same_in_any_order(spark):
    """Copies of a station, whose days come in different orders, have the same cells."""
    days = [(f"2000-{m:02d}-{d:02d}", v) for m, vs in ((1, (0.1, 0.2, 0.3)), (2, (1 / 3, 7 / 3, 22.1)), (3, (1e-9, 5e3, -5e3))) for d, v in enumerate(vs, 1)]
    means = frame(spark, "station_id int, day string, mean double", *[(1, *x) for x in days], *[(2, *x) for x in days[::-1]], *[(3, d, float("inf")) for d, _ in days[:2]]).withColumn("day", F.to_date("day")).coalesce(1)
    cells = S.month_cells(means, S.climatology(means, 2001)).collect()
    a, b, c = ({r["month"]: (r["v"], r["level"]) for r in cells if r["station_id"] == k} for k in (1, 2, 3))
    assert a == b and c[1][0] == float("inf")


def test_near_axis(spark):
    axis = frame(spark, "river string, km double, lat double, lon double", ("R", 0.0, 50.0, 7.0), ("R", 10.0, 50.0, 7.14))
    pos = frame(spark, "pos_id int, lat double, lon double", (1, 50.005, 7.07), (2, 50.1, 7.07), (3, None, None))
    got = R.near_axis(pos, axis).collect()
    assert len(got) == 1 and abs(got[0]["km"] - 5) < 0.01 and abs(got[0]["distance"] - 0.5566) < 0.001


def test_formats(spark, tmp_path):
    import zipfile

    raw = frame(spark, "station_id string, body string", ("s", '[{"timestamp":"2024-01-01T00:00:00+01:00","value":-},{"timestamp":"2024-01-01T01:00:00+01:00","value":-.87}]'), ("t", '[{"timestamp":"2024-01-01T01:00:00Z","value":5}]'), ("u", "rubbish"))
    assert one(S2.measurements_of(raw), "station_id", "value") == [("s", -0.87), ("t", 5.0)]
    with zipfile.ZipFile(tmp_path / "a-koeln-W-2024.zip", "w") as z:
        z.writestr("x.json", "[]")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = S2.ingest_zip(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted((r["body"], r["error"] is None) for r in got.collect() if r["body"]) == [("[]", True)] and got.where("error is not null").count() == 1
    assert got.where("error is null").select(S2.station_from_file_name(F.col("path"))).first()[0] == "KOELN"
    b = frame(spark, "station_id string, y int, min array<double>, max array<double>", ("s", 2024, [1.0, None, 3.0], [2.0, 5.0]), ("g", None, [1.0], [1.0]), ("h", 2023, None, [1.0]))
    assert one(S2.explode_bundle(b), "station_id", "doy", "min_v", "max_v") == [("s", 0, 1, 2)]
    back = S2.to_bundle(S2.explode_bundle(b)).first()
    assert back["y"] == 2024 and len(back["min"]) == 366 and back["min"][0] == 1 and back["max"][1] is None


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"uuid":"a","shortname":"A","water":{"shortname":"R"},"timeseries":[{"shortname":"W","unit":"cm","currentMeasurement":{"value":76},"characteristicValues":[{"shortname":"MThw","value":700}]}]},{"uuid":"b","timeseries":[{"shortname":"W"}]},{"uuid":"c","timeseries":[{"shortname":"Q"}]}]')
    cat = S2.read_catalogue(spark, str(tmp_path / "c.json"))
    assert one(S2.stations_of(cat), "uuid", "value", "w") == [("a", 76.0, "R"), ("b", None, "")]
    assert one(S2.units_of(cat), "station_id", "unit") == [("a", "cm"), ("b", None)]
    assert one(S2.marks_of(cat), "station_id", "tidal") == [("a", True), ("b", False), ("c", False)]


def test_observations(spark):
    schema = "station_id string, " + S2.OBSERVATIONS
    ok = frame(spark, schema, ("s", True, None, [([("2024-01-01T00:00:00Z", (705.0,)), ("2024-01-01T01:00:00Z", (999999999.0,)), ("2024-01-01T02:00:00Z", (None,))],)]), ("t", True, None, None))
    assert one(D.drop_sentinels(S2.flatten_observations(ok)), "value") == [(705.0,)]
    with pytest.raises(Exception, match="no such station"):
        S2.flatten_observations(frame(spark, schema, ("s", False, "no such station", None))).collect()


def test_point_archive(spark):
    text = frame(spark, "body string", ('{"köln":[[0,5],[1000,6],[0,5]],"x":[[1]]}',), ("[]",))
    none = spark.createDataFrame([], "station_id string, ts timestamp, value double")
    new = S2.import_points(text, none)
    assert one(new, "station_id", "value") == [("KÖLN", 5.0), ("KÖLN", 6.0)]
    assert S2.import_points(text, new).count() == 0
    assert S2.import_points(S2.export_points(new), new).count() == 0


def test_files_are_unzipped_once(spark):
    """The look-up of stations and the bodies share one reading of the archives."""
    files = spark.range(2).selectExpr("concat('/in/', id) path", "cast('no archive' as binary) content")
    named = S2.with_station(S2.ingest_zip(files), frame(spark, "name string", ("KÖLN",)), "BONN")
    assert "MapInPandas" not in named._jdf.queryExecution().executedPlan().toString()
    assert one(named, "station", "body") == [("BONN", None), ("BONN", None)]
