"""Pieces that fail, the ledger of failures, and whole runs of the ingest."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from gaugeflow.plans import jobs as J
from gaugeflow.sources import ingest as N
from gaugeflow.sources import states
from gaugeflow.sources import tables as B

from .test_operators import one


def answer(*points, **other):
    return json.dumps({"Succesvol": True, "WaarnemingenLijst": [{"MetingenLijst": [{"Tijdstip": t, "Meetwaarde": {"Waarde_Numeriek": v}} for t, v in points]}]} | other)


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), "station_id string, code string, year int, status int, body string")


def test_answers(spark, tmp_path):
    rows = raw(
        spark, ("s", "a", 2024, 200, answer(("2024-06-01T12:00:00+02:00", 705.0), ("2024-06-01T12:20:00+02:00", None), ("soon", 1.0))), ("s", "a", 2023, 204, None), ("s", "a", 2022, 200, answer(Succesvol=False, Foutmelding="boom")),
        ("s", "a", 2021, 200, '{"Succesvol": false}'), ("s", "a", 2020, 200, "{}"), ("s", "a", 2019, 200, "<html>"), ("s", "a", 2018, 200, None), ("s", "a", 2017, 503, "x"), ("s", "b", 2024, 200, '{"Succesvol": true}'), ("s", "a", None, None, answer()),
    )
    counts = N.Counts()
    readings, failures, empty = N.outcome(N.answers_of(rows), str(tmp_path / "o"), counts)
    assert one(readings.withColumn("ts", F.col("ts").cast("string")), "station_id", "code", "year", "ts", "value") == [("s", "a", 2024, "2024-06-01 10:00:00", 705)]
    assert {r["year"]: r["error"] for r in failures.collect()} == {2022: "boom", 2021: "the request failed", 2020: "the request failed", 2019: "the body can't be read", 2018: "no body", 2017: "status 503"}
    assert {(r["code"], r["year"]) for r in empty.collect()} == {("a", 2023), ("b", 2024), ("a", None)}
    assert counts.get() == {"pieces": 10, "failed": 6, "empty": 3, "points": 1}


def test_one_scan_gives_all_counters(spark, tmp_path):
    """The counters are metrics of the very pass that writes the outcome: the input is read once."""
    pieces = N.answers_of(raw(spark, *[("s", "a", y, 200, answer((f"{y}-01-01T00:00:00Z", 1.0))) for y in range(2000, 2020)]))
    pieces.write.parquet(str(tmp_path / "in"))
    reads = spark.sparkContext.accumulator(0)
    counted = spark.read.parquet(str(tmp_path / "in")).mapInPandas(lambda b: (reads.add(len(x)) or x for x in b), pieces.schema)
    counts = N.Counts()
    N.outcome(counted, str(tmp_path / "o"), counts)
    assert reads.value == counts.get()["pieces"] == 20


def test_archives(spark, tmp_path):
    def zipped(text):
        with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
            z.writestr("x.json", text)
        return held.getvalue()

    files = [("s", "/1.zip", zipped('[{"timestamp":"2024-01-01T00:00:00Z","value":-.5}]')), ("s", "/2.zip", b"PK"), ("t", "/3.zip", zipped("<html>")), ("u", "/4.zip", zipped("[]"))]
    readings, failures, empty = N.outcome(N.archives_of(spark.createDataFrame(files, "station_id string, path string, content binary")), str(tmp_path / "o"))
    assert one(readings, "station_id", "file", "value") == [("s", "/1.zip", -0.5)]
    assert {r["file"]: r["error"][:10] for r in failures.collect()} == {"/2.zip": "BadZipFile", "/3.zip": "the body c"}
    assert one(empty, "station_id", "file") == [("u", "/4.zip")]


def stations(spark, *ids):
    return spark.createDataFrame([(i, i.upper(), "R", 3.0 if i == "low" else 0.0) for i in ids], "station_id string, name string, water string, datum_offset double")


def run(spark, path, *rows, ids=("s", "t"), codes=None, **more):
    return J.run_ingest(spark, path, N.answers_of(raw(spark, *rows)), stations(spark, *ids), "2026-07-16 12:00:00", 2023, 2025, 2026, codes, **more)


def test_a_failed_year_is_read_again_and_merged(spark, tmp_path):
    path = str(tmp_path / "in")
    good = ("s", "a", 2024, 200, answer(("2024-01-02T12:00:00+01:00", 300.0), ("2024-01-02T13:00:00+01:00", 9000.0), ("2027-01-01T00:00:00Z", 1.0)))
    first = run(spark, path, good, ("s", "a", 2025, 500, None), ("t", "b", 2024, 204, None))
    assert first == {"pieces": 3, "failed": 1, "empty": 1, "points": 3, "stations": 2, "skipped": 0, "failed_stations": 1, "station_years": 1}
    assert one(B.read_table(spark, path, "daily"), "station_id", "year", "doy", "min_v", "max_v") == [("s", 2024, 1, 300, 300)]
    assert one(B.read_table(spark, path, "failures"), "station_id", "year", "error", "attempts") == [("s", 2025, "status 500", 1)]
    assert one(B.read_table(spark, path, "state"), "station_id", "fetched_through") == [("t", 2025)]
    second = run(spark, path, good, ("s", "a", 2025, 500, None), ("t", "b", 2024, 204, None))
    assert (second["skipped"], second["pieces"]) == (1, 2)
    assert one(B.read_table(spark, path, "failures"), "attempts") == [(2,)]
    part = lambda: states.current(spark, path)["tables"]["daily"]["parts"]["2024"]
    before = part()
    run(spark, path, ("s", "a", 2025, 200, answer(("2025-03-01T12:00:00+01:00", 8.0))))
    assert part() == before  # another year's rows aren't rewritten
    assert B.read_table(spark, path, "failures").count() == 0
    assert one(B.read_table(spark, path, "state"), "station_id", "fetched_from", "fetched_through") == [("s", 2023, 2025), ("t", 2023, 2025)]
    assert one(B.read_table(spark, path, "manifest"), "station_id", "from_year", "to_year", "gaps", "none") == [("s", 2024, 2025, 365 + 364, False), ("t", None, None, None, True)]


def test_codes_offsets_and_orphans(spark, tmp_path):
    path = str(tmp_path / "in")
    codes = spark.createDataFrame([("live", "low"), ("hist", "low")], "code string, station_id string")
    day = lambda d, v: (f"2024-01-{d:02d}T12:00:00+01:00", v)
    run(spark, path, (None, "live", 2024, 200, answer(day(2, 303.0))), (None, "hist", 2024, 200, answer(day(2, 503.0), day(3, 203.0))), (None, "nobody", 2024, 200, answer(day(2, 1.0))), ids=("low",), codes=codes)
    assert one(B.read_table(spark, path, "daily"), "station_id", "doy", "min_v", "max_v") == [("low", 1, 300, 500), ("low", 2, 200, 200)]
    run(spark, path, ("s", "a", 2024, 200, answer(day(9, 1.0))), ids=("s",))
    assert one(B.read_table(spark, path, "manifest"), "station_id", "n", "none") == [("low", "LOW", False), ("s", "S", False)]


def test_runs_of_nothing(spark, tmp_path):
    path = str(tmp_path / "in")
    assert run(spark, path)["pieces"] == 0
    assert one(B.read_table(spark, path, "manifest"), "station_id", "none") == [("s", True), ("t", True)]
    assert B.read_table(spark, path, "daily").count() == 0
    assert run(spark, path, ("s", "a", 2024, 200, answer(("2024-01-02T12:00:00+01:00", 1.0))))["station_years"] == 1
    assert B.read_table(spark, path, "daily").count() == 1


def test_keys_of_pieces_are_read_without_their_points(spark, tmp_path):
    """What only asks which pieces gave readings (the ledger, the work-list) doesn't lay out each reading for it."""
    pieces = spark.createDataFrame([("s", "c", 2024, None, [(None, 1.0)] * 3, None), ("t", "c", 2024, None, [], None), ("u", "c", 2024, None, [], "boom")], f"station_id string, code string, year int, file string, points {N.POINTS}, error string")
    found = N.sorted_out(pieces, str(tmp_path / "out"))
    assert [r["station_id"] for k in ("good", "empty", "failures") for r in found[k].collect()] == ["s", "t", "u"]
    assert found["readings"].count() == 3
    assert "points" not in found["good"]._jdf.queryExecution().executedPlan().toString()
