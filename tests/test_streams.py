"""Streams over several micro-batches: late, silent and repeated input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import daily as D
from gaugeflow.operators import river as R
from gaugeflow.plans import queries as Q
from gaugeflow.sources import states
from gaugeflow.sources import tables as B
from gaugeflow.streaming import jobs as ST

from .compare import rows
from .conftest import SF
from .test_operators import frame, one

SCHEMA = "station_id string, ts timestamp, value double"


class Feed:
    """A stream of files, one a micro-batch; ``add`` brings the next one."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path / "in")
        self.add()

    def add(self, *points):
        at = lambda t: dt.datetime.fromisoformat(t) if isinstance(t, str) else t
        self.spark.createDataFrame([(s, at(t), v) for s, t, v in points], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)


def run(stream, path):
    """All that there is now; the same folders go on where the last call ended."""
    q = stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def day(d, hm="00:00"):
    return f"2024-01-{d:02d} {hm}:00"


def test_a_late_reading_leaves_no_gap(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    gaps = lambda: run(ST.stateful_gaps(feed.stream(), 120, "4 hours", 48), tmp_path)
    feed.add(("s", day(1, "01:00"), 1.0))
    gaps()
    feed.add(("s", day(1, "05:00"), 1.0), ("t", day(1, "05:00"), 1.0))
    gaps()
    feed.add(("s", day(1, "03:00"), 1.0), ("s", day(1, "03:00"), 2.0))
    gaps()
    feed.add(("s", day(1, "12:00"), 1.0), ("t", day(1, "08:30"), 1.0))
    gaps()
    feed.add(("s", day(1, "20:00"), 1.0), ("s", day(1, "02:00"), 1.0))  # the last one is behind the watermark
    gaps()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert one(out.withColumns({c: F.date_format(c, "HH:mm") for c in ("from_ts", "to_ts")}), "station_id", "from_ts", "to_ts", "hours") == [("s", "05:00", "12:00", 7.0), ("t", "05:00", "08:30", 3.5)]


def test_state_of_silent_stations_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    gaps = lambda: run(ST.stateful_gaps(feed.stream(), 90, "1 hour", 24), tmp_path)
    feed.add(*[(f"s{i}", day(1), 1.0) for i in range(20)])
    gaps()
    feed.add(("live", day(2, "12:00"), 1.0))
    q = gaps()
    feed.add(("live", day(2, "12:30"), 1.0))
    q = gaps()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("to_ts is null").count() == out.count() == 20
    feed.add(("s3", day(3), 1.0), ("live", day(3, "23:00"), 1.0))
    gaps()
    assert spark.read.parquet(str(tmp_path / "out")).where("station_id = 's3' and to_ts is not null").count() == 0  # it starts anew


def test_late_days_are_merged_and_counted(spark, tmp_path):
    feed, path = Feed(spark, tmp_path), str(tmp_path / "table")
    go = lambda: ST.condense_batches(feed.stream(), path, str(tmp_path / "cp"), "1 day").awaitTermination()
    feed.add(("s", day(1, "12:00"), 5.0), ("s", day(1, "13:00"), 7.0), ("s", day(1, "14:00"), 1e9), ("s", None, 1.0))
    feed.add(("s", day(2, "12:00"), 6.0))
    go()
    assert B.read_table(spark, path, "daily").count() == 0
    assert B.read_table(spark, path, "open").count() == 2
    feed.add(("s", day(5, "12:00"), 6.0))
    go()
    assert one(B.read_table(spark, path, "daily"), "doy", "min_v", "max_v") == [(0, 5, 7), (1, 6, 6)]
    feed.add(("s", day(1, "15:00"), 2.0), ("t", day(2, "15:00"), 3.0), ("t", day(6), 4.0))
    go()
    assert one(B.read_table(spark, path, "daily"), "station_id", "doy", "min_v", "max_v") == [("s", 0, 2, 7), ("s", 1, 6, 6), ("t", 1, 3, 3)]
    assert one(B.read_table(spark, path, "open"), "station_id", "doy") == [("s", 4), ("t", 5)]
    assert one(B.read_table(spark, path, "progress"), "late", "readings") == [(2, 7)]


def test_a_batch_that_fails_or_comes_again_counts_once(spark, tmp_path, monkeypatch):
    feed, path = Feed(spark, tmp_path), str(tmp_path / "table")
    go = lambda cp: ST.condense_batches(feed.stream(), path, str(tmp_path / cp), "1 day").awaitTermination()
    feed.add(("s", day(1, "12:00"), 5.0))
    feed.add(("s", day(4, "12:00"), 5.0))
    with monkeypatch.context() as m:
        m.setattr(states, "_point", lambda *a: (_ for _ in ()).throw(OSError("the disk is gone")))
        with pytest.raises(Exception):  # noqa: B017
            go("cp")
    go("cp")
    first = [rows(B.read_table(spark, path, n)) for n in ("daily", "open", "progress")]
    go("anew")  # all batches once more, as after a lost checkpoint
    assert [rows(B.read_table(spark, path, n)) for n in ("daily", "open", "progress")] == first
    assert one(B.read_table(spark, path, "progress"), "readings", "late") == [(2, 0)]


def test_both_paths_are_the_batch_condense(spark, tmp_path):
    feed, path = Feed(spark, tmp_path), str(tmp_path / "table")
    events = Q.events(spark, SF).select(F.col("station_id").cast("string"), F.col("ts").cast("timestamp").alias("ts"), "value")
    for k in range(4):
        events.where(F.pmod(F.xxhash64("ts"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(feed.path)
    ST.condense_batches(feed.stream(), path, str(tmp_path / "cp"), "3 days").awaitTermination()
    both = B.read_table(spark, path, "daily").unionByName(B.read_table(spark, path, "open"))
    assert rows(both) == rows(D.condense(events).select(both.columns))
    assert B.read_table(spark, path, "progress").first()["late"] > 0


def test_near_axis_on_a_stream(spark, tmp_path):
    axis = frame(spark, "river string, km double, lat double, lon double", ("R", 0.0, 50.0, 7.0), ("R", 900.0, 55.0, 12.0), ("Q", 0.0, 50.0, 7.0), ("Q", 5.0, 50.0, 7.0), ("N", 1.0, 48.0, 7.0), ("N", 2.0, 52.0, 7.0))
    points = [(i, 47.5 + i * 0.013 % 8, 6.9 + (i * 0.0131 + i % 7 * 0.01) % 5.5) for i in range(600)] + [(600, None, None), (601, 50.0, 7.0)]
    pos = frame(spark, "pos_id int, lat double, lon double", *points)
    pos.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(pos.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(R.near_axis(live, axis), tmp_path)
    got = rows(R.near_axis(pos, axis))
    assert got == rows(spark.read.parquet(str(tmp_path / "out")))
    assert len(got[1]) == len(plain_near(points, [("R", 0.0, 50.0, 7.0, 900.0, 55.0, 12.0), ("Q", 0.0, 50.0, 7.0, 5.0, 50.0, 7.0), ("N", 1.0, 48.0, 7.0, 2.0, 52.0, 7.0)]))


def plain_near(points, segments, most=2.0):
    """Positions within reach of any segment, by all pairs."""
    import math

    out = set()
    for i, y, x in points:
        for _, _, lat, lon, _, lat2, lon2 in segments if y is not None else []:
            k = math.cos(math.radians(y)) * 111.32
            dx, dy, px, py = (lon2 - lon) * k, (lat2 - lat) * 111.32, (x - lon) * k, (y - lat) * 111.32
            t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            if math.hypot(px - t * dx, py - t * dy) <= most:
                out.add(i)
    return out


def test_stations_of_equal_km_have_one_order(spark):
    """Segments don't depend on the order in which stations come."""
    near = []
    for way in (1, -1):
        axis = frame(spark, "river string, station_id int, km double, lat double, lon double", *[("R", k, float(k // 4), 50.0 + k * 7 % 5 / 50, 7.0 + k / 50) for k in range(20)][::way]).coalesce(1)
        segs = R.axis_cells(axis, 2.0).select("km", "lat", "lon", "lat2", "lon2").distinct()
        near.append(rows(segs))
    assert near[0] == near[1] and all(lon2 > lon for lon, lon2 in ((r[near[0][0].index("lon")], r[near[0][0].index("lon2")]) for r in near[0][1]))


def test_a_long_diagonal_takes_few_cells(spark):
    """Cells grow with a segment's length, not with its box."""
    axis = frame(spark, "river string, km double, lat double, lon double", ("R", 0.0, 40.0, 0.0), ("R", 900.0, 60.0, 20.0))
    plan_rows = R.near_axis(frame(spark, "pos_id int, lat double, lon double", (1, 50.0, 10.0)), axis)
    assert one(plan_rows, "pos_id", "river") == [(1, "R")]
    boxes = (20 / (2 / 111 * 4)) ** 2
    cells = R.axis_cells(axis, 2.0).count()
    assert cells < boxes / 30


def test_trends_hold_each_point_once(spark, tmp_path):
    """Trends over batches are those of all windows at once, and a station's state is as long as its points are many."""
    feed = Feed(spark, tmp_path)
    trends = lambda: run(ST.sliding_trend(feed.stream(), "2 hours"), tmp_path)
    pts = [("s", day(1, f"{h:02d}:{m:02d}"), float(h * h + m)) for h in range(10) for m in (0, 7, 40)]
    feed.add(*pts[:12], ("t", day(1, "01:00"), 5.0), ("t", day(1, "02:30"), None))
    feed.add(*pts[15:], *pts[12:15])
    q = trends()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 2  # windows would be some 60
    feed.add(("s", day(3), 1.0), ("s", day(2, "23:30"), 1.0))
    feed.add(("u", day(4), 1.0))
    trends()
    got = one(spark.read.parquet(str(tmp_path / "out")), "station_id", "at", "trend")
    at = lambda p: dt.datetime.fromisoformat(p[1])
    want, end = [], dt.datetime(2024, 1, 1, 0, 15)
    while end <= dt.datetime(2024, 1, 1, 16):
        own = [p for p in pts if end - dt.timedelta(hours=6) <= at(p) < end]
        hours = (at(own[-1]) - at(own[0])).total_seconds() / 3600 if own else 0
        if hours >= 1:
            want.append(("s", end, (own[-1][2] - own[0][2]) / hours))
        end += dt.timedelta(minutes=15)
    assert [(s, a) for s, a, _ in got] == [(s, a) for s, a, _ in want]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_a_micro_batch_of_many_files(spark, monkeypatch):
    """Batches keep their rows when each has several files."""
    want = rows(Q.stream_condense(spark, SF))
    monkeypatch.setattr(Q, "ARRIVING_ROWS", 80)
    assert Q.arriving(spark, SF, Q.hours_late()).isStreaming
    assert rows(Q.stream_condense(spark, SF)) == want
