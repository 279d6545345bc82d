"""Structured Streaming forms of ingest and live statistics."""

from __future__ import annotations

import threading
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.calendar import day_index, local_day
from ..functions.values import plausible
from ..operators.daily import KEY, condense, merge_extremes
from ..sources import states
from ..sources.tables import upsert_daily, write_snapshot


def streaming_condense(readings: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Daily extremes in event-time windows aligned to UTC+1 days. In the mode
    ``append`` state is bounded by the watermark, and later readings are
    dropped; ``condense_batches`` takes them in."""
    kept = readings.where(plausible(F.col("value"))).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    days = kept.groupBy("station_id", F.window("ts", "1 day", "1 day", "23 hours").alias("w")).agg(F.min("value").alias("min_v"), F.max("value").alias("max_v"))
    day = F.to_date(F.col("w.start") + F.expr("INTERVAL 1 HOUR"))
    return days.withColumn("day", day).select("station_id", F.year("day").alias("year"), day_index(F.col("day")).alias("doy"), "day", "min_v", "max_v")


def dedupe(readings: DataFrame, watermark: str = "2 days") -> DataFrame:
    return readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["station_id", "ts"])


def drop_future(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("ts") <= F.current_timestamp())


def ingest_batches(readings: DataFrame, path: str, checkpoint: str):
    """Each micro-batch is condensed and merged into the daily table. Nothing is
    too late, and a batch that comes twice changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            upsert_daily(batch.sparkSession, path, condense(batch))

    return readings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def condense_batches(readings: DataFrame, path: str, checkpoint: str, delay: str = "2 days"):
    """Daily extremes over micro-batches with few open days: the folder
    ``path`` has the tables ``daily`` (days that are closed), ``open`` (those
    that aren't) and ``progress``.

    A day closes once a reading has come that is ``delay`` after its end (the
    watermark, as of the batch before, as Spark keeps it); only open days are
    read and rewritten by each batch. A reading of a closed day is late: it is
    merged into ``daily`` and counted. So both tables together are the batch
    condense of all that has come. A batch's changes are one new state that
    names the batch, so one that comes again changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = states.read(spark, path, "progress")
        done = before.first() if before is not None else None
        if done is not None and number <= done["batch"]:
            return
        with states.aside(batch.select("station_id", F.col("ts").cast("timestamp").alias("ts"), "value")) as rows:
            passed = F.lit(done["watermark"] if done else None).cast("timestamp")
            over = lambda at: F.coalesce((F.col("day").cast("timestamp") + F.expr("INTERVAL 23 HOURS")) <= at, F.lit(False))
            days = condense(rows)
            late, fresh = days.where(over(passed)), days.where(~over(passed))
            n = rows.where(plausible(F.col("value")) & F.col("ts").isNotNull()).withColumn("day", local_day("ts")).agg(F.count_if(over(passed)).alias("late"), F.count(F.lit(1)).alias("n"), (F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("watermark")).first()
            marks = [w for w in (n["watermark"], done["watermark"] if done else None) if w is not None]
            mark = max(marks, default=None)
            old = states.read(spark, path, "open")
            with states.aside(merge_extremes(old, fresh) if old is not None else fresh.select(*KEY, "min_v", "max_v")) as open_:
                ends = F.lit(mark).cast("timestamp")
                with states.aside(open_.where(over(ends)).unionByName(late.select(open_.columns))) as closed:
                    daily, was = closed, states.read(spark, path, "daily")
                    if was is not None:
                        years = [r["year"] for r in closed.select("year").distinct().collect()]
                        daily = was.where(F.col("year").isin(years)).select(closed.columns).unionByName(closed)
                    progress = spark.createDataFrame([(number, mark, (done["late"] if done else 0) + n["late"], (done["readings"] if done else 0) + n["n"])], "batch long, watermark timestamp, late long, readings long")
                    tables = {"daily": merge_extremes(daily), "open": open_.where(~over(ends)), "progress": progress}
                    states.commit(spark, path, tables, {"daily": "year"}, {"daily": ["station_id", "doy"], "open": ["station_id", "day"]})

    return readings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_batches(live: DataFrame, path: str, checkpoint: str):
    """Each micro-batch's latest value of a station and day goes to its slot."""

    def put(batch: DataFrame, _: int) -> None:
        slots = batch.withColumn("day", F.to_date(F.col("ts") + F.expr("INTERVAL 1 HOUR"))).groupBy("station_id", "day").agg(*[F.max_by(c, "ts").alias(c) for c in ("n", "w", "value", "tidal")])
        if slots.limit(1).count():
            write_snapshot(batch.sparkSession, path, slots)

    return live.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enrich(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """Live rows of a stream with a static ``station_id, base``."""
    return live.join(baseline.select("station_id", "base"), "station_id").withColumn("delta", F.col("value") - F.col("base"))


#: Groups of stations that share their state. Stays as it is while a checkpoint is in use.
_SHARDS = 1024


def sliding_trend(points: DataFrame, watermark: str = "1 hour", least_hours: float = 1.0) -> DataFrame:
    """Trend an hour in sliding windows of 6 hours, a quarter of an hour apart:
    ``station_id, at`` (the window's end) and ``trend``, from its oldest to its
    newest point. Windows whose points are less than ``least_hours`` apart have
    no row, nor have those in which either value is missing.

    A window is given once, when the watermark has passed its end. State is the
    points that an open window may have, each held once, not once for each of
    the 24 windows that it lies in; it goes when no point can come any more that
    lies in a window given before. Stations share state in ``_SHARDS`` groups by
    their hash, as a group costs more than its points do."""
    step, length = 900_000_000, 21_600_000_000

    def follow(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stations, held, values, given = state.get if state.exists else ([], [], [], 0)
        passed = max(0, state.getCurrentWatermarkMs()) * 1000
        own: dict = {}
        for s, t, v in zip(stations, held, values, strict=True):
            own.setdefault(s, []).append((t, v))
        for pdf in () if state.hasTimedOut else batches:
            for s, t, v in zip(pdf["station_id"].tolist(), pdf["t"].tolist(), pdf["value"].tolist(), strict=True):
                own.setdefault(s, []).append((t, None if v != v else v))
        rows, kept, wake = [], [], passed + length
        for station, points in own.items():
            points.sort(key=lambda p: (p[0], p[1] is None, p[1] or 0.0))
            times = [t for t, _ in points]
            # A window of two points or more has two that follow each other: its end is past the later one, and not past the earlier one by more than its length.
            ends = sorted({e for t, u in zip(times, times[1:]) if u - t < length for e in range(max(u // step * step + step, given // step * step), t // step * step + length + 1, step) if e > given})
            for end in ends[: bisect_right(ends, passed)]:
                first, last = bisect_left(times, end - length), bisect_left(times, end) - 1
                hours = (times[last] - times[first]) / 3.6e9
                if hours >= least_hours and points[first][1] is not None and points[last][1] is not None:
                    rows.append((station, pd.Timestamp(end, unit="us"), (points[last][1] - points[first][1]) / hours))
            kept += [(station, *p) for p in points if p[0] // step * step + length > passed]
            later = ends[bisect_right(ends, passed) :]
            wake = min([wake, *later[:1]])
        if not kept and not own and passed - given >= length:
            state.remove()
        else:
            state.update(tuple([p[k] for p in kept] for k in range(3)) + (passed,))
            state.setTimeoutTimestamp(max(wake // 1000, passed // 1000 + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["station_id", "at", "trend"]).astype({"at": "datetime64[us]", "trend": "float64"})

    # The watermark is on a point's time and the length of a window: Spark then drops a point once no open window has it, and not before.
    shard, ts = F.pmod(F.xxhash64("station_id"), F.lit(_SHARDS)), F.col("ts").cast("timestamp")
    cast = points.where(ts.isNotNull()).select(shard.alias("shard"), F.col("station_id").cast("string").alias("station_id"), F.unix_micros(ts).alias("t"), F.col("value").cast("double").alias("value"), (ts + F.expr("INTERVAL 6 HOURS")).alias("last")).withWatermark("last", f"{watermark} 6 hours")
    out = cast.groupBy("shard").applyInPandasWithState(follow, "station_id string, at timestamp, trend double", "stations array<string>, held array<long>, values array<double>, given long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("station_id", F.col("station_id").cast(dict(points.dtypes)["station_id"]))


def stateful_gaps(points: DataFrame, limit_minutes: float = 90, watermark: str = "2 hours", silent_hours: float = 168) -> DataFrame:
    """Gaps between a station's consecutive points in the order of their times,
    in whatever order they come: ``from_ts, to_ts, hours`` for each that is
    wider than the limit.

    A point waits in its station's state until the watermark has passed it, so
    one that comes late, but within the watermark, closes the gap that the
    others would have left; still later ones are dropped by Spark. A station
    that has no point for more than ``silent_hours`` gives one row without
    ``to_ts``, and its state goes; its next point starts anew. State is the
    last instant and those that wait."""
    limit, silence = limit_minutes * 60e6, int(silent_hours * 3600e6)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        passed = max(0, state.getCurrentWatermarkMs()) * 1000
        times = [*waiting, *(() if state.hasTimedOut else (t.value // 1000 for pdf in batches for t in pdf["ts"]))]
        rows, waiting = [], sorted(t for t in times if t > passed)
        for t in sorted(t for t in times if t <= passed):
            if last is not None and t <= last:
                continue
            if last is not None and t - last > silence:
                rows.append((key[0], pd.Timestamp(last, unit="us"), None, None))
            elif last is not None and t - last > limit:
                rows.append((key[0], pd.Timestamp(last, unit="us"), pd.Timestamp(t, unit="us"), (t - last) / 3.6e9))
            last = t
        if last is not None and passed - last > silence:
            rows.append((key[0], pd.Timestamp(last, unit="us"), None, None))
            last = None
        if last is None and not waiting:
            state.remove()
        else:
            state.update((last, waiting))
            wake = min([*waiting[:1], *([last + silence] if last is not None else [])])
            state.setTimeoutTimestamp(max(wake // 1000, passed // 1000 + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["station_id", "from_ts", "to_ts", "hours"]).astype({"from_ts": "datetime64[us]", "to_ts": "datetime64[us]", "hours": "float64"})

    cast = points.select("station_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return cast.groupBy("station_id").applyInPandasWithState(follow, f"station_id {dict(points.dtypes)['station_id']}, from_ts timestamp, to_ts timestamp, hours double", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def only_newer(points: DataFrame, archive: DataFrame) -> DataFrame:
    """Points newer than the station's newest archived one."""
    newest = archive.groupBy("station_id").agg(F.max("ts").alias("high"))
    return points.join(newest, "station_id", "left").where("high is null or ts > high").drop("high")


class StreamCounts(StreamingQueryListener):
    """Counters of a stream's readings, taken along by the query itself: use
    ``on`` on the stream, and ``get`` once it has ended. Sums over all of its
    micro-batches, ``batches`` those with readings; ``dropped`` are rows behind a
    watermark."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.sums, self.ended = spark, name, {}, threading.Event()
        self.lock = threading.Lock()
        spark.streams.addListener(self)

    def on(self, readings: DataFrame) -> DataFrame:
        fine = plausible(F.col("value")) & F.col("ts").isNotNull()
        return readings.observe(self.name, F.count(F.lit(1)).alias("readings"), F.count_if(~fine).alias("skipped"), F.count_if(F.col("value").isNull()).alias("missing"))

    def get(self, seconds: float = 30) -> dict[str, int]:
        """Waits for the end of the query, whose events come a little later."""
        self.ended.wait(seconds)
        self.spark.streams.removeListener(self)
        return dict(self.sums)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self.lock:
                dropped = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
                for k, v in {**row.asDict(), "dropped": dropped, "batches": int(row["readings"] > 0)}.items():
                    self.sums[k] = self.sums.get(k, 0) + v

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, and read what it gave: appended
    rows, or, in the mode ``complete``, the last whole result."""
    spark = stream.sparkSession
    if mode == "append":
        out = stream.writeStream.format("parquet").option("path", path)
    else:
        out = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).outputMode(mode)
    out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is now into an in-memory table; for small
    results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
