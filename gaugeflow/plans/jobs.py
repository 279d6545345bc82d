"""User-level jobs, composed of the operators."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import SENTINEL, outlook
from ..functions.values import state as state_of
from ..operators import daily as D
from ..operators import inventory as I
from ..operators import river as R
from ..operators import stats as S
from ..operators import totals as T
from ..sources import ingest, states
from ..sources.scratch import new_path, once, remove
from ..sources.tables import append_totals, order_of, prune_snapshot, read_or_none, rebuild_totals, upsert_daily, write_snapshot


def ingest_archive(readings: DataFrame, offsets: DataFrame | None, now: str, last_year: int, sentinel: float | None = SENTINEL) -> DataFrame:
    """Raw readings to daily extremes: forecasts and the source's sentinels
    (beyond ``sentinel``; None if it has none) drop, the datum offset is taken
    off, days are condensed, spill years drop."""
    kept = D.drop_forecasts(readings, now)
    if sentinel is not None:
        kept = D.drop_sentinels(kept, sentinel)
    if offsets is not None:
        kept = D.subtract_datum(kept, offsets)
    return D.drop_spill_years(D.condense(kept), last_year)  # condensed days have readings, so there are no empty years


def run_ingest(
    spark: SparkSession, path: str, pieces: DataFrame, stations: DataFrame, now: str, from_year: int, to_year: int, running_year: int,
    codes: DataFrame | None = None, sentinel: float | None = SENTINEL, source: str = "primary", january: bool = False,
) -> dict[str, int]:
    """One run of the ingest, from read pieces (see ``sources.ingest``) to the
    folder ``path`` with the tables ``daily``, ``years`` (days a station and
    year), ``state``, ``manifest`` and ``failures``, all in one new state.

    ``stations``: station_id, name, water, datum_offset, those to be had now.
    The work-list leaves out stations that are complete, and pieces of years
    before a station's first open one. ``codes`` (``code, station_id``) names
    the stations of pieces that only have a code. Forecasts and sentinels drop,
    the datum offset is taken off, days are condensed over all codes and merged
    into the years that they touch; no other year is read or written.

    A failed piece is entered in ``failures`` until a later run mends it, and
    its station's ``fetched_through`` stays, so that the next work-list has it
    again, as it does for stations of which no piece came; all others go on.
    The same run twice changes no table but the attempts. Returns counters:
    pieces, failed, empty and points from the pass that reads the pieces, and
    stations, skipped, failed_stations and station_years from its outcome."""
    if codes is not None:
        named = codes.select("code", F.col("station_id").alias("of_code"))
        pieces = pieces.join(named, "code", "left").withColumn("station_id", F.coalesce("station_id", "of_code")).drop("of_code")
    old = {n: states.read(spark, path, n) for n in ("daily", "years", "state", "manifest", "failures")}
    nothing = lambda **cols: stations.select("station_id", *[F.lit(None).cast(k).alias(c) for c, k in cols.items()]).limit(0)
    state = old["state"] if old["state"] is not None else nothing(name="string", fetched_from="int", fetched_through="int", source="string")
    work = I.backfill_worklist(stations, state, from_year, to_year, january)
    due = pieces.join(work, "station_id").where(F.col("year").isNull() | (F.col("year") >= F.col("start_year"))).drop("start_year")
    counts, at = ingest.Counts(), new_path(spark, "outcome")
    try:
        found = ingest.sorted_out(due, at, counts)
        failures, empty, good = found["failures"], found["empty"], found["good"]
        fresh = ingest_archive(found["readings"], stations, now, running_year, sentinel)
        with states.aside(fresh) as fresh:
            touched = [r["year"] for r in fresh.select("year").distinct().collect()]
            with nullcontext(fresh) if old["daily"] is None else states.aside(D.merge_extremes(old["daily"].where(F.col("year").isin(touched)), fresh)) as merged:
                years = own = I.year_counts(merged)
                if old["years"] is not None:
                    years = old["years"].where(~F.col("year").isin(touched)).select(own.columns).unionByName(own)
                bad = failures.select("station_id").distinct()
                seen = good.select("station_id").unionByName(empty.select("station_id")).distinct()
                done = work.join(seen, "station_id", "left_semi").join(bad, "station_id", "left_anti").join(stations.select("station_id", "name"), "station_id")
                advanced = done.select("station_id", "name", F.lit(from_year).alias("fetched_from"), F.lit(min(to_year, running_year - 1)).alias("fetched_through"), F.lit(source).alias("source"))
                new_state = I.upsert_state(state, advanced)
                previous = old["manifest"] if old["manifest"] is not None else nothing(n="string", w="string")
                manifest = I.manifest_of(stations, I.stats_of_years(years, running_year), new_state, previous, source)
                tables = {"daily": merged, "years": own, "state": new_state, "manifest": manifest, "failures": ingest.ledger(old["failures"], good, failures, empty)}
                by = {"daily": "year", "years": "year"}
                order = {n: order_of(t, by.get(n)) for n, t in tables.items()} | {"failures": ingest.KEY}
                states.commit(spark, path, tables, by, order)
                station_years = fresh.select("station_id", "year").distinct().count()
        failed = failures.select("station_id").distinct().count()
    finally:
        remove(spark, at)
    n, listed = stations.count(), work.count()
    return {**counts.get(), "stations": n, "skipped": n - listed, "failed_stations": failed, "station_years": station_years}


def freeze_year(spark: SparkSession, path: str, accumulated: DataFrame, primary: DataFrame | None, year: int) -> bool:
    """Close a year: the authoritative source lies over what was accumulated;
    without it the accumulation is stored as it is. Returns whether the ingest
    state may advance."""
    own = accumulated.where(F.col("year") == year)
    upsert_daily(spark, path, own if primary is None else D.overlay(primary.where(F.col("year") == year), own))
    return primary is not None


def daily_snapshot(stations: DataFrame, archive: DataFrame, day: str, running_year: int, tidal_span: float = 40.0) -> DataFrame:
    """A capture: the catalogue's stations (``uuid, n, w, value``) with their
    tidal flags."""
    flags = S.tidal_flags(archive, running_year, tidal_span).select("station_id", "tidal")
    rows = stations.select(F.col("uuid").alias("station_id"), "n", "w", "value", F.lit(day).cast("date").alias("day"))
    return rows.join(flags, "station_id", "left").withColumn("tidal", F.coalesce("tidal", F.lit(False)))


def snapshot_run(spark: SparkSession, path: str, stations: DataFrame, archive: DataFrame, day: str, running_year: int, most_months: int = 0, tidal_span: float = 40.0) -> dict:
    """A day's run: the capture with its tidal flags is put into the table at
    ``path``, and months more than ``most_months`` before the day are dropped
    (0 keeps all). Returns the capture's counts, taken by the pass that writes
    it, and the months that went. A second run of a day replaces its slot."""
    seen = Observation()
    capture = daily_snapshot(stations, archive, day, running_year, tidal_span)
    capture = capture.observe(seen, F.count(F.lit(1)).alias("stations"), F.count("value").alias("captured"), F.count_if("tidal").alias("flagged"))
    write_snapshot(spark, path, capture)
    return {**seen.get, "pruned": prune_snapshot(spark, path, day, most_months)}


def river_totals(archive: DataFrame, stations: DataFrame, snapshot: DataFrame, now: str, running_year: int) -> DataFrame:
    """Unrounded daily totals from archive and snapshot, up to the last begun
    day of the running year."""
    filled = D.fill_gaps(archive, snapshot, running_year)
    today = F.to_date(F.lit(now).cast("timestamp") + F.expr("INTERVAL 1 HOUR"))
    return T.river_daily_raw(filled.where(F.col("day") <= today), stations)


def totals_run(spark: SparkSession, path: str, archive: DataFrame, stations: DataFrame, snapshot: DataFrame, now: str, running_year: int, append: bool = False) -> dict[str, int]:
    """Totals from archive and snapshot to the tables ``daily``, ``monthly``
    (every river has all months from the first year on), ``overview`` and
    ``units`` at ``path``: all years anew, or, with ``append``, only the
    running one into the table that is there; then no other year's days are
    summed, and of these only the stations and rivers are looked up. The
    running year's days are filled once, the sums computed once. ``archive`` is
    best a table, as it is read three times. Returns the stations' counters and
    the first day that a snapshot filled (-1 if none did)."""
    today = F.to_date(F.lit(now).cast("timestamp") + F.expr("INTERVAL 1 HOUR"))
    units = None if append else stations.where("unit is not null")
    append = append and read_or_none(spark, path, "monthly") is not None
    mine = F.year("day") == running_year
    # Snapshots fill the running year alone, so days of others are neither joined nor copied.
    past = D.with_mid(D.with_calendar(archive.where(~mine & (F.col("day") <= today)))).select(*D.KEY, "mid")
    with states.aside(D.fill_gaps(archive.where(mine), snapshot, running_year).where(F.col("day") <= today)) as filled:
        whole = past.unionByName(filled.select(past.columns))
        with states.aside(T.river_daily_raw(filled if append else whole, stations)) as raw, states.aside(whole.where("mid is not null").select("station_id").distinct()) as there:
            mids = there.withColumn("mid", F.lit(0.0))
            if append:
                append_totals(spark, T.river_daily(raw), T.river_monthly(raw, running_year, running_year), path, running_year, T.attributed(mids, stations).select("river"))
            else:
                first = raw.agg(F.min("year")).first()[0]
                rebuild_totals(T.river_daily(raw), T.river_monthly(raw, first if first is not None else running_year, running_year), path, units)
            begun = D.provisional_from(filled, running_year).first()[0]
            return {**T.run_counters(mids, stations).first().asDict(), "provisional_from": -1 if begun is None else begun}


def station_history(daily: DataFrame, points: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Archived days as points, merged with the points there are. Stations that
    the manifest (``station_id, none``) marks as without an archive aren't
    looked up in it."""
    if manifest is not None:
        daily = daily.join(manifest.where("none").select("station_id"), "station_id", "left_anti")
    return D.dedupe_points(points.select("station_id", "ts", "value").unionByName(D.two_points(daily)))


def moves(live: DataFrame, snapshot: DataFrame, captures: DataFrame, marks: DataFrame, now: str, lookback_days: int) -> DataFrame:
    """Live stations (``station_id, value``, and ``state`` if known) with marks
    and their change since the baseline's capture, computed once. The one
    chosen capture is a single row, so sending it to all tasks is small."""
    chosen = I.baseline_capture(captures, now, lookback_days)
    base = snapshot.join(F.broadcast(chosen.select("day", "age_h")), "day").select("station_id", F.col("value").alias("base"), "age_h")
    return once(I.movement(live.join(marks, "station_id", "left").join(base.select("station_id", "age_h"), "station_id"), base, F.col("age_h") / 24), "moved")


def rising_board(live: DataFrame, snapshot: DataFrame, captures: DataFrame, marks: DataFrame, now: str, lookback_days: int) -> DataFrame:
    """Risers and fallers with their outlook. ``live``: station_id, value, and
    ``state``, where the source gives one: then it decides who is high or low;
    ``marks``: station_id, tidal, mnw, mhw."""
    return _board(moves(live, snapshot, captures, marks, now, lookback_days))


def _board(moved: DataFrame) -> DataFrame:
    state = state_of(F.col("state")) if "state" in moved.columns else None
    ends = outlook(F.col("value"), F.col("rate"), F.col("mnw"), F.col("mhw"), state=state)
    return I.top_movers(moved).join(moved.select("station_id", *ends), "station_id").select("side", "rank", "station_id", "delta", "rate", "more", "eta_target", "eta_days")


def rising_run(live: DataFrame, months: list[DataFrame], captures: DataFrame, marks: DataFrame, now: str, lookback_days: int) -> tuple[DataFrame, DataFrame]:
    """The board and its counts, for the month shards that could be read (one
    or two; the outage of one leaves the other). ``live`` and ``marks`` as for
    ``rising_board``; a station is tidal by its marks or by a snapshot's flag.

    Counts: rising, falling, steady and tidal stations; without a capture that
    serves as a baseline, high, low, normal and tidal ones, the others null,
    and the board is empty."""
    snapshot = months[0] if len(months) == 1 else I.union_shards(*months)
    flags = snapshot.groupBy("station_id").agg(F.max("tidal").alias("flagged"))
    marks = marks.join(flags, "station_id", "full").select("station_id", (F.coalesce("tidal", F.lit(False)) | F.coalesce("flagged", F.lit(False))).alias("tidal"), "mnw", "mhw")
    moved = moves(live, snapshot, captures, marks, now, lookback_days)
    if I.baseline_capture(captures, now, lookback_days).isEmpty():
        named = live.join(marks, "station_id", "left").withColumn("state", state_of(F.col("state")) if "state" in live.columns else F.lit("normal"))
        counts = I.state_counts(named)
    else:
        counts = I.movement_counts(moved)
    kinds = ("rising", "falling", "steady", "high", "low", "normal", "tidal")
    return _board(moved), counts.select(*[F.col(k) if k in counts.columns else F.lit(None).cast("long").alias(k) for k in kinds])


def station_statistics(daily: DataFrame, current_year: int) -> DataFrame:
    """Year x month cells of the archive."""
    return station_report(daily, current_year)["cells"]


def station_report(daily: DataFrame, current_year: int, live: DataFrame | None = None) -> dict[str, DataFrame]:
    """All statistics of an archive, from daily means that are computed once:
    ``climatology``, ``cells`` (year x month), ``overlay`` (years side by side)
    and, for live values (``station_id, value, month``), ``scores``. Cells and
    scores take two columns of the climatology: they leave its medians and
    counts of years uncomputed."""
    means = once(S.daily_means(D.two_points(daily)), "means")
    clim = S.climatology(means, current_year)
    out = {"climatology": clim, "cells": S.month_cells(means, clim), "overlay": S.year_overlay(means)}
    return out if live is None else out | {"scores": S.score_unusual(live, means, clim)}


def river_wave(mids: DataFrame, stations: DataFrame, first: str, days: int, most: int = 24) -> DataFrame:
    """Sampled stations of each river over a window of days, on their own
    scales, from the first day on which half of them have data."""
    shown = once(R.sample_stations(stations, most).select("station_id", "river", "km", "total"), "shown")
    cells = once(R.window_days(mids.join(shown.select("station_id"), "station_id", "left_semi"), first, days), "wave")
    crop = R.leading_crop(cells)
    return R.scaled(cells).crossJoin(F.broadcast(crop)).where("i >= first").join(shown, "station_id").select("river", "station_id", "day", "value", "scaled", "total")


def totals_explorer(monthly: DataFrame, k: int = 5) -> DataFrame:
    """Yearly bars by band with each bar's total."""
    bars = T.year_bars(once(monthly, "monthly"), k)
    return bars.withColumn("total", F.sum("v").over(Window.partitionBy("year")))


def explorer_views(daily: DataFrame, monthly: DataFrame, year: int, month: int, doy: int, k: int = 5, provisional_from: int | None = None) -> dict[str, DataFrame]:
    """What the explorer shows: ``years`` with totals, the ``months`` of all
    years, the ``days`` of a month, net ``changes`` a month and over the
    ``trailing`` week, and the ``rivers`` and ``deltas`` of a day. The monthly
    frame is computed once, ``daily`` (river, year, doy, v, n, dv, dn) is a
    table."""
    monthly = once(monthly, "monthly")
    dated = daily.withColumn("day", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("doy").cast("int")))
    bars = T.year_bars(monthly, k)
    return {
        "years": bars.withColumn("total", F.sum("v").over(Window.partitionBy("year"))), "months": T.month_bars(monthly, k), "days": T.day_bars(daily, monthly, year, month, k),
        "changes": T.change_bars(monthly), "trailing": T.trailing_net(dated), "rivers": T.day_breakdown(daily, year, doy, provisional_from), "deltas": T.delta_breakdown(daily, year, doy),
    }
