"""Stations: manifest, ingest state, units, work-lists, snapshots, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import days_in_year


def year_counts(daily: DataFrame) -> DataFrame:
    """Days with an extreme a station and year (``station_id, year, days``);
    years without any have no row. Each year's counts follow from that year
    alone, so a table of them is kept up partition by partition."""
    return daily.groupBy("station_id", "year").agg(F.count(F.coalesce("min_v", "max_v")).alias("days")).where("days > 0")


def stats_of_years(years: DataFrame, running_year: int) -> DataFrame:
    """As ``manifest_stats``, from ``year_counts``."""
    missing = F.when(F.col("year") < running_year, days_in_year(F.col("year")) - F.col("days")).otherwise(0)
    return years.groupBy("station_id").agg(F.min("year").alias("from_year"), F.max("year").alias("to_year"), F.sum(missing).cast("long").alias("gaps"))


def manifest_stats(daily: DataFrame, running_year: int) -> DataFrame:
    """First and last year of a station, and the days of closed years on which
    it has neither extreme; the running year is present but has no gaps."""
    return stats_of_years(year_counts(daily), running_year)


def build_manifest(live: DataFrame, daily: DataFrame, meta: DataFrame, previous: DataFrame, running_year: int, default_source: str = "primary") -> DataFrame:
    """Live catalogue and archive side by side: live stations without data are
    marked ``none``; archived ones that are no longer live stay."""
    return manifest_of(live, manifest_stats(daily, running_year), meta, previous, default_source)


def manifest_of(live: DataFrame, stats: DataFrame, meta: DataFrame, previous: DataFrame, default_source: str = "primary") -> DataFrame:
    """``build_manifest`` from the archive's statistics."""
    both = live.select("station_id", F.col("name").alias("l_name"), F.col("water").alias("l_water")).join(stats, "station_id", "full")
    both = both.join(meta.select("station_id", F.col("name").alias("m_name"), "source"), "station_id", "left").join(previous.select("station_id", F.col("n").alias("p_name"), F.col("w").alias("p_water")), "station_id", "left")
    empty = F.lit("")
    return both.select("station_id", F.coalesce("l_name", "m_name", "p_name", empty).alias("n"), F.coalesce("l_water", "p_water", empty).alias("w"), "from_year", "to_year", "gaps", F.col("from_year").isNull().alias("none"), F.coalesce("source", F.lit(default_source)).alias("source"))


def upsert_manifest(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of touched stations are replaced, others stay."""
    return previous.join(fresh, "station_id", "left_anti").unionByName(fresh)


def upsert_state(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fetched_from`` takes the lesser, ``fetched_through`` the greater, other
    fields the fresh value where there is one."""
    f = fresh.select("station_id", *[F.col(c).alias(f"f_{c}") for c in ("fetched_from", "fetched_through", "source", "name")])
    both = state.join(f, "station_id", "full")
    return both.select("station_id", F.coalesce("f_name", "name").alias("name"), F.least("fetched_from", "f_fetched_from").alias("fetched_from"), F.greatest("fetched_through", "f_fetched_through").alias("fetched_through"), F.coalesce("f_source", "source").alias("source"))


def upsert_units(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh units win where they aren't null; absent stations keep theirs."""
    f = fresh.select("station_id", F.col("unit").alias("f_unit"))
    return previous.join(f, "station_id", "full").select("station_id", F.coalesce("f_unit", "unit").alias("unit")).where("unit is not null")


def excluded_stations(units: DataFrame, wanted: str = "cm") -> DataFrame:
    return units.where(~F.col("unit").eqNullSafe(F.lit(wanted))).select("station_id").orderBy("station_id")


def backfill_worklist(stations: DataFrame, state: DataFrame, from_year: int, to_year: int, january: bool = False, epoch_year: int = 2000) -> DataFrame:
    """Stations still to fetch, and from which year; in January the completed
    year is pulled once more."""
    s = stations.select("station_id").join(state.select("station_id", "fetched_from", "fetched_through"), "station_id", "left")
    resumable = F.coalesce(F.coalesce("fetched_from", F.lit(epoch_year)) <= from_year, F.lit(False)) & F.col("fetched_through").isNotNull()
    done = resumable & (F.col("fetched_through") >= to_year)
    start = F.when(resumable, F.greatest(F.lit(from_year), F.col("fetched_through") + 1)).otherwise(F.lit(from_year))
    start = F.least(start, F.lit(to_year - 1)) if january else start
    return s.where(F.lit(january) | ~done).select("station_id", F.greatest(F.lit(from_year), start).cast("int").alias("start_year"))


def apply_snapshot(snapshot: DataFrame, capture: DataFrame) -> DataFrame:
    """Put a capture (``station_id, n, w, day, value, tidal``) into its day's
    slots: the same day's rerun replaces what it has, nulls included; other
    slots stay. Names, waters and the tidal flag are those of the last run, so
    the capture's where it has the station, whatever its day; a station that it
    lacks keeps those of its last day."""
    old = snapshot.join(capture, ["station_id", "day"], "left_anti").withColumn("run", F.lit(0))
    rows = old.unionByName(capture.withColumn("run", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy("station_id").orderBy("run", "day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("station_id", "day", "value", *[F.last(c).over(own).alias(c) for c in ("n", "w", "tidal")])


def capture_counts(capture: DataFrame) -> DataFrame:
    """stations, captured (those with a value), flagged (tidal ones) of a capture."""
    return capture.agg(F.count("*").alias("stations"), F.count("value").alias("captured"), F.count_if(F.coalesce("tidal", F.lit(False))).alias("flagged"))


def union_shards(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two months as one day axis; a station tidal in either is tidal."""
    own = Window.partitionBy("station_id")
    return a.unionByName(b, allowMissingColumns=True).withColumn("tidal", F.max("tidal").over(own))


def expired(shards: DataFrame, reference: str, most_months: int) -> DataFrame:
    """Month shards (``y, m``) more than ``most_months`` before the reference
    day; 0 keeps all."""
    ref = F.lit(reference).cast("date")
    age = (F.year(ref) * 12 + F.month(ref)) - (F.col("y") * 12 + F.col("m"))
    return shards.where((F.lit(most_months) > 0) & (age > most_months))


def baseline_capture(captures: DataFrame, now: str, lookback_days: int, least_hours: float = 12, tolerance_days: float = 2) -> DataFrame:
    """The capture (``day, captured_at``) to compare with: for a lookback of 1
    the newest that is old enough, else the nearest to that many days ago
    within a tolerance on either side; no row if there is none."""
    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("captured_at").cast("timestamp"))) / 3.6e9
    aged = captures.withColumn("age_h", hours).where(F.col("age_h") >= least_hours)
    if lookback_days == 1:
        return aged.orderBy("age_h").limit(1)
    off = F.abs(F.col("age_h") - 24 * lookback_days)
    return aged.where(off <= 24 * tolerance_days).orderBy(off, "age_h").limit(1)


def nearest_before(live: DataFrame, history: DataFrame, span_hours: float = 24) -> DataFrame:
    """Per live row the station's last history value at or before it. Both
    are sorted together within spans of time, and a span gets the last history
    row of those before it: so no task has to hold a whole station, and no
    pairs are joined."""
    span = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (span_hours * 3600e6)).cast("long")
    h = history.select("station_id", span.alias("span"), "ts", F.struct("ts", "value").alias("h")).where("ts is not null and h.value is not null")
    lives = live.select("station_id", span.alias("span"), "ts", "value")
    # Spans of a station: as many as days, not as readings.
    ends = h.groupBy("station_id", "span").agg(F.max("h").alias("last")).join(lives.select("station_id", "span").distinct(), ["station_id", "span"], "full")
    carried = ends.withColumn("h", F.last("last", ignorenulls=True).over(Window.partitionBy("station_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).where("h is not null")
    rows = lives.withColumn("h", F.lit(None).cast(h.schema["h"].dataType)).withColumn("live", F.lit(1))
    for part in (h, carried.select("station_id", "span", "h.ts", "h")):
        rows = rows.unionByName(part.withColumns({"value": F.lit(None).cast("double"), "live": F.lit(0)}))
    order = Window.partitionBy("station_id", "span").orderBy("ts", "live", "h.value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("b", F.last("h", ignorenulls=True).over(order)).where("live = 1").select("station_id", "ts", "value", F.col("b.value").alias("base"))


def nearest_within(live: DataFrame, history: DataFrame, tolerance_hours: float) -> DataFrame:
    """Per live row (``station_id, ts, value``) the station's history value
    that is nearest in time, before or after it, within the tolerance
    (inclusive): ``base`` and ``base_ts``, null if there is none. Of two
    equally near ones the later wins, of several at one instant the least.

    Time is cut into spans as long as the tolerance, so a station of any
    length lies in many tasks. A span gets the last history row of the one
    before it and the first of the one after it; nothing further away can be
    within the tolerance. One sort of a span's rows then serves both sides."""
    width = int(tolerance_hours * 3600e6)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.floor(micros / width).cast("long")
    h = history.where("ts is not null").groupBy("station_id", "ts").agg(F.min("value").alias("value")).where("value is not null").withColumn("span", span)
    own = h.select("station_id", "span", "ts", F.struct("ts", "value").alias("h"))
    ends = own.groupBy("station_id", "span").agg(F.min("h").alias("first"), F.max("h").alias("last"))
    carried = [ends.select("station_id", (F.col("span") + d).alias("span"), F.col(f"{c}.ts").alias("ts"), F.col(c).alias("h")) for c, d in (("first", -1), ("last", 1))]
    rows = live.select("station_id", span.alias("span"), "ts", F.lit(None).cast(own.schema["h"].dataType).alias("h"), "value", F.lit(1).alias("live"))
    for part in (own, *carried):
        rows = rows.unionByName(part.withColumns({"value": F.lit(None).cast("double"), "live": F.lit(0)}))
    order = Window.partitionBy("station_id", "span").orderBy("ts", "live")
    both = rows.withColumn("b", F.last("h", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.first("h", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))

    def off(side: str) -> Column:
        return F.abs(F.unix_micros(F.col(f"{side}.ts").cast("timestamp")) - micros)

    best = F.when(off("a") <= F.coalesce(off("b"), off("a")), F.col("a")).otherwise(F.col("b"))
    found = both.where("live = 1").withColumn("n", F.when(F.coalesce(F.least(off("a"), off("b")) <= width, F.lit(False)), best))
    return found.select("station_id", "ts", "value", F.col("n.value").alias("base"), F.col("n.ts").alias("base_ts"))


def movement(live: DataFrame, baseline: DataFrame, elapsed_days: Column | float) -> DataFrame:
    """Change since the baseline, a day. Stations without a baseline value are
    left out."""
    days = F.lit(elapsed_days) if isinstance(elapsed_days, (int, float)) else elapsed_days
    both = live.join(baseline.where("base is not null").select("station_id", "base"), "station_id").where("value is not null")
    return both.withColumn("delta", F.col("value") - F.col("base")).withColumn("rate", F.col("delta") / days)


def movement_counts(moved: DataFrame) -> DataFrame:
    """Rising from +1 a day, falling from -1, else steady; tidal ones apart."""
    tidal, rate = F.coalesce("tidal", F.lit(False)), F.col("rate")
    return moved.agg(F.count_if(~tidal & (rate >= 1)).alias("rising"), F.count_if(~tidal & (rate <= -1)).alias("falling"), F.count_if(~tidal & (F.abs(rate) < 1)).alias("steady"), F.count_if(tidal).alias("tidal"))


def state_counts(live: DataFrame) -> DataFrame:
    """Without a baseline: counts of high, low, normal and tidal stations."""
    tidal, s = F.coalesce("tidal", F.lit(False)), F.col("state")
    return live.agg(F.count_if(~tidal & (s == "high")).alias("high"), F.count_if(~tidal & (s == "low")).alias("low"), F.count_if(~tidal & (s == "normal")).alias("normal"), F.count_if(tidal).alias("tidal"))


def top_movers(moved: DataFrame, risers: int = 20, fallers: int = 10) -> DataFrame:
    """The fastest risers and steepest fallers, with how many of each there are
    beyond the list."""
    fair = moved.where(~F.coalesce("tidal", F.lit(False)))
    out = None
    for name, sign, n in (("rising", 1, risers), ("falling", -1, fallers)):
        side = fair.where(F.col("rate") * sign >= 1)
        top = side.orderBy(F.col("rate") * -sign, "station_id").limit(n)
        total = side.agg(F.count("*").alias("total"))
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("rate") * -sign, "station_id")))
        one = ranked.crossJoin(F.broadcast(total)).select(F.lit(name).alias("side"), "rank", "station_id", "delta", "rate", F.greatest(F.lit(0), F.col("total") - n).alias("more"))
        out = one if out is None else out.unionByName(one)
    return out
