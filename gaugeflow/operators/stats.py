"""Station statistics: means, climatology, scores, trends, gaps, thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import local_day, round_half_up
from ..functions.values import anomaly_class, ramp_bin
from .order import numbered


def daily_means(points: DataFrame) -> DataFrame:
    """Mean a station and UTC day."""
    return points.where("value is not null and not isnan(value)").groupBy("station_id", local_day("ts", 0).alias("day")).agg(F.avg("value").alias("mean"))


def climatology(means: DataFrame, current_year: int) -> DataFrame:
    """Per station and calendar month, from completed years only: mean, sd (of
    the population, at least 1), min, max, median, and the number of years."""
    past = means.where(F.year("day") < current_year)
    return past.groupBy("station_id", F.month("day").alias("month")).agg(
        F.avg("mean").alias("mean"), F.greatest(F.stddev_pop("mean"), F.lit(1.0)).alias("sd"), F.min("mean").alias("min"), F.max("mean").alias("max"), F.median("mean").alias("med"), F.count_distinct(F.year("day")).alias("years"),
    )


def value_counts(means: DataFrame) -> DataFrame:
    """Daily means counted by value: ``station_id, year, mean, n``. Counts of
    different years add up, so a table of them is kept up a year at a time."""
    return means.groupBy("station_id", F.year("day").alias("year"), "mean").agg(F.count("*").alias("n"))


def score_unusual(live: DataFrame, means: DataFrame, clim: DataFrame, least: int = 45) -> DataFrame:
    """Per live value (``station_id, value, month``): percentile among archived
    daily means, z against the month's climatology, years in the archive. Null
    below ``least`` archived values; a month without climatology has no z."""
    return score_counts(live, value_counts(means), clim, least)


def score_counts(live: DataFrame, counts: DataFrame, clim: DataFrame, least: int = 45) -> DataFrame:
    """``score_unusual`` from ``value_counts``. A station's values and counts
    are sorted together once, so that the running sum of counts up to a value
    is its place: no value meets each mean. The same sort gives the counts' sum
    and years. A station has at most as many counts as days."""
    there = live.where("value is not null").select("station_id", F.col("value").alias("x"), "month").distinct().withColumns({"n": F.lit(0).cast("long"), "live": F.lit(1)})
    held = counts.join(live.select("station_id").distinct(), "station_id", "left_semi").select("station_id", F.col("mean").alias("x"), "n", "year", F.lit(0).alias("live"))
    own = Window.partitionBy("station_id").orderBy("x", "live")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {"below": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(whole), "years": F.size(F.collect_set("year").over(whole)).cast("long")}
    placed = there.unionByName(held, allowMissingColumns=True).withColumns(sums).where((F.col("live") == 1) & (F.col("all") >= least))
    joined = placed.join(clim.select("station_id", "month", F.col("mean").alias("c_mean"), "sd"), ["station_id", "month"], "left")
    return joined.select("station_id", F.col("x").alias("value"), "month", round_half_up(100 * F.col("below") / F.col("all")).alias("pct"), ((F.col("x") - F.col("c_mean")) / F.col("sd")).alias("z"), "years")


def month_cells(means: DataFrame, clim: DataFrame) -> DataFrame:
    """Year x month cells: mean, min, max, level on the station's range of
    monthly means, and anomaly class from the climatology."""
    # Sums of decimals don't depend on the order of the tasks, as those of doubles do in their last digit: a level on an edge stays where it is.
    exact = F.col("mean").try_cast("decimal(38,18)")
    mean = F.when(F.count(exact) == F.count("mean"), F.sum(exact).cast("double") / F.count("mean")).otherwise(F.avg("mean"))
    cells = means.groupBy("station_id", F.year("day").alias("year"), F.month("day").alias("month")).agg(mean.alias("v"), F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    own = Window.partitionBy("station_id")
    binned = cells.withColumn("level", ramp_bin(F.col("v"), F.min("v").over(own), F.nullif(F.max("v").over(own), F.min("v").over(own))))
    z = (F.col("v") - F.col("mean")) / F.col("sd")
    return binned.join(clim.select("station_id", "month", "mean", "sd"), ["station_id", "month"], "left").select("station_id", "year", "month", "v", "lo", "hi", "level", anomaly_class(z).alias("anomaly"))


def year_overlay(means: DataFrame) -> DataFrame:
    """Years as parallel series on a 0..365 axis; Dec 31 of a leap year is 365."""
    return means.select("station_id", F.year("day").alias("year"), (F.dayofyear("day") - 1).alias("doy"), "mean")


def downsample(points: DataFrame, k: int) -> DataFrame:
    """n points a station into k columns of least and greatest value that tile
    the order; with n <= k column x shows point floor(x n / k). Points are
    ranked by ranges (see ``order.numbered``), so no task has to sort all of a
    station's."""
    ranked = numbered(points.select("station_id", "ts", "value"), ["ts", "value"], ["station_id"]).withColumnsRenamed({"rank": "i", "group_rows": "n"})
    many = ranked.where(F.col("n") > k).withColumn("col", F.ceil((F.col("i") + 1) * k / F.col("n")).cast("int") - 1)
    tiles = many.groupBy("station_id", "col").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    few = ranked.where(F.col("n") <= k).select("station_id", "i", "n", "value")
    shown = few.select("station_id", "n").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("col")).withColumn("i", F.floor(F.col("col") * F.col("n") / k).cast("int"))
    spread = shown.join(few, ["station_id", "n", "i"]).select("station_id", "col", F.col("value").alias("lo"), F.col("value").alias("hi"))
    return tiles.unionByName(spread)


def trend_per_hour(points: DataFrame, hours: int = 6, least_hours: float = 1.0) -> DataFrame:
    """Slope from the oldest point of the last ``hours`` before a station's
    newest point to that point; null where they are less than an hour apart."""
    newest = points.groupBy("station_id").agg(F.max("ts").alias("last"))
    recent = points.join(newest, "station_id").where(F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {hours} HOURS"))
    ends = recent.groupBy("station_id").agg(F.min_by("value", "ts").alias("v0"), F.min("ts").alias("t0"), F.max_by("value", "ts").alias("v1"), F.max("ts").alias("t1"))
    span = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 3.6e9
    return ends.select("station_id", F.when(span >= least_hours, (F.col("v1") - F.col("v0")) / span).alias("trend"))


def gap_counts(points: DataFrame, now: str, recent_minutes: float = 90, old_hours: float = 9, old_days: int = 365) -> DataFrame:
    """Consecutive points of a station further apart than a limit, which is
    wider for data over a year old: gaps, and the longest in hours."""
    # Within a day neighbours are found in the day's own rows; between days only the days' first and last points are compared.
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    laid = points.select("station_id", "ts", F.floor(micros / 86_400e6).alias("span")).repartition("station_id", "span")
    inner = laid.select("station_id", "ts", F.lag("ts").over(Window.partitionBy("station_id", "span").orderBy("ts")).alias("was"))
    ends = laid.groupBy("station_id", "span").agg(F.min("ts").alias("ts"), F.max("ts").alias("last"))
    between = ends.select("station_id", "ts", F.lag("last").over(Window.partitionBy("station_id").orderBy("span")).alias("was"))
    hours = (micros - F.unix_micros(F.col("was").cast("timestamp"))) / 3.6e9
    limit = F.when(F.col("ts").cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {old_days} DAYS"), old_hours).otherwise(recent_minutes / 60)
    found = inner.unionByName(between).withColumn("hours", hours).withColumn("gap", F.col("hours") > limit)
    return found.groupBy("station_id").agg(F.count_if("gap").alias("gaps"), F.max(F.when(F.col("gap"), F.col("hours"))).alias("longest_h"))


def thin(points: DataFrame, now: str, fresh_days: int = 16, old_days: int = 365) -> DataFrame:
    """Points up to 16 days old stay; older ones leave the earliest an hour,
    those over a year old the earliest in 6 hours; equal instants collapse."""
    ts, at = F.col("ts").cast("timestamp"), F.lit(now).cast("timestamp")
    tier = F.when(ts < at - F.expr(f"INTERVAL {old_days} DAYS"), 2).when(ts < at - F.expr(f"INTERVAL {fresh_days} DAYS"), 1).otherwise(0)
    seconds = F.unix_seconds(ts)
    bucket = F.when(tier == 2, F.floor(seconds / 21_600)).when(tier == 1, F.floor(seconds / 3_600)).otherwise(F.unix_micros(ts))
    # The earliest point of a bucket is a minimum, so rows are combined before they are shuffled.
    first = points.withColumn("tier", tier).withColumn("bucket", bucket).groupBy("station_id", "tier", "bucket").agg(F.min(F.struct("ts", "value")).alias("p"))
    return first.select("station_id", "p.ts", "p.value", "tier")


#: History windows in days; ``all`` has no bound.
WINDOWS = {"24h": 1, "3d": 3, "7d": 7, "15d": 15, "30d": 30, "1y": 365, "5y": 1825, "10y": 3650, "20y": 7300, "all": None}


def history_window(points: DataFrame, now: str, window: str) -> DataFrame:
    """Points of the last days that ``window`` names."""
    days = WINDOWS[window]
    return points if days is None else points.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def series_pivot(readings: DataFrame, names: list[str]) -> DataFrame:
    """Latest value of each series of a station, a column a series."""
    return readings.groupBy("station_id").pivot("series", names).agg(F.max_by("value", "ts"))


def median_spans(daily: DataFrame, least_days: int = 14) -> DataFrame:
    """Upper median of daily spans a station and year; null under 14 days."""
    own = Window.partitionBy("station_id", "year")
    spans = daily.where("min_v is not null and max_v is not null").withColumn("span", F.col("max_v") - F.col("min_v"))
    ranked = spans.withColumn("k", F.row_number().over(own.orderBy("span", "day")) - 1).withColumn("n", F.count("*").over(own))
    return ranked.groupBy("station_id", "year").agg(F.max(F.when((F.col("n") >= least_days) & (F.col("k") == F.floor(F.col("n") / 2)), F.col("span"))).alias("span"))


def tidal_flags(daily: DataFrame, running_year: int, threshold: float = 40.0, least_days: int = 14) -> DataFrame:
    """Tidal if the median span is 40 or more: that of the running year, or, if
    it has too few days, of the last closed year."""
    spans = median_spans(daily.where(F.col("year").isin(running_year, running_year - 1)), least_days)
    now, last = (F.max(F.when(F.col("year") == y, F.col("span"))) for y in (running_year, running_year - 1))
    return spans.groupBy("station_id").agg(F.coalesce(now, last).alias("span")).withColumn("tidal", F.coalesce(F.col("span") >= threshold, F.lit(False)))
