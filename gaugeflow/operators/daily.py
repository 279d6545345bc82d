"""Readings to daily extremes, and merges of daily tables.

Tables: readings (station_id, ts, value); daily (station_id, year, doy, day,
min_v, max_v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import day_index, local_day
from ..functions.values import daily_mid, not_sentinel, plausible

KEY = ["station_id", "year", "doy", "day"]


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("day")).withColumn("doy", day_index(F.col("day")))


def condense(readings: DataFrame, offset_hours: int = 1) -> DataFrame:
    """Least and greatest plausible reading a station and day. Nulls, NaN and
    implausible readings drop; a day of only such readings has no row."""
    kept = readings.where(plausible(F.col("value")) & F.col("ts").isNotNull())
    days = kept.groupBy("station_id", local_day("ts", offset_hours).alias("day")).agg(F.min("value").alias("min_v"), F.max("value").alias("max_v"))
    return with_calendar(days).select(*KEY, "min_v", "max_v")


def drop_forecasts(readings: DataFrame, now: str) -> DataFrame:
    return readings.where(F.col("ts") <= F.lit(now).cast("timestamp"))


def drop_sentinels(readings: DataFrame, bound: float = 5000.0) -> DataFrame:
    return readings.where(not_sentinel(F.col("value"), bound))


def drop_spill_years(daily: DataFrame, last_year: int) -> DataFrame:
    return daily.where(F.col("year") <= last_year)


def subtract_datum(readings: DataFrame, offsets: DataFrame) -> DataFrame:
    """Subtract each station's datum offset; none counts as 0."""
    joined = readings.join(offsets.select("station_id", "datum_offset"), "station_id", "left")
    return joined.withColumn("value", F.col("value") - F.coalesce("datum_offset", F.lit(0.0))).drop("datum_offset")


def drop_empty_years(daily: DataFrame) -> DataFrame:
    """Without station-years that have no reading at all."""
    own = Window.partitionBy("station_id", "year")
    return daily.withColumn("there", F.count("min_v").over(own)).where("there > 0").drop("there")


def merge_extremes(*tables: DataFrame) -> DataFrame:
    """Union of daily tables: least of mins, greatest of maxes, nulls ignored.
    Idempotent, commutative and associative, so it aggregates before shuffling."""
    first, *rest = [t.select(*KEY, "min_v", "max_v") for t in tables]
    for t in rest:
        first = first.unionByName(t)
    return first.groupBy(*KEY).agg(F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"))


def code_map(registry: DataFrame) -> DataFrame:
    """``code, station_id`` of a registry (``station_id, code, retired``: an
    array of codes, or null). A station or a code that comes twice fails."""
    def once(df: DataFrame, col: str, what: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(col))
        twice = F.raise_error(F.concat(F.lit(f"{what} twice: "), F.coalesce(F.col(col).cast("string"), F.lit("null"))))
        return df.withColumn(col, F.when(n == 1, F.col(col)).otherwise(twice.cast(dict(df.dtypes)[col])))

    rows = once(registry.select("station_id", "code", "retired"), "station_id", "station")
    codes = rows.select(F.explode(F.concat(F.array("code"), F.coalesce("retired", F.array().cast("array<string>")))).alias("code"), "station_id")
    return once(codes, "code", "code").select("code", "station_id")


def combine_codes(daily_by_code: DataFrame, codes: DataFrame) -> DataFrame:
    """Retired and live codes of one station (``code, station_id``) as one table."""
    named = daily_by_code.withColumnRenamed("station_id", "code").join(codes.select("code", "station_id"), "code")
    return merge_extremes(named)


def overlay(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary's day wins column by column and the fallback fills nulls, in
    station-years for which both have a reading; a fallback year that the
    primary lacks stays as it is."""
    sides = [t.select(*KEY, *[(F.col(c) if n == own else F.lit(None).cast("double")).alias(f"{n}_{c}") for n in "pf" for c in ("min_v", "max_v")]) for own, t in (("p", primary), ("f", fallback))]
    # One shuffle, by station and year, serves the days' merge and the look at the fallback's year.
    days = sides[0].unionByName(sides[1]).repartition("station_id", "year").groupBy(*KEY).agg(*[F.max(f"{n}_{c}").alias(f"{n}_{c}") for n in "pf" for c in ("min_v", "max_v")])
    year = Window.partitionBy("station_id", "year")
    both = days.withColumn("has_f", F.count(F.coalesce("f_min_v", "f_max_v")).over(year)).where("has_f > 0")
    return both.select(*KEY, *[F.coalesce(f"p_{c}", f"f_{c}").alias(c) for c in ("min_v", "max_v")]).where("min_v is not null or max_v is not null")


def with_mid(daily: DataFrame) -> DataFrame:
    return daily.withColumn("mid", daily_mid(F.col("min_v"), F.col("max_v")))


def fill_gaps(primary: DataFrame, snapshot: DataFrame, running_year: int) -> DataFrame:
    """Mids of ``primary``; in the running year plausible snapshot values
    (``station_id, day, value``) fill days without one and are marked
    provisional."""
    mids = with_mid(primary).select("station_id", "day", "mid")
    extra = with_calendar(snapshot).where((F.col("year") == running_year) & plausible(F.col("value"))).select("station_id", "day", "value")
    both = mids.join(extra, ["station_id", "day"], "full")
    out = both.withColumn("provisional", F.col("mid").isNull() & F.col("value").isNotNull()).withColumn("mid", F.coalesce("mid", "value"))
    return with_calendar(out).select(*KEY, "mid", "provisional")


def provisional_from(filled: DataFrame, running_year: int) -> DataFrame:
    """First day of the running year that a snapshot filled, over all stations."""
    return filled.where(F.col("year") == running_year).agg(F.min(F.when(F.col("provisional"), F.col("doy"))).alias("provisional_from"))


def densify(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Every key has a row for each day from ``first`` to ``last``; new rows
    have nulls."""
    days = df.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(df, [*keys, "day"], "left")


def two_points(daily: DataFrame) -> DataFrame:
    """Each day as two points: its minimum at 06:00 and maximum at 18:00 UTC+1."""
    at = F.col("day").cast("timestamp")
    rows = daily.select("station_id", F.explode(F.array(F.struct((at + F.expr("INTERVAL 5 HOURS")).alias("ts"), F.col("min_v").alias("value")), F.struct((at + F.expr("INTERVAL 17 HOURS")).alias("ts"), F.col("max_v").alias("value")))).alias("p"))
    return rows.select("station_id", "p.ts", "p.value").where("value is not null")


def dedupe_points(points: DataFrame) -> DataFrame:
    """One point a station and instant; the least value where they differ."""
    return points.groupBy("station_id", "ts").agg(F.min("value").alias("value"))
