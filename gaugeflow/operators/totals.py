"""River totals: sums over a river's stations, and paired day-over-day deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import round_half_up
from ..functions.values import excluded_unit


def attributed(mids: DataFrame, stations: DataFrame) -> DataFrame:
    """Mids (``station_id, day, year, doy, mid``) of stations in cm that have a
    river. The stations are a dimension table; Catalyst broadcasts it where its
    measured size allows."""
    dims = stations.where(~excluded_unit(F.col("unit")) & (F.trim(F.coalesce("river", F.lit(""))) != "")).select("station_id", "river")
    return mids.join(dims, "station_id")


def run_counters(mids: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations of a run: ``excluded`` by their unit, else ``unattributed``
    without a river, else ``included`` if they have a mid on any day, else
    ``silent``. One row."""
    there = mids.where("mid is not null").select("station_id").distinct().withColumn("there", F.lit(True))
    bad, river = excluded_unit(F.col("unit")), F.trim(F.coalesce("river", F.lit(""))) != ""
    some = F.col("there").isNotNull()
    kinds = {"included": ~bad & river & some, "silent": ~bad & river & ~some, "unattributed": ~bad & ~river, "excluded": bad}
    return stations.join(there, "station_id", "left").agg(*[F.count_if(k).alias(n) for n, k in kinds.items()])


def consecutive_deltas(mids: DataFrame) -> DataFrame:
    """``delta`` to the day before, if the station has that day too, in the same
    year and on the very next day; gaps break both sides."""
    own = Window.partitionBy("station_id", "year").orderBy("doy")
    there = mids.where("mid is not null")
    before = there.withColumn("was", F.lag("mid").over(own)).withColumn("was_doy", F.lag("doy").over(own))
    return before.withColumn("delta", F.when(F.col("doy") - F.col("was_doy") == 1, F.col("mid") - F.col("was"))).drop("was", "was_doy")


def river_daily_raw(mids: DataFrame, stations: DataFrame) -> DataFrame:
    """Unrounded sums a river and day: ``v, n, dv, dn``."""
    moved = consecutive_deltas(attributed(mids, stations))
    return moved.groupBy("river", "year", "doy", "day").agg(F.sum("mid").alias("v"), F.count("mid").alias("n"), F.sum("delta").alias("dv"), F.nullif(F.count("delta"), F.lit(0)).alias("dn"))


def river_daily(raw: DataFrame) -> DataFrame:
    """The sums, each rounded once."""
    return raw.select("river", "year", "doy", round_half_up(F.col("v")).alias("v"), "n", round_half_up(F.col("dv")).alias("dv"), "dn")


def river_monthly(raw: DataFrame, from_year: int | None = None, to_year: int | None = None) -> DataFrame:
    """``v``: mean of the month's unrounded daily sums; ``diff``: sum of its
    unrounded deltas. With years given, every river has all their months."""
    out = raw.groupBy("river", "year", F.month("day").alias("month")).agg(round_half_up(F.avg("v")).alias("v"), round_half_up(F.sum("dv")).alias("diff"))
    if from_year is None:
        return out
    # A river's months are few: they are laid into the whole grid within its row.
    cells = out.groupBy("river").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")), F.struct("v", "diff")))).alias("cells"))
    years = F.sequence(F.lit(from_year), F.lit(to_year))
    months = F.flatten(F.transform(years, lambda y: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month")))))
    grid = cells.select("river", "cells", F.explode(months).alias("k")).withColumn("c", F.try_element_at("cells", F.col("k")))
    return grid.select("river", "k.year", "k.month", "c.v", "c.diff")


def banded(monthly: DataFrame, k: int = 5) -> DataFrame:
    """Adds ``band``: the river's name if it is among the ``k`` largest by
    all-time sum, else OTHER."""
    top = monthly.groupBy("river").agg(F.sum("v").alias("s")).where("s is not null").orderBy(F.desc("s"), "river").limit(k).select("river", F.lit(True).alias("top"))
    return monthly.join(F.broadcast(top), "river", "left").withColumn("band", F.when(F.col("top"), F.col("river")).otherwise("OTHER")).drop("top")


def year_bars(monthly: DataFrame, k: int = 5) -> DataFrame:
    """A year's value of a river is the mean of its non-null months; bars sum
    the rivers of a band."""
    by_river = banded(monthly, k).groupBy("band", "river", "year").agg(F.avg("v").alias("v"))
    return by_river.groupBy("year", "band").agg(round_half_up(F.sum("v")).alias("v"))


def month_bars(monthly: DataFrame, k: int = 5) -> DataFrame:
    return banded(monthly, k).groupBy("year", "month", "band").agg(F.sum("v").alias("v"))


def day_bars(daily: DataFrame, monthly: DataFrame, year: int, month: int, k: int = 5) -> DataFrame:
    """A month's days: per day and band the sum of its rivers' values, 0 where
    they are silent, and the day's ``total``. Bands are those of ``monthly``."""
    bands = banded(monthly, k).select("river", "band").distinct()
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    days = bands.select("band").distinct().select("band", F.explode(F.sequence(first, F.last_day(first))).alias("day"))
    own = daily.where(F.col("year") == year).withColumn("day", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("doy").cast("int")))
    sums = own.where(F.month("day") == month).join(bands, "river").groupBy("day", "band").agg(F.sum("v").alias("v"))
    bars = days.join(sums, ["band", "day"], "left").select("day", "band", F.coalesce("v", F.lit(0)).alias("v"))
    return bars.withColumn("total", F.sum("v").over(Window.partitionBy("day")))


def change_bars(monthly: DataFrame) -> DataFrame:
    """Net change a year and month, over rivers; nulls are skipped."""
    return monthly.groupBy("year", "month").agg(F.sum("diff").alias("diff"))


def change_rollup(raw: DataFrame) -> DataFrame:
    """Net change a year, month and day and their subtotals (nulls mark them)."""
    by = raw.withColumn("month", F.month("day")).rollup("year", "month", "doy").agg(F.sum("dv").alias("dv"))
    return by


def trailing_net(daily: DataFrame, days: int = 7) -> DataFrame:
    """Sum of the last ``days`` daily nets over all rivers, by calendar day.
    Days are few, so one window over them is small."""
    net = daily.groupBy("day").agg(F.sum("dv").alias("net")).withColumn("k", F.unix_date("day"))
    own = Window.orderBy("k").rangeBetween(-(days - 1), 0)
    return net.withColumn("trailing", F.sum("net").over(own)).drop("k")


def day_breakdown(daily: DataFrame, year: int, doy: int, provisional_from: int | None = None) -> DataFrame:
    """The rivers of one day by value, with share of the sum and all gauges."""
    one = daily.where((F.col("year") == year) & (F.col("doy") == doy) & F.col("v").isNotNull())
    all_ = Window.partitionBy()
    flag = F.lit(False) if provisional_from is None else F.lit(doy >= provisional_from)
    return one.select("river", "v", "n", F.round(F.col("v") / F.sum("v").over(all_), 6).alias("share"), F.sum("n").over(all_).alias("gauges"), flag.alias("provisional"), F.row_number().over(Window.orderBy(F.desc("v"), "river")).alias("rank"))


def delta_breakdown(daily: DataFrame, year: int, doy: int) -> DataFrame:
    """The rivers of one day by delta, with the total and all pairs."""
    one = daily.where((F.col("year") == year) & (F.col("doy") == doy) & F.col("dv").isNotNull())
    all_ = Window.partitionBy()
    return one.select("river", "dv", "dn", F.sum("dv").over(all_).alias("total"), F.sum("dn").over(all_).alias("pairs"), F.row_number().over(Window.orderBy(F.desc("dv"), "river")).alias("rank"))
