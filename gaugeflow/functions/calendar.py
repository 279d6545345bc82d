"""Calendar columns. Archive days are fixed UTC+1 days without daylight saving;
statistics use UTC days (``offset_hours=0``). The session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCHIVE_OFFSET_HOURS = 1


def local_day(ts, offset_hours: int = ARCHIVE_OFFSET_HOURS) -> Column:
    """Calendar day of ``ts`` at a fixed offset."""
    return F.to_date(F.col(ts) + F.expr(f"INTERVAL {offset_hours} HOURS")) if isinstance(ts, str) else F.to_date(ts + F.expr(f"INTERVAL {offset_hours} HOURS"))


def calendar_parts(ts: str, offset_hours: int = ARCHIVE_OFFSET_HOURS) -> list[Column]:
    """year, month, 0-based day of month at a fixed offset."""
    day = local_day(ts, offset_hours)
    return [F.year(day).alias("y"), F.month(day).alias("m"), (F.day(day) - 1).alias("day_idx")]


def day_index(day: Column) -> Column:
    """0-based day of year."""
    return F.dayofyear(day) - 1


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def days_in_month(day: Column) -> Column:
    return F.day(F.last_day(day))


def shard_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def epoch_day(ts: str) -> Column:
    return F.unix_date(F.to_date(F.col(ts)))


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity: -4.5 -> -4."""
    return F.floor(x + 0.5).cast("long")


def last_begun_day(year: int, now: str, offset_hours: int = ARCHIVE_OFFSET_HOURS) -> Column:
    """0-based last begun day of ``year``: -1 in a future year, the last day in a past one."""
    today = F.to_date(F.lit(now).cast("timestamp") + F.expr(f"INTERVAL {offset_hours} HOURS"))
    return F.when(F.year(today) < year, F.lit(-1)).when(F.year(today) > year, days_in_year(F.lit(year)) - 1).otherwise(day_index(today))


def parse_instant(text: Column) -> Column:
    """ISO-8601 with any offset; null where it can't be read."""
    return F.try_to_timestamp(text)
