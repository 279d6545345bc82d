"""Predicates and small computations on single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plausible readings, inclusive; source-specific sentinel bound.
PLAUSIBLE = (-2000.0, 20000.0)
SENTINEL = 5000.0


def plausible(value: Column, low: float = PLAUSIBLE[0], high: float = PLAUSIBLE[1]) -> Column:
    """Whether a reading is plausible; false for null and NaN."""
    return F.coalesce(value.between(low, high), F.lit(False))


def not_sentinel(value: Column, bound: float = SENTINEL) -> Column:
    return F.coalesce(F.abs(value) <= bound, F.lit(False))


def numeric(text: Column) -> Column:
    """A finite number, or null."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def daily_mid(low: Column, high: Column) -> Column:
    """Mean of a day's extremes; null if either is missing or implausible."""
    return F.when(plausible(low) & plausible(high), (low + high) / 2)


def excluded_unit(unit: Column, wanted: str = "cm") -> Column:
    """True unless the unit is literally the wanted one; unknown is excluded."""
    return ~unit.eqNullSafe(F.lit(wanted))


def state(raw: Column) -> Column:
    """low, high or normal, from the source's state in either case."""
    s = F.lower(raw)
    return F.when(s.isin("low", "lowest"), "low").when(s.isin("high", "highest"), "high").otherwise("normal")


def ramp_bin(value: Column, low: Column, high: Column, levels: int = 4) -> Column:
    """0 .. levels - 1, clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(levels * (value - low) / (high - low)).cast("int")))


def anomaly_class(z: Column) -> Column:
    """neutral, or wet / dry with a density of 1 to 4."""
    size = F.abs(z)
    density = F.when(size < 1.0, 1).when(size < 1.5, 2).when(size < 2.5, 3).otherwise(4)
    return F.when(z.isNull(), None).when(size < 0.5, "neutral").otherwise(F.concat(F.when(z > 0, "wet").otherwise("dry"), F.lit("-"), density.cast("string")))


def outlook(value: Column, rate: Column, low: Column, high: Column, most_days: int = 99, state: Column | None = None) -> list[Column]:
    """eta_target, eta_days: days at ``rate`` a day until the high or low mark;
    over ``most_days`` none. A station whose ``state`` (of ``state``) is high or
    low has that and no days; without states, one whose value is beyond a mark."""
    days = F.floor(F.when(rate > 0, (high - value) / rate).when(rate < 0, (value - low) / F.abs(rate)) + 0.5).cast("long")
    is_high, is_low = (value > high, value < low) if state is None else (state == "high", state == "low")
    target = F.when(is_high, "HIGH").when(is_low, "LOW").when((rate > 0) & (days <= most_days), "MHW").when((rate < 0) & (days <= most_days), "MNW")
    return [target.alias("eta_target"), F.when(target.isin("MHW", "MNW"), days).alias("eta_days")]


def _whole(x: Column, unit: str) -> Column:
    return F.format_string(f"%.0f{unit}", F.floor(x + 0.5).cast("double"))


def _tenths(x: Column, unit: str) -> Column:
    return F.format_string(f"%.1f{unit}", F.floor(x * 10 + 0.5) / 10)


def magnitude(cm: Column) -> Column:
    """A sum in cm as text: metres below a kilometre, else kilometres."""
    return F.when(F.abs(cm) < 100_000, _whole(cm / 100, "m")).otherwise(_tenths(cm / 100_000, "km"))


def signed_magnitude(cm: Column) -> Column:
    """A difference in cm as text with its sign."""
    size = F.abs(cm)
    body = F.when(size < 100, _whole(size, "cm")).when(size < 10_000, _tenths(size / 100, "m")).when(size < 100_000, _whole(size / 100, "m")).otherwise(_tenths(size / 100_000, "km"))
    return F.concat(F.when(cm < 0, "-").otherwise("+"), body)


def fold_name(name: Column, umlaut_as_pair: bool = True) -> Column:
    """Upper-cased without umlauts: as vowel and E, or as the bare vowel."""
    out = F.regexp_replace(name, "ß", "SS")
    for small, plain in (("ä", "A"), ("ö", "O"), ("ü", "U")):
        out = F.regexp_replace(out, f"[{small}{small.upper()}]", plain + ("E" if umlaut_as_pair else ""))
    return F.upper(out)
