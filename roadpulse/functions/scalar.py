"""Column functions; all are built-in expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def number(c: Column) -> Column:
    """A decimal number as text, or null if it is blank or anything else."""
    t = trimmed(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def not_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def first_error(*checks: tuple[Column, Column | str]) -> Column:
    """The message of the first check that is true, or null."""
    return F.coalesce(*(F.when(bad, m if isinstance(m, Column) else F.lit(m)) for bad, m in checks))


def once(c: Column) -> Column:
    """``c`` itself, marked as not deterministic: the optimizer then neither repeats it in expressions that use it nor
    copies it into filters below.  For long expressions that would be evaluated many times."""
    return F.when(F.rand() + 1 > 0, c)


def local_minute(time: Column) -> Column:
    """``M/d/yyyy H:mm`` as written, or null."""
    return F.try_to_timestamp(time, F.lit("M/d/yyyy H:mm"))


def second_part(t_timestamp: Column) -> Column:
    """The seconds of ``MM:SS.s``, or null."""
    s = F.get(F.split(t_timestamp, ":"), F.lit(1))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def instant(base: Column, seconds: Column) -> Column:
    """A local minute at UTC+7 plus seconds, rounded to milliseconds; expects a session time zone of UTC."""
    return F.timestamp_micros(F.unix_micros(F.to_utc_timestamp(base, "+07:00")) + F.round(seconds * 1000).cast("long") * 1000)


def recorded_at(time: Column, t_timestamp: Column) -> Column:
    """``M/d/yyyy H:mm`` at UTC+7 plus the seconds of ``MM:SS.s``; null if either text is malformed."""
    return instant(local_minute(time), second_part(t_timestamp))


def traffic_vehicle(c: Column) -> Column:
    """The vehicle's name in traffic results: bikes are motorcycles."""
    return F.when(c == "bike", F.lit("motorcycle")).otherwise(c)


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window of ``ts``; windows are counted from the year 1, not from 1970."""
    shift = (-62135596800) % seconds
    s = F.unix_micros(ts)
    return F.timestamp_micros(s - F.pmod(s - F.lit(shift * 1_000_000), F.lit(seconds * 1_000_000)))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def level(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "FREE").when(ratio >= 0.5, "SLOW").otherwise("CONGESTED")


def confidence(samples: Column, drivers: Column, min_samples: int, min_drivers: int) -> Column:
    short = (samples < min_samples) | (drivers < min_drivers)
    return F.when(short, F.lit(0.0)).otherwise(F.least(samples / F.lit(2.0 * min_samples), drivers / F.lit(2.0 * min_drivers), F.lit(1.0)))


def has_access(c: Column) -> Column:
    """True for true, 1 and their texts, as map viewers send them."""
    return F.coalesce(c.cast("string").isin("true", "1"), F.lit(False))


def direction_label(forward: Column, reverse: Column) -> Column:
    """Fixed values."""
    return F.when(forward & reverse, "HAI CHIỀU").when(forward, "MỘT CHIỀU · forward").when(reverse, "MỘT CHIỀU · reverse").otherwise("KHÔNG HỖ TRỢ")


def all_of(*conditions: Column) -> Column:
    """Conjunction in which null counts as false."""
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))
