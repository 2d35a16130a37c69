"""Validation and canonical form of raw GPS records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.scalar import first_error, instant, local_minute, not_finite, once, second_part, trimmed
from roadpulse.schemas import NOT_NEGATIVE, OPTIONAL_NUMBERS, REQUIRED_NUMBERS


def _time_error() -> Column:
    """Of time and t_timestamp, parsed as _base, _parts, _minute and _seconds."""
    base, minute, seconds = F.col("_base"), F.col("_minute"), F.col("_seconds")
    quoted = F.concat(F.lit('t_timestamp "'), F.col("t_timestamp"), F.lit('"'))
    return first_error(
        (base.isNull(), F.concat(F.lit('time "'), F.col("time"), F.lit('" is invalid'))),
        (F.size("_parts") != 2, F.concat(quoted, F.lit(" must use MM:SS.s format"))),
        (minute.isNull() | (minute < 0) | (minute >= 60), F.concat(quoted, F.lit(" contains an invalid minute"))),
        (minute != F.minute(base), F.concat(F.lit("t_timestamp minute "), minute.cast("string"), F.lit(" does not match time minute "), F.minute(base).cast("string"))),
        (seconds.isNull() | (seconds < 0) | (seconds >= 60), F.concat(quoted, F.lit(" contains invalid seconds"))),
    )


def canonicalize(df: DataFrame) -> DataFrame:
    """All rows of raw GPS records in canonical form, with ``error``: the first rule that a record breaks, or null.

    Texts are trimmed, status is upper case, vehicle_type lower case, a blank side is null, and
    recorded_at is the instant of time and t_timestamp (null if they are invalid).  Projections in steps, so that no
    expression is repeated: they neither shuffle nor run code outside the JVM.
    """
    texts = ["driver_id", "t_timestamp", "time", "status", "vehicle_type"]
    others = [c for c in df.columns if c not in (*texts, "side", "recorded_at", "error")]
    rows = df.select(*others, *(trimmed(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in texts), trimmed(F.col("side")).alias("side"))
    rows = rows.withColumns({"status": F.upper("status"), "vehicle_type": F.lower("vehicle_type"), "side": F.when(F.col("side") != "", F.col("side")), "_base": local_minute(F.col("time")), "_parts": F.split("t_timestamp", ":")})
    first = F.get("_parts", F.lit(0))
    rows = rows.withColumns({"_minute": F.when(first.rlike(r"^[+-]?\d+$"), first.try_cast("int")), "_seconds": second_part(F.col("t_timestamp"))})
    checks = [(F.col(c) == "", f"{c} is required") for c in ("driver_id", "t_timestamp", "time")]
    checks += [(~F.col("status").isin("IN TRIP", "ONLINE", "OFFLINE"), 'status must be "IN TRIP", "ONLINE", or "OFFLINE"'), (~F.col("vehicle_type").isin("car", "bike"), 'vehicle_type must be "car" or "bike"')]
    for c in REQUIRED_NUMBERS:
        checks += [(F.col(c).isNull(), f"{c} is required"), (not_finite(F.col(c)), f"{c} must be a finite number")]
    checks += [(~F.col("lat").between(-90, 90), "lat must be from -90 to 90"), (~F.col("lng").between(-180, 180), "lng must be from -180 to 180")]
    checks.append(((F.col("bearing") != -1) & ((F.col("bearing") < 0) | (F.col("bearing") >= 360)), "bearing must be -1 or from 0 up to but not including 360"))
    checks += [(F.col(c) < 0, f"{c} must not be negative") for c in NOT_NEGATIVE]
    checks.append((F.col("timestamp") <= 0, "timestamp must be positive"))
    for c in OPTIONAL_NUMBERS:
        checks += [(not_finite(F.col(c)), f"{c} must be a finite number"), (F.col(c) < 0, f"{c} must not be negative")]
    error = once(F.coalesce(first_error(*checks), _time_error()))
    return rows.select(*others, *texts, "side", instant(F.col("_base"), F.col("_seconds")).alias("recorded_at"), error.alias("error"))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records without the error column, quarantined records)."""
    return df.where("error is null").drop("error"), df.where("error is not null")
