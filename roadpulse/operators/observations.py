"""Checks of matched observations, the per-driver gate and reference speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.functions.scalar import all_of, not_finite, traffic_vehicle, trimmed


def is_valid() -> Column:
    """Graph and driver named, index and speed not negative, time set, IN TRIP or ONLINE, car or bike."""
    return all_of(
        trimmed(F.col("graph_version")) != "", trimmed(F.col("driver_id")) != "", F.col("point_index") >= 0, F.col("recorded_at").isNotNull(),
        ~not_finite(F.col("speed")), F.col("speed") >= 0, F.col("status").isin("IN TRIP", "ONLINE"), F.col("vehicle_type").isin("car", "bike"),
    )


def can_aggregate() -> Column:
    """A valid observation in trip on a road that counts; speed 0 and key 0 count too."""
    return all_of(is_valid(), F.col("status") == "IN TRIP", F.col("matched"), F.col("traffic_eligible"), F.col("traversal_key") >= 0)


def driver_gate(df: DataFrame, order: list[str], driver: str = "driver_id", time: str = "recorded_at") -> DataFrame:
    """Adds ``gate``: accepted, equal or older, against the latest time that the driver had before in ``order``.

    Later times are accepted; older and equal ones change nothing, so the latest time is a running
    maximum.  One shuffle by driver.
    """
    before = F.max(time).over(W.partitionBy(driver).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    t = F.col(time)
    return df.withColumn("gate", F.when(before.isNull() | (t > before), "accepted").when(t == before, "equal").otherwise("older"))


def driver_last_state(accepted: DataFrame, driver: str = "driver_id", time: str = "recorded_at") -> DataFrame:
    """Each driver's last status and time, and the last road of an observation that counted."""
    road = F.when(can_aggregate(), F.col(time))
    last = lambda c: F.max_by(F.when(can_aggregate(), F.col(c)), road)
    return accepted.groupBy(driver).agg(F.max_by("status", time).alias("last_status"), F.max(time).alias("last_recorded_at"), last("graph_version").alias("last_graph_version"), last("traversal_key").alias("last_traversal_key"))


def reference_speeds(df: DataFrame, arrival: str = "arrival_seq") -> DataFrame:
    """The last maximum speed by arrival for each road and vehicle; every observation that has one counts,
    whatever its status.  A map-side aggregation."""
    known = df.where("traversal_key >= 0 and max_speed_mps is not null")
    return known.groupBy("graph_version", "traversal_key", traffic_vehicle(F.col("vehicle_type")).alias("vehicle_type")).agg(F.max_by("max_speed_mps", arrival).alias("reference_speed_mps"))
