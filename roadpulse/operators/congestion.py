"""Road-segment windows and congestion states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.config import CongestionConfig
from roadpulse.functions.scalar import clamp, confidence, first_error, level, traffic_vehicle, window_start

KEYS = ["graph_version", "traversal_key", "vehicle_type"]


def segment_windows(df: DataFrame, config: CongestionConfig) -> DataFrame:
    """Median speed, samples and drivers of each road, vehicle and window of observations that count.

    The median is exact.  ``percentile`` keeps counts of distinct speeds, which it combines before the shuffle.
    """
    start = window_start(F.col("recorded_at"), config.window_seconds)
    keyed = df.select("graph_version", "traversal_key", traffic_vehicle(F.col("vehicle_type")).alias("vehicle_type"), start.alias("window_start"), "speed", "driver_id")
    return keyed.groupBy(*KEYS, "window_start").agg(F.percentile("speed", 0.5).alias("current_speed_mps"), F.count("*").alias("sample_count"), F.count_distinct("driver_id").alias("distinct_driver_count"))


def congestion_states(windows: DataFrame, reference: DataFrame, config: CongestionConfig, updated_at: Column | None = None) -> DataFrame:
    """Ratio to the reference speed, score, confidence and level of each window.

    UNKNOWN, with zeros, where evidence or a reference is missing.  The reference (a row for each road
    and vehicle) is not forced into a broadcast: it grows with the map, so its size decides.
    """
    joined = windows.join(reference, KEYS, "left")
    enough = (F.col("sample_count") >= config.min_samples) & (F.col("distinct_driver_count") >= config.min_drivers)
    known = enough & F.coalesce(F.col("reference_speed_mps") > 0, F.lit(False))
    ratio = clamp(F.col("current_speed_mps") / F.col("reference_speed_mps"))
    zero = F.lit(0.0)
    out = joined.select(
        *KEYS, "window_start", "current_speed_mps",
        F.when(known, F.col("reference_speed_mps")).otherwise(zero).alias("reference_speed_mps"),
        F.when(known, ratio).otherwise(zero).alias("speed_ratio"),
        F.when(known, 1 - ratio).otherwise(zero).alias("congestion_score"),
        F.col("sample_count").cast("long").alias("sample_count"), F.col("distinct_driver_count").cast("long").alias("distinct_driver_count"),
        F.when(known, confidence(F.col("sample_count"), F.col("distinct_driver_count"), config.min_samples, config.min_drivers)).otherwise(zero).alias("confidence"),
        F.when(known, level(ratio)).otherwise("UNKNOWN").alias("level"),
    )
    return out if updated_at is None else out.withColumn("updated_at", updated_at)


def closed(windows: DataFrame, now: Column, config: CongestionConfig) -> DataFrame:
    """Windows that have ended by ``now``."""
    return windows.where(F.unix_micros("window_start") + config.window_seconds * 1_000_000 <= F.unix_micros(now))


def state_json(states: DataFrame) -> DataFrame:
    """One JSON object for each state, names in snake case."""
    return states.select(F.to_json(F.struct(*states.columns)).alias("body"))


def request_error(df: DataFrame, keys: str = "traversal_keys", vehicle: str = "vehicle_type") -> DataFrame:
    """Requests for states (keys, min_lng, min_lat, max_lng, max_lat, vehicle) with ``error``: the first rule broken, or null."""
    error = first_error(
        (F.coalesce(F.size(keys), F.lit(0)) <= 0, "traversal_keys are required"),
        (F.exists(keys, lambda k: k < 0), "traversal_keys must be non-negative"),
        ((F.col("min_lng") >= F.col("max_lng")) | (F.col("min_lat") >= F.col("max_lat")), "bounds are invalid"),
        (~F.coalesce(F.col(vehicle).isin("car", "motorcycle"), F.lit(False)), "vehicle_type must be car or motorcycle"),
    )
    return df.withColumn("error", error)


def demo_aggregation(observations: DataFrame, reference_mps: float) -> DataFrame:
    """One row for observations (driver_id, speed_mps, eligible): drivers, the median speed of those that count (0 for none),
    its ratio to the reference and the score."""
    out = observations.agg(
        F.count_distinct(F.when(F.col("eligible"), F.col("driver_id"))).alias("eligible_driver_count"), F.count_distinct("driver_id").alias("total_driver_count"),
        F.coalesce(F.percentile(F.when(F.col("eligible"), F.col("speed_mps")), 0.5), F.lit(0.0)).alias("current_speed_mps"),
    )
    ratio = F.col("current_speed_mps") / F.lit(float(reference_mps))
    return out.withColumns({"reference_speed_mps": F.lit(float(reference_mps)), "speed_ratio": ratio, "congestion_score": 1 - ratio, "level": level(ratio)})
