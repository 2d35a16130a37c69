"""Traces: a driver's points, cut by count or duration with an overlap, or by a sliding window."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.config import TraceConfig


def buffered_traces(df: DataFrame, config: TraceConfig, driver: str = "driver_id", time: str = "recorded_at", order: str = "arrival_seq") -> DataFrame:
    """Traces as a driver's buffer emits them: (driver, trace_no, first_seq, last_seq, n_points, started_at, ended_at, points).

    Points of a driver enter in ``order``; one that is not later than the last of the buffer is dropped.  When
    the buffer holds enough points, or spans enough time with ``min_points``, it is emitted and keeps its
    last ``overlap`` points.  What is left at the end is not emitted.

    The rule depends on where the last trace ended, so a driver's points pass in order: one shuffle by driver, a sort
    that spills, and a pass that holds one driver's buffer (``max_points`` at most, as a buffer of so many is emitted).
    """
    span, most, least, overlap = int(config.max_seconds * 1_000_000), config.max_points, config.min_points, config.overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buffer, n, kind = object(), [], 0, None
        for b in batches:
            kind, out = b.schema.field(0).type, []
            for who, seq, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if who != now:
                    now, buffer, n = who, [], 0
                if buffer and t <= buffer[-1][1]:
                    continue
                buffer.append((seq, t))
                if len(buffer) >= least and (len(buffer) >= most or t - buffer[0][1] >= span):
                    out.append((who, n, buffer))
                    buffer, n = buffer[len(buffer) - min(overlap, len(buffer)) :], n + 1
            who, number, points = zip(*out, strict=True) if out else ((), (), ())
            flat = [p for x in points for p in x]
            ends = pa.array([0, *accumulate(map(len, points))], pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.int64()), pa.array([t for _, t in flat], pa.int64())], ["seq", "t"])
            yield pa.RecordBatch.from_arrays([pa.array(who, kind), pa.array(number, pa.int32()), pa.ListArray.from_arrays(ends, pairs)], [driver, "trace_no", "points"])

    rows = df.select(F.col(driver), F.col(order).cast("long").alias("seq"), F.unix_micros(time).alias("t")).where("t is not null")
    rows = rows.repartition(driver).sortWithinPartitions(driver, "seq", "t")
    shape = f"`{driver}` {df.schema[driver].dataType.simpleString()}, trace_no int, points array<struct<seq:bigint,t:bigint>>"
    return _described(rows.mapInArrow(run, shape), driver)


def sliding_traces(df: DataFrame, size: int = 5, step: int = 3, most: int | None = 12, per_driver: int | None = 60, driver: str = "driver_id", time: str = "recorded_at", order: str = "arrival_seq") -> DataFrame:
    """Windows of ``size`` points every ``step`` points of a driver, in time order; only full ones.

    Of each driver the first ``per_driver`` points by arrival take part.  The first ``most`` traces by driver and
    position are kept (a report's limit); None keeps all.
    """
    if per_driver:
        df = df.withColumn("_n", F.row_number().over(W.partitionBy(driver).orderBy(order))).where(F.col("_n") <= per_driver).drop("_n")
    point = F.struct(F.unix_micros(time).alias("t"), F.col(order).alias("seq"))
    grouped = df.groupBy(driver).agg(F.sort_array(F.collect_list(point)).alias("all")).where(F.size("all") >= size)
    cut = F.transform(F.sequence(F.lit(1), F.size("all") - size + 1, F.lit(step)), lambda i: F.transform(F.slice("all", i, size), lambda p: F.struct(p["seq"].alias("seq"), p["t"].alias("t"))))
    out = _described(grouped.select(driver, F.posexplode(cut).alias("trace_no", "points")), driver)
    return out if most is None else out.orderBy(driver, "trace_no").limit(most)


def _described(df: DataFrame, driver: str) -> DataFrame:
    first, last = F.col("points")[0], F.element_at("points", -1)
    return df.select(driver, "trace_no", first["seq"].alias("first_seq"), last["seq"].alias("last_seq"), F.size("points").alias("n_points"), F.timestamp_micros(first["t"]).alias("started_at"), F.timestamp_micros(last["t"]).alias("ended_at"), "points")


def gap_split(df: DataFrame, max_gap_seconds: float = 20.0, max_speed_mps: float = 70.0, min_displacement_m: float = 0.0, driver: str = "driver_id", time: str = "recorded_at") -> DataFrame:
    """Adds ``run``: a new one begins where a driver pauses longer than ``max_gap_seconds`` or seems to move faster
    than ``max_speed_mps``; points that moved less than ``min_displacement_m`` from the one before are dropped."""
    w = W.partitionBy(driver).orderBy(time)
    lat, lng = F.lag("lat").over(w), F.lag("lng").over(w)
    dt = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6
    dx = (F.col("lng") - lng) * 111_320.0 * F.cos(F.radians("lat"))
    dy = (F.col("lat") - lat) * 111_320.0
    moved = df.withColumn("_dt", dt).withColumn("_d", F.sqrt(dx * dx + dy * dy))
    moved = moved.where(F.col("_d").isNull() | (F.col("_d") >= min_displacement_m))
    cut = F.when((F.col("_dt") > max_gap_seconds) | (F.col("_d") > max_speed_mps * F.col("_dt")), 1).otherwise(0)
    return moved.withColumn("run", F.sum(cut).over(w)).drop("_dt", "_d")
