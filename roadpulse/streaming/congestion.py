"""The streaming forms: windows with a watermark, and traces with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadpulse.config import CongestionConfig, TraceConfig
from roadpulse.functions.scalar import traffic_vehicle
from roadpulse.operators.congestion import KEYS, congestion_states
from roadpulse.operators.observations import can_aggregate


def stream_windows(df: DataFrame, config: CongestionConfig, late: str = "1 minute") -> DataFrame:
    """Segment windows of a stream of observations; a window is emitted once, when the watermark passes its end."""
    d = f"{config.window_seconds} seconds"
    shift = f"{(-62135596800) % config.window_seconds} seconds"
    keyed = df.where(can_aggregate()).withColumn("vehicle_type", traffic_vehicle(F.col("vehicle_type"))).withWatermark("recorded_at", late)
    out = keyed.groupBy(*KEYS, F.window("recorded_at", d, d, shift).alias("w")).agg(F.percentile("speed", 0.5).alias("current_speed_mps"), F.count("*").alias("sample_count"), F.size(F.collect_set("driver_id")).alias("distinct_driver_count"))
    return out.select(*KEYS, F.col("w.start").alias("window_start"), "current_speed_mps", "sample_count", "distinct_driver_count")


def stream_states(df: DataFrame, reference: DataFrame, config: CongestionConfig, late: str = "1 minute") -> DataFrame:
    """Congestion states of a stream against a table of reference speeds."""
    return congestion_states(stream_windows(df, config, late), reference, config)


TRACE = "driver_id string, first_seq long, last_seq long, n_points int, started_at timestamp, ended_at timestamp"


def stream_traces(df: DataFrame, config: TraceConfig, idle_seconds: float = 120.0, late: str = "1 minute") -> DataFrame:
    """Traces of a stream (driver_id, arrival_seq, recorded_at) under the rule of ``buffered_traces``.

    A driver's state is what the buffer holds; it is dropped when the watermark is ``idle_seconds`` past its last point.
    """
    span, idle = int(config.max_seconds * 1_000_000), int(idle_seconds * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buf, out = list(zip(*state.get, strict=True)) if state.exists else [], []
        points = pd.concat(list(batches)).sort_values("arrival_seq")
        for seq, t in zip(points["arrival_seq"], points["t"], strict=True):
            if buf and t <= buf[-1][1]:
                continue
            buf.append((int(seq), int(t)))
            if len(buf) >= config.min_points and (len(buf) >= config.max_points or t - buf[0][1] >= span):
                out.append((key[0], buf[0][0], buf[-1][0], len(buf), buf[0][1], buf[-1][1]))
                buf = buf[len(buf) - min(config.overlap, len(buf)) :]
        state.update(([s for s, _ in buf], [t for _, t in buf]))
        last = buf[-1][1] // 1000 if buf else state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(last + idle, state.getCurrentWatermarkMs() + 1))
        if out:
            made = pd.DataFrame(out, columns=["driver_id", "first_seq", "last_seq", "n_points", "started_at", "ended_at"])
            for c in ("started_at", "ended_at"):
                made[c] = pd.to_datetime(made[c], unit="us")
            yield made

    keyed = df.withWatermark("recorded_at", late).select("driver_id", "arrival_seq", "recorded_at", F.unix_micros("recorded_at").alias("t"))
    return keyed.groupBy("driver_id").applyInPandasWithState(step, TRACE, "seqs array<long>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
