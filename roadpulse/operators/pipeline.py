"""The stages joined: observations to states, and raw GPS records to states."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.config import CongestionConfig, TraceConfig
from roadpulse.operators.canonical import canonicalize, split_valid
from roadpulse.operators.congestion import congestion_states, segment_windows
from roadpulse.operators.matching import route
from roadpulse.operators.observations import can_aggregate, driver_gate, reference_speeds
from roadpulse.operators.traces import buffered_traces


def process_observations(observations: DataFrame, config: CongestionConfig, order: list[str]) -> DataFrame:
    """Congestion states of matched observations that arrive in ``order``.

    Every observation's maximum speed is recorded first, then the driver's gate lets it pass or not, and what counts
    enters its window.  Two shuffles of observations: by driver for the gate, by road and window.
    """
    reference = reference_speeds(observations.withColumn("_at", F.struct(*order)), "_at")
    accepted = driver_gate(observations, order).where("gate = 'accepted'").where(can_aggregate())
    return congestion_states(segment_windows(accepted, config), reference, config)


@dataclass
class Processed:
    """What the pipeline made of raw records: all but ``states`` are there to be looked at or written elsewhere."""

    rejected: DataFrame
    traces: DataFrame
    refused: DataFrame
    observations: DataFrame
    states: DataFrame


def process_events(raw: DataFrame, match: Callable[[DataFrame], DataFrame], trace: TraceConfig, congestion: CongestionConfig, graph_version: str, order: str) -> Processed:
    """Raw GPS records to congestion states: canonical form, traces, routing by vehicle, matching, gate, windows.

    ``order`` is the records' arrival, a unique number.  ``match`` takes points (``order``, driver_id, lat, lng, bearing,
    vehicle_type) of routed traces and returns ``order``, traffic_eligible, traversal_key and max_speed_mps of those
    that it could match.  A trace that mixes vehicles is refused; a point that two traces share is observed twice,
    and the gate drops the second.  Observations arrive when their trace is emitted, in its order.
    """
    valid, rejected = split_valid(canonicalize(raw))
    cut = buffered_traces(valid, trace, order=order)
    listed = cut.select("driver_id", "trace_no", F.col("last_seq").alias("emitted_seq"), F.posexplode("points.seq").alias("point_index", order))
    points = listed.join(valid.drop("driver_id"), order)
    kinds = points.groupBy("driver_id", "trace_no").agg(F.sort_array(F.collect_list(F.struct("point_index", "vehicle_type"))).alias("points"))  # max_points at most
    routed = route(kinds)
    taken = points.join(routed.where("route_error is null").select("driver_id", "trace_no"), ["driver_id", "trace_no"])
    found = match(taken.select(order, "driver_id", "lat", "lng", "bearing", "vehicle_type").dropDuplicates([order]))
    seen = taken.join(found, order, "left")
    observations = seen.select(
        F.lit(graph_version).alias("graph_version"), "driver_id", "trace_no", "emitted_seq", "point_index", F.col(order).alias("arrival_seq"), "recorded_at", "speed", "status", "vehicle_type",
        F.col("traversal_key").isNotNull().alias("matched"), F.coalesce("traffic_eligible", F.lit(False)).alias("traffic_eligible"), "traversal_key", "max_speed_mps",
    )
    states = process_observations(observations, congestion, ["emitted_seq", "point_index"])
    return Processed(rejected, cut, routed.where("route_error is not null").select("driver_id", "trace_no", "route_error"), observations, states)
