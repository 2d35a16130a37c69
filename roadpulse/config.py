"""Settings of the pipeline stages, checked when they are made."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field


def _positive(value: float, name: str) -> None:
    if not (math.isfinite(value) and value > 0):
        raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class TraceConfig:
    """When a driver's buffered points become a trace.  ``service`` and ``library`` are the two presets."""

    max_points: int = 10
    max_seconds: float = 30.0
    min_points: int = 2
    overlap: int = 2

    def __post_init__(self) -> None:
        if self.max_points <= 0 or self.min_points < 2 or self.min_points > self.max_points:
            raise ValueError("0 < 2 <= min_points <= max_points")
        _positive(self.max_seconds, "max_seconds")
        if not 0 <= self.overlap < self.max_points:
            raise ValueError("0 <= overlap < max_points")

    @classmethod
    def library(cls) -> TraceConfig:
        return cls()

    @classmethod
    def service(cls) -> TraceConfig:
        return cls(max_points=5)


@dataclass(frozen=True)
class CongestionConfig:
    """Window length and the evidence that a window needs."""

    window_seconds: int = 10
    min_samples: int = 1
    min_drivers: int = 1

    def __post_init__(self) -> None:
        _positive(self.window_seconds, "window_seconds")
        if self.min_samples <= 0 or self.min_drivers <= 0:
            raise ValueError("min_samples and min_drivers must be positive")


@dataclass(frozen=True)
class MatchConfig:
    """Radius and cell size of the nearest-edge matcher, in metres and degrees (None: twice the radius)."""

    graph_version: str = "synthetic-v1"
    gps_accuracy_m: float = 10.0
    cell_degrees: float | None = None

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", self.graph_version):
            raise ValueError("graph_version has other characters than letters, digits, '.', '_' and '-'")
        _positive(self.gps_accuracy_m, "gps_accuracy_m")
        if self.cell_degrees is not None:
            _positive(self.cell_degrees, "cell_degrees")


@dataclass(frozen=True)
class Bounds:
    """A box of longitudes and latitudes, both ends included."""

    min_lng: float
    min_lat: float
    max_lng: float
    max_lat: float

    def __post_init__(self) -> None:
        v = (self.min_lng, self.min_lat, self.max_lng, self.max_lat)
        if not all(map(math.isfinite, v)):
            raise ValueError("bounds must be finite")
        if not (-180 <= self.min_lng < self.max_lng <= 180 and -90 <= self.min_lat < self.max_lat <= 90):
            raise ValueError("bounds are out of range or not ordered")

    @classmethod
    def parse(cls, text: str) -> Bounds:
        """``minLon,minLat,maxLon,maxLat``."""
        parts = text.split(",")
        if len(parts) != 4:
            raise ValueError("bounds need four numbers")
        return cls(*(float(p.strip()) for p in parts))


def distance_km(text: str) -> float:
    """A distance limit as text: finite, from 0.1 to 1000, without white space around it."""
    if text != text.strip():
        raise ValueError("distance_km is not a number")
    value = float(text)
    if not (math.isfinite(value) and 0.1 <= value <= 1000):
        raise ValueError("distance_km must be from 0.1 to 1000")
    return value


@dataclass(frozen=True)
class Settings:
    """All stages' settings, from environment-like text values; unset or blank ones keep their defaults."""

    trace: TraceConfig = field(default_factory=TraceConfig.service)
    congestion: CongestionConfig = field(default_factory=CongestionConfig)
    match: MatchConfig = field(default_factory=MatchConfig)
    collections: tuple[str, ...] = ("edges",)

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> Settings:
        def get(name, kind, default):
            text = env.get(name, "").strip()
            return kind(text) if text else default

        t, c, m = TraceConfig.service(), CongestionConfig(), MatchConfig()
        return cls(
            TraceConfig(get("TRACE_MAX_POINTS", int, t.max_points), get("TRACE_MAX_DURATION", seconds, t.max_seconds), get("TRACE_MIN_POINTS", int, t.min_points), get("TRACE_OVERLAP_POINTS", int, t.overlap)),
            CongestionConfig(int(get("TRAFFIC_WINDOW", seconds, c.window_seconds)), get("TRAFFIC_MIN_SAMPLES", int, c.min_samples), get("TRAFFIC_MIN_DRIVERS", int, c.min_drivers)),
            MatchConfig(get("GRAPH_VERSION", str, m.graph_version), get("GPS_ACCURACY", float, m.gps_accuracy_m)),
            tuple(x.strip() for x in env.get("EDGE_COLLECTIONS", "edges").split(",") if x.strip()) or ("edges",),
        )


def seconds(text: str) -> float:
    """A duration such as ``1h30m``, ``500ms`` or ``10s``."""
    units = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "us": 1e-6, "ns": 1e-9}
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ms|us|ns|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"{text!r} is not a duration")
    return sum(float(a) * units[b] for a, b in parts)
