"""Schemas of the records that come in from outside."""

from __future__ import annotations

from pyspark.sql import types as T

REQUIRED_NUMBERS = ["lat", "lng", "bearing", "bearing_acc", "horizontal_acc", "speed", "speed_acc", "time_delta", "vertical_acc", "timestamp", "altitude"]
NOT_NEGATIVE = ["bearing_acc", "horizontal_acc", "speed", "speed_acc", "time_delta", "vertical_acc"]
OPTIONAL_NUMBERS = ["delta_time", "distance"]
TEXTS = ["driver_id", "t_timestamp", "status", "vehicle_type", "time", "side"]

GPS_PAYLOAD = T.StructType([T.StructField(c, T.StringType()) for c in TEXTS] + [T.StructField(c, T.DoubleType()) for c in REQUIRED_NUMBERS + OPTIONAL_NUMBERS])

MATCH_RESPONSE = "array<struct<point_index:int,matched:boolean,eligible_for_traffic:boolean,traversal_key:bigint,max_speed_kmh:double>>"

#: Fixed values.
EDGE_PROPERTIES = ["graph_version", "edge_id", "traversal_key", "forward", "osm_way_id", "distance_m", "road_class", "car_access", "motorcycle_access", "name"]

#: Fixed values.
ROAD_CLASSES = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link"]
