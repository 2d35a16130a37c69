"""Inputs of the catalogue's queries: views of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Observations: one for each event.  Key and maximum speed come from the event's number k.
OBS_SQL = """
k AS (SELECT event_id, user_id, event_type, value, ts, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events),
obs AS (
  SELECT 'synthetic-v1' AS graph_version, concat('driver-', CAST(user_id AS VARCHAR)) AS driver_id, event_id AS arrival_seq, ts AS recorded_at, value / 10 AS speed,
    CASE WHEN event_type = 'error' THEN 'OFFLINE' WHEN event_type = 'signup' THEN 'ONLINE' ELSE 'IN TRIP' END AS status,
    CASE WHEN user_id % 2 = 0 THEN 'bike' ELSE 'car' END AS vehicle_type, 0 AS point_index,
    event_id % 10 <> 0 AS matched, (event_id % 10 <> 0 AND event_id % 7 <> 0) AS traffic_eligible,
    CASE WHEN event_id % 10 <> 0 THEN k END AS traversal_key,
    CASE WHEN event_id % 10 <> 0 AND k % 10 <> 9 THEN (30 + (k % 5) * 10) / CAST(3.6 AS DOUBLE) END AS max_speed_mps,
    20.97 + CAST(event_id % 500 AS DOUBLE) / 10000 AS lat, 105.92 + CAST(user_id % 500 AS DOUBLE) / 10000 AS lng
  FROM k
)"""

#: The directed road graph: even part keys are two-way.
EDGES_SQL = """
edges AS (
  SELECT concat('synthetic-v1_e', CAST(p_partkey AS VARCHAR), CASE WHEN d.fwd THEN '_f' ELSE '_r' END) AS id, p_partkey AS edge_id,
    p_partkey * 2 + CASE WHEN d.fwd THEN 0 ELSE 1 END AS traversal_key, d.fwd AS forward, p_partkey + 1 AS osm_way_id, p_retailprice AS distance_m,
    CASE p_size % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' ELSE 'tertiary' END AS road_class,
    p_size % 3 <> 0 AS car_access, TRUE AS motorcycle_access, p_name AS name, p_partkey % 2 AS collection_ord,
    105.92 + CAST(p_partkey % 97 AS DOUBLE) / 2000 AS ax, 20.97 + CAST(p_partkey % 89 AS DOUBLE) / 2000 AS ay,
    105.92 + CAST((p_partkey + p_size) % 97 AS DOUBLE) / 2000 AS bx, 20.97 + CAST((p_partkey * 3 + 1) % 89 AS DOUBLE) / 2000 AS by_
  FROM part CROSS JOIN (SELECT TRUE AS fwd UNION ALL SELECT FALSE AS fwd) d WHERE d.fwd OR p_partkey % 2 = 0
)"""

#: Late and repeated arrivals, for the driver gate.
SCRAMBLED_SQL = """
scrambled AS (
  SELECT event_id + CASE WHEN event_id % 5 = 0 THEN 700 ELSE 0 END AS arr, 0 AS dup, event_id, user_id, ts FROM events
  UNION ALL SELECT event_id + 300, 1, event_id, user_id, ts FROM events WHERE event_id % 11 = 0
)"""

#: Raw GPS records with a defect for some event numbers.  Whole seconds and milliseconds of ts at UTC+7.
RAW_SQL = """
raw AS (
  SELECT event_id, CASE WHEN event_id % 41 = 0 THEN '  ' ELSE concat(' driver-', CAST(user_id AS VARCHAR), ' ') END AS driver_id,
    CASE WHEN event_id % 43 = 0 THEN '99:00.0' WHEN event_id % 47 = 0 THEN '0930' WHEN event_id % 53 = 0 THEN concat(mm, ':61.5') ELSE concat(mm, ':', ss) END AS t_timestamp,
    CASE WHEN event_id % 59 = 0 THEN '2026-07-24' ELSE tm END AS time, CASE WHEN event_id % 61 = 0 THEN 'parked' WHEN event_id % 2 = 0 THEN ' in trip' ELSE 'Online' END AS status,
    CASE WHEN event_id % 67 = 0 THEN 'truck' WHEN event_id % 3 = 0 THEN 'Bike ' ELSE 'car' END AS vehicle_type, CASE WHEN event_id % 4 = 0 THEN ' left ' WHEN event_id % 4 = 1 THEN ' ' END AS side,
    CASE WHEN event_id % 71 = 0 THEN 91.0 ELSE 10.5 END + 0.0 AS lat, CASE WHEN event_id % 73 = 0 THEN -180.5 ELSE 106.5 END + 0.0 AS lng, CASE WHEN event_id % 79 = 0 THEN 360.0 ELSE -1.0 END AS bearing,
    0.0 AS bearing_acc, 3.0 AS horizontal_acc, CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 89 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 97 = 0 THEN -1.0 ELSE value / 10 END AS speed,
    1.5 AS speed_acc, 5.0 AS time_delta, 1.0 AS vertical_acc, CASE WHEN event_id % 101 = 0 THEN 0.0 ELSE 1784872804400.0 END AS "timestamp", 58.7 AS altitude,
    CASE WHEN event_id % 103 = 0 THEN -1.0 WHEN event_id % 2 = 0 THEN 5.0 END AS delta_time, CASE WHEN event_id % 5 = 0 THEN 45.0 END AS distance
  FROM local
)"""

_LOCAL_DUCK = """
local AS (SELECT event_id, user_id, value, strftime(ts + INTERVAL 7 HOUR, '%-m/%-d/%Y %-H:%M') AS tm, strftime(ts, '%M') AS mm, strftime(ts, '%S.%g') AS ss FROM events)"""
_LOCAL_SPARK = """
local AS (SELECT event_id, user_id, value, date_format(ts + INTERVAL 7 HOUR, 'M/d/yyyy H:mm') AS tm, date_format(ts, 'mm') AS mm, date_format(ts, 'ss.SSS') AS ss FROM events)"""

#: Queries' common box and distance limits.
BOX = (105.925, 20.975, 105.945, 20.99)
TARGET_M = 200_000.0


def _view(spark: SparkSession, sf_dir: str, tables: list[str], parts: list[str], name: str) -> DataFrame:
    frames = {}
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        frames[t] = df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df
    text = ", ".join(p.replace("VARCHAR", "STRING").replace('"timestamp"', "`timestamp`") for p in parts)
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **frames)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["events"], [OBS_SQL], "obs")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _view(spark, sf_dir, ["part"], [EDGES_SQL], "edges").withColumn("graph_version", F.lit("synthetic-v1"))
    line = F.array(F.array("ax", "ay"), F.array("bx", "by_"))
    return df.withColumn("coordinates", F.when(F.col("forward"), line).otherwise(F.reverse(line)))


def scrambled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["events"], [SCRAMBLED_SQL], "scrambled")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _view(spark, sf_dir, ["events"], [_LOCAL_SPARK, RAW_SQL], "raw")
    numbers = [c for c, kind in df.dtypes if kind.startswith("decimal")]
    return df.withColumns({c: F.col(c).cast("double") for c in numbers})


RAW_DUCK = _LOCAL_DUCK + "," + RAW_SQL
