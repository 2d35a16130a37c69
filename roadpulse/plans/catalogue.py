"""Named queries of the core library and the SQL that states the same result.

Times come out as microseconds since 1970, so results do not depend on a session's time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.config import Bounds, CongestionConfig, MatchConfig, TraceConfig
from roadpulse.functions import scalar
from roadpulse.operators import canonical, congestion, edges, matching, pipeline, replay, traces
from roadpulse.operators import observations as obs
from roadpulse.plans import views
from roadpulse.sources.gps import csv_candidates, ingest, parse_bodies, replay_points

DAY = 86_400
WINDOW = CongestionConfig(DAY, 2, 2)
WEEK = CongestionConfig(7 * DAY, 1, 1)
#: Events of a driver lie hours apart, so traces span up to twelve.
TRACE = TraceConfig(5, 12 * 3600.0, 2, 2)
BOX = Bounds(*views.BOX)
FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def register(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return register


def micros(c: str) -> Column:
    return F.unix_micros(c).alias(f"{c}_us")


OBS, EDGES, SCRAMBLED, RAW = (f"WITH {x}" for x in (views.OBS_SQL, views.EDGES_SQL, views.SCRAMBLED_SQL, views.RAW_DUCK))

VALID = "status IN ('IN TRIP', 'ONLINE') AND speed >= 0 AND speed < 'inf'::DOUBLE AND vehicle_type IN ('car', 'bike') AND point_index >= 0"
COUNTS = f"({VALID} AND status = 'IN TRIP' AND matched AND traffic_eligible AND coalesce(traversal_key >= 0, FALSE))"
TRAFFIC = "CASE vehicle_type WHEN 'bike' THEN 'motorcycle' ELSE vehicle_type END"
GATED = """, gated AS (
  SELECT *, CASE WHEN b IS NULL OR recorded_at > b THEN 'accepted' WHEN recorded_at = b THEN 'equal' ELSE 'older' END AS gate
  FROM (SELECT *, max(recorded_at) OVER (PARTITION BY driver_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM obs))"""
#: The median of a sorted list s.
MEDIAN = "(s[(len(s) + 1) // 2] + s[len(s) // 2 + 1]) / 2"


def windows_sql(seconds: int) -> str:
    shift = (-62135596800) % seconds * 1_000_000
    d = seconds * 1_000_000
    return GATED + f""", grouped AS (
  SELECT graph_version, traversal_key, {TRAFFIC} AS vehicle_type, epoch_us(recorded_at) - (epoch_us(recorded_at) - {shift}) % {d} AS window_start_us,
    list_sort(list(speed)) AS s, count(*) AS sample_count, count(DISTINCT driver_id) AS distinct_driver_count
  FROM gated WHERE gate = 'accepted' AND {COUNTS} GROUP BY ALL), windows AS (SELECT * EXCLUDE (s), {MEDIAN} AS current_speed_mps FROM grouped)"""


REFERENCE_SQL = f""", reference AS (
  SELECT graph_version, traversal_key, {TRAFFIC} AS vehicle_type, arg_max(max_speed_mps, arrival_seq) AS reference_speed_mps
  FROM obs WHERE traversal_key >= 0 AND max_speed_mps IS NOT NULL GROUP BY ALL)"""

STATES_SQL = OBS + windows_sql(DAY) + REFERENCE_SQL + """, joined AS (
  SELECT w.*, r.reference_speed_mps AS ref, sample_count >= 2 AND distinct_driver_count >= 2 AND coalesce(r.reference_speed_mps > 0, FALSE) AS known,
    least(greatest(current_speed_mps / r.reference_speed_mps, 0), 1) AS ratio
  FROM windows w LEFT JOIN reference r USING (graph_version, traversal_key, vehicle_type)
), states AS (
  SELECT graph_version, traversal_key, vehicle_type, window_start_us, current_speed_mps, CASE WHEN known THEN ref ELSE 0 END AS reference_speed_mps,
    CASE WHEN known THEN ratio ELSE 0 END AS speed_ratio, CASE WHEN known THEN 1 - ratio ELSE 0 END AS congestion_score, sample_count, distinct_driver_count,
    CASE WHEN known THEN least(sample_count / CAST(4 AS DOUBLE), distinct_driver_count / CAST(4 AS DOUBLE), 1) ELSE 0 END AS confidence,
    CASE WHEN NOT known THEN 'UNKNOWN' WHEN ratio >= 0.8 THEN 'FREE' WHEN ratio >= 0.5 THEN 'SLOW' ELSE 'CONGESTED' END AS level
  FROM joined)"""  # fmt: skip


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs.driver_gate(views.observations(spark, sf_dir), ["arrival_seq"]).where("gate = 'accepted'")


def _windows(spark: SparkSession, sf_dir: str, config: CongestionConfig) -> DataFrame:
    return congestion.segment_windows(_accepted(spark, sf_dir).where(obs.can_aggregate()), config)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return congestion.congestion_states(_windows(spark, sf_dir, WINDOW), obs.reference_speeds(views.observations(spark, sf_dir)), WINDOW)


@query(STATES_SQL + " SELECT * FROM states")
def congestion_states(spark, sf_dir):
    out = _states(spark, sf_dir)
    return out.select(*(micros(c) if c == "window_start" else c for c in out.columns))


@query(STATES_SQL + " SELECT level, count(*) AS n FROM states GROUP BY level")
def level_distribution(spark, sf_dir):
    return _states(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query(STATES_SQL + " SELECT sample_count, distinct_driver_count, level = 'UNKNOWN' AS unknown, confidence, count(*) AS n FROM states GROUP BY ALL")
def confidence(spark, sf_dir):
    return _states(spark, sf_dir).groupBy("sample_count", "distinct_driver_count", (F.col("level") == "UNKNOWN").alias("unknown"), "confidence").agg(F.count("*").alias("n"))


@query(STATES_SQL + ", e AS (SELECT * FROM edges), last AS (SELECT traversal_key, arg_max({l: level, s: current_speed_mps}, window_start_us * 2 + CASE vehicle_type WHEN 'motorcycle' THEN 1 ELSE 0 END) AS x FROM states GROUP BY traversal_key) SELECT e.id, e.traversal_key, x.l AS level, x.s AS current_speed_mps FROM e LEFT JOIN last USING (traversal_key)".replace(", e AS", "," + views.EDGES_SQL + ", e AS"))
def state_edge_overlay(spark, sf_dir):
    return edges.overlay(views.edges(spark, sf_dir).select("id", "traversal_key"), _states(spark, sf_dir))


@query(STATES_SQL + " SELECT count(*) AS n FROM states WHERE window_start_us + 86400000000 <= 1735689600000000")
def closed_windows(spark, sf_dir):
    now = F.timestamp_micros(F.lit(1_735_689_600_000_000))
    return congestion.closed(_windows(spark, sf_dir, WINDOW), now, WINDOW).agg(F.count("*").alias("n"))


@query(OBS + windows_sql(7 * DAY) + " SELECT * FROM windows")
def segment_window_agg(spark, sf_dir):
    out = _windows(spark, sf_dir, WEEK)
    return out.select(*(micros(c) if c == "window_start" else c for c in out.columns))


@query(OBS + f", g AS (SELECT traversal_key, list_sort(list(speed) FILTER (WHERE {COUNTS})) AS s FROM obs GROUP BY traversal_key) SELECT traversal_key, coalesce({MEDIAN}, 0) AS median_speed FROM g")
def median_speed(spark, sf_dir):
    counted = F.when(obs.can_aggregate(), F.col("speed"))
    return views.observations(spark, sf_dir).groupBy("traversal_key").agg(F.coalesce(F.percentile(counted, 0.5), F.lit(0.0)).alias("median_speed"))


@query(OBS + REFERENCE_SQL + " SELECT * FROM reference")
def reference_last_write(spark, sf_dir):
    return obs.reference_speeds(views.observations(spark, sf_dir))


@query(OBS + f" SELECT arrival_seq, ({VALID}) AS is_valid FROM obs")
def obs_is_valid(spark, sf_dir):
    return views.observations(spark, sf_dir).select("arrival_seq", obs.is_valid().alias("is_valid"))


@query(OBS + f" SELECT arrival_seq, {COUNTS} AS can_aggregate FROM obs")
def obs_can_aggregate(spark, sf_dir):
    return views.observations(spark, sf_dir).select("arrival_seq", obs.can_aggregate().alias("can_aggregate"))


@query(OBS + f" SELECT {TRAFFIC} AS vehicle_type, count(*) AS n FROM obs GROUP BY ALL")
def vehicle_normalize(spark, sf_dir):
    return views.observations(spark, sf_dir).groupBy(scalar.traffic_vehicle(F.col("vehicle_type")).alias("vehicle_type")).agg(F.count("*").alias("n"))


@query(SCRAMBLED + """, b AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY arr, dup, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM scrambled)
SELECT event_id, dup, CASE WHEN b IS NULL OR ts > b THEN 'accepted' WHEN ts = b THEN 'equal' ELSE 'older' END AS gate FROM b""")  # fmt: skip
def driver_gate(spark, sf_dir):
    return obs.driver_gate(views.scrambled(spark, sf_dir), ["arr", "dup", "event_id"], "user_id", "ts").select("event_id", "dup", "gate")


@query(OBS + GATED + f"""SELECT driver_id, arg_max(status, recorded_at) AS last_status, epoch_us(max(recorded_at)) AS last_recorded_at_us,
arg_max(graph_version, recorded_at) FILTER (WHERE {COUNTS}) AS last_graph_version, arg_max(traversal_key, recorded_at) FILTER (WHERE {COUNTS}) AS last_traversal_key FROM gated WHERE gate = 'accepted' GROUP BY driver_id""")  # fmt: skip
def driver_last_state(spark, sf_dir):
    return obs.driver_last_state(_accepted(spark, sf_dir)).select("driver_id", "last_status", micros("last_recorded_at"), "last_graph_version", "last_traversal_key")


TRACE_SQL = """WITH RECURSIVE p AS (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events
), t AS (
  SELECT user_id, CAST(0 AS BIGINT) AS trace_no, CAST(1 AS BIGINT) AS s,
    (SELECT min(q.rn) FROM p q, p f WHERE q.user_id = u.user_id AND f.user_id = u.user_id AND f.rn = 1 AND q.rn >= 2 AND (q.rn >= 5 OR q.ts - f.ts >= INTERVAL 12 HOUR)) AS e
  FROM (SELECT DISTINCT user_id FROM p) u
  UNION ALL
  SELECT t.user_id, trace_no + 1, greatest(t.e - 1, t.s),
    (SELECT min(q.rn) FROM p q, p f WHERE q.user_id = t.user_id AND f.user_id = t.user_id AND f.rn = greatest(t.e - 1, t.s) AND q.rn > t.e
      AND (q.rn - greatest(t.e - 1, t.s) + 1 >= 5 OR q.ts - f.ts >= INTERVAL 12 HOUR))
  FROM t WHERE t.e IS NOT NULL
)
SELECT concat('driver-', CAST(t.user_id AS VARCHAR)) AS driver_id, CAST(trace_no AS INTEGER) AS trace_no, a.event_id AS first_seq, b.event_id AS last_seq, CAST(e - s + 1 AS INTEGER) AS n_points, epoch_us(a.ts) AS started_at_us, epoch_us(b.ts) AS ended_at_us
FROM t JOIN p a ON a.user_id = t.user_id AND a.rn = s JOIN p b ON b.user_id = t.user_id AND b.rn = e"""


@query(TRACE_SQL)
def trace_buffer(spark, sf_dir):
    out = traces.buffered_traces(views.observations(spark, sf_dir), TRACE)
    return out.select("driver_id", "trace_no", "first_seq", "last_seq", "n_points", micros("started_at"), micros("ended_at"))


SLIDING_SQL = OBS + """, early AS (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY arrival_seq) AS k FROM obs),
p AS (SELECT driver_id, arrival_seq, recorded_at, row_number() OVER (PARTITION BY driver_id ORDER BY recorded_at, arrival_seq) AS rn FROM early WHERE k <= 60),
t AS (SELECT a.driver_id, CAST((a.rn - 1) // 3 AS INTEGER) AS trace_no, a.arrival_seq AS first_seq, b.arrival_seq AS last_seq, a.rn FROM p a JOIN p b ON a.driver_id = b.driver_id AND b.rn = a.rn + 4 WHERE (a.rn - 1) % 3 = 0)"""  # fmt: skip


@query(SLIDING_SQL + " SELECT driver_id, trace_no, first_seq, last_seq FROM t ORDER BY driver_id, trace_no LIMIT 12")
def demo_sliding_traces(spark, sf_dir):
    return traces.sliding_traces(views.observations(spark, sf_dir)).select("driver_id", "trace_no", "first_seq", "last_seq")


@query(SLIDING_SQL + " SELECT driver_id, trace_no, first_seq, last_seq FROM t")
def sliding_traces_all(spark, sf_dir):
    return traces.sliding_traces(views.observations(spark, sf_dir), most=None).select("driver_id", "trace_no", "first_seq", "last_seq")


@query(SLIDING_SQL + """, m AS (SELECT t.driver_id, t.trace_no, o.traversal_key, """ + COUNTS.replace("matched", "o.matched") + """ AS counted FROM t JOIN p x ON x.driver_id = t.driver_id AND x.rn BETWEEN t.rn AND t.rn + 4 JOIN obs o ON o.arrival_seq = x.arrival_seq)
SELECT (SELECT count(*) FROM obs) AS scanned_rows, (SELECT count(*) FROM p) AS candidate_points, (SELECT count(*) FROM t) AS attempted_traces,
(SELECT count(*) FROM (SELECT driver_id, trace_no FROM m GROUP BY ALL HAVING bool_or(counted))) AS matched_traces, (SELECT count(*) FROM m WHERE counted AND traversal_key BETWEEN 10 AND 40) AS matched_observations""")  # fmt: skip
def demo_counters(spark, sf_dir):
    rows = views.observations(spark, sf_dir)
    cut = traces.sliding_traces(rows, most=None)
    points = cut.select("driver_id", "trace_no", F.explode("points.seq").alias("arrival_seq")).join(rows.select("arrival_seq", "traversal_key", obs.can_aggregate().alias("counted")), "arrival_seq")
    each = points.groupBy("driver_id", "trace_no").agg(F.bool_or("counted").alias("some"), F.count_if(F.col("counted") & F.col("traversal_key").between(10, 40)).alias("n"))
    taken = rows.groupBy("driver_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("scanned_rows"), F.sum(F.least("n", F.lit(60))).alias("candidate_points"))
    return taken.crossJoin(each.agg(F.count("*").alias("attempted_traces"), F.count_if("some").alias("matched_traces"), F.coalesce(F.sum("n"), F.lit(0)).alias("matched_observations")))


@query(OBS + " SELECT arrival_seq, driver_id, traversal_key FROM obs WHERE traversal_key IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def allow_set_semi(spark, sf_dir):
    allowed = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 10").select(F.col("p_partkey").alias("traversal_key"))
    return views.observations(spark, sf_dir).join(allowed, "traversal_key", "left_semi").select("arrival_seq", "driver_id", "traversal_key")


# The raw record's checks, in order.
_TIME_OK = "try_strptime(time, '%-m/%-d/%Y %-H:%M')"
_NUMBERS = ["lat", "lng", "bearing", "bearing_acc", "horizontal_acc", "speed", "speed_acc", "time_delta", "vertical_acc", "timestamp", "altitude"]
_CHECKS = [
    ("trim(driver_id) = ''", "'driver_id is required'"),
    ("upper(trim(status)) NOT IN ('IN TRIP', 'ONLINE', 'OFFLINE')", """'status must be "IN TRIP", "ONLINE", or "OFFLINE"'"""),
    ("lower(trim(vehicle_type)) NOT IN ('car', 'bike')", """'vehicle_type must be "car" or "bike"'"""),
    *((c, m) for n in _NUMBERS for c, m in ((f'"{n}" IS NULL', f"'{n} is required'"), (f'NOT isfinite(CAST("{n}" AS DOUBLE))', f"'{n} must be a finite number'"))),
    ("lat NOT BETWEEN -90 AND 90", "'lat must be from -90 to 90'"), ("lng NOT BETWEEN -180 AND 180", "'lng must be from -180 to 180'"),
    ("bearing <> -1 AND (bearing < 0 OR bearing >= 360)", "'bearing must be -1 or from 0 up to but not including 360'"),
    *((f"{n} < 0", f"'{n} must not be negative'") for n in ("bearing_acc", "horizontal_acc", "speed", "speed_acc", "time_delta", "vertical_acc")),
    ('"timestamp" <= 0', "'timestamp must be positive'"), *((f"{n} < 0", f"'{n} must not be negative'") for n in ("delta_time", "distance")),
    (f"{_TIME_OK} IS NULL", """concat('time "', time, '" is invalid')"""),
    ("len(string_split(t_timestamp, ':')) <> 2", """concat('t_timestamp "', t_timestamp, '" must use MM:SS.s format')"""),
    ("CAST(string_split(t_timestamp, ':')[1] AS INTEGER) >= 60", """concat('t_timestamp "', t_timestamp, '" contains an invalid minute')"""),
    ("CAST(string_split(t_timestamp, ':')[2] AS DOUBLE) >= 60", """concat('t_timestamp "', t_timestamp, '" contains invalid seconds')"""),
]
CHECKED = RAW + ", checked AS (SELECT *, CASE " + " ".join(f"WHEN {c} THEN {m}" for c, m in _CHECKS) + " END AS error FROM raw)"
PARSED = f"epoch_us({_TIME_OK} - INTERVAL 7 HOUR) + CAST(round(CAST(string_split(t_timestamp, ':')[2] AS DOUBLE) * 1000) AS BIGINT) * 1000"


@query(CHECKED + " SELECT event_id, error FROM checked WHERE error IS NOT NULL")
def canonicalize_errors(spark, sf_dir):
    return canonical.split_valid(canonical.canonicalize(views.raw(spark, sf_dir)))[1].select("event_id", "error")


@query(CHECKED + f" SELECT event_id, trim(driver_id) AS driver_id, upper(trim(status)) AS status, lower(trim(vehicle_type)) AS vehicle_type, nullif(trim(side), '') AS side, speed, delta_time, {PARSED} AS recorded_at_us FROM checked WHERE error IS NULL")
def canonicalize_valid(spark, sf_dir):
    good = canonical.split_valid(canonical.canonicalize(views.raw(spark, sf_dir)))[0]
    return good.select("event_id", "driver_id", "status", "vehicle_type", "side", "speed", "delta_time", micros("recorded_at"))


@query(RAW + f" SELECT event_id, {PARSED} AS recorded_at_us FROM raw WHERE {_TIME_OK} IS NOT NULL AND t_timestamp LIKE '%:%'")
def recorded_at_parse(spark, sf_dir):
    rows = views.raw(spark, sf_dir).withColumn("recorded_at", scalar.recorded_at(F.col("time"), F.col("t_timestamp")))
    return rows.where("recorded_at is not null").select("event_id", micros("recorded_at"))


@query(RAW + """, ok AS (SELECT *, row_number() OVER (PARTITION BY trim(driver_id) ORDER BY event_id) AS k FROM raw
WHERE lat BETWEEN 10 AND 11 AND lng BETWEEN 106 AND 107 AND lower(trim(vehicle_type)) = 'bike' AND speed IS NOT NULL AND NOT isnan(speed)) SELECT event_id, trim(driver_id) AS driver_id, speed FROM ok WHERE k <= 60""")  # fmt: skip
def demo_point_limit(spark, sf_dir):
    texts = views.raw(spark, sf_dir)
    texts = texts.select("event_id", *(F.col(c).cast("string").alias(c) for c in texts.columns if c != "event_id"))
    return csv_candidates(texts, Bounds(106, 10, 107, 11), "motorcycle", "event_id").select("event_id", "driver_id", "speed")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as features whose properties are raw JSON texts, some with a defect."""
    e, n = views.edges(spark, sf_dir), F.col("edge_id")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    props = {"graph_version": text(F.col("graph_version")), "edge_id": n.cast("string"), "traversal_key": (F.col("traversal_key") + F.when(n % 17 == 0, 1).otherwise(0)).cast("string"), "forward": F.col("forward").cast("string"), "osm_way_id": F.when(n % 19 == 0, "0").otherwise(F.col("osm_way_id").cast("string")), "distance_m": F.when(n % 23 == 0, '"12"').otherwise(F.col("distance_m").cast("string")), "road_class": text(F.when(n % 29 == 0, "path").otherwise(F.col("road_class"))), "car_access": F.col("car_access").cast("string"), "motorcycle_access": F.when(n % 31 == 0, "false").otherwise("true")}
    made = F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v)))
    made = F.when(n % 37 == 0, F.map_concat(made, F.create_map(F.lit("lanes"), F.lit("2")))).otherwise(made)
    return e.select("id", F.lit("Feature").alias("type"), F.lit("LineString").alias("geometry_type"), F.when(n % 41 == 0, F.slice("coordinates", 1, 1)).otherwise(F.col("coordinates")).alias("coordinates"), made.alias("properties"))


FEATURES_SQL = EDGES + """, checked AS (SELECT id, CASE WHEN edge_id % 37 = 0 THEN 'feature has unsupported property lanes' WHEN edge_id % 17 = 0 THEN 'traversal_key does not match edge_id and direction'
 WHEN edge_id % 19 = 0 THEN 'feature has invalid osm_way_id' WHEN edge_id % 23 = 0 THEN 'feature has invalid distance_m' WHEN edge_id % 29 = 0 THEN 'feature has unsupported road_class'
 WHEN edge_id % 31 = 0 AND NOT car_access THEN 'feature is inaccessible to both car and motorcycle' WHEN edge_id % 41 = 0 THEN 'geometry must contain at least two coordinates' END AS error FROM edges)"""  # fmt: skip


@query(FEATURES_SQL + " SELECT id, error FROM checked")
def edge_validate(spark, sf_dir):
    return edges.validate_features(_features(spark, sf_dir), "synthetic-v1").select("id", "error")


@query(FEATURES_SQL + " SELECT count(*) AS n_read, count(*) FILTER (WHERE error IS NULL) AS n_valid, count(error) AS n_invalid FROM checked")
def edge_import_stats(spark, sf_dir):
    return edges.import_stats(edges.validate_features(_features(spark, sf_dir), "synthetic-v1"))


@query(EDGES + ", w AS (SELECT concat('synthetic-v1_e', CAST(edge_id // 3 AS VARCHAR)) AS id, traversal_key AS line_no, distance_m, road_class FROM edges) SELECT id, arg_max(distance_m, line_no) AS distance_m, arg_max(road_class, line_no) AS road_class, 'unknown' AS traffic_status FROM w GROUP BY id")
def edge_upsert(spark, sf_dir):
    written = views.edges(spark, sf_dir).select(F.concat(F.lit("synthetic-v1_e"), F.floor(F.col("edge_id") / 3).cast("string")).alias("id"), F.col("traversal_key").alias("line_no"), "distance_m", "road_class")
    return edges.upsert(written, "line_no")


# A segment meets the box if an end lies in it or it crosses one of the box's diagonals (strictly enough for these data).
_X0, _Y0, _X1, _Y1 = views.BOX
_SIDE = lambda px, py: f"((bx - ax) * ({py} - ay) - (by_ - ay) * ({px} - ax))"
IN_BOX = f"""(greatest(ax, bx) >= {_X0} AND least(ax, bx) <= {_X1} AND greatest(ay, by_) >= {_Y0} AND least(ay, by_) <= {_Y1}
 AND NOT (least({_SIDE(_X0, _Y0)}, {_SIDE(_X0, _Y1)}, {_SIDE(_X1, _Y0)}, {_SIDE(_X1, _Y1)}) > 0 OR greatest({_SIDE(_X0, _Y0)}, {_SIDE(_X0, _Y1)}, {_SIDE(_X1, _Y0)}, {_SIDE(_X1, _Y1)}) < 0))"""


@query(EDGES + f" SELECT id, edge_id FROM edges WHERE {IN_BOX}")
def edges_in_bbox(spark, sf_dir):
    return edges.in_box(views.edges(spark, sf_dir), BOX).select("id", "edge_id")


@query(EDGES + f", b AS (SELECT id, edge_id FROM edges WHERE {IN_BOX} ORDER BY id LIMIT 101) SELECT id, edge_id, (SELECT count(*) FROM b) > 100 AS truncated FROM b ORDER BY id LIMIT 100")
def edges_read_bounds(spark, sf_dir):
    return edges.read_bounds(edges.in_box(views.edges(spark, sf_dir), BOX), 100, ["id"]).select("id", "edge_id", "truncated")


@query(EDGES + f""", r AS (SELECT *, (row_number() OVER (PARTITION BY collection_ord ORDER BY id) - 1) // 100 AS page FROM edges),
n AS (SELECT *, row_number() OVER (ORDER BY collection_ord, page, id) AS rn FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY rn) AS k FROM n),
p AS (SELECT collection_ord, page, sum(CASE WHEN k = 1 THEN distance_m ELSE 0 END) AS m FROM f GROUP BY ALL), c AS (SELECT *, sum(m) OVER (ORDER BY collection_ord, page) AS total FROM p),
stop AS (SELECT min(collection_ord * 1000000 + page) AS s FROM c WHERE total >= {views.TARGET_M})
SELECT id, edge_id, s IS NOT NULL AS truncated FROM n, stop WHERE s IS NULL OR collection_ord * 1000000 + page <= s""")  # fmt: skip
def edges_distance_limit(spark, sf_dir):
    return edges.distance_limit(views.edges(spark, sf_dir), views.TARGET_M).select("id", "edge_id", "truncated")


@query(EDGES + f""", n AS (SELECT *, row_number() OVER (ORDER BY id) AS rn, row_number() OVER (PARTITION BY edge_id ORDER BY id) AS k FROM edges),
c AS (SELECT *, coalesce(sum(CASE WHEN k = 1 THEN distance_m ELSE 0 END) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT id, edge_id FROM c WHERE rn < coalesce((SELECT min(rn) FROM c WHERE k = 1 AND before >= {views.TARGET_M}), 1000000000)""")  # fmt: skip
def edges_select_distance(spark, sf_dir):
    return edges.select_distance(views.edges(spark, sf_dir), views.TARGET_M).select("id", "edge_id")


@query(EDGES + """ SELECT id, CASE WHEN f AND r THEN 'HAI CHIỀU' WHEN f THEN 'MỘT CHIỀU · forward' ELSE 'MỘT CHIỀU · reverse' END AS road_direction, c AS car_supported, m AS motorcycle_supported
FROM (SELECT id, bool_or(forward) OVER w AS f, bool_or(NOT forward) OVER w AS r, bool_or(car_access) OVER w AS c, bool_or(motorcycle_access) OVER w AS m FROM edges WINDOW w AS (PARTITION BY edge_id))""")  # fmt: skip
def edge_directions(spark, sf_dir):
    return edges.directions(views.edges(spark, sf_dir)).select("id", "road_direction", "car_supported", "motorcycle_supported")


@query(EDGES + ", e AS (SELECT edge_id, bool_or(forward) AND bool_or(NOT forward) AS twice FROM edges GROUP BY edge_id) SELECT count(*) FILTER (WHERE NOT twice) AS one_way, count(*) FILTER (WHERE twice) AS two_way FROM e")
def edge_oneway_counts(spark, sf_dir):
    return edges.oneway_counts(views.edges(spark, sf_dir))


@query("SELECT event_id, map_from_entries(list_zip(['kind', 'value', 'n'][1:m], [event_type, CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR)][1:m]))['kind'] AS kind, least(3, m) AS n_fields FROM (SELECT *, 1 + event_id % 3 AS m FROM events)")
def field_zip(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    values = F.slice(F.array("event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")), 1, 1 + F.col("event_id").cast("int") % 3)
    fields = edges.zip_fields(F.array(*map(F.lit, ("kind", "value", "n"))), values)
    return e.select("event_id", F.try_element_at(fields, F.lit("kind")).alias("kind"), F.size(fields).cast("long").alias("n_fields"))


def _matched_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with a matcher's answer in reverse order, some of them faulty."""
    rows = views.observations(spark, sf_dir)
    cut = traces.sliding_traces(rows, most=None, per_driver=None)
    points = cut.select(F.concat_ws("-", "driver_id", "trace_no").alias("trace_id"), "driver_id", F.col("first_seq").alias("k"), F.posexplode("points.seq").alias("i", "arrival_seq")).join(rows.drop("driver_id"), "arrival_seq")
    k, odd = F.col("k"), F.col("i") == 2
    answer = F.struct(
        F.when((k % 13 == 0) & odd, 9).when((k % 17 == 0) & odd, 1).otherwise(F.col("i")).cast("int").alias("point_index"), F.col("matched").alias("matched"),
        F.when((k % 19 == 0) & odd & F.col("matched"), None).otherwise(F.col("traffic_eligible")).alias("eligible_for_traffic"), F.col("traversal_key").alias("traversal_key"),
        F.when((k % 23 == 0) & odd & F.col("matched"), -1.0).when(F.col("max_speed_mps").isNotNull(), 50.0).alias("max_speed_kmh"),
    )
    point = F.struct("i", "driver_id", "recorded_at", "speed", "status", "vehicle_type", "lat", "lng")
    grouped = points.groupBy("trace_id", "driver_id").agg(F.sort_array(F.collect_list(point)).alias("points"), F.sort_array(F.collect_list(F.struct("i", answer.alias("a"))), False).alias("r"))
    return grouped.select("trace_id", "driver_id", "points", F.col("r.a").alias("matched_points"))


ADAPT_SQL = OBS + """, p AS (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY recorded_at, arrival_seq) AS rn FROM obs),
t AS (SELECT a.driver_id, (a.rn - 1) // 3 AS trace_no, a.arrival_seq AS k, a.rn FROM p a JOIN p b ON a.driver_id = b.driver_id AND b.rn = a.rn + 4 WHERE (a.rn - 1) % 3 = 0),
q AS (SELECT concat(t.driver_id, '-', CAST(trace_no AS VARCHAR)) AS trace_id, k, x.rn - t.rn AS i, x.* EXCLUDE (rn) FROM t JOIN p x ON x.driver_id = t.driver_id AND x.rn BETWEEN t.rn AND t.rn + 4),
e AS (SELECT trace_id, CASE WHEN max(k) % 13 = 0 THEN 'point_index is outside trace' WHEN max(k) % 17 = 0 THEN 'point_index appears more than once'
 WHEN max(k) % 19 = 0 AND bool_or(i = 2 AND matched) THEN 'matched point is missing eligible_for_traffic' WHEN max(k) % 23 = 0 AND bool_or(i = 2 AND matched) THEN 'matched point has invalid max_speed_kmh' END AS error FROM q GROUP BY trace_id)"""  # fmt: skip


@query(ADAPT_SQL + " SELECT trace_id, error FROM e")
def adapter_checks(spark, sf_dir):
    return matching.adapt(_matched_traces(spark, sf_dir), "synthetic-v1").select("trace_id", "error")


@query(ADAPT_SQL + " SELECT trace_id, CAST(i AS INTEGER) AS point_index, epoch_us(recorded_at) AS recorded_at_us, speed, matched, traffic_eligible, traversal_key, CASE WHEN max_speed_mps IS NOT NULL THEN 50 / CAST(3.6 AS DOUBLE) END AS max_speed_mps FROM q JOIN e USING (trace_id) WHERE error IS NULL")
def adapted_observations(spark, sf_dir):
    out = matching.observations(matching.adapt(_matched_traces(spark, sf_dir), "synthetic-v1"), "synthetic-v1")
    return out.select("trace_id", "point_index", micros("recorded_at"), "speed", "matched", "traffic_eligible", "traversal_key", "max_speed_mps")


_KX = "111320.0 * cos(radians(lat))"
MATCH_SQL = OBS + "," + views.EDGES_SQL + f""", o AS (SELECT arrival_seq AS id, lat, lng, vehicle_type FROM obs), c AS (
  SELECT o.id, e.traversal_key, (lng - e.sx) * ({_KX}) AS px, (lat - e.sy) * 111320.0 AS py, (e.tx - e.sx) * ({_KX}) AS qx, (e.ty - e.sy) * 111320.0 AS qy
  FROM o JOIN (SELECT *, CASE WHEN forward THEN ax ELSE bx END AS sx, CASE WHEN forward THEN ay ELSE by_ END AS sy, CASE WHEN forward THEN bx ELSE ax END AS tx, CASE WHEN forward THEN by_ ELSE ay END AS ty FROM edges) e
  ON CASE WHEN vehicle_type = 'car' THEN e.car_access ELSE e.motorcycle_access END AND abs(lat - (e.sy + e.ty) / 2) < abs(e.sy - e.ty) / 2 + 0.001 AND abs(lng - (e.sx + e.tx) / 2) < abs(e.sx - e.tx) / 2 + 0.001
), d AS (SELECT id, traversal_key, px, py, qx, qy, CASE WHEN qx * qx + qy * qy > 0 THEN least(greatest((px * qx + py * qy) / (qx * qx + qy * qy), 0), 1) ELSE 0 END AS t FROM c),
m AS (SELECT id, traversal_key, sqrt(pow(px - t * qx, 2) + pow(py - t * qy, 2)) AS dist FROM d)
SELECT id, arg_min(traversal_key, round(dist, 6) * 1000000000000 + traversal_key) AS traversal_key, round(min(dist), 3) AS snap_distance_m, TRUE AS traffic_eligible FROM m WHERE dist <= 25 GROUP BY id"""  # fmt: skip


@query(MATCH_SQL)
def nearest_edge_match(spark, sf_dir):
    points = views.observations(spark, sf_dir).select(F.col("arrival_seq").alias("id"), "lat", "lng", F.lit(-1.0).alias("bearing"), "vehicle_type")
    found = matching.NearestEdge(MatchConfig(gps_accuracy_m=25.0)).match(points, views.edges(spark, sf_dir))
    return found.select("id", "traversal_key", F.round("snap_distance_m", 3).alias("snap_distance_m"), "traffic_eligible")


@query(ADAPT_SQL + """, x AS (SELECT trace_id, driver_id, string_agg(concat('<trkpt lat="', CAST(lat AS VARCHAR), '" lon="', CAST(lng AS VARCHAR), '"><time>', strftime(recorded_at, '%Y-%m-%dT%H:%M:%S'), rtrim(rtrim(strftime(recorded_at, '.%f'), '0'), '.'), 'Z</time></trkpt>'), '' ORDER BY i) AS body FROM q GROUP BY ALL)
SELECT trace_id, concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="roadpulse"><trk><name>', driver_id, '</name><trkseg>', body, '</trkseg></trk></gpx>') AS gpx FROM x""")  # fmt: skip
def gpx_encode(spark, sf_dir):
    return replay.gpx(_matched_traces(spark, sf_dir)).select("trace_id", "gpx")


@query("""WITH f AS (SELECT user_id, min(event_id) AS s FROM events GROUP BY user_id), d AS (SELECT user_id, row_number() OVER (ORDER BY s) - 1 AS driver_idx FROM f), g AS (SELECT max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) + 60000 AS span FROM events),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence FROM events)
SELECT CAST(c AS INTEGER) AS cycle, CAST(sequence AS INTEGER) AS sequence, driver_idx, concat('vegeta-run-', CAST(c AS VARCHAR), '-driver-', CAST(user_id AS VARCHAR), '-', CAST(sequence AS VARCHAR)) AS event_id, epoch_us(ts) // 1000 + c * span AS recorded_at_ms
FROM q JOIN d USING (user_id), g, range(2) r(c)""")  # fmt: skip
def loadgen_interleave(spark, sf_dir):
    rows = views.observations(spark, sf_dir).select("driver_id", "arrival_seq", F.unix_millis("recorded_at").alias("recorded_at_ms"))
    return replay.interleave(rows, "arrival_seq", "run", cycles=2).select("cycle", "sequence", "driver_idx", "event_id", "recorded_at_ms")


@query("WITH f AS (SELECT user_id, min(event_id) AS s FROM events GROUP BY user_id), d AS (SELECT user_id, row_number() OVER (ORDER BY s) - 1 AS k FROM f) SELECT event_id AS arrival_seq, concat('driver-', CAST(user_id AS VARCHAR)) AS driver_id FROM events JOIN d USING (user_id) WHERE k % 4 = 1")
def driver_shard(spark, sf_dir):
    return replay.shard(views.observations(spark, sf_dir).select("driver_id", "arrival_seq"), 1, 4, "arrival_seq").select("arrival_seq", "driver_id")


@query(OBS + """, w AS (SELECT *, epoch_us(recorded_at) - lag(epoch_us(recorded_at)) OVER (PARTITION BY driver_id ORDER BY recorded_at) AS gap FROM obs)
SELECT arrival_seq, sum(CASE WHEN gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY driver_id ORDER BY recorded_at) AS run FROM w""")  # fmt: skip
def trace_gap_split(spark, sf_dir):
    return traces.gap_split(views.observations(spark, sf_dir), 12 * 3600.0, 1e9).select("arrival_seq", "run")


_SECONDS = "CAST(string_split(t_timestamp, ':')[2] AS DOUBLE)"
REPLAY_SQL = RAW + f""", seen AS (SELECT *, trim(driver_id) AS who, min(event_id) OVER (PARTITION BY trim(driver_id)) AS f, row_number() OVER (PARTITION BY trim(driver_id) ORDER BY event_id) AS k FROM raw),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY who = '', f) AS d FROM seen)
SELECT event_id, who AS driver_id, CASE WHEN who = '' THEN 'driver_id is empty' WHEN {_TIME_OK} IS NULL THEN concat('time "', time, '" is invalid')
  WHEN len(string_split(t_timestamp, ':')) <> 2 THEN concat('t_timestamp "', t_timestamp, '" must use MM:SS.s format') WHEN {_SECONDS} >= 60 THEN concat('t_timestamp "', t_timestamp, '" contains invalid seconds')
  WHEN isnan(speed) THEN 'speed: "NaN" must be finite' WHEN lng < -180 THEN 'lng must be from -180 to 180' WHEN lat > 90 THEN 'lat must be from -90 to 90' WHEN bearing >= 360 THEN 'bearing must be -1 or from 0 up to 360' END AS error,
  epoch_us({_TIME_OK} - INTERVAL 7 HOUR) // 1000 + CAST(round({_SECONDS} * 1000) AS BIGINT) AS recorded_at_ms, CASE WHEN isnan(speed) THEN NULL ELSE coalesce(speed, -1) END AS speed_mps
FROM ranked WHERE who = '' OR (d <= 100 AND k <= 50)"""


@query(REPLAY_SQL)
def replay_csv_points(spark, sf_dir):
    texts = views.raw(spark, sf_dir)
    texts = texts.select("event_id", *(F.col(c).cast("string").alias(c) for c in texts.columns if c != "event_id"))
    out = replay_points(texts, "event_id", 100, 50)
    return out.select("event_id", "driver_id", "error", "recorded_at_ms", F.when(~F.isnan("speed_mps"), F.col("speed_mps")).alias("speed_mps"))


_BODY = """CASE WHEN event_id % 107 = 0 THEN 'request body is empty' WHEN event_id % 109 = 0 THEN 'request body must be one JSON object' WHEN event_id % 113 = 0 THEN 'unknown field extra' ELSE error END"""


@query(CHECKED + f", b AS (SELECT event_id, {_BODY} AS error FROM checked) SELECT event_id, error FROM b WHERE error IS NOT NULL")
def json_ingest_errors(spark, sf_dir):
    return ingest(_bodies(spark, sf_dir))[1].select("event_id", "error")


@query(CHECKED + f", b AS (SELECT *, {_BODY} AS e FROM checked) SELECT event_id, trim(driver_id) AS driver_id, lower(trim(vehicle_type)) AS vehicle_type, speed, distance, {PARSED} AS recorded_at_us FROM b WHERE e IS NULL")
def json_ingest(spark, sf_dir):
    return ingest(_bodies(spark, sf_dir))[0].select("event_id", "driver_id", "vehicle_type", "speed", "distance", micros("recorded_at"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed JSON bodies of the raw records, some blank, with text after the object or with another field."""
    rows, n = views.raw(spark, sf_dir), F.col("event_id")
    names = [c for c in rows.columns if c != "event_id"]
    body = F.to_json(F.struct(*names))
    body = F.when(n % 107 == 0, " ").when(n % 109 == 0, F.concat(body, F.lit(" {}"))).when(n % 113 == 0, F.concat(F.lit('{"extra":1,'), F.substr(body, F.lit(2)))).otherwise(body)
    return parse_bodies(rows.select("event_id", body.alias("body"))).drop("body")


_ROUTED = """, r AS (SELECT trace_id, CASE WHEN max(k) % 29 = 0 THEN 'spaceship' WHEN max(k) % 31 = 0 THEN 'mixed' ELSE max(vehicle_type) END AS v, max(vehicle_type) AS w FROM q GROUP BY trace_id)
SELECT trace_id, CASE v WHEN 'car' THEN 'car' WHEN 'bike' THEN 'motorcycle' END AS profile, CASE v WHEN 'spaceship' THEN 'unsupported vehicle type "spaceship"' WHEN 'mixed' THEN concat('trace point 3 changes vehicle type from "', w, '" to "', CASE w WHEN 'car' THEN 'bike' ELSE 'car' END, '"') END AS route_error FROM r"""


@query(ADAPT_SQL + _ROUTED)
def vehicle_route(spark, sf_dir):
    rows = views.observations(spark, sf_dir)
    cut = traces.sliding_traces(rows, most=None, per_driver=None).select(F.concat_ws("-", "driver_id", "trace_no").alias("trace_id"), F.col("first_seq").alias("k"), F.posexplode("points.seq").alias("i", "arrival_seq"))
    points = cut.join(rows.select("arrival_seq", "vehicle_type"), "arrival_seq")
    other = F.when(F.col("vehicle_type") == "car", "bike").otherwise("car")
    kind = F.when(F.col("k") % 29 == 0, "spaceship").when((F.col("k") % 31 == 0) & (F.col("i") == 3), other).otherwise(F.col("vehicle_type"))
    listed = points.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("i", kind.alias("vehicle_type")))).alias("points"))
    return matching.route(listed).select("trace_id", "profile", "route_error")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'traversal_keys are required' WHEN event_id % 11 = 0 THEN 'traversal_keys must be non-negative' WHEN event_id % 13 = 0 THEN 'bounds are invalid'
  WHEN event_type NOT IN ('click', 'view') THEN 'vehicle_type must be car or motorcycle' END AS error FROM events""")  # fmt: skip
def congestion_request_checks(spark, sf_dir):
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    keys = F.when(n % 7 == 0, F.array().cast("array<long>")).otherwise(F.array(n, F.when(n % 11 == 0, -1).otherwise(n + 1)))
    kind = F.when(F.col("event_type") == "click", "car").when(F.col("event_type") == "view", "motorcycle").otherwise(F.col("event_type"))
    requests = e.select("event_id", keys.alias("traversal_keys"), kind.alias("vehicle_type"), F.lit(106.0).alias("min_lng"), F.lit(10.0).alias("min_lat"), F.when(n % 13 == 0, 106.0).otherwise(107.0).alias("max_lng"), F.lit(11.0).alias("max_lat"))
    return congestion.request_error(requests).select("event_id", "error")


#: Driver, speed and whether the observation counts.
DEMO = [("1", 0.0, True), ("1", 2.2753384, False), ("1", 0.06876571, False)]


@query("SELECT CAST(1 AS BIGINT) AS eligible_driver_count, CAST(1 AS BIGINT) AS total_driver_count, CAST(0 AS DOUBLE) AS current_speed_mps, CAST(10 AS DOUBLE) AS reference_speed_mps, CAST(0 AS DOUBLE) AS speed_ratio, CAST(1 AS DOUBLE) AS congestion_score, 'CONGESTED' AS level")
def demo_flow(spark, sf_dir):
    return congestion.demo_aggregation(spark.createDataFrame(DEMO, "driver_id string, speed_mps double, eligible boolean"), 10.0)


@query(STATES_SQL + " SELECT CAST(traversal_key AS VARCHAR) AS traversal_key, vehicle_type, level, CAST(sample_count AS VARCHAR) AS sample_count, strftime(make_timestamp(window_start_us), '%Y-%m-%dT%H:%M:%S.000Z') AS window_start, 'synthetic-v1' AS graph_version FROM states")
def state_bodies(spark, sf_dir):
    bodies = congestion.state_json(_states(spark, sf_dir))
    return bodies.select(*(F.get_json_object("body", f"$.{c}").alias(c) for c in ("traversal_key", "vehicle_type", "level", "sample_count", "window_start", "graph_version")))


#: Raw records of one vehicle for each driver; what the matcher answers is taken from the observations' view.
_RECURSIVE = views.RAW_DUCK.replace("raw AS (", "raw0 AS (", 1) + """, raw AS (SELECT * REPLACE (CASE WHEN CAST(regexp_extract(driver_id, '[0-9]+') AS BIGINT) % 2 = 0 THEN 'Bike ' ELSE 'car' END AS vehicle_type) FROM raw0 WHERE driver_id <> '  ')"""
PIPELINE_SQL = "WITH RECURSIVE " + views.OBS_SQL.replace("obs AS (", "seen AS (") + "," + _RECURSIVE + ", checked AS (SELECT *, CASE " + " ".join(f"WHEN {c} THEN {m}" for c, m in _CHECKS) + f""" END AS error FROM raw),
valid AS (SELECT event_id, trim(driver_id) AS driver_id, upper(trim(status)) AS status, lower(trim(vehicle_type)) AS vehicle_type, speed, {PARSED} AS us FROM checked WHERE error IS NULL),
later AS (SELECT *, max(us) OVER (PARTITION BY driver_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM valid),
p AS (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY event_id) AS rn FROM later WHERE b IS NULL OR us > b),
t AS (
  SELECT driver_id, 0 AS trace_no, CAST(1 AS BIGINT) AS s, (SELECT min(q.rn) FROM p q, p f WHERE q.driver_id = u.driver_id AND f.driver_id = u.driver_id AND f.rn = 1 AND q.rn >= 2 AND (q.rn >= 5 OR q.us - f.us >= 43200000000)) AS e FROM (SELECT DISTINCT driver_id FROM p) u
  UNION ALL
  SELECT t.driver_id, trace_no + 1, greatest(t.e - 1, t.s), (SELECT min(q.rn) FROM p q, p f WHERE q.driver_id = t.driver_id AND f.driver_id = t.driver_id AND f.rn = greatest(t.e - 1, t.s) AND q.rn > t.e AND (q.rn - greatest(t.e - 1, t.s) + 1 >= 5 OR q.us - f.us >= 43200000000))
  FROM t WHERE t.e IS NOT NULL
), obs AS (
  SELECT 'synthetic-v1' AS graph_version, p.driver_id, trace_no * 100 + p.rn - t.s AS arrival_seq, make_timestamp(p.us) AS recorded_at, p.speed, p.status, p.vehicle_type, p.rn - t.s AS point_index,
    seen.matched, seen.traffic_eligible, seen.traversal_key, seen.max_speed_mps FROM t JOIN p ON p.driver_id = t.driver_id AND p.rn BETWEEN t.s AND t.e JOIN seen ON seen.arrival_seq = p.event_id
)""" + STATES_SQL.removeprefix(OBS)


@query(PIPELINE_SQL + " SELECT * FROM states")
def pipeline_states(spark, sf_dir):
    raw = views.raw(spark, sf_dir).where("driver_id <> '  '")
    number = F.regexp_extract("driver_id", "[0-9]+", 0).cast("long")
    raw = raw.withColumn("vehicle_type", F.when(number % 2 == 0, "Bike ").otherwise("car"))
    answers = views.observations(spark, sf_dir).where("matched").select(F.col("arrival_seq").alias("event_id"), "traffic_eligible", "traversal_key", "max_speed_mps")
    made = pipeline.process_events(raw, lambda points: points.select("event_id").join(answers, "event_id"), TRACE, WINDOW, "synthetic-v1", "event_id")
    return made.states.select(*(micros(c) if c == "window_start" else c for c in made.states.columns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
