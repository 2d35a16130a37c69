"""Golden cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from roadpulse.config import Bounds, CongestionConfig, MatchConfig, Settings, TraceConfig, distance_km, seconds
from roadpulse.functions import scalar
from roadpulse.operators import canonical, congestion, edges, matching, observations, replay, traces
from roadpulse.operators.matching import NearestEdge, VehicleRouter, route
from roadpulse.operators.pipeline import process_events
from roadpulse.operators.replay import interleave
from roadpulse.schemas import GPS_PAYLOAD
from roadpulse.sources.edges import parse_features
from roadpulse.sources.gps import csv_candidates, ingest, parse_bodies, read_bodies, read_csv, stream_bodies

UTC = dt.timezone.utc
BASE = {
    "driver_id": " driver-001 ", "t_timestamp": "00:04.4", "status": " in trip ", "vehicle_type": " Bike ", "time": "7/24/2026 5:00", "side": " left ", "lat": 10.7783785, "lng": 106.70171,
    "bearing": 90.0, "bearing_acc": 0.0, "horizontal_acc": 3.0, "speed": 9.0, "speed_acc": 1.5, "time_delta": 5.0, "vertical_acc": 1.0, "timestamp": 1784872804400.0, "altitude": 58.7, "delta_time": 5.004, "distance": 45.0,
}


def canon(spark, *changes):
    rows = [tuple(({**BASE, **c})[f.name] for f in GPS_PAYLOAD.fields) for c in changes]
    return canonical.canonicalize(spark.createDataFrame(rows, GPS_PAYLOAD)).collect()


def test_canonical_golden(spark):
    (r,) = canon(spark, {})
    assert (r.driver_id, r.status, r.vehicle_type, r.side, r.error) == ("driver-001", "IN TRIP", "bike", "left", None)
    assert r.recorded_at == dt.datetime(2026, 7, 23, 22, 0, 4, 400000)


CASES = [
    ({"driver_id": " "}, "driver_id is required"), ({"driver_id": None, "time": None}, "driver_id is required"), ({"t_timestamp": None}, "t_timestamp is required"), ({"time": " "}, "time is required"),
    ({"status": "parked"}, 'status must be "IN TRIP", "ONLINE", or "OFFLINE"'), ({"vehicle_type": "truck"}, 'vehicle_type must be "car" or "bike"'), ({"lat": None}, "lat is required"), ({"lng": float("nan")}, "lng must be a finite number"),
    ({"altitude": float("-inf")}, "altitude must be a finite number"), ({"lat": 90.1}, "lat must be from -90 to 90"), ({"lng": -180.1}, "lng must be from -180 to 180"), ({"bearing": 360.0}, "bearing must be -1 or from 0 up to but not including 360"), ({"bearing": -1.0}, None),
    ({"speed": -0.1}, "speed must not be negative"), ({"timestamp": 0.0}, "timestamp must be positive"), ({"distance": -1.0}, "distance must not be negative"), ({"delta_time": float("inf")}, "delta_time must be a finite number"), ({"distance": None, "side": " "}, None),
    ({"t_timestamp": "00:59.9996"}, None), ({"t_timestamp": "01:00.0"}, "t_timestamp minute 1 does not match time minute 0"), ({"t_timestamp": "60:00"}, 't_timestamp "60:00" contains an invalid minute'), ({"t_timestamp": "00:60"}, 't_timestamp "00:60" contains invalid seconds'),
    ({"t_timestamp": "00:1.5d"}, 't_timestamp "00:1.5d" contains invalid seconds'), ({"t_timestamp": "0004"}, 't_timestamp "0004" must use MM:SS.s format'), ({"time": "2/31/2026 5:00"}, 'time "2/31/2026 5:00" is invalid'), ({"time": "7/24/2026 24:00"}, 'time "7/24/2026 24:00" is invalid'),
]


def test_canonical_errors(spark):
    rows = canon(spark, *(c for c, _ in CASES))
    assert [r.error for r in rows] == [e for _, e in CASES]
    assert next(r for r in rows if r.t_timestamp == "00:59.9996").recorded_at == dt.datetime(2026, 7, 23, 22, 1)


def test_bodies(spark):
    bodies = ['{"driver_id": "a", "lat": 1.5}', '{"driver_id": "a"} x', "[]", '{"x": 1}', "", None, '{"driver_id": "' + "a" * (1 << 20) + '"}', '{"lat": "text"}']
    out = parse_bodies(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")).orderBy("i").collect()
    assert (out[0].driver_id, out[0].lat, out[0].decode_error) == ("a", 1.5, None)
    assert [r.decode_error for r in out[1:]] == ["request body must be one JSON object"] * 2 + ["unknown field x", "request body is empty", "request body is empty", "request body is too large", "request body must be one JSON object"]


def test_csv(spark, tmp_path):
    names = [f.name for f in GPS_PAYLOAD.fields]
    path = tmp_path / "gps.csv"
    rows = [{**BASE, "driver_id": "a", "speed": v} for v in (1.0, "x", "", 2.0, 3.0)] + [{**BASE, "lat": 50.0}]
    path.write_text(",".join(names) + "\n" + "".join(",".join(str(r[c]) for c in names) + "\n" for r in rows))
    df = read_csv(spark, str(path), ["lat", "lng"]).withColumn("seq", F.monotonically_increasing_id())
    got = csv_candidates(df, Bounds(106, 10, 107, 11), "motorcycle", "seq", per_driver=2).collect()
    assert [r.speed for r in got] == [1.0, 2.0] and got[0].distance is None
    with pytest.raises(ValueError, match="missing columns: zzz"):
        read_csv(spark, str(path), ["zzz"])


def test_config():
    for bad in (lambda: TraceConfig(max_points=0), lambda: TraceConfig(min_points=1), lambda: TraceConfig(overlap=10), lambda: CongestionConfig(0), lambda: CongestionConfig(10, 0), lambda: MatchConfig("a b"), lambda: Bounds(1, 1, 1, 2), lambda: Bounds.parse("1,2,3"), lambda: Bounds.parse("1,2,x,4"), lambda: distance_km("0.01"), lambda: distance_km(" 1"), lambda: distance_km("nan"), lambda: seconds("5")):
        with pytest.raises(ValueError):
            bad()
    assert Bounds.parse("1, 2,3,4") == Bounds(1, 2, 3, 4) and distance_km("1.5") == 1.5 and seconds("1m30s") == 90
    s = Settings.from_env({"TRACE_MAX_POINTS": "7", "TRAFFIC_WINDOW": "1m", "EDGE_COLLECTIONS": "a, b,"})
    assert (s.trace.max_points, s.congestion.window_seconds, s.collections) == (7, 60, ("a", "b"))


def test_window_start(spark):
    ts = dt.datetime(2024, 1, 3, 5, 6, 7, 890000)
    for d in (7, 10, 11, 3600, 7 * 86400):
        got = spark.createDataFrame([(ts,)], "t timestamp").select(F.unix_micros(scalar.window_start(F.col("t"), d))).first()[0]
        since = (ts - dt.datetime(1, 1, 1)) // dt.timedelta(seconds=d) * d
        assert got == int((dt.datetime(1, 1, 1) + dt.timedelta(seconds=since) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


CALC = [
    ([0.0], 1, 2, 2, 10.0, ("UNKNOWN", 0, 0, 0, 0)), ([0.0, 10.0], 2, 2, 2, None, ("UNKNOWN", 0, 0, 0, 0)), ([0.0, 0.0, 5.0, 10.0], 2, 4, 2, 10.0, ("CONGESTED", 10, 0.25, 0.75, 0.5)), ([15.0, 20.0], 1, 2, 1, 10.0, ("FREE", 10, 1, 0, 0.5)),
    ([8.0], 1, 1, 1, 10.0, ("FREE", 10, 0.8, None, 0.5)), ([7.99], 1, 1, 1, 10.0, ("SLOW", 10, None, None, 0.5)), ([5.0], 1, 1, 1, 10.0, ("SLOW", 10, 0.5, 0.5, 0.5)), ([4.99], 1, 1, 1, 10.0, ("CONGESTED", 10, None, None, 0.5)),
]


@pytest.mark.parametrize("speeds,drivers,min_samples,min_drivers,ref,want", CALC)
def test_calculator(spark, speeds, drivers, min_samples, min_drivers, ref, want):
    c = CongestionConfig(10, min_samples, min_drivers)
    rows = [("g", 1, "bike", dt.datetime(2026, 1, 1), v, f"d{k % drivers}") for k, v in enumerate(speeds)]
    w = congestion.segment_windows(spark.createDataFrame(rows, "graph_version string, traversal_key long, vehicle_type string, recorded_at timestamp, speed double, driver_id string"), c)
    r = spark.createDataFrame([("g", 1, "motorcycle", ref)], "graph_version string, traversal_key long, vehicle_type string, reference_speed_mps double")
    s = congestion.congestion_states(w, r, c).first()
    for got, x in zip((s.level, s.reference_speed_mps, s.speed_ratio, s.congestion_score, s.confidence), want):
        assert x is None or got == pytest.approx(x) if not isinstance(x, str) else got == x


def test_confidence(spark):
    rows = [(4, 2, 0.0), (5, 1, 0.0), (5, 2, 0.5), (10, 4, 1.0), (20, 2, 0.5)]
    out = spark.createDataFrame(rows, "n int, d int, want double").select("want", scalar.confidence(F.col("n"), F.col("d"), 5, 2).alias("got")).collect()
    assert all(r.want == r.got for r in out)


OBS = "graph_version string, driver_id string, point_index int, recorded_at timestamp, speed double, status string, vehicle_type string, matched boolean, traffic_eligible boolean, traversal_key long"


def test_observation_checks(spark):
    good = ("g", "d", 0, dt.datetime(2026, 1, 1), 0.0, "IN TRIP", "car", True, True, 0)
    change = lambda k, v: (*good[:k], v, *good[k + 1 :])
    rows = [good, change(0, " "), change(1, None), change(2, -1), change(3, None), change(4, -1.0), change(4, float("nan")), change(5, "OFFLINE"), change(6, "motorcycle"), change(5, "ONLINE"), change(7, False), change(8, False), change(9, -1), change(9, None)]
    out = spark.createDataFrame(rows, OBS).select(observations.is_valid().alias("v"), observations.can_aggregate().alias("a")).collect()
    assert [r.v for r in out] == [True] + [False] * 8 + [True] * 5
    assert [r.a for r in out] == [True] + [False] * 13


def buffer(points, c):
    """The rule, one point after the other."""
    buf, out = [], []
    for seq, t in points:
        if buf and t <= buf[-1][1]:
            continue
        buf.append((seq, t))
        if len(buf) >= c.min_points and (len(buf) >= c.max_points or t - buf[0][1] >= c.max_seconds):
            out.append([s for s, _ in buf])
            buf = buf[len(buf) - c.overlap :] if c.overlap else []
    return out


@pytest.mark.parametrize("c", [TraceConfig(), TraceConfig.service(), TraceConfig(3, 1e9, 2, 0), TraceConfig(4, 5.0, 2, 1)])
def test_buffered_traces(spark, c):
    import random

    r, rows = random.Random(3), []
    start = dt.datetime(2026, 7, 31, 4)
    for d in range(6):
        t = 0
        for k in range(40):
            t += r.choice([1, 1, 1, -1, 0, 7, 30])
            rows.append((f"d{d}", d * 100 + k, start + dt.timedelta(seconds=t), t))
    got = traces.buffered_traces(spark.createDataFrame(rows, "driver_id string, arrival_seq long, recorded_at timestamp, t int"), c).orderBy("driver_id", "trace_no").collect()
    want = [(f"d{d}", s) for d in range(6) for s in buffer([(q, t) for n, q, _, t in rows if n == f"d{d}"], c)]
    assert [(x.driver_id, [p.seq for p in x.points]) for x in got] == want


def test_matching(spark):
    box = MatchConfig(gps_accuracy_m=50.0)
    line = lambda *p: [[float(x), float(y)] for x, y in p]
    graph = spark.createDataFrame([(2, "primary", True, True, line((106.0, 10.0), (106.01, 10.0))), (3, "primary", True, True, line((106.01, 10.0), (106.0, 10.0))), (4, "service", False, True, line((106.0, 10.0002), (106.01, 10.0002)))], "traversal_key long, road_class string, car_access boolean, motorcycle_access boolean, coordinates array<array<double>>")
    points = spark.createDataFrame([(1, 10.00001, 106.005, -1.0, "car"), (2, 10.00001, 106.005, 270.0, "car"), (3, 10.00019, 106.005, -1.0, "bike"), (4, 10.00019, 106.005, 90.0, "car"), (5, 10.5, 106.0, -1.0, "car")], "id long, lat double, lng double, bearing double, vehicle_type string")
    got = {r.id: (r.traversal_key, r.traffic_eligible) for r in matching.NearestEdge(box).match(points, graph).collect()}
    assert got == {1: (2, True), 2: (3, True), 3: (4, False), 4: (2, True)}


def test_features(spark):
    good = '{"type":"Feature","id":"g_e1_f","geometry":{"type":"LineString","coordinates":[[106,10],[107,11]]},"properties":{"graph_version":"g","edge_id":1,"traversal_key":2,"forward":true,"osm_way_id":5,"distance_m":1.5,"road_class":"primary","car_access":true,"motorcycle_access":false}}'
    edit = lambda a, b: good.replace(a, b)
    cases = [
        (good, None), (edit('"Feature"', '"X"'), "object is not a GeoJSON Feature"), (edit('"edge_id":1', '"edge_id":"1"'), "feature has invalid edge_id"), (edit('"edge_id":1,', ""), "feature has no edge_id"), (edit('"edge_id":1', '"edge_id":1.5'), "feature has invalid edge_id"),
        (edit('"forward":true', '"forward":"true"'), "feature has invalid forward"), (edit('"graph_version":"g"', '"graph_version":"h"'), "graph_version does not match expected version"), (edit("g_e1_f", "g_e1_r"), "feature ID does not match graph version, edge ID, or direction"), (edit('"osm_way_id":5', '"lanes":5'), "feature has unsupported property lanes"),
        (edit('"primary"', '"path"'), "feature has unsupported road_class"), (edit('"car_access":true', '"car_access":false'), "feature is inaccessible to both car and motorcycle"), (edit(",[107,11]", ""), "geometry must contain at least two coordinates"), (edit("[107,11]", "[197,11]"), "geometry has invalid coordinate at index 1"), (edit("[107,11]", "[107]"), "geometry has invalid coordinate at index 1"),
    ]
    lines = spark.createDataFrame([*((i, s) for i, (s, _) in enumerate(cases)), (99, "  ")], "line_no int, value string")
    out = edges.validate_features(parse_features(lines), "g").orderBy("line_no").collect()
    assert [r.error for r in out] == [e for _, e in cases]
    assert (out[0].edge_id, out[0].forward, out[0].distance_m, out[0].name) == (1, True, 1.5, None)


def test_import(spark, tmp_path):
    line = lambda n, d: '{"type":"Feature","id":"g_e1_f","geometry":{"type":"LineString","coordinates":[[106,10],[107,11]]},"properties":{"graph_version":"g","edge_id":1,"traversal_key":2,"forward":true,"osm_way_id":5,"distance_m":%s,"road_class":"primary","car_access":true,"motorcycle_access":false}}' % d
    df = parse_features(spark.createDataFrame([(0, line(0, 1)), (1, line(1, 2))], "line_no int, value string"))
    assert edges.import_features(df, "g", str(tmp_path / "e")).first().n_valid == 2
    (row,) = spark.read.parquet(str(tmp_path / "e")).collect()
    assert (row.distance_m, row.traffic_status, row.max_lng) == (2.0, "unknown", 107.0)
    with pytest.raises(ValueError, match=r"feature 1 \(g_e1_f\): feature has invalid distance_m"):
        edges.import_features(parse_features(spark.createDataFrame([(0, line(0, 1)), (1, line(1, -2))], "line_no int, value string")), "g")


def test_crosses(spark):
    box = Bounds(0.0, 0.0, 10.0, 10.0)
    rows = [([[-1.0, 5.0], [11.0, 5.0]], True), ([[-1.0, -1.0], [-1.0, 11.0]], False), ([[5.0, 5.0], [6.0, 6.0]], True), ([[-5.0, 6.0], [6.0, 17.0]], False), ([[10.0, 10.0], [12.0, 12.0]], True), ([[3.0, 3.0], [3.0, 3.0]], True), ([[11.0, 3.0], [11.0, 3.0]], False), ([[-1.0, 9.0], [2.0, 12.0]], True)]
    out = spark.createDataFrame(rows, "c array<array<double>>, want boolean").select("want", edges.crosses("c", box).alias("got")).collect()
    assert all(r.want == r.got for r in out)


def test_gpx(spark):
    t = dt.datetime(2026, 1, 1, 0, 0, 4, 400000)
    df = spark.createDataFrame([("a<b", [(10.5, 106.25, t), (10.0, 106.0, dt.datetime(2026, 1, 1, 0, 0, 10))]), ("c", [(1.0, 2.0, t)]), ("d", [(1.0, 2.0, t), (1.0, 2.0, None)])], "driver_id string, points array<struct<lat:double,lng:double,recorded_at:timestamp>>")
    got = [r.gpx for r in replay.gpx(df).collect()]
    assert "<name>a&lt;b</name>" in got[0] and '<trkpt lat="10.5" lon="106.25"><time>2026-01-01T00:00:04.4Z</time></trkpt>' in got[0] and "<time>2026-01-01T00:00:10Z</time>" in got[0]
    assert got[1:] == [None, None]


def test_targets(spark):
    import base64
    import json

    rows = spark.createDataFrame([("a", 1, 1000), ("b", 2, 2000), ("a", 3, 3000)], "driver_id string, seq int, recorded_at_ms long")
    out = replay.targets(replay.interleave(rows, "seq", "r"), "http://x", ["event_id", "recorded_at_ms"]).orderBy("cycle", "sequence", "driver_idx").collect()
    bodies = [json.loads(base64.b64decode(json.loads(r.target)["body"])) for r in out]
    assert [b["event_id"] for b in bodies] == ["vegeta-r-0-a-0", "vegeta-r-0-b-0", "vegeta-r-0-a-1"]


def test_bodies_with_text_after_the_object(spark):
    good = '{"driver_id":"d","lat":1.5}'
    bodies = [good, good + " {}", good + "," + good, good + '],[{"lat":2}', good + '} {"lat":2}', "[" + good + "]", "", None, '{"driver_id":', '{"extra":1}', " " + good + "\n"]
    got = [r.decode_error for r in parse_bodies(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")).orderBy("i").collect()]
    one, empty = "request body must be one JSON object", "request body is empty"
    assert got == [None, one, one, one, one, one, empty, empty, one, "unknown field extra", None]


def test_bodies_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"driver_id":"d"}\n\n{"x":1}\n')
    good, bad = ingest(stream_bodies(spark, str(tmp_path / "in")))
    q = bad.select("error").writeStream.format("memory").queryName("rejected").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.error for r in spark.table("rejected").collect()) == ["request body is empty", "t_timestamp is required", "unknown field x"]
    assert good.isStreaming and read_bodies(spark, str(tmp_path / "in")).count() == 3


def test_all_shards_keep_the_span_of_all_drivers(spark):
    rows = [(d, k, 1000 * k + (50_000 if d == "b" else 0)) for d in "abc" for k in range(4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, driver_id string, k int, recorded_at_ms long")
    whole = {(r.event_id, r.recorded_at_ms) for r in interleave(df, "seq", "r", cycles=2).collect()}
    parts = [{(r.event_id, r.recorded_at_ms) for r in interleave(df, "seq", "r", cycles=2, shard_index=i, shard_count=2).collect()} for i in range(2)]
    assert parts[0] | parts[1] == whole and not parts[0] & parts[1] and all(parts)


def test_router_sends_each_vehicle_to_its_matcher(spark):
    class Fixed:
        def __init__(self, key):
            self.key = key

        def match(self, points, edges):
            return points.select("id", F.lit(self.key).alias("traversal_key"))

    points = spark.createDataFrame([(1, "car"), (2, "bike"), (3, "truck")], "id int, vehicle_type string")
    assert {r.id: r.traversal_key for r in VehicleRouter(Fixed(10), Fixed(20)).match(points, points).collect()} == {1: 10, 2: 20}
    traces = spark.createDataFrame([(1, []), (2, None), (3, [("bike",), (None,)])], "i int, points array<struct<vehicle_type:string>>")
    assert [r.route_error for r in route(traces).orderBy("i").collect()] == ["trace points are required"] * 2 + ['trace point 1 changes vehicle type from "bike" to ""']


def test_nearest_edge_equals_brute_force(spark):
    import math
    import random

    r = random.Random(3)
    lines = [[[106 + r.uniform(0, 0.02), 10 + r.uniform(0, 0.02)] for _ in range(r.randint(2, 3))] for _ in range(60)] + [[[106.01, 10.0], [106.01, 10.02]], [[106.0, 10.01], [106.02, 10.01]], [[106.005, 10.005]] * 2]
    edges = spark.createDataFrame([(k, "primary", k % 3 > 0, True, c) for k, c in enumerate(lines)], "traversal_key long, road_class string, car_access boolean, motorcycle_access boolean, coordinates array<array<double>>")
    points = [(i, 10 + r.uniform(-0.001, 0.021), 106 + r.uniform(-0.001, 0.021), -1.0, r.choice(["car", "bike"])) for i in range(600)]

    def distance(lat, lng, a, b):
        kx = 111_320.0 * math.cos(math.radians(lat))
        px, py, qx, qy = (lng - a[0]) * kx, (lat - a[1]) * 111_320.0, (b[0] - a[0]) * kx, (b[1] - a[1]) * 111_320.0
        n = qx * qx + qy * qy
        t = min(max((px * qx + py * qy) / n, 0), 1) if n else 0
        return math.hypot(px - t * qx, py - t * qy)

    want = {}
    for i, lat, lng, _, kind in points:
        found = [(round(min(distance(lat, lng, a, b) for a, b in zip(c, c[1:])), 6), k) for k, c in enumerate(lines) if kind == "bike" or k % 3]
        if min(found)[0] <= 25:
            want[i] = min(found)[1]
    df = spark.createDataFrame(points, "id int, lat double, lng double, bearing double, vehicle_type string")
    for cell in (None, 0.005):
        assert {x.id: x.traversal_key for x in NearestEdge(MatchConfig(gps_accuracy_m=25.0, cell_degrees=cell)).match(df, edges).collect()} == want
    assert len(want) > 50


def test_pipeline_keeps_what_it_refuses(spark):
    base = {"t_timestamp": "00:01.0", "lat": 10.0, "lng": 106.0, "bearing": -1.0, "status": "in trip", "time": "7/24/2026 5:00", "timestamp": 1.0, "altitude": 0.0}
    zero = dict.fromkeys(["bearing_acc", "horizontal_acc", "speed", "speed_acc", "time_delta", "vertical_acc"], 0.0)
    rows = [Row(seq=10 * d + k, driver_id=f"d{d}", vehicle_type="car" if d != 2 or k < 3 else "bike", side=None, delta_time=None, distance=None, **{**base, **zero, "t_timestamp": f"00:{k:02}.0", "speed": 5.0 + d}) for d in range(3) for k in range(5)]
    rows.append(Row(**{**rows[0].asDict(), "seq": 99, "lat": 95.0}))
    raw = spark.createDataFrame(rows, "seq long, driver_id string, vehicle_type string, side string, delta_time double, distance double, t_timestamp string, lat double, lng double, bearing double, status string, time string, timestamp double, altitude double, bearing_acc double, horizontal_acc double, speed double, speed_acc double, time_delta double, vertical_acc double")
    match = lambda p: p.select("seq", F.lit(True).alias("traffic_eligible"), F.lit(7).cast("long").alias("traversal_key"), F.lit(20.0).alias("max_speed_mps"))
    made = process_events(raw, match, TraceConfig(5, 30.0, 2, 2), CongestionConfig(10, 1, 1), "g", "seq")
    assert [r.error for r in made.rejected.collect()] == ["lat must be from -90 to 90"]
    assert [(r.driver_id, r.route_error) for r in made.refused.collect()] == [("d2", 'trace point 3 changes vehicle type from "car" to "bike"')]
    state = made.states.collect()
    assert [(s.traversal_key, s.vehicle_type, s.sample_count, s.distinct_driver_count, s.current_speed_mps, s.level) for s in state] == [(7, "car", 10, 2, 5.5, "CONGESTED")]


def test_nearest_edge_writes_no_row_for_a_cell(spark, monkeypatch):
    """Long edges that lie dense, and points that share their places: rows follow the input, not the cells or candidates."""
    import math
    import random

    r = random.Random(5)
    spot = lambda: [106 + r.uniform(0, 0.05), 10 + r.uniform(0, 0.05)]
    lines = [[spot(), spot()] for _ in range(400)]
    lines += [x[::-1] for x in lines[:100]] + lines[:100]  # the other way, and copies with greater keys
    edges = spark.createDataFrame([(k, "primary" if k % 2 else "service", k % 3 > 0, True, x) for k, x in enumerate(lines)], "traversal_key long, road_class string, car_access boolean, motorcycle_access boolean, coordinates array<array<double>>")
    places = [(*spot(), r.choice([-1.0, 0.0, 90.0, None]), r.choice(["car", "bike", None])) for _ in range(300)]
    points = [(f"p{i}", *places[i % 300]) for i in range(3000)] + [("none", None, 10.0, -1.0, "car"), ("nan", float("nan"), 10.0, -1.0, "car")]
    want = {}
    for i, (lng, lat, bearing, kind) in enumerate(places):
        kx, found = 111_320.0 * math.cos(math.radians(lat)), []
        for k, (a, b) in enumerate(lines):
            if kind == "car" and k % 3 == 0:
                continue
            px, py, qx, qy = (lng - a[0]) * kx, (lat - a[1]) * 111_320.0, (b[0] - a[0]) * kx, (b[1] - a[1]) * 111_320.0
            t = min(max((px * qx + py * qy) / (qx * qx + qy * qy), 0), 1)
            turn = (bearing or 0) >= 0 and bearing is not None and math.cos(math.radians(bearing) - math.atan2(qx, qy)) < 0
            found.append((round(math.hypot(px - t * qx, py - t * qy), 6), turn, k))
        if min(found)[0] <= 25:
            want |= {f"p{j}": (min(found)[2], min(found)[2] % 2 == 1) for j in range(i, 3000, 300)}
    df = spark.createDataFrame(points, "id string, lng double, lat double, bearing double, vehicle_type string")
    sc = spark.sparkContext

    def matched(group):
        sc.setJobGroup(group, group)
        try:
            return {x.id: (x.traversal_key, x.traffic_eligible) for x in NearestEdge(MatchConfig(gps_accuracy_m=25.0)).match(df, edges).collect()}
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    assert matched("rows of the matcher") == want and len(want) > 1000
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("rows of the matcher") for s in tracker.getJobInfo(j).stageIds}
    written = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s))
    assert 3000 <= written < 20_000
    # Tiles dealt out in shares, segments in several parts.
    monkeypatch.setattr(matching, "TILE_POINTS", 20)
    monkeypatch.setattr(matching, "TILE_SEGMENTS", 7)
    assert matched("shares") == want
