"""Directed road edges: validation of features, bounding boxes, distance limits, directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.config import Bounds
from roadpulse.functions.ordering import running
from roadpulse.functions.scalar import direction_label, first_error, has_access
from roadpulse.schemas import EDGE_PROPERTIES, ROAD_CLASSES


def _property(name: str) -> Column:
    """The property's JSON text, null if it is absent; properties are a map of raw JSON texts."""
    return F.try_element_at("properties", F.lit(name))


def _text(name: str) -> Column:
    raw = _property(name)
    return F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))


def _number(name: str) -> Column:
    raw = _property(name)
    return F.when(raw.rlike(r"^-?\d"), raw.try_cast("double"))


def validate_features(df: DataFrame, graph_version: str) -> DataFrame:
    """Features (type, id, geometry_type, coordinates, properties) with typed columns and ``error``: the first rule broken, or null.

    ``properties`` is map<string,string> of raw JSON texts, so that "1" and 1 differ; ``coordinates`` is
    array<array<double>>.
    """
    edge, key, way, distance = (_number(c) for c in ("edge_id", "traversal_key", "osm_way_id", "distance_m"))
    graph, road, name = _text("graph_version"), _text("road_class"), _text("name")
    flag = lambda c: F.when(_property(c).isin("true", "false"), _property(c) == "true")
    forward, car, motorcycle = flag("forward"), flag("car_access"), flag("motorcycle_access")
    other = F.array_except(F.map_keys("properties"), F.array(*map(F.lit, EDGE_PROPERTIES)))
    no = lambda c: (_property(c).isNull(), f"feature has no {c}")
    whole = lambda c, v, least: [no(c), (v.isNull() | (v < least) | (v != F.floor(v)), f"feature has invalid {c}")]
    boolean = lambda c, v: [no(c), (v.isNull(), f"feature has invalid {c}")]
    wanted = F.concat(graph, F.lit("_e"), edge.cast("bigint").cast("string"), F.when(forward, "_f").otherwise("_r"))
    bad = lambda p: (F.size(p) < 2) | ~F.coalesce(p[0].between(-180, 180) & p[1].between(-90, 90), F.lit(False)) | F.isnan(p[0]) | F.isnan(p[1])
    at = F.array_position(F.transform("coordinates", lambda p: F.when(bad(p), 1).otherwise(0)), 1)
    error = first_error(
        (F.coalesce(F.col("type"), F.lit("")) != "Feature", "object is not a GeoJSON Feature"),
        (F.size(other) > 0, F.concat(F.lit("feature has unsupported property "), F.array_min(other))),
        (~F.coalesce(graph == graph_version, F.lit(False)), "graph_version does not match expected version"),
        *whole("edge_id", edge, 0), *whole("traversal_key", key, 0), *boolean("forward", forward),
        (~F.coalesce(F.col("id") == wanted, F.lit(False)), "feature ID does not match graph version, edge ID, or direction"),
        (key != edge * 2 + F.when(forward, 0).otherwise(1), "traversal_key does not match edge_id and direction"),
        (way.isNull() | (way < 1) | (way != F.floor(way)), "feature has invalid osm_way_id"),
        (~F.coalesce(distance > 0, F.lit(False)), "feature has invalid distance_m"),
        no("road_class"), (F.coalesce(road, F.lit("")) == "", "feature has invalid road_class"), (~road.isin(ROAD_CLASSES), "feature has unsupported road_class"),
        *boolean("car_access", car), *boolean("motorcycle_access", motorcycle), (~car & ~motorcycle, "feature is inaccessible to both car and motorcycle"),
        (_property("name").isNotNull() & (F.coalesce(name, F.lit("")) == ""), "feature has invalid name"),
        (F.coalesce(F.col("geometry_type"), F.lit("")) != "LineString", "geometry is not a LineString"),
        (F.coalesce(F.size("coordinates"), F.lit(0)) < 2, "geometry must contain at least two coordinates"),
        (at > 0, F.concat(F.lit("geometry has invalid coordinate at index "), (at - 1).cast("string"))),
    )
    typed = {"graph_version": graph, "edge_id": edge.cast("bigint"), "traversal_key": key.cast("bigint"), "forward": forward, "osm_way_id": way.cast("bigint"), "distance_m": distance, "road_class": road, "car_access": car, "motorcycle_access": motorcycle, "name": name}
    keep = [c for c in df.columns if c not in typed and c not in ("type", "geometry_type", "properties")]
    return df.select(*keep, *(v.alias(k) for k, v in typed.items()), error.alias("error"))


def import_stats(validated: DataFrame) -> DataFrame:
    """One row: features read, valid and invalid."""
    return validated.agg(F.count("*").alias("n_read"), F.count_if(F.col("error").isNull()).alias("n_valid"), F.count_if(F.col("error").isNotNull()).alias("n_invalid"))


def upsert(edges: DataFrame, order: str) -> DataFrame:
    """The last row of each id in ``order``, with traffic_status unknown; a map-side aggregation, no sort."""
    rest = [c for c in edges.columns if c not in ("id", order)]
    last = edges.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select("id", *(F.col(f"_r.{c}").alias(c) for c in rest), F.lit("unknown").alias("traffic_status"))


def first_of_id(edges: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each feature id across collections."""
    rest = [c for c in edges.columns if c != "id"]
    first = edges.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select("id", *(F.col(f"_r.{c}").alias(c) for c in rest))


def crosses(coordinates: str, box: Bounds) -> Column:
    """Whether a line string of [lng, lat] pairs meets the box: each segment is clipped to it (Liang-Barsky)."""
    points = F.col(coordinates)

    def meets(i: Column) -> Column:
        a, b = F.element_at(points, i), F.element_at(points, i + 1)
        dx, dy = b[0] - a[0], b[1] - a[1]
        sides = [(-dx, a[0] - box.min_lng), (dx, box.max_lng - a[0]), (-dy, a[1] - box.min_lat), (dy, box.max_lat - a[1])]
        enter = F.greatest(F.lit(0.0), *(F.when(p < 0, q / p) for p, q in sides))
        leave = F.least(F.lit(1.0), *(F.when(p > 0, q / p) for p, q in sides))
        outside = F.lit(False)
        for p, q in sides:
            outside = outside | ((p == 0) & (q < 0))
        return ~outside & (enter <= leave)

    return F.exists(F.sequence(F.lit(1), F.size(points) - 1), meets)


def in_box(edges: DataFrame, box: Bounds, coordinates: str = "coordinates") -> DataFrame:
    """Edges whose line meets the box.  If the table has envelope columns, those reach the scan first."""
    if {"min_lng", "max_lng", "min_lat", "max_lat"} <= set(edges.columns):
        edges = edges.where((F.col("min_lng") <= box.max_lng) & (F.col("max_lng") >= box.min_lng) & (F.col("min_lat") <= box.max_lat) & (F.col("max_lat") >= box.min_lat))
    return edges.where((F.size(coordinates) >= 2) & crosses(coordinates, box))


def read_bounds(edges: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The first ``limit`` edges with ``truncated``: whether there are more."""
    top = edges.orderBy(*order).limit(limit + 1)
    n = F.count("*").over(W.partitionBy(F.lit(1)))
    return top.withColumn("truncated", n > limit).withColumn("_rn", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))).where(F.col("_rn") <= limit).drop("_rn")


def distance_limit(edges: DataFrame, target_m: float, page: int = 100, collection: str = "collection_ord", order: str = "id") -> DataFrame:
    """Edges page by page until the physical edges read so far reach ``target_m`` metres, with ``truncated``.

    Collections follow each other; pages hold ``page`` rows of a collection; an id counts once, a physical edge once with its first positive
    length.  The sum is looked at after each full page of a collection (and at its end), so the page
    that reaches the target stays whole.
    """
    placed = running(edges, [collection, order], F.lit(0))
    # A row for each collection: the rows of those before it.
    before = W.partitionBy(F.lit(1)).orderBy(collection).rowsBetween(W.unboundedPreceding, -1)
    begin = edges.groupBy(collection).agg(F.count("*").alias("_k")).select(collection, (F.coalesce(F.sum("_k").over(before), F.lit(0)) + 1).alias("_b"))
    paged = first_of_id(placed.drop("total").join(F.broadcast(begin), collection), ["rn"])
    paged = paged.withColumn("_n", F.col("rn")).withColumn("_page", F.struct(F.col(collection).alias("c"), F.floor((F.col("rn") - F.col("_b")) / page).alias("p"))).drop("rn", "_b")
    # The first place of each physical edge decides where its length enters.
    counts = F.col("distance_m") > 0
    lengths = paged.where(counts).groupBy("edge_id").agg(F.min_by(F.struct("_page", "distance_m"), F.struct("_page", "_n")).alias("x"))
    pages = lengths.groupBy(F.col("x._page").alias("_page")).agg(F.sum("x.distance_m").alias("m"))
    every = paged.groupBy("_page").agg(F.count("*").alias("k")).join(pages, "_page", "left")
    run = running(every, ["_page"], F.coalesce("m", F.lit(0.0)))
    last = run.agg(F.min(F.when(F.col("total") >= target_m, F.col("_page"))).alias("_last"))
    out = paged.join(F.broadcast(last)).where(F.col("_last").isNull() | (F.col("_page") <= F.col("_last")))
    return out.withColumn("truncated", F.col("_last").isNotNull()).drop("_n", "_page", "_last")


def select_distance(edges: DataFrame, target_m: float, order: str = "id") -> DataFrame:
    """Edges in ``order`` up to the first new physical edge at which the edges before it reach ``target_m`` metres."""
    first = edges.groupBy("edge_id").agg(F.min(order).alias("_first"))
    marked = edges.join(first, "edge_id").withColumn("_new", F.col(order) == F.col("_first"))
    own = F.when(F.col("_new"), F.coalesce("distance_m", F.lit(0.0))).otherwise(0.0)
    run = running(marked, [order], own).withColumn("_before", F.col("total") - own)
    stop = run.where(F.col("_new") & (F.col("_before") >= target_m)).agg(F.min("rn").alias("_stop"))
    return run.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("rn") < F.col("_stop"))).drop("_first", "_new", "_before", "_stop", "rn", "total")


def directions(edges: DataFrame) -> DataFrame:
    """Each feature with its physical edge's direction label and the vehicles that either direction admits."""
    w = W.partitionBy(F.col("edge_id").cast("string"))
    forward = F.coalesce("forward", F.lit(False))
    some = lambda c: F.bool_or(c).over(w)
    return edges.withColumns({"road_direction": direction_label(some(forward), some(~forward)), "car_supported": some(has_access(F.col("car_access"))), "motorcycle_supported": some(has_access(F.col("motorcycle_access")))})


def oneway_counts(edges: DataFrame) -> DataFrame:
    """Physical edges with one direction, and with both."""
    each = edges.groupBy("edge_id").agg(F.bool_or("forward").alias("f"), F.bool_or(~F.col("forward")).alias("r"))
    both = F.col("f") & F.col("r")
    return each.agg(F.count_if(~both).alias("one_way"), F.count_if(both).alias("two_way"))


def overlay(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Edges with the level and speed of their road's last state."""
    last = states.groupBy("traversal_key").agg(F.max_by(F.struct("level", "current_speed_mps"), F.struct("window_start", "vehicle_type")).alias("s"))
    return edges.join(last, "traversal_key", "left").select(*edges.columns, F.col("s.level").alias("level"), F.col("s.current_speed_mps").alias("current_speed_mps"))


def zip_fields(names: Column, values: Column) -> Column:
    """A map of names and values, as long as the shorter of them."""
    n = F.least(F.size(names), F.size(values))
    return F.map_from_arrays(F.slice(names, 1, n), F.slice(values, 1, n))


def import_features(df: DataFrame, graph_version: str, path: str | None = None, order: str = "line_no", limit: int | None = None) -> DataFrame:
    """Validate features and, unless ``path`` is None (a dry run), write the last of each id as parquet with envelopes.

    The first invalid feature in ``order`` raises ValueError.  Returns the stats row.
    """
    checked = validate_features(df, graph_version)
    if limit:
        checked = checked.orderBy(order).limit(limit)
    bad = checked.where("error is not null").agg(F.min_by(F.struct(order, "id", "error"), order).alias("b")).first().b
    if bad is not None:
        raise ValueError(f"feature {bad[0]} ({bad[1]}): {bad[2]}")
    if path:
        lng, lat = F.transform("coordinates", lambda p: p[0]), F.transform("coordinates", lambda p: p[1])
        out = upsert(checked.drop("error"), order)
        out = out.withColumns({"min_lng": F.array_min(lng), "max_lng": F.array_max(lng), "min_lat": F.array_min(lat), "max_lat": F.array_max(lat)})
        out.write.mode("overwrite").parquet(path)
    return import_stats(checked)


