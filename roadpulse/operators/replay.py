"""Replay workloads and GPX documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.functions.ordering import running


def driver_index(df: DataFrame, order: str, driver: str = "driver_id") -> DataFrame:
    """(driver, driver_idx): drivers numbered from 0 by their first row in ``order``."""
    first = df.groupBy(driver).agg(F.min(order).alias("_first"))
    return running(first, ["_first", driver], F.lit(0)).select(driver, (F.col("rn") - 1).alias("driver_idx"))


def shard(df: DataFrame, index: int, count: int, order: str, driver: str = "driver_id") -> DataFrame:
    """Rows of the drivers whose number leaves ``index`` when divided by ``count``."""
    if not 0 <= index < count:
        raise ValueError("0 <= index < count")
    return df.join(driver_index(df, order, driver), driver).where(F.pmod(F.col("driver_idx"), F.lit(count)) == index)


def interleave(df: DataFrame, order: str, run_id: str, cycles: int = 1, pause_ms: int = 60_000, max_drivers: int | None = None, max_events: int | None = None, shift_ms: int = 0, shard_index: int = 0, shard_count: int = 1, prefix: str = "vegeta", driver: str = "driver_id", time_ms: str = "recorded_at_ms") -> DataFrame:
    """Events of all drivers in turn (cycle, sequence, driver number), times shifted by a cycle's span and pause.

    The span is that of all drivers taken, before the shard's are chosen, so all shards keep step.

    ``cycle``, ``sequence`` and ``driver_idx`` are the order; sort by them where an ordered file is written.
    """
    numbered = df.withColumn("sequence", F.row_number().over(W.partitionBy(driver).orderBy(order)) - 1)
    drivers = driver_index(df, order, driver)
    if max_drivers:
        drivers = drivers.where(F.col("driver_idx") < max_drivers)
    if max_events:
        numbered = numbered.where(F.col("sequence") < max_events)
    taken = numbered.join(drivers, driver)
    span = taken.agg((F.max(time_ms) - F.min(time_ms) + pause_ms).alias("_span"))
    if not 0 <= shard_index < shard_count:
        raise ValueError("0 <= shard_index < shard_count")
    if shard_count > 1:
        taken = taken.where(F.pmod(F.col("driver_idx"), F.lit(shard_count)) == shard_index)
    rows = taken.join(F.broadcast(span)).withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    event = F.concat_ws("-", F.lit(prefix), F.lit(run_id), F.col("cycle").cast("string"), F.col(driver), F.col("sequence").cast("string"))
    return rows.withColumn("event_id", event).withColumn(time_ms, F.col(time_ms) + F.lit(shift_ms) + F.col("cycle") * F.col("_span")).drop("_span")


def targets(events: DataFrame, url: str, columns: list[str]) -> DataFrame:
    """Load-generator targets: method, url, header and the event as base64 JSON."""
    body = F.base64(F.to_binary(F.to_json(F.struct(*columns)), F.lit("utf-8")))
    header = F.expr("map('Content-Type', array('application/json'))")
    return events.select("cycle", "sequence", "driver_idx", F.to_json(F.struct(F.lit("POST").alias("method"), F.lit(url).alias("url"), header.alias("header"), body.alias("body"))).alias("target"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _stamp(ts: Column) -> Column:
    """RFC 3339 in UTC without trailing zeros."""
    text = F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.when(F.length(text) < 19, whole).otherwise(F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(text)), F.lit("Z"))


def gpx(traces: DataFrame, driver: str = "driver_id", points: str = "points", creator: str = "roadpulse") -> DataFrame:
    """Traces with ``gpx``, a GPX 1.1 document of their points (lat, lng, recorded_at); null for fewer than two points or a missing time."""
    one = lambda p: F.concat(F.lit('<trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lng"].cast("string"), F.lit('"><time>'), _stamp(p["recorded_at"]), F.lit("</time></trkpt>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="%s"><trk><name>' % creator
    text = F.concat(F.lit(head), _escaped(F.col(driver)), F.lit("</name><trkseg>"), F.array_join(F.transform(points, one), ""), F.lit("</trkseg></trk></gpx>"))
    ok = (F.size(points) >= 2) & ~F.exists(points, lambda p: p["recorded_at"].isNull())
    return traces.withColumn("gpx", F.when(ok, text))
