"""GPS sources: JSON bodies and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.config import Bounds
from roadpulse.functions.scalar import NUMBER, first_error, not_finite, number, once, trimmed
from roadpulse.operators.canonical import canonicalize, split_valid
from roadpulse.schemas import GPS_PAYLOAD, REQUIRED_NUMBERS

MAX_BODY = 1 << 20


def parse_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Raw records of JSON bodies, one object each, with ``decode_error`` or null; other columns stay.

    Bodies over 1 MiB, malformed ones, text after the object, arrays and unknown fields are errors.
    """
    text, brought = trimmed(F.col(body)), F.col("_t")
    parsed = F.from_json(body, T.StructType([*GPS_PAYLOAD.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    keys = F.json_object_keys(body)
    # Parsers stop at the end of the first value; in brackets and in braces nothing can follow it.
    alone = (F.json_array_length(F.concat(F.lit("["), F.col(body), F.lit("]"))) == 1) & (F.size(F.json_object_keys(F.concat(F.lit('{"v":'), F.col(body), F.lit("}")))) == 1)
    unknown = F.array_except(keys, F.array(*(F.lit(f.name) for f in GPS_PAYLOAD.fields)))
    error = F.coalesce(
        F.when(F.octet_length(body) > MAX_BODY, "request body is too large"),
        F.when(brought.isNull() | (brought == ""), "request body is empty"),
        F.when(~brought.startswith("{") | ~brought.endswith("}") | keys.isNull() | F.col("_p._corrupt").isNotNull() | ~F.coalesce(alone, F.lit(False)), "request body must be one JSON object"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_min(unknown))),
    )
    names = [f.name for f in GPS_PAYLOAD.fields]
    out = df.withColumn("_p", once(parsed)).withColumn("_t", text).withColumn("decode_error", once(error))
    return out.select(*df.columns, *(F.col(f"_p.{c}").alias(c) for c in names), "decode_error")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of files with one JSON body a line; see ``parse_bodies``."""
    return parse_bodies(spark.read.text(path).withColumnRenamed("value", "body"))


def stream_bodies(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same of a folder into which files come; any other streaming source of text fits ``parse_bodies`` as well."""
    return parse_bodies(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "body"))


def ingest(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical records, quarantined records with ``error``) of parsed bodies; of batches and streams alike."""
    made = canonicalize(parsed)
    return split_valid(made.withColumn("error", once(F.coalesce("decode_error", "error"))).drop("decode_error"))


def _float(name: str, required: bool) -> tuple[Column, list[tuple[Column, Column]]]:
    """A CSV number (blank: -1 unless ``required``) and the checks that refuse it."""
    raw = F.coalesce(F.col(name), F.lit(""))
    text = trimmed(raw)
    value = text.try_cast("double")
    blank = F.lit(False) if required else text == ""
    quoted = F.concat(F.lit(f'{name} "' if required else f'{name}: "'), raw if required else text, F.lit('"'))
    checks = [(~blank & value.isNull(), F.concat(quoted, F.lit(" is invalid"))), (~blank & not_finite(value), F.concat(quoted, F.lit(" must be finite")))]
    return F.when(blank, F.lit(-1.0)).otherwise(value), checks


def replay_points(texts: DataFrame, order: str, max_drivers: int | None = None, events_per_driver: int | None = None) -> DataFrame:
    """Points of a load generator's CSV rows: ``order``, driver_id, recorded_at_ms, lng, lat, speed_mps, heading_deg, accuracy_m, error.

    Drivers count in the order of their first row, ``max_drivers`` of them at most, and each with its first
    ``events_per_driver`` rows.  The checks are looser than those of ingestion: blank speed, bearing and accuracy are -1,
    and the minute of t_timestamp is not compared.  ``error`` is the first rule broken, or null; a file with any should
    not be replayed.
    """
    who = trimmed(F.coalesce(F.col("driver_id"), F.lit("")))
    rows = texts.withColumn("driver_id", who)
    if max_drivers:
        first = rows.where("driver_id <> ''").groupBy("driver_id").agg(F.min(order).alias("_first")).orderBy("_first").limit(max_drivers)
        rows = rows.where("driver_id = ''").unionByName(rows.join(first.select("driver_id"), "driver_id", "left_semi").select(*rows.columns))
    if events_per_driver:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("driver_id").orderBy(order))).where((F.col("driver_id") == "") | (F.col("_n") <= events_per_driver)).drop("_n")
    base = F.to_utc_timestamp(F.try_to_timestamp(trimmed(F.col("time")), F.lit("M/d/yyyy H:mm")), "+07:00")
    parts = F.split(trimmed(F.coalesce(F.col("t_timestamp"), F.lit(""))), ":")
    second = F.get(parts, F.lit(1))
    seconds = F.when(second.rlike(NUMBER), second.try_cast("double"))
    stamp = F.concat(F.lit('t_timestamp "'), F.coalesce(F.col("t_timestamp"), F.lit("")), F.lit('"'))
    lng, bad_lng = _float("lng", True)
    lat, bad_lat = _float("lat", True)
    speed, bad_speed = _float("speed", False)
    heading, bad_heading = _float("bearing", False)
    accuracy, bad_accuracy = _float("horizontal_acc", False)
    error = first_error(
        (F.col("driver_id") == "", "driver_id is empty"),
        (base.isNull(), F.concat(F.lit('time "'), F.coalesce(F.col("time"), F.lit("")), F.lit('" is invalid'))),
        (F.size(parts) != 2, F.concat(stamp, F.lit(" must use MM:SS.s format"))),
        (seconds.isNull() | (seconds < 0) | (seconds >= 60), F.concat(stamp, F.lit(" contains invalid seconds"))),
        *bad_lng, *bad_lat, *bad_speed, *bad_heading, *bad_accuracy,
        (~lng.between(-180, 180), "lng must be from -180 to 180"),
        (~lat.between(-90, 90), "lat must be from -90 to 90"),
        ((speed != -1) & (speed < 0), "speed must be -1 or non-negative"),
        ((heading != -1) & ((heading < 0) | (heading >= 360)), "bearing must be -1 or from 0 up to 360"),
        ((accuracy != -1) & (accuracy < 0), "horizontal_acc must be -1 or non-negative"),
    )
    at = F.unix_millis(base) + F.round(seconds * 1000).cast("long")
    return rows.select(order, "driver_id", at.alias("recorded_at_ms"), lng.alias("lng"), lat.alias("lat"), speed.alias("speed_mps"), heading.alias("heading_deg"), accuracy.alias("accuracy_m"), error.alias("error"))


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file with a header as texts; a missing required column raises ValueError, a malformed row fails the read."""
    df = spark.read.csv(path, header=True, mode="FAILFAST", inferSchema=False)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def csv_candidates(texts: DataFrame, box: Bounds, vehicle: str, order: str, per_driver: int = 60) -> DataFrame:
    """Raw records of text columns inside the box and of the vehicle, the first ``per_driver`` of each driver in ``order``.

    Rows with a blank or malformed required number are skipped; side, delta_time and distance are not
    taken from files.  The box is tested before other columns are parsed.
    """
    lat, lng = number(F.col("lat")), number(F.col("lng"))
    inside = texts.where(lat.between(box.min_lat, box.max_lat) & lng.between(box.min_lng, box.max_lng))
    kind = F.lower(trimmed(F.col("vehicle_type")))
    inside = inside.where(kind == ("bike" if vehicle == "motorcycle" else vehicle))
    out = inside.select(order, *(trimmed(F.col(c)).alias(c) for c in ("driver_id", "t_timestamp", "status", "vehicle_type", "time")), *(number(F.col(c)).alias(c) for c in REQUIRED_NUMBERS))
    out = out.dropna(subset=REQUIRED_NUMBERS)
    out = out.withColumn("_n", F.row_number().over(W.partitionBy("driver_id").orderBy(order))).where(F.col("_n") <= per_driver).drop("_n")
    return out.withColumns({"side": F.lit(None).cast("string"), "delta_time": F.lit(None).cast("double"), "distance": F.lit(None).cast("double")})
