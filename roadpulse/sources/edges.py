"""Edge sources: GeoJSON text sequences and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.scalar import trimmed


def parse_features(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """Features of GeoJSON lines, blank ones skipped: (order, id, type, geometry_type, coordinates, properties).

    Properties are a map of raw JSON texts, which tells "1" from 1.
    """
    text = F.regexp_replace(trimmed(F.col(line)), "^\x1e", "")
    rows = lines.select(order, text.alias("_t")).where("_t <> ''")
    # Strings keep their quotes in a variant's JSON text.
    raw = F.try_parse_json("_t")
    props = F.transform_values(F.try_variant_get(raw, "$.properties", "map<string,variant>"), lambda k, v: F.to_json(v))
    return rows.select(
        order, F.get_json_object("_t", "$.id").alias("id"), F.get_json_object("_t", "$.type").alias("type"), F.get_json_object("_t", "$.geometry.type").alias("geometry_type"),
        F.from_json(F.get_json_object("_t", "$.geometry.coordinates"), "array<array<double>>").alias("coordinates"), F.coalesce(props, F.expr("cast(map() as map<string,string>)")).alias("properties"),
    )


def read_edges(spark: SparkSession, *paths: str) -> DataFrame:
    """Edge tables as ordered collections, ids of the first collection first."""
    out = None
    for k, path in enumerate(paths):
        one = spark.read.parquet(path).withColumn("collection_ord", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
