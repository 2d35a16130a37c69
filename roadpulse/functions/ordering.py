"""Places and running sums over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, order: list[str], value: Column) -> DataFrame:
    """``df`` with rn, the place in ``order``, and total, the sum of ``value`` up to the row, both over all rows.

    In two levels, so that no task sees all rows: places and sums within ranges of ``order``, plus those of the
    ranges before.  One row for each range is what the second level holds.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_v", value.cast("double")).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    inner = W.partitionBy("_p").orderBy(*order)
    local = ranged.withColumn("_r", F.row_number().over(inner)).withColumn("_s", F.sum("_v").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    sums = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("_v").alias("_t"))
    outer = W.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_t").over(outer), F.lit(0.0)).alias("_bt"))
    out = local.join(F.broadcast(before), "_p")
    return out.withColumn("rn", F.col("_r") + F.col("_bn")).withColumn("total", F.col("_s") + F.col("_bt")).drop("_p", "_r", "_s", "_n", "_t", "_v", "_bn", "_bt")
