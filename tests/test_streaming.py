"""A stream's closed windows and traces equal those of a batch over the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from roadpulse.config import CongestionConfig, TraceConfig
from roadpulse.operators.congestion import segment_windows
from roadpulse.operators.observations import can_aggregate
from roadpulse.operators.traces import buffered_traces
from roadpulse.plans import views
from roadpulse.streaming.congestion import stream_traces, stream_windows

SF = "/root/testdata/sf0.001"


def drain(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return spark.table(name)


def test_windows(spark, tmp_path):
    rows = views.observations(spark, SF)
    rows.repartition(1).write.parquet(str(tmp_path / "obs"))
    c = CongestionConfig(7 * 86400, 1, 1)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "obs"))
    got = drain(spark, stream_windows(stream, c), "w").collect()
    want = {tuple(r): r for r in segment_windows(rows.where(can_aggregate()), c).select(*got[0].__fields__).collect()}
    assert got and all(tuple(r) in want for r in got)
    last = rows.agg(F.max("recorded_at")).first()[0] - dt.timedelta(minutes=1)
    assert len(got) == sum(r.window_start + dt.timedelta(days=7) <= last for r in want.values())


def test_traces(spark, tmp_path):
    rows = views.observations(spark, SF)
    rows.repartition(1).write.parquet(str(tmp_path / "obs"))
    c = TraceConfig(5, 12 * 3600.0, 2, 2)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "obs"))
    got = drain(spark, stream_traces(stream, c), "t").collect()
    want = buffered_traces(rows, c).select("driver_id", "first_seq", "last_seq", "n_points", "started_at", "ended_at").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
