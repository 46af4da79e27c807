"""Bars and alerts from streams against their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from recurra.operators import signals
from recurra.sources import bars as B
from recurra.streaming import live


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_bars(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(minutes=7 * i), 100.0 + i % 13, 1.0, i) for i in range(200)]
    ticks = spark.createDataFrame(rows, "ticker string, ts timestamp, price double, size double, event_id long")
    ticks.write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/t")
    got = {r.ts: (r.open, r.close, r.volume) for r in run(live.stream_bars(stream), "bars").collect()}
    batch = {r.ts: (r.open, r.close, r.volume) for r in B.bars_from_ticks(ticks, ["ts", "event_id"]).collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(got) >= len(batch) - 4


def test_cooldown(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    alerts = spark.createDataFrame([(t, start + dt.timedelta(hours=h)) for t in "AB" for h in (0, 3, 8, 9, 15, 16)], "ticker string, ts timestamp")
    alerts.write.parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema(alerts.schema).parquet(f"{tmp_path}/a")
    got = sorted(map(tuple, run(live.cooled_stream(stream), "alerts").select("ticker", F.unix_seconds("ts")).collect()))
    assert got == sorted(map(tuple, signals.cooled_down(alerts).select("ticker", F.unix_seconds("ts")).collect()))
