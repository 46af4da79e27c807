"""The pattern store: a Parquet table partitioned by timeframe; ids are hashes of the natural key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def with_ids(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("pattern_id", F.xxhash64("ticker", "timeframe", "start_time", "window_size"))


def store(patterns: DataFrame, path: str) -> int:
    """Append, clustered by ticker and time within each timeframe; how many rows were written.

    Rows of one id are kept once when read.
    """
    seen = Observation()
    rows = with_ids(patterns).observe(seen, F.count("*").alias("n"))
    rows = rows.repartition("timeframe", "ticker").sortWithinPartitions("timeframe", "ticker", "start_time")
    rows.write.mode("append").partitionBy("timeframe").parquet(path)
    return int(seen.get["n"])


def load(spark: SparkSession, path: str, timeframe: str | None = None, ticker: str | None = None, limit: int | None = 10_000) -> DataFrame:
    """Patterns by id, filters pushed to the scan; only ids are compared before the limit, and the chosen rows are then read."""
    rows = spark.read.parquet(path)
    if timeframe:
        rows = rows.where(F.col("timeframe") == timeframe)
    if ticker:
        rows = rows.where(F.col("ticker") == ticker)
    if not limit:
        return rows.dropDuplicates(["pattern_id"])
    chosen = rows.select("pattern_id").distinct().orderBy("pattern_id").limit(limit)
    return rows.join(chosen, "pattern_id", "left_semi").dropDuplicates(["pattern_id"]).orderBy("pattern_id")


def alerts_sink(path: str):
    """A foreachBatch function that writes each batch once, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
