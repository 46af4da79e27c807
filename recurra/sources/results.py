"""Scan results: an append-only table, one folder a batch, whose rows hold their matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCH = (
    "rank:int,pattern_id:bigint,ticker:string,start_time:timestamp,composite:double,cosine:double,euclidean:double,dtw:double,"
    "forward_return:double,max_drawdown:double,max_runup:double,time_to_resolution:int,outcome_label:string"
)
RESULT = (
    "ticker string, timeframe string, as_of timestamp, window_size int, echo_type string, similarity double, confidence double, n_matches int, "
    f"mean_return double, mean_drawdown double, matches array<struct<{MATCH}>>"
)


def write_results(rows: DataFrame, path: str, batch: int) -> None:
    """Write a batch under its number; written again, it takes the place of the first try.

    Rows lie in order of ticker, timeframe and time, so that a reader of few series skips most of a file.
    """
    rows = rows.repartitionByRange("ticker", "timeframe").sortWithinPartitions("ticker", "timeframe", "as_of")
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_results(spark: SparkSession, path: str, ticker: str | None = None, timeframe: str | None = None, schema: str = RESULT) -> DataFrame:
    """All batches; the filters reach the scan."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    for column, value in (("ticker", ticker), ("timeframe", timeframe)):
        rows = rows.where(F.col(column) == value) if value else rows
    return rows


def latest(rows: DataFrame) -> DataFrame:
    """The newest result of each (ticker, timeframe), by time and then batch; one partial aggregate, no sort of the table."""
    keys = ("ticker", "timeframe")
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("as_of", "batch")).alias("r"))
    return last.select(*keys, "r.*")
