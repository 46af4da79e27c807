"""Shared plumbing of the corpus operators: tables, folders, sizes, edge cases."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if none is set and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint, after which Spark's cleaner is told to delete the shuffle files that it was made from."""
    made = checkpoint(df)
    let_go(df.sparkSession)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_parts(df: DataFrame, text: str, part_bytes: int) -> int:
    """How many parts of about `part_bytes` of text a table has, at least one a shuffle partition."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // part_bytes))


def part_of(key: str, parts: int) -> Column:
    """A part number that depends on the key alone; null keys have one too."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def fold(key: str) -> Column:
    """crc32 of the key as text, mod 5: what splits are made by; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5, F.lit(-1)).cast("int")
