"""Ledger tables as Parquet: append, latest view, compaction, and batches packed in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.combine import live


def append(rows: DataFrame, path: str) -> None:
    """Files by ledger, sorted by timestamp, so that scans skip files and row groups."""
    rows.sortWithinPartitions("ledger", "timestamp").write.partitionBy("ledger").mode("append").parquet(path)


def latest(spark: SparkSession, path: str, keys: list[str], version: str = "version") -> DataFrame:
    """The live rows of a table of versions: put, update and remove are all appended rows."""
    return live(spark.read.parquet(path), keys, version)


def compact(spark: SparkSession, path: str, to: str, keys: list[str], version: str = "version") -> None:
    """Rewrites a table of versions with only its live rows, in files by ledger and stretch of time: a busy ledger is many tasks' work."""
    rows = latest(spark, path, keys, version)
    rows.repartitionByRange("ledger", "timestamp").sortWithinPartitions("ledger", "timestamp").write.partitionBy("ledger").parquet(to)


def pack(batch: DataFrame) -> DataFrame:
    """Requests of each batch_id as one row with an array, in the batch's order. A batch is at most a message of requests."""
    rest = [c for c in batch.columns if c not in ("batch_id", "index")]
    return batch.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("index", F.struct(*rest).alias("request")))).alias("requests"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("batch_id", F.explode("requests").alias("r")).select("batch_id", "r.index", "r.request.*")
