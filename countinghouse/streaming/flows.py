"""Streams of transfers and events."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..functions.columns import has
from ..model import NS, TRANSFER_FLAGS


def read_table(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder; its checkpoint is the resume point."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def changes_after(events: DataFrame, timestamp_last: int = 0) -> DataFrame:
    """Events that come after a resume point, of a table or a stream."""
    return events.where(F.col("timestamp") > timestamp_last)


def publish(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch, in time order, to a sink; a batch that is repeated after a failure has the same number."""
    return events.writeStream.foreachBatch(lambda df, n: sink(df.orderBy("timestamp"), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent(transfers: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of transfers without repeats of an id within the delay."""
    rows = transfers.withColumn("event_time", F.timestamp_micros(F.floor(F.col("timestamp") / 1000)))
    return rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"])


EXPIRY_SCHEMA = StructType([StructField(n, LongType()) for n in ("pending_id", "ledger", "amount", "expired_at")])


#: Keys of the expiry's state: each holds the open transfers whose hashed id falls to it. Fixed, since state is found by it.
EXPIRY_BUCKETS = 1024
_OPEN = np.dtype([(n, np.int64) for n in ("id", "known", "ledger", "amount", "expires_at", "resolved_at")])
_NEVER = np.iinfo(np.int64).max


class Expiry(StatefulProcessor):
    """Keyed by bucket of pending transfers: holds them until they are resolved or the watermark passes their expiry, then tells that they expired.

    A bucket's state is one packed array, read and written once a batch, so that the state's cost is by bucket and not by
    transfer; a busy ledger is spread over all buckets. Of a transfer's resolvers the first in time is held, so it doesn't
    matter in which order rows of a batch come. A resolver whose transfer isn't there goes once the watermark passes it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", StructType([StructField("rows", BinaryType()), StructField("timer", LongType())]))

    def _held(self) -> tuple[np.ndarray, int]:
        """What is open in the bucket, and when its one timer goes off (0: none)."""
        rows, timer = self.open.get() if self.open.exists() else (b"", 0)
        return np.frombuffer(bytes(rows), _OPEN), timer

    def _settle(self, rows: np.ndarray, watermark: int, timer: int, fired: bool) -> pd.DataFrame:
        """Writes what stays open, sets the bucket's one timer and returns what expired."""
        timed = (rows["known"] == 1) & (rows["expires_at"] != 0)
        resolved = np.where(timed, rows["resolved_at"] < rows["expires_at"], rows["resolved_at"] != _NEVER)
        # The end of a transfer's timeout also ends the state of what is resolved; without a timeout, the resolver does.
        # Spark fires a timer that equals the watermark, in whole milliseconds: the next one has surely reached the end.
        ends = np.where(timed, rows["expires_at"], rows["resolved_at"]) // 1_000_000 + 1
        over = np.where(timed | (rows["known"] == 0), ends <= watermark, resolved)
        gone, kept = rows[over & timed & ~resolved], rows[~over]
        wait = int(ends[~over].min()) if len(kept) else 0
        wait = 0 if wait > _NEVER // 1_000_000 else wait
        if wait != timer or fired:
            if timer and not fired:
                self.handle.deleteTimer(timer)
            if wait:
                self.handle.registerTimer(wait)
        if len(kept):
            self.open.update((kept.tobytes(), wait))
        else:
            self.open.clear()
        return pd.DataFrame({"pending_id": gone["id"], "ledger": gone["ledger"], "amount": gone["amount"], "expired_at": gone["expires_at"]})

    def handleInputRows(self, key, rows, timerValues):
        held, timer = self._held()
        parts = [held]
        for pdf in rows:
            new = np.zeros(len(pdf), _OPEN)
            pending = (pdf["flags"].to_numpy() & TRANSFER_FLAGS["pending"]) != 0
            at, timeout = pdf["timestamp"].to_numpy(), pdf["timeout"].to_numpy()
            new["id"], new["known"] = pdf["key"].to_numpy(), pending
            new["ledger"], new["amount"] = np.where(pending, pdf["ledger"].to_numpy(), 0), np.where(pending, pdf["amount"].to_numpy(), 0)
            new["expires_at"] = np.where(pending & (timeout != 0), at + timeout * NS, 0)
            new["resolved_at"] = np.where(pending, _NEVER, at)
            parts.append(new)
        every = np.concatenate(parts)
        every = every[np.lexsort((every["known"], every["id"]))]
        first = np.flatnonzero(np.append(True, every["id"][1:] != every["id"][:-1]))
        merged = every[np.append(first[1:], len(every)) - 1]
        merged["resolved_at"] = np.minimum.reduceat(every["resolved_at"], first)
        yield self._settle(merged, timerValues.getCurrentWatermarkInMs(), timer, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, timer = self._held()
        yield self._settle(held, timerValues.getCurrentWatermarkInMs(), timer, True)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """The state store that timers need, for the queries started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def expiries(transfers: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of expired pending transfers from a stream of transfers, by event time."""
    two_phase = F.col("flags").bitwiseAND(F.lit(TRANSFER_FLAGS["pending"] | TRANSFER_FLAGS["post_pending"] | TRANSFER_FLAGS["void_pending"])) != 0
    rows = transfers.where(two_phase)
    rows = rows.withColumn("key", F.when(has("flags", TRANSFER_FLAGS["pending"]), F.col("id")).otherwise(F.col("pending_id")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(EXPIRY_BUCKETS)))
    rows = rows.select("bucket", "key", "ledger", F.col("amount").cast("long").alias("amount"), "flags", "timeout", "timestamp", F.timestamp_micros(F.floor(F.col("timestamp") / 1000)).alias("event_time"))
    return rows.withWatermark("event_time", delay).groupBy("bucket").transformWithStateInPandas(Expiry(), outputStructType=EXPIRY_SCHEMA, outputMode="Append", timeMode="EventTime")
