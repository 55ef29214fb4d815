"""Merges, intersections and version rules of sorted runs, as set operations of DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unit_draw


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """For each key the row with the highest version. Partial maxima go over the shuffle, a row a key and task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("best"))
    return best.select(*keys, "best.*").select(*rows.columns)


def live(rows: DataFrame, keys: list[str], version: str, deleted: str = "deleted") -> DataFrame:
    """The newest rows without those that a tombstone removes."""
    return newest(rows, keys, version).where(~F.col(deleted))


def merge(streams: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of streams; of rows with equal keys the one of the first stream stays (column stream tells which)."""
    ranked = [s.withColumn("stream", F.lit(n)) for n, s in enumerate(streams)]
    both = reduce(lambda a, b: a.unionByName(b), ranked)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "stream").alias("best"))
    return best.select(*keys, "best.*")


def intersect(streams: list[DataFrame], key: str) -> DataFrame:
    """Keys that all streams have."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), streams[1:], streams[0].select(key).distinct())


def cancel(operations: DataFrame, keys: list[str], sign: str = "sign") -> DataFrame:
    """Index entries after puts (+1) and removes (-1) of equal keys cancel; column net is 1 for a put, -1 for a remove that remain."""
    return operations.groupBy(*keys).agg(F.sum(sign).cast("long").alias("net")).where(F.col("net") != 0)


def merge_levels(upper: DataFrame, lower: DataFrame, keys: list[str], drop_tombstones: bool = False, deleted: str = "deleted") -> DataFrame:
    """A run merged into the level below: the upper row wins; tombstones go where nothing lies below."""
    out = merge([upper, lower], keys).drop("stream")
    return out.where(~F.col(deleted)) if drop_tombstones else out


def visible(rows: DataFrame, snapshot: int, low: str = "snapshot_min", high: str = "snapshot_max") -> DataFrame:
    """Rows that a snapshot sees."""
    return rows.where((F.col(low) <= snapshot) & (F.col(high) >= snapshot))


def key_ranges(rows: DataFrame, level: str, key: str) -> DataFrame:
    """Smallest and largest key, and the number of rows, of each level."""
    return rows.groupBy(level).agg(F.min(key).alias("key_min"), F.max(key).alias("key_max"), F.count("*").alias("rows"))


def sampled_one(rows: DataFrame, keys: list[str], weight: str, seed: int = 0) -> DataFrame:
    """A weighted reservoir sample of one row for each key, decided by a hash of the row's other columns."""
    rest = [c for c in rows.columns if c not in keys]
    unit = unit_draw(F.lit(seed), *[c for c in rows.columns if c != weight])
    drawn = rows.where(F.col(weight) > 0).withColumn("draw", F.log(unit) / F.col(weight))
    return drawn.groupBy(*keys).agg(F.max_by(F.struct(*rest), "draw").alias("one")).select(*keys, "one.*")
