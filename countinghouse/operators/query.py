"""Lookups, filtered reads and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ACCOUNT_FILTER_FLAGS, PAGE_MAX, AccountFilter, QueryFilter

#: Most requested ids that are sent to every task; more are joined over a shuffle.
BROADCAST_IDS = 100_000


def _requested(spark, ids: list[int]) -> DataFrame:
    rows = [(int(i), n) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "requested_id long, position long")


def lookup(rows: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """The rows with these ids and the position of each id in the request; an id asked for twice comes twice."""
    asked = _requested(rows.sparkSession, ids)
    asked = F.broadcast(asked) if len(ids) <= BROADCAST_IDS else asked
    # The list of ids is a filter as well, so that a scan can skip row groups.
    found = rows.where(F.col(key).isin(*{int(i) for i in ids})) if 0 < len(ids) <= 1000 else rows
    return found.join(asked, found[key] == asked["requested_id"]).drop("requested_id")


def lookup_status(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """For each distinct id of a table of ids whether rows have it (found), as a batched multi-get."""
    known = rows.select(F.col(key).alias("known_id")).distinct()
    asked = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    return asked.join(known, asked["id"] == known["known_id"], "left").select("id", F.col("known_id").isNotNull().alias("found"))


def missing_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    asked = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    return asked.join(rows.select(F.col(key).alias("id")), "id", "left_anti")


def _window(f) -> list[Column]:
    out = []
    if f.timestamp_min:
        out.append(F.col("timestamp") >= f.timestamp_min)
    if f.timestamp_max:
        out.append(F.col("timestamp") <= f.timestamp_max)
    return out


def _equal(f, names) -> list[Column]:
    return [F.col(n) == getattr(f, n) for n in names if getattr(f, n)]


def _page(rows: DataFrame, f, conditions: list[Column]) -> DataFrame:
    """One scan with all conditions, ordered by timestamp and cut at the limit (PAGE_MAX at most); nothing if the filter is invalid."""
    if not f.valid():
        return rows.limit(0)
    for c in conditions:
        rows = rows.where(c)
    order = F.desc("timestamp") if f.reversed else F.asc("timestamp")
    return rows.orderBy(order).limit(min(f.limit, PAGE_MAX))


def account_transfers(transfers: DataFrame, f: AccountFilter) -> DataFrame:
    """Transfers that debit or credit an account."""
    sides = []
    if f.flags & ACCOUNT_FILTER_FLAGS["debits"]:
        sides.append(F.col("debit_account_id") == f.account_id)
    if f.flags & ACCOUNT_FILTER_FLAGS["credits"]:
        sides.append(F.col("credit_account_id") == f.account_id)
    side = sides[0] if len(sides) == 1 else sides[0] | sides[1] if sides else F.lit(False)
    return _page(transfers, f, [side, *_window(f), *_equal(f, ("user_data_128", "user_data_64", "user_data_32", "code"))])


def query(rows: DataFrame, f: QueryFilter) -> DataFrame:
    """Accounts or transfers that have all the filter's values."""
    return _page(rows, f, [*_window(f), *_equal(f, ("user_data_128", "user_data_64", "user_data_32", "ledger", "code"))])


def next_page(rows: DataFrame, last: int, limit: int, descending: bool = False) -> DataFrame:
    """The page after a timestamp, of at most PAGE_MAX rows."""
    after = F.col("timestamp") < last if descending else F.col("timestamp") > last
    return rows.where(after).orderBy(F.desc("timestamp") if descending else F.asc("timestamp")).limit(min(limit, PAGE_MAX))
