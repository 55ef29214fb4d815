"""Two-phase transfers: resolution, expiry and the events of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import expires_at, has
from ..model import PENDING_STATUS, TRANSFER_FLAGS

_RESOLVES = TRANSFER_FLAGS["post_pending"] | TRANSFER_FLAGS["void_pending"]


def pending_transfers(transfers: DataFrame) -> DataFrame:
    return transfers.where(has("flags", TRANSFER_FLAGS["pending"])).withColumn("expires_at", expires_at())


def _resolvers(transfers: DataFrame) -> DataFrame:
    return transfers.where(has("flags", _RESOLVES) & (F.col("pending_id") != 0))


def resolver_status() -> Column:
    """What becomes of a resolver that was joined to its pending transfer p and comes first in time; null: it applies."""
    posts, amount, full = has("flags", TRANSFER_FLAGS["post_pending"]), F.col("amount"), F.col("p_amount")
    return (
        F.when(F.col("p_id").isNull(), 25)
        .when(~has("p_flags", TRANSFER_FLAGS["pending"]), 26)
        .when((F.col("debit_account_id") != 0) & (F.col("debit_account_id") != F.col("p_debit_account_id")), 27)
        .when((F.col("credit_account_id") != 0) & (F.col("credit_account_id") != F.col("p_credit_account_id")), 28)
        .when((F.col("ledger") != 0) & (F.col("ledger") != F.col("p_ledger")), 29)
        .when((F.col("code") != 0) & (F.col("code") != F.col("p_code")), 30)
        .when(posts & (amount > full), 31)
        .when(~posts & (amount != 0) & (amount < full), 32)
        .when(~posts & (amount > full), 31)
        .when(F.col("p_expires_at").isNotNull() & (F.col("timestamp") >= F.col("p_expires_at")), 35)
    )


def _joined(transfers: DataFrame, named: DataFrame) -> DataFrame:
    """Each resolver of transfers with the row of named that it names (columns p_*) and own_status: what it would get if no other resolver came."""
    names = ("id", "debit_account_id", "credit_account_id", "amount", "ledger", "code", "flags", "timestamp")
    pending = named.select(*[F.col(n).alias(f"p_{n}") for n in names], expires_at().alias("p_expires_at"))
    rows = _resolvers(transfers)
    rows = rows.join(pending, (rows["pending_id"] == pending["p_id"]) & (pending["p_timestamp"] < rows["timestamp"]), "left")
    return rows.withColumn("own_status", resolver_status())


def resolve(transfers: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Each resolver with its pending transfer (columns p_*) and status: null if it applies.

    The first resolver that fits wins; a later one fails as already posted or voided. One equi-join on the pending
    id; both sides have at most a few rows a key, and a hot key can be split. named: the transfers that may be named,
    each id once; those of the table itself if it isn't given.
    """
    rows = _joined(transfers, transfers if named is None else named)
    fits = rows.where(F.col("own_status").isNull())
    first = fits.groupBy(F.col("pending_id").alias("first_pending_id")).agg(F.min_by(F.struct("timestamp", "flags"), "timestamp").alias("first"))
    rows = rows.join(first, rows["pending_id"] == first["first_pending_id"], "left").drop("first_pending_id")
    late = F.col("first").isNotNull() & (F.col("first.timestamp") < F.col("timestamp"))
    again = F.when(has(F.col("first.flags"), TRANSFER_FLAGS["post_pending"]), 33).otherwise(34)
    in_order = F.col("own_status").isNull() | (F.col("own_status") == 35)
    return rows.withColumn("status", F.when(late & in_order, again).otherwise(F.col("own_status"))).drop("own_status", "first")


def two_phase_states(transfers: DataFrame) -> DataFrame:
    """Each pending transfer with expires_at and done: the resolver (id, flags, amount, timestamp) that applies to it at some time, or null.

    Resolvers meet their pending transfers once, and the first that fits is found by the same key: one join, one grouping
    and one join back, from which status, movements and expiry are all derived.
    """
    fits = _joined(transfers, transfers).where(F.col("own_status").isNull())
    done = fits.groupBy(F.col("pending_id").alias("done_id")).agg(F.min_by(F.struct("id", "flags", F.col("amount").cast("decimal(38,0)").alias("amount"), "timestamp"), "timestamp").alias("done"))
    rows = pending_transfers(transfers)
    return rows.join(done, rows["id"] == done["done_id"], "left").drop("done_id")


def status_at(now: int) -> Column:
    """What a row of two_phase_states is at a time."""
    resolved = F.coalesce(F.col("done.timestamp") <= now, F.lit(False))
    return (
        F.when(resolved & has("done.flags", TRANSFER_FLAGS["post_pending"]), PENDING_STATUS["posted"])
        .when(resolved, PENDING_STATUS["voided"])
        .when(F.col("expires_at") <= now, PENDING_STATUS["expired"])
        .otherwise(PENDING_STATUS["pending"])
    )


def pending_status(transfers: DataFrame, now: int) -> DataFrame:
    """id, timestamp, expires_at, amount and status of each pending transfer at a time."""
    rows = two_phase_states(transfers).where(F.col("timestamp") <= now)
    resolved_at = F.when(F.col("done.timestamp") <= now, F.col("done.timestamp"))
    return rows.select("id", "debit_account_id", "credit_account_id", "ledger", "amount", "timestamp", "expires_at", resolved_at.alias("resolved_at"), status_at(now).alias("status"))


def status_index(transfers: DataFrame, now: int) -> DataFrame:
    """Of all transfers id and transfer_pending_status_indexed: the status of a pending transfer, null for any other, which isn't indexed."""
    others = transfers.where(~has("flags", TRANSFER_FLAGS["pending"])).select("id", F.lit(None).cast("int").alias("transfer_pending_status_indexed"))
    return pending_status(transfers, now).select("id", F.col("status").alias("transfer_pending_status_indexed")).unionByName(others)


def due(transfers: DataFrame, now: int) -> DataFrame:
    """Pending transfers to expire at a time, in order of (expires_at, timestamp)."""
    rows = pending_status(transfers, now).where(F.col("status") == PENDING_STATUS["expired"])
    return rows.orderBy("expires_at", "timestamp")


def outstanding(transfers: DataFrame, now: int) -> DataFrame:
    """Pending sums and counts by account and side at a time."""
    rows = pending_status(transfers, now).where(F.col("status") == PENDING_STATUS["pending"])
    sides = F.explode(F.array(F.struct(F.col("debit_account_id").alias("account_id"), F.lit("debit").alias("side")), F.struct(F.col("credit_account_id").alias("account_id"), F.lit("credit").alias("side"))))
    rows = rows.select(sides.alias("s"), "amount").select("s.*", "amount")
    return rows.groupBy("account_id", "side").agg(F.sum("amount").alias("amount"), F.count("*").alias("transfers"))
