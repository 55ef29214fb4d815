"""Accounts and transfers derived from the star-schema tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TRANSFER_FLAGS

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_ACCOUNT, SUPPLIER_ACCOUNT = 1_000_000_000, 2_000_000_000
TIMEOUT = 432_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nanos(name: str):
    """Nanoseconds since the epoch of a timestamp without a time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))") * 1000


def _account(rows: DataFrame, id_, code: int, flags, user_data_64) -> DataFrame:
    zero, amount = F.lit(0).cast("long"), F.lit(0).cast("decimal(38,0)")
    return rows.select(
        id_.cast("long").alias("id"), amount.alias("debits_pending"), amount.alias("debits_posted"), amount.alias("credits_pending"), amount.alias("credits_posted"),
        zero.alias("user_data_128"), user_data_64.cast("long").alias("user_data_64"), zero.alias("user_data_32"),
        F.lit(1).cast("long").alias("ledger"), F.lit(code).alias("code"), flags.cast("int").alias("flags"), id_.cast("long").alias("timestamp"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account for each customer, event type and supplier."""
    customers = _account(table(spark, sf_dir, "customer"), F.col("c_custkey") + 1, 10, F.when(F.col("c_custkey") % 2 == 0, 8).otherwise(0), F.col("c_nationkey"))
    types = _account(spark.range(1, len(EVENT_TYPES) + 1), F.col("id") + EVENT_ACCOUNT, 20, F.lit(8), F.lit(0))
    suppliers = _account(table(spark, sf_dir, "supplier"), F.col("s_suppkey") + SUPPLIER_ACCOUNT, 30, F.lit(0), F.col("s_nationkey"))
    return customers.unionByName(types).unionByName(suppliers)


def _transfer(rows: DataFrame, **columns) -> DataFrame:
    kinds = {"amount": "decimal(38,0)", "code": "int", "flags": "int"}
    names = ("id", "debit_account_id", "credit_account_id", "amount", "pending_id", "user_data_128", "user_data_64", "user_data_32", "timeout", "ledger", "code", "flags", "timestamp")
    return rows.select(*[F.lit(columns.get(n, 0)).cast(kinds.get(n, "long")).alias(n) for n in names])


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single-phase transfer for each event."""
    kind = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(k)) for k, t in enumerate(EVENT_TYPES, 1)])
    return _transfer(
        table(spark, sf_dir, "events"), id=F.col("event_id") + 1, debit_account_id=F.col("user_id") + 1, credit_account_id=kind + EVENT_ACCOUNT,
        amount=F.round(F.col("value") * 100), code=kind, ledger=1, user_data_64=F.col("event_id") % 7, timestamp=_nanos("ts"),
    )


def two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending transfer for each order and, for orders with status F or O, the transfer that posts or voids it."""
    k, d = F.col("o_orderkey"), _nanos("o_orderdate")
    orders = table(spark, sf_dir, "orders")
    same = {"debit_account_id": F.col("o_custkey") + 1, "credit_account_id": k % 10 + SUPPLIER_ACCOUNT, "amount": F.round(F.col("o_totalprice") * 100), "ledger": 1, "code": 1}
    pending = _transfer(orders, id=2 * (k + 1), flags=TRANSFER_FLAGS["pending"], timeout=TIMEOUT, timestamp=d + 2 * (k + 1), **same)
    days = (k % 10 + 1) * F.lit(86_400_000_000_000)
    flags = F.when(F.col("o_orderstatus") == "F", TRANSFER_FLAGS["post_pending"]).otherwise(TRANSFER_FLAGS["void_pending"])
    resolved = orders.where(F.col("o_orderstatus").isin("F", "O"))
    resolver = _transfer(resolved, id=2 * (k + 1) + 1, pending_id=2 * (k + 1), flags=flags, timestamp=d + 2 * (k + 1) + 1 + days, **same)
    return pending.unionByName(resolver)


ACCOUNTS_SQL = """
accounts AS (
  SELECT CAST(c_custkey + 1 AS BIGINT) AS id, 1 AS ledger, 10 AS code, CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 0 END AS flags, CAST(c_nationkey AS BIGINT) AS user_data_64, CAST(c_custkey + 1 AS BIGINT) AS timestamp FROM customer
  UNION ALL SELECT CAST(1000000000 + k AS BIGINT), 1, 20, 8, 0, CAST(1000000000 + k AS BIGINT) FROM range(1, 6) AS r(k)
  UNION ALL SELECT CAST(2000000000 + s_suppkey AS BIGINT), 1, 30, 0, CAST(s_nationkey AS BIGINT), CAST(2000000000 + s_suppkey AS BIGINT) FROM supplier)"""

TRANSFERS_SQL = """
transfers AS (
  SELECT CAST(event_id + 1 AS BIGINT) AS id, CAST(user_id + 1 AS BIGINT) AS debit_account_id, CAST(1000000000 + k AS BIGINT) AS credit_account_id,
         CAST(round(value * 100) AS BIGINT) AS amount, CAST(0 AS BIGINT) AS pending_id, CAST(event_id % 7 AS BIGINT) AS user_data_64, CAST(0 AS BIGINT) AS timeout, 1 AS ledger, k AS code, 0 AS flags,
         epoch_us(ts) * 1000 AS timestamp
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS k FROM events))"""

TWO_PHASE_SQL = """
o AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) * 1000 AS d, CAST(o_custkey + 1 AS BIGINT) AS dr, CAST(2000000000 + o_orderkey % 10 AS BIGINT) AS cr,
             CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderstatus AS s FROM orders),
pend AS (SELECT CAST(2 * (k + 1) AS BIGINT) AS id, dr, cr, amount, d + 2 * (k + 1) AS timestamp, d + 2 * (k + 1) + 432000000000000 AS expires_at FROM o),
res AS (SELECT CAST(2 * (k + 1) + 1 AS BIGINT) AS id, CAST(2 * (k + 1) AS BIGINT) AS pending_id, dr, cr, amount, CASE s WHEN 'F' THEN 4 ELSE 8 END AS flags,
               d + 2 * (k + 1) + 1 + (k % 10 + 1) * 86400000000000 AS timestamp FROM o WHERE s IN ('F', 'O'))"""
