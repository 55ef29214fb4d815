"""A seeded workload of accounts and transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import unit_draw

ID_ORDERS = ("sequential", "reversed", "random")
DISTRIBUTIONS = ("uniform", "zipfian", "latest")


def _unit(seed: int, salt: int) -> Column:
    """A number above 0 and up to 1 that the row's number decides."""
    return unit_draw(F.lit(seed), F.lit(salt), "n")


def _pick(unit: Column, accounts: int, distribution: str, theta: float) -> Column:
    if distribution == "uniform":
        at = unit * accounts
    else:  # the inverse of a power law's distribution function
        at = F.pow(unit, F.lit(1 / (1 - theta))) * accounts
    at = F.least(F.floor(at), F.lit(accounts - 1))
    return F.lit(accounts - 1) - at if distribution == "latest" else at


def accounts(spark: SparkSession, n: int, ledger: int = 1) -> DataFrame:
    return spark.range(n).select((F.col("id") + 1).alias("id"), F.lit(ledger).cast("long").alias("ledger"), F.lit(1).alias("code"), F.lit(0).alias("flags"), (F.col("id") + 1).alias("timestamp"))


def transfers(spark: SparkSession, n: int, n_accounts: int, distribution: str = "uniform", id_order: str = "sequential", theta: float = 0.9, seed: int = 42) -> DataFrame:
    """n transfers between different accounts, made where they are written: nothing is gathered or shuffled."""
    if distribution not in DISTRIBUTIONS or id_order not in ID_ORDERS or n_accounts < 2:
        raise ValueError("unknown distribution or order of ids, or fewer than two accounts")
    rows = spark.range(n).withColumnRenamed("id", "n")
    debit = _pick(_unit(seed, 1), n_accounts, distribution, theta)
    step = F.least(F.floor(_unit(seed, 2) * (n_accounts - 1)), F.lit(n_accounts - 2)) + 1
    ids = {"sequential": F.col("n") + 1, "reversed": F.lit(n) - F.col("n"), "random": F.pmod(F.xxhash64(F.lit(seed), F.col("n")), F.lit(2**62)) + 1}
    return rows.select(
        ids[id_order].cast("long").alias("id"), (debit + 1).cast("long").alias("debit_account_id"), (F.pmod(debit + step, F.lit(n_accounts)) + 1).cast("long").alias("credit_account_id"),
        F.ceil(_unit(seed, 3) * 10_000).cast("decimal(38,0)").alias("amount"), F.lit(1).cast("long").alias("ledger"), F.lit(1).alias("code"), F.lit(0).alias("flags"),
        (F.col("n") + n_accounts + 1).cast("long").alias("timestamp"),
    )
