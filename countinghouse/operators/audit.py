"""Audits and summaries: double entry, agreement of copies, intervals, medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import credits_exceed_debits, debits_exceed_credits


def trial_balance(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sums of the four balances of each ledger and whether debits equal credits."""
    ledgers = accounts.select(F.col("id").alias("account_id"), "ledger")
    rows = balances.join(ledgers, "account_id")
    names = ("debits_pending", "debits_posted", "credits_pending", "credits_posted")
    sums = rows.groupBy("ledger").agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("accounts"))
    equal = (F.col("debits_posted") == F.col("credits_posted")) & (F.col("debits_pending") == F.col("credits_pending"))
    return sums.withColumn("balanced", equal)


def limit_breaches(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts whose balances break the limit in their flags."""
    flags = accounts.select(F.col("id").alias("account_id"), "flags")
    rows = balances.join(flags, "account_id")
    return rows.where(debits_exceed_credits(F.lit(0)) | credits_exceed_debits(F.lit(0)))


def double_entry(moves: DataFrame) -> DataFrame:
    """Movements by ledger and type, and those that debit and credit one account or move nothing."""
    same = (F.col("debit_account_id") == F.col("credit_account_id")).cast("long")
    empty = ((F.col("pending") == 0) & (F.col("posted") == 0)).cast("long")
    return moves.groupBy("ledger", "type").agg(F.count("*").alias("movements"), F.sum("amount").alias("amount"), F.sum(same).alias("same_account"), F.sum(empty).alias("empty"))


def smallest_interval(rows: DataFrame, keys: list[str], low: str = "lower", high: str = "upper") -> DataFrame:
    """For each key the narrowest interval that lies in the most of its intervals; touching bounds overlap.

    Bounds are counted by (key, offset) before the running sum, so that sources which agree cost one row.
    """
    bounds = rows.select(*keys, F.explode(F.array(F.struct(F.col(low).alias("at"), F.lit(1).alias("opens"), F.lit(0).alias("closes")), F.struct(F.col(high).alias("at"), F.lit(0).alias("opens"), F.lit(1).alias("closes")))).alias("b")).select(*keys, "b.*")
    by_offset = bounds.groupBy(*keys, "at").agg(F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    order = Window.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = by_offset.withColumn("open", F.sum("opens").over(so_far) - F.sum("closes").over(so_far) + F.col("closes"))
    rows = rows.withColumn("next_at", F.when(F.col("closes") > 0, F.col("at")).otherwise(F.lead("at").over(order)))
    width = F.col("next_at") - F.col("at")
    best = rows.where("opens > 0").groupBy(*keys).agg(F.max(F.struct("open", -width, -F.col("at"), "at", "next_at")).alias("best"))
    total = bounds.groupBy(*keys).agg(F.sum("opens").alias("sources"))
    out = best.join(total, keys)
    return out.select(*keys, F.col("best.at").alias("lower"), F.col("best.next_at").alias("upper"), F.col("best.open").alias("sources_true"), (F.col("sources") - F.col("best.open")).alias("sources_false"))


#: One over the share of ranks by which the bounds of a median may be off.
_ACCURACY = 10_000


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at half the length of each key's sorted values.

    A sketch a key bounds it from both sides; values below the bounds are only counted, and just those between them,
    less than a thousandth of a large key, are ranked.
    """
    margin = 4 / _ACCURACY
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, [0.5 - margin, 0.5 + margin], _ACCURACY).alias("cuts"), F.floor(F.count(value) / 2).alias("half"))
    cuts = cuts.select(*[F.col(k).alias(f"cut_{k}") for k in keys], F.col("cuts")[0].alias("low"), F.col("cuts")[1].alias("high"), "half")
    on = [rows[k].eqNullSafe(cuts[f"cut_{k}"]) for k in keys]
    counted = rows.where(F.col(value).isNotNull()).join(cuts, on).where(F.col(value) <= F.col("high"))
    # Values below the bounds fall into one row a key.
    place = F.when(F.col(value) >= F.col("low"), F.col(value))
    counted = counted.groupBy(*keys, place.alias("value_at"), "half").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(*keys).orderBy(F.col("value_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(so_far))
    return ranked.where((F.col("upto") > F.col("half")) & F.col("value_at").isNotNull()).groupBy(*keys).agg(F.min("value_at").alias("median"))


def quorum(copies: DataFrame, keys: list[str], value: str, copy: str) -> DataFrame:
    """For each key the value most copies agree on, how many do, and which; ties go to the larger value."""
    groups = copies.groupBy(*keys, value).agg(F.count("*").alias("agreeing"), F.array_sort(F.collect_set(copy)).alias("copies"))
    best = groups.groupBy(*keys).agg(F.max(F.struct("agreeing", value, "copies")).alias("best"))
    return best.select(*keys, F.col(f"best.{value}").alias(value), F.col("best.agreeing").alias("agreeing"), F.col("best.copies").alias("copies"))


def counts_by(rows: DataFrame, group: str, across: str, values: list) -> DataFrame:
    """Counts of rows by a column, one column for each of the given values of another."""
    return rows.groupBy(group).agg(*[F.sum((F.col(across) == v).cast("long")).alias(f"n_{v}") for v in values])


def highest(copies: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each key the largest value that any copy reports of each column."""
    return copies.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def fingerprint(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count and an order-free checksum of a table, or of each of its parts: sums of 52 bits of each row's MD5, to compare copies."""
    by = by or []
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).cast("binary")), 1, 13)
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.conv(digits, 16, 10).cast("decimal(38,0)")).alias("checksum"))
