"""Derived columns of accounts, transfers and events, and the registry that names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ACCOUNT_FLAGS, NS, OPERATIONS, PENDING_STATUS, TIMESTAMP_MAX, TIMESTAMP_MIN, TRANSFER_FLAGS, TRANSIENT


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def has(flags: str | Column, bit: int) -> Column:
    """Whether any of the bits is set."""
    return col(flags).bitwiseAND(F.lit(bit)) != 0


def reserved_bits(flags: str | Column, mask: int) -> Column:
    return has(flags, ~mask & 0xFFFF)


def with_closed(flags: str | Column) -> Column:
    return col(flags).bitwiseOR(F.lit(ACCOUNT_FLAGS["closed"]))


def without_closed(flags: str | Column) -> Column:
    return col(flags).bitwiseAND(F.lit(~ACCOUNT_FLAGS["closed"] & 0xFFFF))


def account_limits_exclude(flags: str | Column) -> Column:
    """Both balance limits at once, which is invalid."""
    both = ACCOUNT_FLAGS["debits_must_not_exceed_credits"] | ACCOUNT_FLAGS["credits_must_not_exceed_debits"]
    return col(flags).bitwiseAND(F.lit(both)) == both


def post_xor_void(flags: str | Column) -> Column:
    return has(flags, TRANSFER_FLAGS["post_pending"]) != has(flags, TRANSFER_FLAGS["void_pending"])


def nonzero(name: str | Column) -> Column:
    """The value, null where it is 0: zero stands for none."""
    return F.nullif(col(name), F.lit(0))


def debits_exceed_credits(amount: str | Column) -> Column:
    over = F.col("debits_pending") + F.col("debits_posted") + col(amount) > F.col("credits_posted")
    return has("flags", ACCOUNT_FLAGS["debits_must_not_exceed_credits"]) & over


def credits_exceed_debits(amount: str | Column) -> Column:
    over = F.col("credits_pending") + F.col("credits_posted") + col(amount) > F.col("debits_posted")
    return has("flags", ACCOUNT_FLAGS["credits_must_not_exceed_debits"]) & over


def transient(status: str | Column) -> Column:
    return col(status).isin(*TRANSIENT)


def valid_timestamp(name: str | Column) -> Column:
    return col(name).between(TIMESTAMP_MIN, TIMESTAMP_MAX)


def expires_at() -> Column:
    """When a pending transfer with a timeout expires, else null."""
    pending = has("flags", TRANSFER_FLAGS["pending"]) & (F.col("timeout") > 0)
    return F.when(pending, F.col("timestamp") + F.col("timeout") * NS)


def when_expired(name: str) -> Column:
    return F.when(F.col("transfer_pending_status") == PENDING_STATUS["expired"], F.col(name))


def prunable() -> Column:
    """Neither account of an event keeps a history."""
    return ~has("dr_account_flags", ACCOUNT_FLAGS["history"]) & ~has("cr_account_flags", ACCOUNT_FLAGS["history"])


def sort_key(field: str | Column, timestamp: str | Column = "timestamp") -> Column:
    """A composite key that orders by field, then by timestamp."""
    return F.struct(col(field).alias("field"), col(timestamp).alias("timestamp"))


def div_ceil(a: str | Column, b: int) -> Column:
    return F.expr(f"({a} + {b - 1}) DIV {b}") if isinstance(a, str) else ((a + (b - 1)) / b).cast("long")


def align_forward(name: str, step: int) -> Column:
    return div_ceil(name, step) * step


def checkpoint_of(op: str, interval: int) -> Column:
    """The last multiple of the interval, less one, that an operation number has reached; 0 before the first."""
    return F.when(F.col(op) < interval - 1, F.lit(0)).otherwise(((F.col(op) + 1) / interval).cast("long") * interval - 1)


def fastrange(hash_: str | Column, n: int) -> Column:
    """A number below n from a 64-bit hash, in proportion to its unsigned value; a decimal hash beyond 64 bits isn't cut to them."""
    whole, signed = F.lit(str(1 << 64)).cast("decimal(20,0)"), col(hash_).cast("decimal(38,0)")
    unsigned = F.when(signed < 0, signed + whole).otherwise(signed).cast("decimal(38,0)")
    return F.call_function("div", unsigned * F.lit(n).cast("decimal(10,0)"), whole)


#: Nanoseconds of a unit of time.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": NS, "m": 60 * NS, "h": 3600 * NS, "d": 86_400 * NS}


def duration(value: str | Column, unit: str) -> Column:
    """Nanoseconds of a whole number of units."""
    return col(value).cast("long") * F.lit(UNITS[unit])


def in_unit(nanos: str | Column, unit: str) -> Column:
    """Whole units in a duration, rounded down."""
    return F.floor(col(nanos) / F.lit(UNITS[unit])).cast("long")


def clamp(value: str | Column, low: int, high: int) -> Column:
    return F.least(F.greatest(col(value), F.lit(low)), F.lit(high))


def operation_name(code: str | Column) -> Column:
    """The name of an operation by its wire number, null if there is none."""
    return F.coalesce(*[F.when(col(code) == n, name) for name, n in OPERATIONS.items()])


def unit_draw(*columns: str | Column) -> Column:
    """A number above 0 and up to 1 that the columns' values decide, from the first 13 hex digits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *[col(c).cast("string") for c in columns]).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float((1 << 52) + 1))


def display_id(name: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(col(name)), 32, "0"))


#: Derived columns by name: what a table of transfers, accounts or events is "indexed" by. Users may add theirs.
REGISTRY: dict[str, Callable[[], Column]] = {
    "expires_at": expires_at,
    "prunable": prunable,
    "imported": lambda: has("flags", TRANSFER_FLAGS["imported"]),
    "closing": lambda: has("flags", TRANSFER_FLAGS["closing_debit"] | TRANSFER_FLAGS["closing_credit"]),
    "user_data_128_indexed": lambda: nonzero("user_data_128"),
    "user_data_64_indexed": lambda: nonzero("user_data_64"),
    "user_data_32_indexed": lambda: nonzero("user_data_32"),
    "pending_id_indexed": lambda: nonzero("pending_id"),
    "account_imported": lambda: has("flags", ACCOUNT_FLAGS["imported"]),
    "account_closed": lambda: has("flags", ACCOUNT_FLAGS["closed"]),
    "dr_account_id_expired": lambda: when_expired("dr_account_id"),
    "cr_account_id_expired": lambda: when_expired("cr_account_id"),
    "pending_id_expired": lambda: when_expired("transfer_pending_id"),
    "ledger_expired": lambda: when_expired("ledger"),
}


def derived(*names: str) -> dict[str, Column]:
    """For df.withColumns: the registered columns of these names."""
    return {n: REGISTRY[n]() for n in names}
