"""Data model: tables, flag bits, status codes and request filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

NS = 1_000_000_000
#: Timestamps are nanoseconds; 0 and the top bit are invalid.
TIMESTAMP_MIN, TIMESTAMP_MAX = 1, 2**63 - 1
#: Most rows of a reply; a larger limit is cut to it.
PAGE_MAX = 8190
#: The largest amount a decimal(38,0) holds; larger ones are rejected at load.
AMOUNT_MAX = 10**38 - 1

# Flag bits.
ACCOUNT_FLAGS = {
    "linked": 1, "debits_must_not_exceed_credits": 2, "credits_must_not_exceed_debits": 4,
    "history": 8, "imported": 16, "closed": 32,
}
TRANSFER_FLAGS = {
    "linked": 1, "pending": 2, "post_pending": 4, "void_pending": 8, "balancing_debit": 16,
    "balancing_credit": 32, "closing_debit": 64, "closing_credit": 128, "imported": 256,
}
ACCOUNT_FILTER_FLAGS = {"debits": 1, "credits": 2, "reversed": 4}
QUERY_FILTER_FLAGS = {"reversed": 1}
#: Bits that account flags may use; LENIENT_ACCOUNT_MASK also lets the three undefined bits pass.
ACCOUNT_MASK, LENIENT_ACCOUNT_MASK, TRANSFER_MASK = 0x3F, 0x1FF, 0x1FF

# The states of a two-phase transfer, which are the types of change events too.
PENDING_STATUS = {"none": 0, "pending": 1, "posted": 2, "voided": 3, "expired": 4}

CREATED = 4294967295
# Result codes, in order of precedence.
ACCOUNT_STATUS = {
    "linked_event_failed": 1, "linked_event_chain_open": 2, "timestamp_must_be_zero": 3, "reserved_field": 4,
    "reserved_flag": 5, "id_must_not_be_zero": 6, "id_must_not_be_int_max": 7, "flags_are_mutually_exclusive": 8,
    "debits_pending_must_be_zero": 9, "debits_posted_must_be_zero": 10, "credits_pending_must_be_zero": 11,
    "credits_posted_must_be_zero": 12, "ledger_must_not_be_zero": 13, "code_must_not_be_zero": 14,
    "exists_with_different_flags": 15, "exists_with_different_user_data_128": 16, "exists_with_different_user_data_64": 17,
    "exists_with_different_user_data_32": 18, "exists_with_different_ledger": 19, "exists_with_different_code": 20,
    "exists": 21, "imported_event_expected": 22, "imported_event_not_expected": 23,
    "imported_event_timestamp_out_of_range": 24, "imported_event_timestamp_must_not_advance": 25,
    "imported_event_timestamp_must_not_regress": 26, "created": CREATED,
}
TRANSFER_STATUS = {
    "linked_event_failed": 1, "linked_event_chain_open": 2, "timestamp_must_be_zero": 3, "reserved_flag": 4,
    "id_must_not_be_zero": 5, "id_must_not_be_int_max": 6, "flags_are_mutually_exclusive": 7,
    "debit_account_id_must_not_be_zero": 8, "debit_account_id_must_not_be_int_max": 9,
    "credit_account_id_must_not_be_zero": 10, "credit_account_id_must_not_be_int_max": 11, "accounts_must_be_different": 12,
    "pending_id_must_be_zero": 13, "pending_id_must_not_be_zero": 14, "pending_id_must_not_be_int_max": 15,
    "pending_id_must_be_different": 16, "timeout_reserved_for_pending_transfer": 17, "ledger_must_not_be_zero": 19,
    "code_must_not_be_zero": 20, "debit_account_not_found": 21, "credit_account_not_found": 22,
    "accounts_must_have_the_same_ledger": 23, "transfer_must_have_the_same_ledger_as_accounts": 24,
    "pending_transfer_not_found": 25, "pending_transfer_not_pending": 26, "pending_transfer_has_different_debit_account_id": 27,
    "pending_transfer_has_different_credit_account_id": 28, "pending_transfer_has_different_ledger": 29,
    "pending_transfer_has_different_code": 30, "exceeds_pending_transfer_amount": 31, "pending_transfer_has_different_amount": 32,
    "pending_transfer_already_posted": 33, "pending_transfer_already_voided": 34, "pending_transfer_expired": 35,
    "exists_with_different_flags": 36, "exists_with_different_debit_account_id": 37, "exists_with_different_credit_account_id": 38,
    "exists_with_different_amount": 39, "exists_with_different_pending_id": 40, "exists_with_different_user_data_128": 41,
    "exists_with_different_user_data_64": 42, "exists_with_different_user_data_32": 43, "exists_with_different_timeout": 44,
    "exists_with_different_code": 45, "exists": 46, "overflows_debits_pending": 47, "overflows_credits_pending": 48,
    "overflows_debits_posted": 49, "overflows_credits_posted": 50, "overflows_debits": 51, "overflows_credits": 52,
    "overflows_timeout": 53, "exceeds_credits": 54, "exceeds_debits": 55, "imported_event_expected": 56,
    "imported_event_not_expected": 57, "imported_event_timestamp_out_of_range": 58, "imported_event_timestamp_must_not_advance": 59,
    "imported_event_timestamp_must_not_regress": 60, "imported_event_timestamp_must_postdate_debit_account": 61,
    "imported_event_timestamp_must_postdate_credit_account": 62, "imported_event_timeout_must_be_zero": 63,
    "closing_transfer_must_be_pending": 64, "debit_account_already_closed": 65, "credit_account_already_closed": 66,
    "exists_with_different_ledger": 67, "id_already_failed": 68, "created": CREATED,
}
# Fields that a request with a known id is compared by, in order, and the code where they differ.
ACCOUNT_DIFFERS = {"flags": 15, "user_data_128": 16, "user_data_64": 17, "user_data_32": 18, "ledger": 19, "code": 20}
TRANSFER_DIFFERS = {
    "flags": 36, "debit_account_id": 37, "credit_account_id": 38, "amount": 39, "pending_id": 40, "user_data_128": 41,
    "user_data_64": 42, "user_data_32": 43, "timeout": 44, "code": 45, "ledger": 67,
}
# The wire numbers of operations.
OPERATIONS = {
    "pulse": 128, "get_change_events": 137, "lookup_accounts": 140, "lookup_transfers": 141, "get_account_transfers": 142, "get_account_balances": 143,
    "query_accounts": 144, "query_transfers": 145, "create_accounts": 146, "create_transfers": 147,
}
#: Failures that depend on the state of the ledger; the id of a transfer that fails so may not be used again.
TRANSIENT = (21, 22, 25, 54, 55, 65, 66)

_AMOUNT = T.DecimalType(38, 0)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_L, _I = T.LongType(), T.IntegerType()
ACCOUNT_SCHEMA = _schema(
    ("id", _L), ("debits_pending", _AMOUNT), ("debits_posted", _AMOUNT), ("credits_pending", _AMOUNT), ("credits_posted", _AMOUNT),
    ("user_data_128", _L), ("user_data_64", _L), ("user_data_32", _L), ("ledger", _L), ("code", _I), ("flags", _I), ("timestamp", _L),
)
TRANSFER_SCHEMA = _schema(
    ("id", _L), ("debit_account_id", _L), ("credit_account_id", _L), ("amount", _AMOUNT), ("pending_id", _L), ("user_data_128", _L),
    ("user_data_64", _L), ("user_data_32", _L), ("timeout", _L), ("ledger", _L), ("code", _I), ("flags", _I), ("timestamp", _L),
)


class _Filter:
    def _valid(self, mask: int) -> bool:
        bounds = (self.timestamp_min, self.timestamp_max)
        in_range = all(0 <= b <= TIMESTAMP_MAX for b in bounds) and not (self.timestamp_max and self.timestamp_min > self.timestamp_max)
        return in_range and self.limit > 0 and not self.flags & ~mask


@dataclass(frozen=True)
class AccountFilter(_Filter):
    """Transfers or balances of one account. Zero means no filter; bounds are inclusive; a limit is needed."""

    account_id: int
    user_data_128: int = 0
    user_data_64: int = 0
    user_data_32: int = 0
    code: int = 0
    timestamp_min: int = 0
    timestamp_max: int = 0
    limit: int = 0
    flags: int = ACCOUNT_FILTER_FLAGS["debits"] | ACCOUNT_FILTER_FLAGS["credits"]

    def valid(self) -> bool:
        return self.account_id > 0 and bool(self.flags & 3) and self._valid(7)

    @property
    def reversed(self) -> bool:
        return bool(self.flags & ACCOUNT_FILTER_FLAGS["reversed"])


@dataclass(frozen=True)
class QueryFilter(_Filter):
    """Accounts or transfers by equality on any of the fields. Zero means no filter."""

    user_data_128: int = 0
    user_data_64: int = 0
    user_data_32: int = 0
    ledger: int = 0
    code: int = 0
    timestamp_min: int = 0
    timestamp_max: int = 0
    limit: int = 0
    flags: int = 0

    def valid(self) -> bool:
        return self._valid(1)

    @property
    def reversed(self) -> bool:
        return bool(self.flags & QUERY_FILTER_FLAGS["reversed"])


@dataclass(frozen=True)
class ChangeEventsFilter(_Filter):
    """Change events of a stretch of time."""

    timestamp_min: int = 0
    timestamp_max: int = 0
    limit: int = 0
    flags: int = 0

    def valid(self) -> bool:
        return self._valid(0)
