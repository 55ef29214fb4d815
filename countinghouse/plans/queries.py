"""The registered ledger queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_folder
from ..functions.columns import (
    align_forward, checkpoint_of, clamp, derived, display_id, div_ceil, duration, fastrange, has, in_unit, nonzero, operation_name, post_xor_void, sort_key, transient,
    valid_timestamp, with_closed, without_closed,
)
from ..model import OPERATIONS, TRANSIENT, AccountFilter, ChangeEventsFilter, QueryFilter
from ..operators import audit, combine, events, fold, pending, query, validate
from ..sources import derived as tables
from ..sources import generator
from ..sources.derived import ACCOUNTS_SQL, TRANSFERS_SQL, TWO_PHASE_SQL
from ..streaming import flows

NOW = 988_000_000_000_000_000
_A, _T, _P = (f"WITH {x}" for x in (ACCOUNTS_SQL, TRANSFERS_SQL, TWO_PHASE_SQL))
_REGISTRY: dict = {}


def register(sql: str | None):
    def add(f):
        _REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _moved(df: DataFrame) -> DataFrame:
    """The columns of transfers that are compared."""
    return _longs(df.select("id", "debit_account_id", "credit_account_id", "amount", "code", "user_data_64", "timestamp"), "amount", "code")


_MOVED = "SELECT id, debit_account_id, credit_account_id, amount, CAST(code AS BIGINT) AS code, user_data_64, timestamp FROM transfers"
_SEEN = "SELECT id, CAST(ledger AS BIGINT) AS ledger, CAST(code AS BIGINT) AS code, CAST(flags AS BIGINT) AS flags, user_data_64, timestamp FROM accounts"


def _seen(df: DataFrame) -> DataFrame:
    return _longs(df.select("id", "ledger", "code", "flags", "user_data_64", "timestamp"), "code", "flags")


# --- lookups

_ASKED = [3, 1, 1_000_000_002, 2_000_000_000, 77, 999_999_999, 3]
_ASKED_SQL = ", ".join(f"({i}, {n})" for n, i in enumerate(_ASKED))


@register(f"{_A} SELECT CAST(p AS BIGINT) AS position, x.* FROM ({_SEEN}) x JOIN (VALUES {_ASKED_SQL}) v(i, p) ON x.id = i")
def lookup_accounts(spark, d):
    found = query.lookup(tables.accounts(spark, d), _ASKED)
    return _longs(found.select("position", "id", "ledger", "code", "flags", "user_data_64", "timestamp"), "code", "flags")


@register(f"{_T} SELECT CAST(p AS BIGINT) AS position, x.* FROM ({_MOVED}) x JOIN (VALUES {_ASKED_SQL}) v(i, p) ON x.id = i")
def lookup_transfers(spark, d):
    found = query.lookup(tables.transfers(spark, d), _ASKED)
    return _longs(found.select("position", "id", "debit_account_id", "credit_account_id", "amount", "code", "user_data_64", "timestamp"), "amount", "code")


@register(f"{_A} SELECT DISTINCT CAST(o_custkey + 1 + 40 * (o_orderkey % 3) AS BIGINT) AS id FROM orders WHERE o_custkey + 1 + 40 * (o_orderkey % 3) NOT IN (SELECT id FROM accounts)")
def lookup_missing_ids(spark, d):
    asked = tables.table(spark, d, "orders").select((F.col("o_custkey") + 1 + 40 * (F.col("o_orderkey") % 3)).cast("long").alias("id"))
    return query.missing_ids(tables.accounts(spark, d), asked)


@register(f"{_A}, i AS (SELECT DISTINCT CAST(o_custkey + 1 + 40 * (o_orderkey % 3) AS BIGINT) AS id FROM orders) SELECT id, id IN (SELECT id FROM accounts) AS found FROM i")
def lookup_batch_status(spark, d):
    asked = tables.table(spark, d, "orders").select((F.col("o_custkey") + 1 + 40 * (F.col("o_orderkey") % 3)).cast("long").alias("id"))
    return query.lookup_status(tables.accounts(spark, d), asked)


@register(f"{_T}, w AS (SELECT timestamp AS moment, row_number() OVER (ORDER BY id) - 1 AS p FROM transfers WHERE id IN (1, 5, 17, 100)) SELECT CAST(p AS BIGINT) AS position, x.* FROM ({_MOVED}) x JOIN w ON x.timestamp = moment")
def lookup_by_timestamp(spark, d):
    rows = tables.transfers(spark, d)
    asked = [r["timestamp"] for r in rows.where(F.col("id").isin(1, 5, 17, 100)).orderBy("id").select("timestamp").collect()]
    found = query.lookup(rows, asked, key="timestamp")
    return _longs(found.select("position", "id", "debit_account_id", "credit_account_id", "amount", "code", "user_data_64", "timestamp"), "amount", "code")


# --- transfers of an account

_ACCOUNT, _SHOP = 7, 1_000_000_003
_FROM, _TO = 1_704_500_000_000_000_000, 1_706_000_000_000_000_000


def _of_account(name: str, f: AccountFilter, where: str) -> None:
    order = "DESC" if f.reversed else "ASC"

    def run(spark, d):
        return _moved(query.account_transfers(tables.transfers(spark, d), f))

    run.__name__ = name
    register(f"{_T} {_MOVED} WHERE {where} ORDER BY timestamp {order} LIMIT {f.limit}")(run)


_of_account("account_transfers_debits", AccountFilter(_ACCOUNT, limit=8190, flags=1), f"debit_account_id = {_ACCOUNT}")
_of_account("account_transfers_credits", AccountFilter(_SHOP, limit=8190, flags=2), f"credit_account_id = {_SHOP}")
_of_account("account_transfers_both", AccountFilter(_ACCOUNT, limit=50, flags=7), f"debit_account_id = {_ACCOUNT} OR credit_account_id = {_ACCOUNT}")
_of_account("account_transfers_window", AccountFilter(_SHOP, timestamp_min=_FROM, timestamp_max=_TO, limit=8190), f"credit_account_id = {_SHOP} AND timestamp BETWEEN {_FROM} AND {_TO}")
_of_account("account_transfers_reversed_limit", AccountFilter(_SHOP, limit=25, flags=7), f"credit_account_id = {_SHOP}")
_of_account("account_transfers_code", AccountFilter(_ACCOUNT, code=3, limit=8190), f"debit_account_id = {_ACCOUNT} AND code = 3")
_of_account("account_transfers_user_data", AccountFilter(_SHOP, user_data_64=5, limit=8190), f"credit_account_id = {_SHOP} AND user_data_64 = 5")
_of_account("account_transfers_invalid_filter", AccountFilter(_SHOP, limit=0), "false")


# --- queries by field

@register(f"{_A} {_SEEN} WHERE ledger = 1 AND code = 30 ORDER BY timestamp LIMIT 8190")
def query_accounts_ledger_code(spark, d):
    return _seen(query.query(tables.accounts(spark, d), QueryFilter(ledger=1, code=30, limit=8190)))


def _by_field(name: str, f: QueryFilter, where: str) -> None:
    def run(spark, d):
        return _moved(query.query(tables.transfers(spark, d), f))

    run.__name__ = name
    register(f"{_T} {_MOVED} WHERE {where} ORDER BY timestamp {'DESC' if f.reversed else 'ASC'} LIMIT {f.limit}")(run)


_by_field("query_transfers_code_window", QueryFilter(code=2, timestamp_min=_FROM, timestamp_max=_TO, limit=8190), f"code = 2 AND timestamp BETWEEN {_FROM} AND {_TO}")
_by_field("query_transfers_reversed", QueryFilter(ledger=1, limit=100, flags=1), "ledger = 1")
_by_field("query_transfers_user_data", QueryFilter(user_data_64=3, code=4, limit=8190), "user_data_64 = 3 AND code = 4")


@register(f"{_T}, p AS (SELECT max(timestamp) AS last FROM (SELECT timestamp FROM transfers ORDER BY timestamp LIMIT 100)) {_MOVED}, p WHERE timestamp > last ORDER BY timestamp LIMIT 100")
def keyset_page(spark, d):
    rows = tables.transfers(spark, d)
    last = rows.orderBy("timestamp").limit(100).agg(F.max("timestamp")).first()[0]
    return _moved(query.next_page(rows, last or 0, 100))


# --- balances

_BALANCES = ("debits_pending", "debits_posted", "credits_pending", "credits_posted")
_RESOLVED = f"""{_P},
ranked AS (SELECT res.*, expires_at, pend.timestamp AS p_at, row_number() OVER (PARTITION BY pending_id ORDER BY res.timestamp) AS n FROM res JOIN pend ON pend.id = pending_id),
done AS (SELECT * FROM ranked WHERE n = 1 AND timestamp < expires_at AND timestamp <= {NOW}),
st AS (SELECT pend.*, done.timestamp AS resolved_at, CASE WHEN done.flags = 4 THEN 2 WHEN done.flags = 8 THEN 3 WHEN pend.expires_at <= {NOW} THEN 4 ELSE 1 END AS status
       FROM pend LEFT JOIN done ON done.pending_id = pend.id WHERE pend.timestamp <= {NOW}),
mv AS MATERIALIZED (
  SELECT timestamp, id AS transfer_id, dr, cr, amount, 1 AS type, amount AS pending, 0 AS posted FROM st
  UNION ALL SELECT timestamp, id, dr, cr, amount, CASE flags WHEN 4 THEN 2 ELSE 3 END, -amount, CASE flags WHEN 4 THEN amount ELSE 0 END FROM done
  UNION ALL SELECT expires_at, id, dr, cr, amount, 4, -amount, 0 FROM st WHERE status = 4),
en AS MATERIALIZED (
  SELECT timestamp, transfer_id, type, dr AS account_id, 'debit' AS side, pending AS dp, posted AS dc, 0 AS cp, 0 AS cc FROM mv
  UNION ALL SELECT timestamp, transfer_id, type, cr, 'credit', 0, 0, pending, posted FROM mv)"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {n}" for c, n in zip(("dp", "dc", "cp", "cc"), _BALANCES))


def _two_phase_moves(spark, d):
    return events.movements(tables.two_phase(spark, d), NOW)


@register(f"{_RESOLVED} SELECT account_id, {_SUMS} FROM en GROUP BY account_id")
def account_balances_total(spark, d):
    return _longs(events.totals(_two_phase_moves(spark, d)), *_BALANCES)


@register(f"""{_RESOLVED} SELECT timestamp, transfer_id, account_id, side,
 {', '.join(f"CAST(sum({c}) OVER (PARTITION BY account_id ORDER BY timestamp, transfer_id, side ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {n}" for c, n in zip(('dp', 'dc', 'cp', 'cc'), _BALANCES))} FROM en""")
def running_balances(spark, d):
    return _longs(events.running(_two_phase_moves(spark, d)).drop("type", "ledger", "pending_id", "amount"), *_BALANCES)


@register(f"""{_T}, e AS (SELECT timestamp, sum(amount) OVER (ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS c FROM transfers WHERE credit_account_id = {_SHOP})
SELECT timestamp, CAST(0 AS BIGINT) AS debits_pending, CAST(0 AS BIGINT) AS debits_posted, CAST(0 AS BIGINT) AS credits_pending, CAST(c AS BIGINT) AS credits_posted FROM e ORDER BY timestamp DESC LIMIT 500""")
def account_balance_history(spark, d):
    rows = events.account_balances(events.movements(tables.transfers(spark, d)), tables.accounts(spark, d), AccountFilter(_SHOP, limit=500, flags=7))
    return _longs(rows, *_BALANCES)


_AS_OF = 800_000_000_000_000_000


@register(f"{_RESOLVED} SELECT account_id, {_SUMS} FROM en WHERE timestamp <= {_AS_OF} GROUP BY account_id")
def balance_as_of(spark, d):
    return _longs(events.balances_as_of(_two_phase_moves(spark, d), _AS_OF), *_BALANCES)


@register(f"""{_RESOLVED}, {ACCOUNTS_SQL}, b AS (SELECT account_id, {_SUMS} FROM en GROUP BY account_id)
SELECT CAST(ledger AS BIGINT) AS ledger, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in _BALANCES)}, count(*) AS accounts,
       sum(debits_posted) = sum(credits_posted) AND sum(debits_pending) = sum(credits_pending) AS balanced FROM b JOIN accounts ON id = account_id GROUP BY ledger""")
def ledger_trial_balance(spark, d):
    rows = audit.trial_balance(events.totals(_two_phase_moves(spark, d)), tables.accounts(spark, d))
    return _longs(rows, *_BALANCES)


@register(f"""{_RESOLVED}, {ACCOUNTS_SQL}, b AS (SELECT account_id, {_SUMS} FROM en GROUP BY account_id)
SELECT b.* FROM b JOIN accounts ON id = account_id WHERE (code = 30 AND debits_pending + debits_posted > credits_posted) OR (code = 10 AND id % 3 = 0 AND debits_pending + debits_posted > credits_posted)""")
def limit_breaches(spark, d):
    flags = F.when((F.col("code") == 30) | ((F.col("code") == 10) & (F.col("id") % 3 == 0)), 2).otherwise(0)
    rows = audit.limit_breaches(events.totals(_two_phase_moves(spark, d)), tables.accounts(spark, d).withColumn("flags", flags))
    return _longs(rows.drop("flags"), *_BALANCES)


# --- two-phase transfers

@register(f"{_RESOLVED} SELECT id, CAST(amount AS BIGINT) AS amount, timestamp, expires_at, resolved_at, CAST(status AS BIGINT) AS status FROM st")
def pending_status(spark, d):
    rows = pending.pending_status(tables.two_phase(spark, d), NOW)
    return _longs(rows.select("id", "amount", "timestamp", "expires_at", "resolved_at", "status"), "amount", "status")


@register(f"{_RESOLVED} SELECT id, expires_at FROM st WHERE status = 4")
def expires_at_due(spark, d):
    return pending.due(tables.two_phase(spark, d), NOW).select("id", "expires_at")


@register(f"{_RESOLVED} SELECT timestamp, transfer_id, CAST(amount AS BIGINT) AS amount, CAST(1 AS BIGINT) AS ledger, dr AS debit_account_id, cr AS credit_account_id FROM mv WHERE type = 4")
def expired_events(spark, d):
    rows = _two_phase_moves(spark, d).where("type = 4").select("timestamp", "transfer_id", "amount", "ledger", "debit_account_id", "credit_account_id")
    return _longs(rows, "amount")


@register(f"{_P} SELECT res.id, pending_id, CAST(CASE WHEN res.timestamp >= expires_at THEN 35 END AS BIGINT) AS status, expires_at FROM res JOIN pend ON pend.id = pending_id")
def resolver_join(spark, d):
    return _longs(pending.resolve(tables.two_phase(spark, d)).select("id", "pending_id", "status", F.col("p_expires_at").alias("expires_at")), "status")


@register(f"""{_RESOLVED} SELECT account_id, side, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS transfers
FROM (SELECT dr AS account_id, 'debit' AS side, amount FROM st WHERE status = 1 UNION ALL SELECT cr, 'credit', amount FROM st WHERE status = 1) GROUP BY account_id, side""")
def pending_outstanding(spark, d):
    return _longs(pending.outstanding(tables.two_phase(spark, d), NOW), "amount")


# --- change events

def _events(spark, d):
    """The movements with both accounts' flags and timestamps."""
    return events.event_flags(_two_phase_moves(spark, d), tables.accounts(spark, d))


_EVENTS = f"""{_RESOLVED}, {ACCOUNTS_SQL},
run AS MATERIALIZED (SELECT *, {', '.join(f"sum({c}) OVER (PARTITION BY account_id ORDER BY timestamp, transfer_id, side ROWS UNBOUNDED PRECEDING) AS r_{c}" for c in ('dp', 'dc', 'cp', 'cc'))} FROM en),
ev AS MATERIALIZED (SELECT mv.timestamp, mv.transfer_id, mv.type, mv.dr, mv.cr, mv.amount, a.r_dp AS dr_dp, a.r_dc AS dr_dc, b.r_cp AS cr_cp, b.r_cc AS cr_cc,
              x.flags AS dr_flags, y.flags AS cr_flags, x.timestamp AS dr_at, y.timestamp AS cr_at, x.user_data_64 AS dr_u64, y.user_data_64 AS cr_u64
       FROM mv JOIN run a ON a.transfer_id = mv.transfer_id AND a.type = mv.type AND a.side = 'debit' JOIN run b ON b.transfer_id = mv.transfer_id AND b.type = mv.type AND b.side = 'credit'
       JOIN accounts x ON x.id = mv.dr JOIN accounts y ON y.id = mv.cr)"""
_EV_FROM, _EV_TO = 700_000_000_000_000_000, 900_000_000_000_000_000


@register(f"""{_EVENTS}, t AS (SELECT id, timestamp FROM pend UNION ALL SELECT id, timestamp FROM res)
SELECT ev.timestamp, transfer_id, CAST(type AS BIGINT) AS transfer_pending_status, dr AS dr_account_id, cr AS cr_account_id, CAST(ev.amount AS BIGINT) AS amount,
CAST(dr_dp AS BIGINT) AS dr_debits_pending, CAST(dr_dc AS BIGINT) AS dr_debits_posted, CAST(cr_cp AS BIGINT) AS cr_credits_pending, CAST(cr_cc AS BIGINT) AS cr_credits_posted,
CAST(CASE WHEN transfer_id % 2 = 0 THEN 432000 ELSE 0 END AS BIGINT) AS transfer_timeout, CAST(10 AS BIGINT) AS dr_account_code, CAST(30 AS BIGINT) AS cr_account_code,
t.timestamp AS transfer_timestamp, CAST(0 AS BIGINT) AS dr_account_user_data_128, dr_u64 AS dr_account_user_data_64, CAST(0 AS BIGINT) AS dr_account_user_data_32, cr_u64 AS cr_account_user_data_64,
dr_at AS dr_account_timestamp, cr_at AS cr_account_timestamp, CAST(dr_flags AS BIGINT) AS dr_account_flags, CAST(cr_flags AS BIGINT) AS cr_account_flags
FROM ev JOIN t ON t.id = transfer_id WHERE ev.timestamp BETWEEN {_EV_FROM} AND {_EV_TO} ORDER BY ev.timestamp LIMIT 2000""")
def change_events_window(spark, d):
    f = ChangeEventsFilter(_EV_FROM, _EV_TO, limit=2000)
    rows = events.change_events(_two_phase_moves(spark, d), tables.two_phase(spark, d), tables.accounts(spark, d), f)
    names = (
        "timestamp", "transfer_id", "transfer_pending_status", "dr_account_id", "cr_account_id", "amount", "dr_debits_pending", "dr_debits_posted", "cr_credits_pending", "cr_credits_posted", "transfer_timeout",
        "dr_account_code", "cr_account_code", "transfer_timestamp", "dr_account_user_data_128", "dr_account_user_data_64", "dr_account_user_data_32", "cr_account_user_data_64", "dr_account_timestamp", "cr_account_timestamp",
        "dr_account_flags", "cr_account_flags",
    )
    return _longs(rows.select(*names), *names)


@register(f"{_RESOLVED} SELECT CAST(type AS BIGINT) AS type, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM mv GROUP BY type")
def change_event_types(spark, d):
    rows = _two_phase_moves(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return _longs(rows, "type", "amount")


@register(f"{_EVENTS} SELECT dr_at AS account_timestamp, timestamp FROM ev WHERE dr_flags & 8 <> 0 UNION ALL SELECT cr_at, timestamp FROM ev WHERE cr_flags & 8 <> 0")
def account_timestamp_index(spark, d):
    return events.history_index(_events(spark, d))


@register(f"""{_EVENTS} SELECT timestamp, transfer_id, CAST(type AS BIGINT) AS type, dr AS dr_account_id, cr AS cr_account_id,
CAST(dr_dp AS BIGINT) AS dr_debits_pending, CAST(dr_dc AS BIGINT) AS dr_debits_posted, CAST(cr_cp AS BIGINT) AS cr_credits_pending, CAST(cr_cc AS BIGINT) AS cr_credits_posted FROM ev""")
def account_events(spark, d):
    """Every event with both accounts' balances after it."""
    rows = events.account_events(_two_phase_moves(spark, d), tables.accounts(spark, d)).withColumnRenamed("transfer_pending_status", "type")
    names = ("timestamp", "transfer_id", "type", "dr_account_id", "cr_account_id", "dr_debits_pending", "dr_debits_posted", "cr_credits_pending", "cr_credits_posted")
    return _longs(rows.select(*names), *names)


@register(f"{_EVENTS} SELECT timestamp, transfer_id FROM ev WHERE dr_flags & 8 = 0 AND cr_flags & 8 = 0")
def prunable_events(spark, d):
    return events.prunable_events(_events(spark, d)).select("timestamp", "transfer_id")


@register(f"{_EVENTS} SELECT timestamp, transfer_id FROM ev WHERE NOT (dr_flags & 8 = 0 AND cr_flags & 8 = 0)")
def history_events(spark, d):
    return events.keep_unprunable(_events(spark, d)).select("timestamp", "transfer_id")


@register(f"""{_RESOLVED} SELECT timestamp, CASE type WHEN 4 THEN dr END AS dr_account_id_expired, CASE type WHEN 4 THEN cr END AS cr_account_id_expired,
CASE type WHEN 4 THEN transfer_id END AS pending_id_expired, CAST(CASE type WHEN 4 THEN 1 END AS BIGINT) AS ledger_expired FROM mv""")
def expired_index(spark, d):
    names = ("dr_account_id_expired", "cr_account_id_expired", "pending_id_expired", "ledger_expired")
    rows = _two_phase_moves(spark, d).withColumnsRenamed({"type": "transfer_pending_status", "pending_id": "transfer_pending_id", "debit_account_id": "dr_account_id", "credit_account_id": "cr_account_id"})
    return rows.withColumns(derived(*names)).select("timestamp", *names)


@register(f"{_RESOLVED} SELECT id, CAST(status AS BIGINT) AS transfer_pending_status_indexed FROM st UNION ALL SELECT id, NULL FROM res")
def pending_status_index(spark, d):
    return _longs(pending.status_index(tables.two_phase(spark, d), NOW), "transfer_pending_status_indexed")


# --- derived columns

@register(f"""{_P} SELECT id, CAST(expires_at AS BIGINT) AS expires_at, CAST(NULL AS BIGINT) AS pending_id_indexed, false AS closing, false AS imported FROM pend
UNION ALL SELECT id, NULL, pending_id, false, false FROM res""")
def transfer_indexes(spark, d):
    names = ("expires_at", "pending_id_indexed", "closing", "imported")
    return tables.two_phase(spark, d).withColumns(derived(*names)).select("id", *names)


@register(f"{_A} SELECT id, flags & 8 <> 0 AS history, flags & 32 <> 0 AS closed, nullif(user_data_64, 0) AS user_data_64_indexed, timestamp BETWEEN 1 AND 9223372036854775807 AS valid_timestamp FROM accounts")
def account_flags(spark, d):
    rows = tables.accounts(spark, d)
    return rows.select("id", has("flags", 8).alias("history"), has("flags", 32).alias("closed"), nonzero("user_data_64").alias("user_data_64_indexed"), valid_timestamp("timestamp").alias("valid_timestamp"))


@register(f"{_P}, t AS (SELECT id, 2 AS flags, timestamp, 1 AS code FROM pend UNION ALL SELECT id, flags, timestamp, 1 FROM res) SELECT id, CAST(flags | 32 AS BIGINT) AS closed, CAST(flags & ~32 AS BIGINT) AS opened, (flags & 4 <> 0) <> (flags & 8 <> 0) AS resolves, id % 70 IN ({', '.join(map(str, TRANSIENT))}) AS passing, CAST(1 AS BIGINT) AS key_field, timestamp AS key_timestamp FROM t")
def flag_columns(spark, d):
    """Flags set and cleared, one of two flags, passing failures and composite keys."""
    rows = tables.two_phase(spark, d).withColumn("key", sort_key("code"))
    out = rows.select("id", with_closed("flags").alias("closed"), without_closed("flags").alias("opened"), post_xor_void("flags").alias("resolves"), transient(F.col("id") % 70).alias("passing"), F.col("key.field").alias("key_field"), F.col("key.timestamp").alias("key_timestamp"))
    return _longs(out, "closed", "opened", "key_field")


@register("""SELECT CAST(o_orderkey AS BIGINT) AS k, CAST((o_custkey + 7) // 8 AS BIGINT) AS blocks, CAST((o_custkey + 7) // 8 * 8 AS BIGINT) AS aligned, CAST(CASE WHEN o_orderkey < 959 THEN 0 ELSE (o_orderkey + 1) // 960 * 960 - 1 END AS BIGINT) AS checkpoint,
lpad(lower(to_hex(o_orderkey)), 32, '0') AS shown, CAST(o_custkey * 60000000000 AS BIGINT) AS nanos, CAST(o_custkey // 60 AS BIGINT) AS hours, CAST(least(greatest(o_custkey, 10), 500) AS BIGINT) AS clamped,
CAST((o_orderkey::HUGEINT * 900000000000000 * 1000) // 18446744073709551616::HUGEINT AS BIGINT) AS bucket FROM orders""")
def number_columns(spark, d):
    """Division and alignment upwards, checkpoints of operations, ids as text, durations and ranges."""
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    rows = tables.table(spark, d, "orders").select(k.alias("k"), c.alias("c"), (k.cast("decimal(20,0)") * F.lit(900_000_000_000_000).cast("decimal(18,0)")).alias("hash"), duration(c, "m").alias("nanos"))
    out = rows.select("k", div_ceil("c", 8).alias("blocks"), align_forward("c", 8).alias("aligned"), checkpoint_of("k", 960).alias("checkpoint"), display_id("k").alias("shown"), "nanos", in_unit("nanos", "h").alias("hours"), clamp("c", 10, 500).alias("clamped"), fastrange("hash", 1000).alias("bucket"))
    return _longs(out, "blocks", "aligned", "checkpoint", "clamped", "bucket")


@register(f"WITH n AS (SELECT * FROM (VALUES {', '.join(f'({n}, {name!r})' for name, n in OPERATIONS.items())}) AS v(code, name)) SELECT CAST(128 + event_id % 20 AS BIGINT) AS operation, name, count(*) AS events FROM events LEFT JOIN n ON code = 128 + event_id % 20 GROUP BY ALL")
def operation_names(spark, d):
    rows = tables.table(spark, d, "events").select((128 + F.col("event_id") % 20).cast("long").alias("operation"))
    return rows.withColumn("name", operation_name("operation")).groupBy("operation", "name").agg(F.count("*").alias("events"))


# --- merges and versions

@register(f"""{_T}, u AS (SELECT id, 0 AS s, timestamp FROM transfers WHERE id % 2 = 0 UNION ALL SELECT id, 1, timestamp + 1 FROM transfers WHERE id % 3 = 0 UNION ALL SELECT id, 2, timestamp + 2 FROM transfers WHERE id % 5 = 0)
SELECT id, CAST(min(s) AS BIGINT) AS stream, min_by(timestamp, s) AS timestamp FROM u GROUP BY id""")
def kway_merge_dedup(spark, d):
    rows = tables.transfers(spark, d).select("id", "timestamp")
    streams = [rows.where(F.col("id") % m == 0).withColumn("timestamp", F.col("timestamp") + n) for n, m in enumerate((2, 3, 5))]
    return _longs(combine.merge(streams, ["id"]), "stream")


@register(f"{_T} SELECT timestamp FROM transfers WHERE code = 3 INTERSECT SELECT timestamp FROM transfers WHERE user_data_64 = 2 INTERSECT SELECT timestamp FROM transfers WHERE credit_account_id = {_SHOP}")
def zigzag_intersect(spark, d):
    rows = tables.transfers(spark, d)
    return combine.intersect([rows.where("code = 3").select("timestamp"), rows.where("user_data_64 = 2").select("timestamp"), rows.where(F.col("credit_account_id") == _SHOP).select("timestamp")], "timestamp")


_VERSIONS = "v AS (SELECT CAST(user_id AS BIGINT) AS key, CAST(event_id AS BIGINT) AS version, event_type, event_type = 'error' AS deleted FROM events)"


def _versions(spark, d):
    rows = tables.table(spark, d, "events")
    return rows.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("version"), "event_type", (F.col("event_type") == "error").alias("deleted"))


@register(f"WITH {_VERSIONS} SELECT key, max(version) AS version, max_by(event_type, version) AS event_type, max_by(deleted, version) AS deleted FROM v GROUP BY key")
def newest_wins(spark, d):
    return combine.newest(_versions(spark, d), ["key"], "version")


@register(f"WITH {_VERSIONS} SELECT * FROM (SELECT key, max(version) AS version, max_by(event_type, version) AS event_type, max_by(deleted, version) AS deleted FROM v GROUP BY key) WHERE NOT deleted")
def live_rows(spark, d):
    return combine.live(_versions(spark, d), ["key"], "version")


@register("SELECT CAST(user_id AS BIGINT) AS key, CAST(sum(CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE -1 END) AS BIGINT) AS net FROM events GROUP BY user_id HAVING sum(CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE -1 END) <> 0")
def put_remove_cancel(spark, d):
    rows = tables.table(spark, d, "events").select(F.col("user_id").cast("long").alias("key"), F.when(F.col("event_type").isin("purchase", "view"), 1).otherwise(-1).alias("sign"))
    return combine.cancel(rows, ["key"])


@register(f"""WITH {_VERSIONS}, a AS (SELECT key, max(version) AS version, max_by(deleted, version) AS deleted FROM v WHERE version % 2 = 0 GROUP BY key), b AS (SELECT key, max(version) AS version, max_by(deleted, version) AS deleted FROM v WHERE version % 2 = 1 GROUP BY key)
SELECT key, version FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)) WHERE NOT deleted""")
def compaction_merge(spark, d):
    rows = _versions(spark, d).drop("event_type")
    upper, lower = (combine.newest(rows.where(F.col("version") % 2 == r), ["key"], "version") for r in (0, 1))
    return combine.merge_levels(upper, lower, ["key"], drop_tombstones=True).select("key", "version")


@register("SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE o_orderkey % 97 <= 50 AND o_orderkey % 97 + o_orderkey % 31 >= 50")
def snapshot_visible(spark, d):
    k = F.col("o_orderkey").cast("long")
    rows = tables.table(spark, d, "orders").select(k.alias("id"), (k % 97).alias("snapshot_min"), (k % 97 + k % 31).alias("snapshot_max"))
    return combine.visible(rows, 50).select("id")


@register("SELECT CAST(o_orderkey % 7 AS BIGINT) AS level, CAST(min(o_custkey) AS BIGINT) AS key_min, CAST(max(o_custkey) AS BIGINT) AS key_max, count(*) AS rows FROM orders GROUP BY 1")
def level_key_ranges(spark, d):
    rows = tables.table(spark, d, "orders").select((F.col("o_orderkey") % 7).cast("long").alias("level"), F.col("o_custkey").cast("long").alias("key"))
    return combine.key_ranges(rows, "level", "key")


# --- validation

def _account_requests(spark, d):
    k = F.col("c_custkey")
    zero = F.lit(0).cast("decimal(38,0)")
    amount = lambda test: F.when(test, 5).otherwise(0).cast("decimal(38,0)")
    flags = F.when(k % 19 == 2, 6).when(k % 23 == 4, 64).when(k % 5 == 1, 8).otherwise(0)
    return tables.table(spark, d, "customer").select(
        F.expr("CAST(c_custkey DIV 8190 AS BIGINT)").alias("batch_id"), k.cast("long").alias("index"), F.when(k % 11 == 3, 0).when(k % 43 == 7, k).otherwise(k + 1).cast("long").alias("id"),
        zero.alias("debits_pending"), amount(k % 29 == 1).alias("debits_posted"), amount(k % 31 == 2).alias("credits_pending"), zero.alias("credits_posted"),
        F.lit(0).cast("long").alias("user_data_128"), F.col("c_nationkey").cast("long").alias("user_data_64"), F.lit(0).cast("long").alias("user_data_32"),
        F.when(k % 13 == 5, 0).otherwise(1).cast("long").alias("ledger"), F.when(k % 17 == 7, 0).otherwise(10).alias("code"), flags.alias("flags"), F.when(k % 37 == 8, 9).otherwise(0).cast("long").alias("timestamp"),
    )


@register(f"""{_A}, q AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(CASE WHEN c_custkey % 11 = 3 THEN 0 WHEN c_custkey % 43 = 7 THEN c_custkey ELSE c_custkey + 1 END AS BIGINT) AS id,
  CASE WHEN c_custkey % 19 = 2 THEN 6 WHEN c_custkey % 23 = 4 THEN 64 WHEN c_custkey % 5 = 1 THEN 8 ELSE 0 END AS flags, c_nationkey AS u FROM customer),
s AS (SELECT *, CASE WHEN k % 37 = 8 THEN 3 WHEN flags = 64 THEN 5 WHEN id = 0 THEN 6 WHEN flags = 6 THEN 8 WHEN k % 29 = 1 THEN 10 WHEN k % 31 = 2 THEN 11 WHEN k % 13 = 5 THEN 13 WHEN k % 17 = 7 THEN 14 END AS shape FROM q),
e AS (SELECT s.*, x.id AS known, x.flags AS xf, x.user_data_64 AS xu, x.code AS xc FROM s LEFT JOIN (SELECT * FROM accounts WHERE id % 2 = 0 AND code = 10) x USING (id)),
f AS (SELECT *, first_value(k) OVER w AS fk, first_value(flags) OVER w AS ff, first_value(u) OVER w AS fu FROM e WHERE shape IS NULL AND known IS NULL WINDOW w AS (PARTITION BY id ORDER BY k))
SELECT CAST(e.k // 8190 AS BIGINT) AS batch_id, e.k AS index, e.id, CAST(coalesce(e.shape, CASE WHEN e.known IS NOT NULL THEN CASE WHEN e.flags <> e.xf THEN 15 WHEN e.u <> e.xu THEN 17 ELSE 21 END
  WHEN fk < e.k THEN CASE WHEN e.flags <> ff THEN 15 WHEN e.u <> fu THEN 17 ELSE 21 END END, 4294967295) AS BIGINT) AS status FROM e LEFT JOIN f USING (k)""")
def create_accounts_status(spark, d):
    existing = tables.accounts(spark, d).where("id % 2 = 0 AND code = 10")
    return validate.create_accounts(_account_requests(spark, d), existing)


def _transfer_requests(spark, d):
    """Two-phase transfers as requests, some of them spoilt."""
    k = F.col("id")
    rows = tables.two_phase(spark, d).withColumn("at", F.col("timestamp"))
    changes = {
        "debit_account_id": F.when(k % 41 == 4, F.col("debit_account_id") + 100_000_000).when(k % 53 == 6, F.col("credit_account_id")).otherwise(F.col("debit_account_id")),
        "code": F.when(k % 62 == 10, 0).otherwise(F.col("code")), "timeout": F.when(k % 74 == 11, 5).otherwise(F.col("timeout")),
        "amount": F.when(k % 86 == 13, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(38,0)"),
    }
    rows = rows.withColumns(changes)
    return rows.withColumns({"batch_id": F.floor(F.col("at") / F.lit(10**16)), "index": F.col("at"), "timestamp": F.lit(0).cast("long")})


_STATUSES = f"""{_P},
p AS (SELECT *, k % 5 = 0 AS known, CASE WHEN id % 53 = 6 AND id % 41 <> 4 THEN cr WHEN id % 41 = 4 THEN dr + 100000000 ELSE dr END AS d2, amount + CASE WHEN id % 86 = 13 THEN 1 ELSE 0 END AS a2 FROM (SELECT *, id // 2 - 1 AS k FROM pend)),
ps AS (SELECT *, CASE WHEN d2 = cr THEN 12 WHEN id % 62 = 10 THEN 20 WHEN known THEN CASE WHEN d2 <> dr THEN 37 WHEN a2 <> amount THEN 39 ELSE 46 END WHEN d2 <> dr THEN 21 END AS status FROM p),
r AS (SELECT *, CASE WHEN id % 53 = 6 AND id % 41 <> 4 THEN cr WHEN id % 41 = 4 THEN dr + 100000000 ELSE dr END AS d2, amount + CASE WHEN id % 86 = 13 THEN 1 ELSE 0 END AS a2 FROM res),
rs AS (SELECT r.*, CASE WHEN r.d2 = r.cr THEN 12 WHEN r.id % 74 = 11 THEN 17 WHEN ps.status IS NOT NULL AND NOT known THEN 25 WHEN r.d2 <> CASE WHEN known THEN ps.dr ELSE ps.d2 END THEN 27
         WHEN r.a2 > CASE WHEN known THEN ps.amount ELSE ps.a2 END THEN 31 WHEN flags = 8 AND r.a2 < CASE WHEN known THEN ps.amount ELSE ps.a2 END THEN 32 WHEN r.timestamp >= ps.expires_at THEN 35 END AS status
       FROM r JOIN ps ON ps.id = pending_id)"""


def _results(spark, d):
    """The spoilt requests against a table that has every fifth order's pending transfer already."""
    existing = tables.two_phase(spark, d).where("id % 2 = 0 AND (id DIV 2 - 1) % 5 = 0")
    return validate.create_transfers(_transfer_requests(spark, d), tables.accounts(spark, d), existing)


@register(f"{_STATUSES} SELECT id, CAST(coalesce(status, 4294967295) AS BIGINT) AS status FROM ps UNION ALL SELECT id, CAST(coalesce(status, 4294967295) AS BIGINT) FROM rs")
def create_transfers_status(spark, d):
    return _results(spark, d).select("id", "status")


@register(f"{_STATUSES} SELECT id FROM ps WHERE status IN (21, 22, 25) UNION SELECT id FROM rs WHERE status IN (21, 22, 25)")
def used_up_ids(spark, d):
    """Ids that failed for a passing reason and may not be asked again."""
    return validate.used_up_ids(_results(spark, d))


@register("SELECT CAST(l_orderkey AS BIGINT) AS id, timestamp, CAST(rank AS BIGINT) AS rank FROM (SELECT l_orderkey, l_linenumber * 1000000 + l_suppkey * 100 + l_partkey % 100 AS timestamp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_suppkey * 100 + l_partkey % 100) AS rank FROM lineitem) WHERE rank > 1")
def duplicate_ids(spark, d):
    at = (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_partkey") % 100).cast("long")
    rows = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), at.alias("timestamp"))
    return _longs(validate.duplicates(rows), "rank")


@register("""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS account_id, epoch_us(o_orderdate) * 1000 AS timestamp FROM orders),
x AS (SELECT *, lag(timestamp) OVER (PARTITION BY account_id ORDER BY id) AS previous_timestamp FROM o) SELECT * FROM x WHERE timestamp <= previous_timestamp""")
def imported_monotonic(spark, d):
    rows = tables.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("account_id"), tables._nanos("o_orderdate").alias("timestamp"))
    return validate.regressions(rows, ["account_id"])


_CHAIN = """WITH q AS (SELECT CAST(o_orderkey // 50 AS BIGINT) AS batch_id, CAST(o_orderkey AS BIGINT) AS index, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 1 ELSE 0 END AS flags, CASE WHEN o_orderkey % 17 = 0 THEN 20 END AS status FROM orders),
l AS (SELECT *, CASE WHEN coalesce(lag(flags) OVER (PARTITION BY batch_id ORDER BY index), 0) = 1 THEN 0 ELSE 1 END AS starts, lead(index) OVER (PARTITION BY batch_id ORDER BY index) IS NULL AS last FROM q),
c AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY batch_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM l),
f AS (SELECT *, bool_or(last AND flags = 1) OVER w AS open, min(CASE WHEN status IS NOT NULL THEN index END) OVER w AS failed_at, max(index) OVER w AS last_at FROM c WINDOW w AS (PARTITION BY batch_id, chain))
SELECT batch_id, index, chain, CAST(CASE WHEN open AND index = last_at THEN 2 WHEN failed_at = index THEN status WHEN open OR failed_at IS NOT NULL THEN 1 ELSE 4294967295 END AS BIGINT) AS status FROM f"""


@register(_CHAIN)
def linked_chains(spark, d):
    k = F.col("o_orderkey").cast("long")
    rows = tables.table(spark, d, "orders").select(F.expr("CAST(o_orderkey DIV 50 AS BIGINT)").alias("batch_id"), k.alias("index"), F.when((k % 4).isin(1, 2), 1).otherwise(0).alias("flags"), F.when(k % 17 == 0, 20).alias("status"))
    return _longs(validate.with_chain_failures(validate.chains(rows)).select("batch_id", "index", "chain", "status"), "chain")


@register(None)
def create_transfers_fold(spark, d):
    """Two-phase transfers as requests under credit limits: every fourth customer's debits must not exceed its credits."""
    requests = tables.two_phase(spark, d).withColumns({"batch_id": F.lit(0).cast("long"), "index": F.col("timestamp"), "at": F.col("timestamp"), "own": F.col("timestamp")})
    requests = requests.withColumn("timestamp", F.lit(0).cast("long")).withColumn("shape", F.coalesce(validate.transfer_shape(), F.lit(0))).withColumn("timestamp", F.col("own")).drop("own", "at")
    limited = tables.accounts(spark, d).withColumn("flags", F.when((F.col("code") == 10) & (F.col("id") % 4 == 0), 2).otherwise(F.col("flags")))
    return fold.create_transfers_fold(requests, limited)


# --- audits

@register(f"{_RESOLVED} SELECT CAST(1 AS BIGINT) AS ledger, CAST(type AS BIGINT) AS type, count(*) AS movements, CAST(sum(amount) AS BIGINT) AS amount, count(*) FILTER (WHERE dr = cr) AS same_account, count(*) FILTER (WHERE pending = 0 AND posted = 0) AS empty FROM mv GROUP BY type")
def double_entry_check(spark, d):
    return _longs(audit.double_entry(_two_phase_moves(spark, d)), "type", "amount")


@register("""WITH b AS (SELECT CAST(l_orderkey AS BIGINT) AS key, CAST(l_partkey AS BIGINT) AS lo, CAST(l_partkey + l_suppkey AS BIGINT) AS hi FROM lineitem),
p AS (SELECT DISTINCT key, lo AS pos FROM b),
c AS (SELECT p.key, p.pos, count(*) AS n, min(b.hi) AS nxt FROM p JOIN b ON b.key = p.key AND b.lo <= p.pos AND b.hi >= p.pos GROUP BY p.key, p.pos),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, nxt - pos, pos) AS k FROM c), s AS (SELECT key, count(*) AS sources FROM b GROUP BY key)
SELECT r.key, pos AS lower, nxt AS upper, CAST(n AS BIGINT) AS sources_true, CAST(sources - n AS BIGINT) AS sources_false FROM r JOIN s ON r.key = s.key WHERE k = 1""")
def marzullo_interval(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key"), F.col("l_partkey").cast("long").alias("lower"), (F.col("l_partkey") + F.col("l_suppkey")).cast("long").alias("upper"))
    return _longs(audit.smallest_interval(rows, ["key"]), "sources_true", "sources_false")


@register("SELECT o_orderpriority AS key, median FROM (SELECT o_orderpriority, CAST(list_sort(list(o_custkey))[count(*) // 2 + 1] AS BIGINT) AS median FROM orders GROUP BY o_orderpriority)")
def upper_median(spark, d):
    rows = tables.table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("long").alias("value"))
    return audit.upper_median(rows, ["key"], "value")


@register("SELECT event_type, count(*) FILTER (WHERE user_id % 4 = 0) AS n_0, count(*) FILTER (WHERE user_id % 4 = 1) AS n_1, count(*) FILTER (WHERE user_id % 4 = 2) AS n_2, count(*) FILTER (WHERE user_id % 4 = 3) AS n_3 FROM events GROUP BY event_type")
def manifest_counts(spark, d):
    rows = tables.table(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("level"))
    return audit.counts_by(rows, "event_type", "level", [0, 1, 2, 3])


@register("""WITH g AS (SELECT CAST(l_orderkey AS BIGINT) AS key, l_returnflag AS value, count(*) AS agreeing, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS copies FROM lineitem GROUP BY ALL)
SELECT key, max_by(value, agreeing * 1000 + ascii(value)) AS value, max(agreeing) AS agreeing, max_by(copies, agreeing * 1000 + ascii(value)) AS copies FROM g GROUP BY key""")
def quorum_groups(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key"), F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("copy"))
    return audit.quorum(rows, ["key"], "value", "copy").withColumn("copies", F.array_join(F.col("copies").cast("array<string>"), ","))


@register("SELECT 'events' AS name, count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def table_counts(spark, d):
    out = [tables.table(spark, d, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in ("events", "orders", "customer")]
    return out[0].union(out[1]).union(out[2])


_DRAW = "(CAST(('0x' || substr(md5({}), 1, 13)) AS BIGINT) + 1) / 4503599627370497::DOUBLE".format


@register(f"{_T}, w AS (SELECT *, ln({_DRAW("'7:' || code || ':' || id")}) / amount AS draw FROM transfers WHERE amount > 0) SELECT CAST(code AS BIGINT) AS code, max_by(id, draw) AS id, CAST(max_by(amount, draw) AS DOUBLE) AS weight FROM w GROUP BY code")
def weighted_sample(spark, d):
    rows = tables.transfers(spark, d).select("code", "id", F.col("amount").cast("double").alias("weight"))
    return _longs(combine.sampled_one(rows, ["code"], "weight", seed=7), "code").select("code", "id", "weight")


@register("SELECT CAST(user_id AS BIGINT) AS key, max(event_id) AS event_id, CAST(max(floor(value)) AS BIGINT) AS value FROM events GROUP BY user_id")
def highest_of_copies(spark, d):
    rows = tables.table(spark, d, "events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.floor("value").cast("long").alias("value"))
    return audit.highest(rows, ["key"], ["event_id", "value"])


@register("SELECT CAST(o_orderkey % 8 AS BIGINT) AS part, count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5((o_orderkey % 8) || ':' || o_orderkey || ':' || o_custkey || ':' || o_orderstatus), 1, 13)) AS BIGINT)) AS VARCHAR) AS checksum FROM orders GROUP BY 1")
def table_fingerprints(spark, d):
    """Counts and checksums of the parts of a table, by which copies are compared."""
    rows = tables.table(spark, d, "orders").select((F.col("o_orderkey") % 8).cast("long").alias("part"), F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus")
    return audit.fingerprint(rows, ["part"]).withColumn("checksum", F.col("checksum").cast("string"))


@register("SELECT CAST(a AS BIGINT) AS account_id, CAST(count(*) AS BIGINT) AS ids FROM (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS a, o_orderkey FROM orders) GROUP BY a")
def batch_pack_unpack(spark, d):
    """Orders packed into a row a customer and unpacked again."""
    from ..sources import store

    rows = tables.table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("batch_id"), F.col("o_orderkey").cast("long").alias("index"), F.col("o_totalprice").alias("amount"))
    return store.unpack(store.pack(rows)).groupBy(F.col("batch_id").alias("account_id")).agg(F.countDistinct("index").alias("ids"))


@register(f"""WITH n AS (SELECT (SELECT count(*) FROM events) AS transfers, (SELECT count(*) FROM customer) AS accounts),
g AS (SELECT least(floor(pow({_DRAW("'42:1:' || i")}, 1 / (1 - 0.9::DOUBLE)) * accounts), accounts - 1) AS debit, ceil({_DRAW("'42:3:' || i")} * 10000) AS amount FROM (SELECT unnest(range(transfers)) AS i, accounts FROM n))
SELECT CAST(debit + 1 AS BIGINT) AS debit_account_id, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM g GROUP BY debit""")
def generated_transfers(spark, d):
    """A seeded zipfian workload, as many transfers as there are events, as counts by how busy the debited account is."""
    n, accounts = (tables.table(spark, d, t).count() for t in ("events", "customer"))
    rows = generator.transfers(spark, n, accounts, "zipfian", "random")
    return rows.groupBy("debit_account_id").agg(F.count("*").alias("n"), F.sum("amount").cast("long").alias("amount"))


# --- streams

#: Rows of a file that a stream reads, about.
FILE_ROWS = 1_000_000


def _stream_folder(spark: SparkSession) -> str:
    """A folder of its own for a stream's checkpoint and output, in the shared folder."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def _streamed(spark, rows: DataFrame, parts: int):
    """rows as Parquet files, one stretch of time after the other, which a stream then reads a stretch a batch."""
    folder = _stream_folder(spark)
    found = rows.agg(F.percentile_approx("timestamp", [n / parts for n in range(1, parts)], 1000).alias("cuts"), F.count("*").alias("n")).first()
    cuts, files = found["cuts"] or [], max(1, found["n"] // (parts * FILE_ROWS))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows.where(F.lit(True) if low is None else F.col("timestamp") > low).where(F.lit(True) if high is None else F.col("timestamp") <= high)
        part.repartition(files).write.mode("append").parquet(f"{folder}/in")
    return flows.read_table(spark, f"{folder}/in", rows.schema, files), folder


@register(f"{_T}, p AS (SELECT timestamp AS t FROM transfers ORDER BY timestamp LIMIT 1 OFFSET 100) {_MOVED}, p WHERE timestamp > t")
def stream_cdc(spark, d):
    """The transfers after a resume point, read as a stream and written by micro-batches."""
    rows = _moved(tables.transfers(spark, d))
    last = rows.orderBy("timestamp").limit(101).agg(F.max("timestamp")).first()[0] or 0
    stream, folder = _streamed(spark, rows, 4)
    flows.publish(flows.changes_after(stream, last), lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@register(f"""{_P}, clock AS (SELECT max(timestamp) - 1000000 AS t FROM (SELECT timestamp FROM pend UNION ALL SELECT timestamp FROM res)),
done AS (SELECT pending_id FROM res JOIN pend ON pend.id = pending_id WHERE res.timestamp < expires_at)
SELECT id AS pending_id, CAST(1 AS BIGINT) AS ledger, CAST(amount AS BIGINT) AS amount, expires_at AS expired_at FROM pend, clock WHERE expires_at <= t AND id NOT IN (SELECT pending_id FROM done)""")
def stream_expiry(spark, d):
    """Expired pending transfers, from timers of a stream of two-phase transfers."""
    stream, folder = _streamed(spark, tables.two_phase(spark, d), 4)
    with flows.rocksdb(spark):
        query_ = flows.expiries(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(flows.EXPIRY_SCHEMA).parquet(f"{folder}/out")


@register(f"{_T} SELECT id, amount FROM transfers")
def stream_idempotent(spark, d):
    """Each transfer sent twice and taken once."""
    rows = _moved(tables.transfers(spark, d))
    stream, folder = _streamed(spark, rows.unionByName(rows), 4)
    query_ = flows.idempotent(stream).select("id", "amount").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def queries() -> dict:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}



