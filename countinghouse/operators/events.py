"""Balance-change events: one for each transfer that takes effect and for each expiry, with both accounts' balances after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import has, prunable
from ..model import ACCOUNT_FLAGS, PAGE_MAX, PENDING_STATUS, TRANSFER_FLAGS, AccountFilter, ChangeEventsFilter
from .pending import status_at, two_phase_states

_BALANCES = ("debits_pending", "debits_posted", "credits_pending", "credits_posted")
_RESOLVES = TRANSFER_FLAGS["post_pending"] | TRANSFER_FLAGS["void_pending"]


def movements(transfers: DataFrame, now: int | None = None) -> DataFrame:
    """What takes effect, by time: transfer_id, accounts, amount, type, and by how much pending and posted sums change on both sides.

    A two-phase transfer's movements (created, then resolved or expired) come from its one row of two_phase_states.
    """
    zero, none = F.lit(0).cast("decimal(38,0)"), F.lit(0).cast("long")
    amount = F.col("amount").cast("decimal(38,0)")
    plain = transfers.where(~has("flags", _RESOLVES | TRANSFER_FLAGS["pending"]))
    single = plain.select(
        "timestamp", F.col("id").alias("transfer_id"), none.alias("pending_id"), "debit_account_id", "credit_account_id", "ledger", amount.alias("amount"),
        F.lit(PENDING_STATUS["none"]).alias("type"), zero.alias("pending"), amount.alias("posted"),
    )

    def move(timestamp, id_, pending_id, moved, type_, pending, posted):
        columns = {"timestamp": timestamp, "transfer_id": id_, "pending_id": pending_id, "amount": moved, "type": type_.cast("int"), "pending": pending.cast("decimal(38,0)"), "posted": posted}
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    posts = has("done.flags", TRANSFER_FLAGS["post_pending"])
    moved = F.when(posts, F.col("done.amount")).otherwise(amount)
    steps = [
        move(F.col("timestamp"), F.col("id"), none, amount, F.lit(PENDING_STATUS["pending"]), amount, zero),
        F.when(
            F.col("done").isNotNull(),
            move(F.col("done.timestamp"), F.col("done.id"), F.col("id"), moved, F.when(posts, PENDING_STATUS["posted"]).otherwise(PENDING_STATUS["voided"]), -amount, F.when(posts, moved).otherwise(zero)),
        ),
    ]
    if now is not None:
        gone = (F.col("timestamp") <= now) & (status_at(now) == PENDING_STATUS["expired"])
        steps.append(F.when(gone, move(F.col("expires_at"), F.col("id"), F.col("id"), amount, F.lit(PENDING_STATUS["expired"]), -amount, zero)))
    states = two_phase_states(transfers).select("debit_account_id", "credit_account_id", "ledger", F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("m"))
    out = single.unionByName(states.select("m.*", "debit_account_id", "credit_account_id", "ledger").select(*single.columns))
    return out if now is None else out.where(F.col("timestamp") <= now)


def entries(moves: DataFrame) -> DataFrame:
    """The movements once for each side: account_id and the changes of its four balances."""
    zero = F.lit(0).cast("decimal(38,0)")

    def side(account: str, debit: bool):
        p, q = F.col("pending"), F.col("posted")
        changes = (p, q, zero, zero) if debit else (zero, zero, p, q)
        return F.struct(F.col(account).alias("account_id"), F.lit("debit" if debit else "credit").alias("side"), *[c.alias(n) for c, n in zip(changes, _BALANCES)])

    both = F.explode(F.array(side("debit_account_id", True), side("credit_account_id", False)))
    names = ("timestamp", "transfer_id", "pending_id", "type", "ledger", "amount")
    return moves.select(*names, both.alias("e")).select(*names, "e.*")


def totals(moves: DataFrame) -> DataFrame:
    """The four balances of each account; partial sums go over the shuffle, so a busy account is no bottleneck."""
    return entries(moves).groupBy("account_id").agg(*[F.sum(n).alias(n) for n in _BALANCES])


def _stretch():
    """The day of a timestamp: a busy account's rows are dealt by account and day, so that they aren't one task's work."""
    return F.floor(F.col("timestamp") / F.lit(86_400_000_000_000))


def running(moves: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The entries with the account's four balances after each, and with its own columns (account_*) if accounts are given.

    Running sums within an account and stretch of time are added to the sums of its stretches before, so that an
    account with very many entries isn't one task's work. Accounts join the stretches, not the entries, for that too.
    """
    rows = entries(moves).withColumn("stretch", _stretch())
    own = Window.partitionBy("account_id", "stretch").orderBy("timestamp", "transfer_id", "side").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("account_id", "stretch").agg(*[F.sum(n).alias(f"{n}_in") for n in _BALANCES])
    before = Window.partitionBy("account_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("account_id", "stretch", *[F.coalesce(F.sum(f"{n}_in").over(before), F.lit(0)).cast("decimal(38,0)").alias(f"{n}_base") for n in _BALANCES])
    names = ("timestamp", "transfer_id", "pending_id", "type", "ledger", "amount", "account_id", "side")
    rows = rows.select(*names, "stretch", *[F.sum(n).over(own).alias(n) for n in _BALANCES])
    own_columns = []
    if accounts is not None:
        known = _known(accounts)
        own_columns = [c for c in known.columns if c != "known_id"]
        base = base.join(known, base["account_id"] == known["known_id"], "left").drop("known_id")
    rows = rows.join(base, ["account_id", "stretch"])
    return rows.select(*names, *own_columns, *[(F.col(n) + F.col(f"{n}_base")).cast("decimal(38,0)").alias(n) for n in _BALANCES])


_ACCOUNT = ("timestamp", "flags", "user_data_128", "user_data_64", "user_data_32", "code")


def _known(accounts: DataFrame) -> DataFrame:
    return accounts.select(F.col("id").alias("known_id"), *[F.col(n).alias(f"account_{n}") for n in _ACCOUNT])


def _paired(rows: DataFrame) -> DataFrame:
    """Entries with balances and account_* columns, brought together: a row a movement with both accounts (dr_*, cr_*) after it.

    The two sides of a movement meet by one grouping, two rows a key.
    """
    kept = ("account_id", *_BALANCES, *[f"account_{n}" for n in _ACCOUNT])
    side = lambda name: F.max(F.when(F.col("side") == name, F.struct(*kept)))
    both = rows.groupBy("timestamp", "transfer_id", "type", "pending_id", "ledger", "amount").agg(side("debit").alias("dr"), side("credit").alias("cr"))
    return both.select(
        "timestamp", "transfer_id", F.col("pending_id").alias("transfer_pending_id"), "ledger", "amount", F.col("type").alias("transfer_pending_status"),
        *[F.col(f"{p}.{n}").alias(f"{p}_{n}") for p in ("dr", "cr") for n in kept],
    )


def account_events(moves: DataFrame, accounts: DataFrame) -> DataFrame:
    """An event a movement: both accounts' ids, timestamps, flags and balances after it."""
    return _paired(running(moves, accounts))


def event_flags(moves: DataFrame, accounts: DataFrame) -> DataFrame:
    """The movements with both accounts' timestamps and flags: all that pruning and the history index need, without balances."""
    out = moves.select("timestamp", "transfer_id", F.col("pending_id").alias("transfer_pending_id"), "ledger", F.col("type").alias("transfer_pending_status"), F.col("debit_account_id").alias("dr_account_id"), F.col("credit_account_id").alias("cr_account_id"))
    out = out.withColumn("stretch", _stretch())
    for p in ("dr", "cr"):
        # Accounts join the days on which they move, and movements those, so that a busy account isn't one task's join.
        known = accounts.select(F.col("id").alias("known_id"), F.col("timestamp").alias(f"{p}_account_timestamp"), F.col("flags").alias(f"{p}_account_flags"))
        days = moves.select(F.col("debit_account_id" if p == "dr" else "credit_account_id").alias(f"{p}_account_id"), _stretch().alias("stretch")).distinct()
        out = out.join(days.join(known, days[f"{p}_account_id"] == known["known_id"], "left").drop("known_id"), [f"{p}_account_id", "stretch"])
    return out.drop("stretch")


def change_events(moves: DataFrame, transfers: DataFrame, accounts: DataFrame, f: ChangeEventsFilter) -> DataFrame:
    """Change events of a stretch of time in full, in time order: at most a page.

    The page is taken from the movements first. Balances before it are sums over the movements of its accounts before
    timestamp_min (nothing lies between that and the page); only the page's own entries are added up in order.
    """
    page = moves.limit(0) if not f.valid() else moves
    if f.timestamp_min:
        page = page.where(F.col("timestamp") >= f.timestamp_min)
    if f.timestamp_max:
        page = page.where(F.col("timestamp") <= f.timestamp_max)
    page = page.orderBy("timestamp").limit(min(f.limit, PAGE_MAX)) if f.valid() else page
    own = Window.partitionBy("account_id").orderBy("timestamp", "transfer_id", "side").rowsBetween(Window.unboundedPreceding, 0)
    sides = entries(page)
    after = sides.withColumns({n: F.sum(n).over(own) for n in _BALANCES})
    if f.timestamp_min:
        wanted = F.broadcast(sides.select(F.col("account_id").alias("wanted_id")).distinct())  # two a row of the page at most
        earlier = entries(moves.where(F.col("timestamp") < f.timestamp_min))
        base = earlier.join(wanted, earlier["account_id"] == wanted["wanted_id"], "left_semi").groupBy(F.col("account_id").alias("base_id")).agg(*[F.sum(n).alias(f"{n}_base") for n in _BALANCES])
        after = after.join(base, after["account_id"] == base["base_id"], "left")
        after = after.withColumns({n: (F.col(n) + F.coalesce(f"{n}_base", F.lit(0))).cast("decimal(38,0)") for n in _BALANCES})
    known = _known(accounts)
    events = _paired(after.join(known, after["account_id"] == known["known_id"], "left"))
    names = ("user_data_128", "user_data_64", "user_data_32", "timeout", "code", "flags", "timestamp")
    moved = transfers.select(F.col("id").alias("t_id"), *[F.col(n).alias(f"transfer_{n}") for n in names])
    # The page is the small side, so that transfers are read once and not moved.
    out = moved.join(F.broadcast(events), moved["t_id"] == events["transfer_id"], "right").drop("t_id")
    return out.orderBy("timestamp")


def history_index(events: DataFrame) -> DataFrame:
    """(account_timestamp, timestamp) of events, for accounts that keep a history."""
    sides = F.array(*[F.struct(F.col(f"{p}_account_timestamp").alias("account_timestamp"), F.col(f"{p}_account_flags").alias("flags")) for p in ("dr", "cr")])
    rows = events.select("timestamp", F.explode(sides).alias("s")).where(has("s.flags", ACCOUNT_FLAGS["history"]))
    return rows.select("s.account_timestamp", "timestamp")


def account_balances(moves: DataFrame, accounts: DataFrame, f: AccountFilter) -> DataFrame:
    """Balances of one account after each of its movements, if it keeps a history."""
    kept = accounts.where((F.col("id") == f.account_id) & has("flags", ACCOUNT_FLAGS["history"])).select(F.col("id").alias("kept_id"))
    mine = moves.where((F.col("debit_account_id") == f.account_id) | (F.col("credit_account_id") == f.account_id))
    rows = running(mine).where(F.col("account_id") == f.account_id)
    rows = rows.join(kept, rows["account_id"] == kept["kept_id"], "left_semi")
    wanted = [s for s in ("debit", "credit") if f.flags & {"debit": 1, "credit": 2}[s]]
    if not f.valid():
        return rows.select("timestamp", *_BALANCES).limit(0)
    rows = rows.where(F.col("side").isin(*wanted))
    if f.timestamp_min:
        rows = rows.where(F.col("timestamp") >= f.timestamp_min)
    if f.timestamp_max:
        rows = rows.where(F.col("timestamp") <= f.timestamp_max)
    return rows.select("timestamp", *_BALANCES).orderBy(F.desc("timestamp") if f.reversed else F.asc("timestamp")).limit(min(f.limit, PAGE_MAX))


def balances_as_of(moves: DataFrame, at: int) -> DataFrame:
    """The four balances of each account at a time: sums of what came before, with no window."""
    return totals(moves.where(F.col("timestamp") <= at))


def prunable_events(events: DataFrame) -> DataFrame:
    return events.where(prunable())


def keep_unprunable(events: DataFrame) -> DataFrame:
    return events.where(~prunable())
