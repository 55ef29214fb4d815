"""The general path for transfers: an ordered fold over requests that depend on each other.

Where limits, balancing, closing, chains or failed ids make a result depend on
earlier results, requests are applied one after the other, but only within a
group that results can cross: requests that share an id, a pending transfer, a
chain, or an account whose balance or state decides results (one with a limit,
or that a balancing or closing request names; any account, if all amounts
together could overflow a balance). Groups are connected components of these
links within a ledger. Rows are dealt by group, sorted by time and streamed: a
task holds the state of one group at a time (accounts touched, open pending
transfers, ids used). A group that is as large as its ledger is one task's work;
its rules leave no other order.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.columns import has
from ..graph import components
from ..model import AMOUNT_MAX, CREATED, NS, TRANSFER_DIFFERS, TRANSFER_FLAGS, TRANSIENT

_T = TRANSFER_FLAGS


@dataclass
class Account:
    flags: int
    ledger: int
    dp: int = 0
    dc: int = 0
    cp: int = 0
    cc: int = 0

    def debit_breaks(self, amount: int) -> bool:
        return bool(self.flags & 2) and self.dp + self.dc + amount > self.cc

    def credit_breaks(self, amount: int) -> bool:
        return bool(self.flags & 4) and self.cp + self.cc + amount > self.dc


@dataclass
class Ledger:
    """The state of a ledger and the rules in order."""

    accounts: dict = field(default_factory=dict)
    done: dict = field(default_factory=dict)
    failed: set = field(default_factory=set)
    pending: dict = field(default_factory=dict)
    due: list = field(default_factory=list)
    undo: list | None = None

    def _set(self, holder, name, value):
        """Assigns, remembering the old value while a chain is open."""
        if self.undo is not None:
            self.undo.append((holder, name, holder.get(name) if isinstance(holder, dict) else getattr(holder, name)))
        if isinstance(holder, dict):
            holder[name] = value
        else:
            setattr(holder, name, value)

    def _move(self, dr, cr, pending: int, posted: int):
        for account, p, q in ((dr, "dp", "dc"), (cr, "cp", "cc")):
            self._set(account, p, getattr(account, p) + pending)
            self._set(account, q, getattr(account, q) + posted)

    def expire(self, now: int):
        while self.due and self.due[0][0] <= now:
            _, id_ = heapq.heappop(self.due)
            state, t = self.pending[id_]
            if state == "pending":
                self._finish(id_, t, "expired", 0)

    def _finish(self, id_: int, t: dict, state: str, posted: int):
        dr, cr = self.accounts[t["debit_account_id"]], self.accounts[t["credit_account_id"]]
        self._move(dr, cr, -t["amount"], posted)
        if state != "posted":  # a closing transfer that is undone opens its account again
            for bit, account in ((_T["closing_debit"], dr), (_T["closing_credit"], cr)):
                if t["flags"] & bit:
                    self._set(account, "flags", account.flags & ~32)
        self._set(self.pending, id_, (state, t))

    def apply(self, r: dict) -> tuple[int, int]:
        """(status, amount moved) of a request that is sound by itself."""
        known = self.done.get(r["id"])
        if known:
            return next((code for n, code in TRANSFER_DIFFERS.items() if known[n] != r[n]), 46), 0
        if r["id"] in self.failed:
            return 68, 0
        return self._resolve(r) if r["flags"] & (_T["post_pending"] | _T["void_pending"]) else self._create(r)

    def _resolve(self, r: dict) -> tuple[int, int]:
        if r["pending_id"] not in self.pending:
            return (26 if r["pending_id"] in self.done else 25), 0
        state, t = self.pending[r["pending_id"]]
        for name, code in (("debit_account_id", 27), ("credit_account_id", 28), ("ledger", 29), ("code", 30)):
            if r[name] and r[name] != t[name]:
                return code, 0
        posts = bool(r["flags"] & _T["post_pending"])
        amount = r["amount"] if posts else r["amount"] or t["amount"]
        if amount > t["amount"]:
            return 31, 0
        if not posts and amount < t["amount"]:
            return 32, 0
        if state != "pending":
            return {"posted": 33, "voided": 34, "expired": 35}[state], 0
        for name, code in (("debit_account_id", 65), ("credit_account_id", 66)):
            if self.accounts[t[name]].flags & 32 and not (not posts and t["flags"] & (_T["closing_debit"] | _T["closing_credit"])):
                return code, 0
        self._finish(r["pending_id"], t, "posted" if posts else "voided", amount if posts else 0)
        self._set(self.done, r["id"], r)
        return CREATED, amount

    def _create(self, r: dict) -> tuple[int, int]:
        dr, cr = self.accounts.get(r["debit_account_id"]), self.accounts.get(r["credit_account_id"])
        for account, code in ((dr, 21), (cr, 22)):
            if account is None:
                return code, 0
        if dr.ledger != cr.ledger:
            return 23, 0
        if r["ledger"] != dr.ledger:
            return 24, 0
        for account, code in ((dr, 65), (cr, 66)):
            if account.flags & 32:
                return code, 0
        amount, pends = r["amount"], bool(r["flags"] & _T["pending"])
        if r["flags"] & _T["balancing_debit"]:
            amount = min(amount, max(0, dr.cc - dr.dp - dr.dc))
        if r["flags"] & _T["balancing_credit"]:
            amount = min(amount, max(0, cr.dc - cr.cp - cr.cc))
        sums = ((dr.dp, 47), (cr.cp, 48)) if pends else ((dr.dc, 49), (cr.cc, 50))
        for total, code in (*sums, (dr.dp + dr.dc, 51), (cr.cp + cr.cc, 52)):
            if total + amount > AMOUNT_MAX:
                return code, 0
        if r["timestamp"] + r["timeout"] * NS > 2**63 - 1:
            return 53, 0
        if dr.debit_breaks(amount):
            return 54, 0
        if cr.credit_breaks(amount):
            return 55, 0
        self._move(dr, cr, amount if pends else 0, 0 if pends else amount)
        if pends:
            self._set(self.pending, r["id"], ("pending", r | {"amount": amount}))
            if r["timeout"]:
                heapq.heappush(self.due, (r["timestamp"] + r["timeout"] * NS, r["id"]))
            for bit, account in ((_T["closing_debit"], dr), (_T["closing_credit"], cr)):
                if r["flags"] & bit:
                    self._set(account, "flags", account.flags | 32)
        self._set(self.done, r["id"], r)
        return CREATED, amount

    def roll_back(self):
        for holder, name, old in reversed(self.undo):
            if isinstance(holder, dict):
                if old is None:
                    holder.pop(name, None)
                else:
                    holder[name] = old
            else:
                setattr(holder, name, old)
        # Timers of transfers that were undone.
        self.due = [x for x in self.due if x[1] in self.pending]
        heapq.heapify(self.due)
        self.undo = None

    def run(self, chain: list[dict]) -> list[tuple[int, int]]:
        """Results of a chain of requests (one, if it isn't linked): all take effect or none does."""
        self.expire(chain[0]["timestamp"])
        if len(chain) == 1 and not chain[0]["flags"] & _T["linked"]:
            r = chain[0]
            out = [(r["shape"], 0) if r["shape"] else self.apply(r)]
        else:
            self.undo, out = [], []
            for r in chain:
                status, amount = (r["shape"], 0) if r["shape"] else self.apply(r)
                out.append((status, amount))
                if status != CREATED:
                    break
            is_open = bool(chain[-1]["flags"] & _T["linked"])
            if out[-1][0] != CREATED or is_open:
                self.roll_back()
                first = len(out) - 1 if out[-1][0] != CREATED else None
                out = [(out[i][0] if i == first else 1, 0) for i in range(len(chain))]
                if is_open:
                    out[-1] = (2, 0)
            self.undo = None
        for r, (status, _) in zip(chain, out):
            if status in TRANSIENT:
                self.failed.add(r["id"])
        return out


def _folded(batches):
    """Rows sorted by group and time: results of the requests."""
    group, state, chain, results = None, Ledger(), [], []

    def finish():
        for r, (status, amount) in zip(chain, state.run(chain)):
            results.append((r["batch_id"], r["index"], r["id"], r["ledger"], status, amount))
        chain.clear()

    def out():
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in results], k) for i, k in enumerate(kinds)], ["batch_id", "index", "id", "ledger", "status", "amount"])
        results.clear()
        return batch

    for batch in batches:
        for r in batch.to_pylist():
            if chain and (r["chain"] is None or r["chain"] != chain[-1]["chain"]):
                finish()
            at = (r["ledger"], r["kind"], r["key"])
            if at != group:
                group, state = at, Ledger()
            for name, flags, ledger in (("debit_account_id", "dr_flags", "dr_ledger"), ("credit_account_id", "cr_flags", "cr_ledger")):
                if r[flags] is not None and r[name] not in state.accounts:
                    state.accounts[r[name]] = Account(r[flags], r[ledger])
            r["amount"] = int(r["amount"])
            chain.append(r)
        yield out()
    if chain:
        finish()
    yield out()


_ORDER = ("ledger", "timestamp", "batch_id", "index")
#: Accounts that most rows name, looked up apart, so that a busy account isn't one task's join.
BUSY = 1000


def _with_chains(rows: DataFrame, n: int) -> DataFrame:
    """rows with chain: the place of the first request of its chain in its ledger's order; null outside chains.

    Rows are dealt by ranges of the order; what a range needs of those before it is a row a range.
    """
    rows = cut(rows.repartitionByRange(n, *_ORDER).withColumn("part", F.spark_partition_id()))
    own, parts = Window.partitionBy("part").orderBy(*_ORDER), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.struct("ledger", "batch_id", "flags")
    last = rows.groupBy("part").agg(F.max_by(seen, F.struct(*_ORDER)).alias("last")).withColumn("last", F.last("last").over(parts))
    rows = rows.join(F.broadcast(last), "part").withColumn("before", F.coalesce(F.lag(seen).over(own), "last"))
    goes_on = has("before.flags", _T["linked"]) & F.col("before.ledger").eqNullSafe(F.col("ledger")) & F.col("before.batch_id").eqNullSafe(F.col("batch_id"))
    rows = rows.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("place", F.col("part") * F.lit(1 << 40) + F.row_number().over(own))
    start = F.when(~F.col("goes_on"), F.col("place"))
    carried = rows.groupBy("part").agg(F.max(start).alias("carried")).withColumn("carried", F.max("carried").over(parts))
    rows = rows.join(F.broadcast(carried), "part")
    first = F.coalesce(F.max(start).over(own.rowsBetween(Window.unboundedPreceding, 0)), "carried")
    chain = F.when(F.col("goes_on") | has("flags", _T["linked"]), first)
    return rows.withColumn("chain", chain).drop("part", "last", "before", "goes_on", "place", "carried")


def _with_accounts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with dr_* and cr_*: flags, ledger and ordered of both accounts, null where there is none.

    The busiest accounts come by a broadcast of at most BUSY rows, so no key of the joins has many rows.
    """
    sides = rows.select(F.explode(F.array("debit_account_id", "credit_account_id")).alias("busy"))
    busy = sides.groupBy("busy").count().orderBy(F.desc("count"), "busy").limit(BUSY).drop("count")
    busy = known.join(F.broadcast(busy), known["id"] == F.col("busy"), "left_semi")
    for p, name in (("dr", "debit_account_id"), ("cr", "credit_account_id")):
        info = lambda df, tag: df.select(F.col("id").alias(f"{tag}_id"), F.struct("flags", "ledger", "ordered").alias(f"{tag}_info"))
        rows = rows.join(F.broadcast(info(busy, "busy")), rows[name] == F.col("busy_id"), "left")
        # What is found already is dealt by a hash of its id; whatever that meets isn't used.
        rows = rows.withColumn("asked", F.when(F.col("busy_id").isNull(), F.col(name)).otherwise(F.xxhash64("id")))
        rows = rows.join(info(known, "known"), F.col("asked") == F.col("known_id"), "left")
        found = F.when(F.col("busy_id").isNull(), F.col("known_info")).otherwise(F.col("busy_info"))
        rows = rows.withColumn("found", found).withColumns({f"{p}_{c}": F.col(f"found.{c}") for c in ("flags", "ledger", "ordered")})
        rows = rows.drop("busy_id", "busy_info", "known_id", "known_info", "asked", "found")
    return rows


def _node(kind: int, key: str) -> Column:
    """What requests of a ledger can share: 0 a home, 1 an account, 2 a chain, 3 an id."""
    return F.struct(F.col("ledger"), F.lit(kind).alias("kind"), F.col(key).alias("key"))


def _grouped(rows: DataFrame) -> DataFrame:
    """rows with kind and key: with the ledger, the group of requests that results can cross.

    A request's home is the pending transfer it names, or itself. What homes share (accounts that decide, chains, ids) are
    hubs. A home with one hub belongs to it; only hubs that homes join are left for connected components.
    """
    resolves = has("flags", _T["post_pending"] | _T["void_pending"])
    rows = rows.withColumn("home", F.when(resolves, F.col("pending_id")).otherwise(F.col("id")))
    places = rows.select("ledger", F.explode(F.array(F.struct(F.col("id").alias("at"), "home"), F.struct(F.col("home").alias("at"), "home"))).alias("p")).select("ledger", "p.*")
    shared = places.groupBy("ledger", "at").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low != high").select("ledger", "at")
    shared = places.join(shared, ["ledger", "at"], "left_semi").select("ledger", "home", _node(3, "at").alias("hub"))
    links = rows.select("ledger", "home", F.explode(F.array(
        F.when(~resolves & F.col("dr_ordered"), _node(1, "debit_account_id")), F.when(~resolves & F.col("cr_ordered"), _node(1, "credit_account_id")), F.when(F.col("chain").isNotNull(), _node(2, "chain")),
    )).alias("hub")).where(F.col("hub").isNotNull())
    homes = cut(links.unionByName(shared).distinct().groupBy("ledger", "home").agg(F.collect_set("hub").alias("hubs")))
    joined = homes.where(F.size("hubs") > 1).select(F.explode("hubs").alias("b"), F.array_min("hubs").alias("a")).where("a != b")
    labels = homes.select(F.col("ledger").alias("l_ledger"), F.col("home").alias("l_home"), F.array_min("hubs").alias("hub"))
    if joined.limit(1).count():
        labels = labels.join(components(joined), F.col("hub") == F.col("node"), "left").withColumn("hub", F.coalesce("root", "hub")).drop("node", "root")
    rows = rows.join(labels, rows["ledger"].eqNullSafe(F.col("l_ledger")) & (rows["home"] == F.col("l_home")), "left")
    group = F.coalesce("hub", _node(0, "home"))
    return rows.withColumns({"kind": group["kind"], "key": group["key"]}).drop("home", "l_ledger", "l_home", "hub", "dr_ordered", "cr_ordered")


def create_transfers_fold(batch: DataFrame, accounts: DataFrame, partitions: int | None = None) -> DataFrame:
    """batch_id, index, id, ledger, status and amount moved of each request.

    batch: columns of transfers with timestamp the time each takes effect, batch_id, index, and shape: what
    validate.transfer_shape says (0 if the request is sound by itself).
    """
    names = ["id", "debit_account_id", "credit_account_id", "amount", "pending_id", "user_data_128", "user_data_64", "user_data_32", "timeout", "ledger", "code", "flags", "timestamp", "batch_id", "index", "shape"]
    rows = batch.select(*names)
    n = partitions or int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on_debit, on_credit = _T["balancing_debit"] | _T["closing_debit"], _T["balancing_credit"] | _T["closing_credit"]
    facts = rows.agg(
        F.max(has("flags", _T["linked"])).alias("linked"), F.max(has("flags", on_debit | on_credit)).alias("odd"), F.sum(F.col("amount").cast("double")).alias("total"),
    ).first()
    limited = has("flags", 2 | 4)
    # Where all amounts together stay below the largest balance, no balance overflows.
    if (facts["total"] or 0) > float(AMOUNT_MAX) * 0.999:
        limited = F.lit(True)
    known = accounts.dropDuplicates(["id"]).select("id", "flags", "ledger", limited.alias("ordered"))
    if facts["odd"]:
        side = lambda bits, name: rows.where(has("flags", bits)).select(F.col(name).alias("marked"))
        marked = side(on_debit, "debit_account_id").unionByName(side(on_credit, "credit_account_id")).distinct()
        known = known.join(marked, known["id"] == marked["marked"], "left").withColumn("ordered", F.col("ordered") | F.col("marked").isNotNull()).drop("marked")
    rows = _with_chains(rows, n) if facts["linked"] else rows.withColumn("chain", F.lit(None).cast("long"))
    rows = _grouped(_with_accounts(rows, known))
    dealt = rows.repartition(n, "ledger", "kind", "key").sortWithinPartitions("ledger", "kind", "key", "timestamp", "batch_id", "index")
    return dealt.mapInArrow(_folded, "batch_id long, index long, id long, ledger long, status long, amount decimal(38,0)")
