"""Batches of new accounts and transfers: status codes by joins and windows.

A batch is a table of requests with batch_id and index (its place in the batch).
The joins hold where no result depends on an earlier one's success beyond what
they show; `needs_order` names the requests for which they don't, and
`create_transfers` refuses a batch that has any. `fold.py` applies such requests
one after the other.

Import rules: the first request of a batch says whether the batch imports; an
imported timestamp lies before the batch's clock and after all that exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.columns import account_limits_exclude, has, post_xor_void, reserved_bits, transient
from ..model import ACCOUNT_DIFFERS, ACCOUNT_FLAGS, ACCOUNT_MASK, AMOUNT_MAX, CREATED, NS, TIMESTAMP_MAX, TRANSFER_DIFFERS, TRANSFER_FLAGS, TRANSFER_MASK
from .pending import resolve

ID_MAX = 2**63 - 1
_T = TRANSFER_FLAGS


def first_of(rules: list[tuple[Column, int]]) -> Column:
    """The code of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(test, code) for test, code in rules], F.lit(None).cast("int"))


def chains(batch: DataFrame, linked_bit: int = 1) -> DataFrame:
    """batch with chain (a number within the batch) and chain_open: the batch ends inside it. A row with the linked flag goes on with the next."""
    order = Window.partitionBy("batch_id").orderBy("index")
    linked = has("flags", linked_bit)
    starts = F.when(F.coalesce(F.lag(linked).over(order), F.lit(False)), 0).otherwise(1)
    rows = batch.withColumn("_starts", starts).withColumn("_last", F.lead("index").over(order).isNull())
    rows = rows.withColumn("chain", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("chain_open", F.max(F.col("_last") & linked).over(Window.partitionBy("batch_id", "chain")))
    return rows.drop("_starts", "_last")


def with_chain_failures(rows: DataFrame) -> DataFrame:
    """rows (chain, chain_open, status: null for success) with the final status: the first failure of a chain keeps its code, its other rows get 1, the last row of an open chain 2."""
    chain = Window.partitionBy("batch_id", "chain")
    failed_at = F.min(F.when(F.col("status").isNotNull(), F.col("index"))).over(chain)
    last = F.max("index").over(chain)
    rows = rows.withColumn("_failed_at", failed_at).withColumn("_last_at", last)
    status = (
        F.when(F.col("chain_open") & (F.col("index") == F.col("_last_at")), 2)
        .when(F.col("_failed_at") == F.col("index"), F.col("status"))
        .when(F.col("chain_open") | F.col("_failed_at").isNotNull(), 1)
        .otherwise(F.lit(None))
    )
    return rows.withColumn("status", F.coalesce(status.cast("long"), F.lit(CREATED))).drop("_failed_at", "_last_at")


def _facts(batch: DataFrame, imported: int, odd: Column | None = None) -> dict:
    """What a batch has at all: linked, imported and odd requests, and the sum of its amounts. One look decides which rules need a window or a join."""
    amount = F.col("amount").cast("double") if "amount" in batch.columns else F.lit(0.0)
    columns = {"linked": F.max(has("flags", 1)), "imported": F.max(has("flags", imported)), "odd": F.max(F.lit(False) if odd is None else odd), "total": F.coalesce(F.sum(amount), F.lit(0.0))}
    return batch.agg(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def _in_chains(rows: DataFrame, facts: dict) -> DataFrame:
    """rows with chain and chain_open; a window only where something is linked."""
    return chains(rows) if facts["linked"] else rows.withColumns({"chain": F.lit(0), "chain_open": F.lit(False)})


def _settled(rows: DataFrame, facts: dict) -> DataFrame:
    """batch_id, index, id and the final status."""
    rows = with_chain_failures(rows) if facts["linked"] else rows.withColumn("status", F.coalesce(F.col("status").cast("long"), F.lit(CREATED)))
    return rows.select("batch_id", "index", "id", "status")


def _import_rules(rows: DataFrame, bit: int, expected: int, not_expected: int, ahead: int, clock: int | Column | None) -> DataFrame:
    """rows with import_rule: the code where a request doesn't import as its batch's first one does, or where its timestamp isn't before the clock."""
    imported = has("flags", bit)
    first = F.first(imported).over(Window.partitionBy("batch_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0))
    late = imported & (F.col("timestamp") >= (clock if isinstance(clock, Column) else F.lit(clock))) if clock is not None else F.lit(False)
    return rows.withColumn("import_rule", first_of([(first & ~imported, expected), (~first & imported, not_expected), (late, ahead)]))


def _newest_before(rows: DataFrame, counts: Column, at: Column, existing: DataFrame) -> DataFrame:
    """rows with newest: the largest `at` of existing rows and of the rows before it, in order of batch and index, for which counts holds.

    Within a batch by a window over its at most 8,190 requests, over batches by one over a row a batch.
    """
    taken = F.when(counts, at)
    within = F.max(taken).over(Window.partitionBy("batch_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    batches = rows.groupBy(F.col("batch_id").alias("b")).agg(F.max(taken).alias("last"))
    batches = batches.select("b", F.max("last").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    newest = existing.agg(F.coalesce(F.max("timestamp"), F.lit(0)).alias("known_newest"))
    out = rows.withColumn("within", within)
    out = out.join(batches, out["batch_id"] == batches["b"], "left").crossJoin(F.broadcast(newest))  # one number
    return out.withColumn("newest", F.greatest(F.coalesce("within", F.lit(0)), F.coalesce("earlier", F.lit(0)), "known_newest")).drop("b", "within", "earlier", "known_newest")


def account_shape(mask: int = ACCOUNT_MASK, id_max: int = ID_MAX) -> Column:
    """The first rule that an account request breaks by itself, or null."""
    imported = has("flags", ACCOUNT_FLAGS["imported"])
    return first_of([
        (imported & ~F.col("timestamp").between(1, TIMESTAMP_MAX), 24), (~imported & (F.col("timestamp") != 0), 3), (reserved_bits("flags", mask), 5),
        (F.col("id") == 0, 6), (F.col("id") == id_max, 7), (account_limits_exclude("flags"), 8), (F.col("debits_pending") != 0, 9), (F.col("debits_posted") != 0, 10),
        (F.col("credits_pending") != 0, 11), (F.col("credits_posted") != 0, 12), (F.col("ledger") == 0, 13), (F.col("code") == 0, 14),
    ])


def _with_known(rows: DataFrame, existing: DataFrame, fields) -> DataFrame:
    """rows with known: the fields of the existing row that has the id, or null."""
    known = existing.select(F.col("id").alias("known_id"), F.struct(*fields).alias("known")).dropDuplicates(["known_id"])
    return rows.join(known, rows["id"] == known["known_id"], "left").drop("known_id")


def _by_id(rows: DataFrame, fields: dict[str, int], exists: int) -> DataFrame:
    """rows (status: what a request is by itself, own: what the ledger says, known) with the final status, null if created.

    Of the requests that share an id, in order, each gets its own code until one is created or fails for a passing
    reason; then the id exists or, in the other case, is used up (68).
    """
    settles = F.col("status").isNull() & F.col("known").isNull() & (F.col("own").isNull() | transient("own"))
    first = rows.where(settles).groupBy(F.col("id").alias("first_id")).agg(F.min(F.struct("batch_id", "index", "own", *fields)).alias("first"))
    rows = rows.join(first, rows["id"] == first["first_id"], "left").drop("first_id")
    later = F.coalesce((F.col("batch_id") > F.col("first.batch_id")) | ((F.col("batch_id") == F.col("first.batch_id")) & (F.col("index") > F.col("first.index"))), F.lit(False))

    def compare(other: str) -> Column:
        return F.coalesce(*[F.when(F.col(n) != F.col(f"{other}.{n}"), code) for n, code in fields.items()], F.lit(exists))

    status = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("known").isNotNull(), compare("known"))
        .when(F.col("used_up"), 68)
        .when(later & F.col("first.own").isNotNull(), 68)
        .when(later, compare("first"))
        .otherwise(F.col("own"))
    )
    return rows.withColumn("status", status).drop("known", "first", "own", "used_up")


def create_accounts(batch: DataFrame, accounts: DataFrame, mask: int = ACCOUNT_MASK, clock: int | Column | None = None) -> DataFrame:
    """batch_id, index, id and status of each account request.

    clock: the time at which the batches are taken, which imported timestamps must not reach; not tested if not given.
    Of imported requests that share an id only the first counts for the order of timestamps.
    """
    bit = ACCOUNT_FLAGS["imported"]
    facts = _facts(batch, bit)
    rows = _in_chains(batch, facts)
    rows = _import_rules(rows, bit, 22, 23, 25, clock) if facts["imported"] else rows.withColumn("import_rule", F.lit(None).cast("int"))
    # 24 comes before 25: a timestamp out of range is no timestamp.
    shape = account_shape(mask)
    mixed = F.when(F.col("import_rule") < 24, F.col("import_rule"))
    rows = rows.withColumn("status", F.coalesce(mixed, F.when(shape == 24, shape), "import_rule", shape)).drop("import_rule")
    rows = _with_known(rows, accounts, list(ACCOUNT_DIFFERS))
    own = F.lit(None).cast("int")
    if facts["imported"]:
        sound = F.col("status").isNull() & F.col("known").isNull()
        rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("batch_id", "id", sound).orderBy("index")) > 1)
        rows = _newest_before(rows, sound & ~F.col("again") & has("flags", bit), F.col("timestamp"), accounts).drop("again")
        own = F.when(has("flags", bit) & (F.col("timestamp") <= F.col("newest")), 26)
    rows = rows.withColumns({"own": own, "used_up": F.lit(False)}).drop("newest")
    return _settled(_by_id(rows, ACCOUNT_DIFFERS, 21), facts)


def transfer_shape(mask: int = TRANSFER_MASK, id_max: int = ID_MAX) -> Column:
    """The first rule that a transfer request breaks by itself, or null."""
    imported, pending = has("flags", _T["imported"]), has("flags", _T["pending"])
    post, void = has("flags", _T["post_pending"]), has("flags", _T["void_pending"])
    balancing = has("flags", _T["balancing_debit"] | _T["balancing_credit"])
    closing = has("flags", _T["closing_debit"] | _T["closing_credit"])
    resolves = post | void
    dr, cr = F.col("debit_account_id"), F.col("credit_account_id")
    return first_of([
        (imported & ~F.col("timestamp").between(1, TIMESTAMP_MAX), 58), (~imported & (F.col("timestamp") != 0), 3), (reserved_bits("flags", mask), 4),
        (F.col("id") == 0, 5), (F.col("id") == id_max, 6), (resolves & (~post_xor_void("flags") | pending | balancing | closing), 7),
        (~resolves & (dr == 0), 8), (dr == id_max, 9), (~resolves & (cr == 0), 10), (cr == id_max, 11), ((dr != 0) & (dr == cr), 12),
        (~resolves & (F.col("pending_id") != 0), 13), (resolves & (F.col("pending_id") == 0), 14), (resolves & (F.col("pending_id") == id_max), 15),
        (resolves & (F.col("pending_id") == F.col("id")), 16), (~pending & (F.col("timeout") != 0), 17), (imported & (F.col("timeout") != 0), 63),
        (closing & ~pending, 64), (~resolves & (F.col("ledger") == 0), 19), (~resolves & (F.col("code") == 0), 20),
    ])


def _odd() -> Column:
    """Whether a request that is sound by itself balances or closes."""
    return has("flags", _T["balancing_debit"] | _T["balancing_credit"] | _T["closing_debit"] | _T["closing_credit"]) & transfer_shape().isNull()


def needs_order(batch: DataFrame, accounts: DataFrame, transfers: DataFrame, facts: dict | None = None) -> DataFrame:
    """(batch_id, index, reason) of requests whose result may depend on results before it in ways that joins don't show.

    One look at the tables tells which reasons can occur at all; only those are joined for.
    """
    resolves = has("flags", _T["post_pending"] | _T["void_pending"])
    place = ["batch_id", "index"]
    seen = facts or _facts(batch, _T["imported"], _odd())
    before = transfers.agg(F.sum(F.col("amount").cast("double"))).first()[0] or 0.0
    marked = accounts.where(has("flags", ACCOUNT_FLAGS["debits_must_not_exceed_credits"] | ACCOUNT_FLAGS["credits_must_not_exceed_debits"] | ACCOUNT_FLAGS["closed"])).select(F.col("id").alias("account"))

    ids = batch.groupBy(F.col("id").alias("shared_id")).agg(
        F.count("*").alias("n"), F.max(resolves).alias("some"), F.min(resolves).alias("all"), F.min("pending_id").alias("low"), F.max("pending_id").alias("high"),
        F.max(has("flags", _T["linked"] | _T["imported"])).alias("bound"),
    )
    odd = ids.where((F.col("n") > 1) & ((F.col("some") & (~F.col("all") | (F.col("low") != F.col("high")))) | F.col("bound"))).select("shared_id")
    out = batch.join(odd, batch["id"] == odd["shared_id"], "left_semi").select(*place, F.lit("an id shared by different resolvers, or with a linked or imported request").alias("reason"))
    if seen["odd"]:
        out = out.unionByName(batch.where(_odd()).select(*place, F.lit("balancing or closing").alias("reason")))
    if marked.limit(1).count():
        sides = F.explode(F.array("debit_account_id", "credit_account_id")).alias("account")
        resolved, held = batch.where(resolves).select(*place, "pending_id"), transfers.select(F.col("id").alias("held_id"), sides)
        touched = batch.where(~resolves).select(*place, sides).unionByName(resolved.join(held, resolved["pending_id"] == held["held_id"]).select(*place, "account"))
        out = out.unionByName(touched.join(marked, "account", "left_semi").select(*place, F.lit("an account with a limit, or closed").alias("reason")))
    if seen["linked"]:
        # What a chain's rows create may be undone, so nothing else may name it, and they may not resolve anything.
        linked = chains(batch).withColumn("in_chain", F.max(has("flags", _T["linked"])).over(Window.partitionBy("batch_id", "chain"))).where("in_chain")
        named = batch.where(resolves).select(F.col("pending_id").alias("named_id")).distinct()
        undone = linked.join(named, linked["id"] == named["named_id"], "left_semi").unionByName(linked.where(resolves))
        out = out.unionByName(undone.select(*place, F.lit("two-phase transfers in a chain").alias("reason")))
    # Where all amounts together stay below the largest balance, no balance overflows and codes 47 to 52 can't occur.
    if seen["total"] + before > float(AMOUNT_MAX) * 0.999:
        out = out.unionByName(batch.select(*place, F.lit("balances may overflow").alias("reason")))
    return out


def create_transfers(batch: DataFrame, accounts: DataFrame, transfers: DataFrame, used_up: DataFrame | None = None, clock: int | Column | None = None, check: bool = True) -> DataFrame:
    """batch_id, index, id and status of each transfer request.

    Requests carry timestamp 0 unless imported; column at is the time that the batch's clock gives each (the timestamp
    of an imported one). transfers are those created before, used_up the ids (column id) that failed for a passing
    reason before. clock: as for create_accounts. A batch with requests that need the order is refused; check=False is
    for callers that have asked needs_order themselves.
    """
    facts = _facts(batch, _T["imported"], _odd())
    if check and (found := needs_order(batch, accounts, transfers, facts).limit(1).collect()):
        raise ValueError(f"this batch needs the ordered fold: request {found[0]['index']} of batch {found[0]['batch_id']}: {found[0]['reason']}")
    imported = has("flags", _T["imported"])
    rows = _in_chains(batch, facts)
    rows = _import_rules(rows, _T["imported"], 56, 57, 59, clock) if facts["imported"] else rows.withColumn("import_rule", F.lit(None).cast("int"))
    shape = transfer_shape()
    mixed = F.when(F.col("import_rule") < 58, F.col("import_rule"))
    rows = rows.withColumn("status", F.coalesce(mixed, F.when(shape == 58, shape), "import_rule", shape)).drop("import_rule")
    for p, name in (("dr", "debit_account_id"), ("cr", "credit_account_id")):
        known = accounts.select(F.col("id").alias(f"{p}_id"), F.col("ledger").alias(f"{p}_ledger"), F.col("timestamp").alias(f"{p}_at"))
        rows = rows.join(known, rows[name] == known[f"{p}_id"], "left")
    resolves = has("flags", _T["post_pending"] | _T["void_pending"])
    overflow = has("flags", _T["pending"]) & (F.col("timeout") > (F.lit(TIMESTAMP_MAX) - F.col("at")) / NS)
    on_accounts = first_of([
        (F.col("dr_id").isNull(), 21), (F.col("cr_id").isNull(), 22), (F.col("dr_ledger") != F.col("cr_ledger"), 23),
        (F.col("ledger") != F.col("dr_ledger"), 24), (overflow, 53), (imported & (F.col("timestamp") <= F.col("dr_at")), 61), (imported & (F.col("timestamp") <= F.col("cr_at")), 62),
    ])
    rows = rows.withColumn("own", F.when(~resolves, on_accounts)).drop("dr_id", "dr_ledger", "dr_at", "cr_id", "cr_ledger", "cr_at")
    rows = _with_known(rows, transfers, list(TRANSFER_DIFFERS))
    if used_up is None:
        rows = rows.withColumn("used_up", F.lit(False))
    else:
        used = used_up.select(F.col("id").alias("used_id")).distinct()
        rows = rows.join(used, rows["id"] == used["used_id"], "left").withColumn("used_up", F.col("used_id").isNotNull()).drop("used_id")
    if facts["imported"]:
        # 60: an imported timestamp comes after all transfers that exist and were imported before it.
        sound = F.col("status").isNull() & F.col("known").isNull() & F.col("own").isNull()
        rows = _newest_before(rows, sound & imported, F.col("timestamp"), transfers)
        rows = rows.withColumn("own", F.coalesce("own", F.when(imported & (F.col("timestamp") <= F.col("newest")), 60))).drop("newest")
    rows = cut(rows)  # read four times below

    # Requests that name no pending transfer depend on accounts and ids only.
    plain = cut(_by_id(rows.where(~resolves), TRANSFER_DIFFERS, 46))
    names = ("id", "debit_account_id", "credit_account_id", "amount", "pending_id", "timeout", "ledger", "code", "flags")
    created = plain.where(F.col("status").isNull()).select(*names, F.col("at").alias("timestamp"))
    none = {"batch_id": F.lit(None).cast("long"), "index": F.lit(None).cast("long")}
    before = transfers.select(*names, "timestamp")
    asked = rows.where(resolves & F.col("status").isNull() & F.col("known").isNull()).select(*names, F.col("at").alias("timestamp"), F.col("batch_id").cast("long").alias("batch_id"), F.col("index").cast("long").alias("index"))
    found = resolve(before.withColumns(none).unionByName(asked), before.unionByName(created)).where(F.col("batch_id").isNotNull())
    found = found.select(F.col("batch_id").alias("found_batch"), F.col("index").alias("found_index"), F.col("status").alias("found"))
    other = rows.where(resolves)
    other = other.join(found, (other["batch_id"] == found["found_batch"]) & (other["index"] == found["found_index"]), "left")
    other = cut(other.withColumn("own", F.coalesce("own", "found")).drop("found_batch", "found_index", "found"))
    other = cut(_by_id(other, TRANSFER_DIFFERS, 46))
    # Who names a resolver of the batch that was created names something that isn't pending.
    done = other.where(F.col("status").isNull()).groupBy(F.col("id").alias("done_id")).agg(F.min("at").alias("done_at"))
    other = other.join(done, (other["pending_id"] == done["done_id"]) & (done["done_at"] < other["at"]), "left")
    other = other.withColumn("status", F.when((F.col("status") == 25) & F.col("done_id").isNotNull(), 26).otherwise(F.col("status"))).drop("done_id", "done_at")
    return _settled(plain.unionByName(other), facts)


def used_up_ids(results: DataFrame) -> DataFrame:
    """The ids that results (id, status) of create_transfers use up: failed for a passing reason, they may not be asked again."""
    return results.where(transient("status")).select("id").distinct()


def duplicates(batch: DataFrame) -> DataFrame:
    """Rows whose id an earlier row of the table has, with their rank."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("timestamp"))
    return batch.withColumn("rank", rank).where("rank > 1")


def regressions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose timestamp doesn't advance over the row before them within their key, by id."""
    before = F.lag("timestamp").over(Window.partitionBy(*keys).orderBy("id"))
    return rows.withColumn("previous_timestamp", before).where(F.col("timestamp") <= F.col("previous_timestamp"))
