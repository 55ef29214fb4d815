"""Hand-made cases: merges, status codes, the fold against the fast path, streams against batch."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from countinghouse.functions.columns import credits_exceed_debits, debits_exceed_credits, display_id, div_ceil
from countinghouse.model import ACCOUNT_SCHEMA, AMOUNT_MAX, CREATED, TRANSFER_SCHEMA, AccountFilter, ChangeEventsFilter, QueryFilter
from countinghouse.operators import audit, combine, events, fold, pending, query, validate
from countinghouse.plans import queries as plans
from countinghouse.sources import derived, generator, store
from countinghouse.streaming import flows

A = [f.name for f in ACCOUNT_SCHEMA]
T = [f.name for f in TRANSFER_SCHEMA]


def accounts(spark, *rows):
    base = dict.fromkeys(A, 0) | {"ledger": 1, "code": 10}
    full = [base | r for r in rows]
    from decimal import Decimal

    amounts = ("debits_pending", "debits_posted", "credits_pending", "credits_posted")
    return spark.createDataFrame([tuple(Decimal(r[n]) if n in amounts else r[n] for n in A) for r in full], ACCOUNT_SCHEMA)


def requests(spark, *rows, batch=True):
    from decimal import Decimal

    base = dict.fromkeys(T, 0) | {"ledger": 1, "code": 1, "debit_account_id": 1, "credit_account_id": 2, "amount": 10}
    full = [base | {"id": 100 + n} | r for n, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(Decimal(r[n]) if n == "amount" else r[n] for n in T) for r in full], TRANSFER_SCHEMA)
    place = {100 + n: n for n in range(len(rows))} | {r["id"]: n for n, r in enumerate(full)}
    at = spark.createDataFrame([(r["id"], n, full[n].get("at", 1000 + n)) for n, r in enumerate(full)], "k long, index long, at long")
    assert place
    # Repeated ids are numbered by their place.
    rows_ = [tuple(Decimal(r[n]) if n == "amount" else r[n] for n in T) + (0, n, r.get("at", 1000 + n)) for n, r in enumerate(full)]
    schema = TRANSFER_SCHEMA.__class__(TRANSFER_SCHEMA.fields + spark.createDataFrame([], "batch_id long, index long, at long").schema.fields)
    assert at.count() == len(rows) and df.count() == len(rows)
    return spark.createDataFrame(rows_, schema)


def fast(spark, accs, *rows, existing=(), **options):
    before = requests(spark, *existing).select(*T) if existing else spark.createDataFrame([], TRANSFER_SCHEMA)
    out = validate.create_transfers(requests(spark, *rows), accs, before, **options)
    return [r["status"] for r in out.orderBy("index").collect()]


def folded(spark, accs, *rows):
    batch = requests(spark, *rows).withColumn("shape", F.coalesce(validate.transfer_shape(), F.lit(0))).withColumn("timestamp", F.col("at"))
    out = fold.create_transfers_fold(batch, accs).orderBy("index").collect()
    return [r["status"] for r in out], [int(r["amount"]) for r in out]


@pytest.fixture(scope="module")
def plain(spark):
    return accounts(spark, {"id": 1, "timestamp": 1}, {"id": 2, "timestamp": 2}, {"id": 3, "timestamp": 3, "ledger": 2})


def test_merge_and_intersection(spark):
    def stream(keys):
        return spark.createDataFrame([(k,) for k in keys], "key int")

    got = combine.merge([stream(s) for s in ([0, 3, 4, 8, 11], [2, 11, 12, 13, 15], [1, 2, 11])], ["key"]).collect()
    assert sorted((r["key"], r["stream"]) for r in got) == [(0, 0), (1, 2), (2, 1), (3, 0), (4, 0), (8, 0), (11, 0), (12, 1), (13, 1), (15, 1)]
    assert sorted(r[0] for r in combine.intersect([stream(range(a, a + 5)) for a in (1, 2, 3, 4)], "key").collect()) == [4, 5]
    assert combine.intersect([stream([1, 3, 5]), stream([2, 4])], "key").count() == 0
    assert combine.intersect([stream([1, 3, 5]), stream([])], "key").count() == 0
    many = [stream(range(1, 1001)), stream(range(10, 1001, 10)), stream([10**k for k in range(9)])]
    assert sorted(r[0] for r in combine.intersect(many, "key").collect()) == [10, 100, 1000]


def test_levels_and_tombstones(spark):
    def run(rows):
        return spark.createDataFrame(rows, "key long, data long, deleted boolean")

    assert [tuple(r) for r in combine.merge_levels(run([(1, 100, False)]), run([(1, 200, False)]), ["key"]).select("key", "data").collect()] == [(1, 100)]
    got = combine.merge_levels(run([(1, 0, True)]), run([(1, 10, False), (2, 20, False)]), ["key"], drop_tombstones=True)
    assert [tuple(r)[:2] for r in got.select("key", "data").collect()] == [(2, 20)]
    signs = spark.createDataFrame([(5, 1), (5, -1), (6, 1)], "key long, sign int")
    assert [tuple(r) for r in combine.cancel(signs, ["key"]).collect()] == [(6, 1)]


def test_smallest_interval(spark):
    rows = [("a", 11, 13), ("a", 10, 12), ("a", 8, 12), ("b", 8, 12), ("b", 10, 12), ("b", 8, 9), ("c", 1, 2), ("c", 2, 3)]
    df = spark.createDataFrame(rows, "key string, lower long, upper long")
    got = {r["key"]: (r["lower"], r["upper"], r["sources_true"]) for r in audit.smallest_interval(df, ["key"]).collect()}
    assert got == {"a": (11, 12, 3), "b": (8, 9, 2), "c": (2, 2, 2)}


def test_filters(spark, plain):
    assert not AccountFilter(0, limit=1).valid() and not AccountFilter(1).valid() and not AccountFilter(1, limit=1, flags=8).valid() and not AccountFilter(1, limit=1, flags=4).valid()
    assert not QueryFilter(limit=1, flags=2).valid() and not QueryFilter(limit=1, timestamp_min=5, timestamp_max=4).valid()
    assert ChangeEventsFilter(limit=1).valid() and not ChangeEventsFilter().valid()
    assert query.query(plain, QueryFilter(limit=0)).count() == 0
    assert [r["id"] for r in query.query(plain, QueryFilter(timestamp_min=2, limit=5, flags=1)).collect()] == [3, 2]


def test_limit_columns(spark):
    df = accounts(spark, {"id": 1, "flags": 2, "debits_posted": 5, "credits_posted": 10}, {"id": 2, "flags": 4, "credits_posted": 5, "debits_posted": 10}, {"id": 3})
    got = df.select("id", debits_exceed_credits(F.lit(6)).alias("d"), credits_exceed_debits(F.lit(6)).alias("c"), div_ceil("id", 2).alias("h"), display_id("id").alias("x")).orderBy("id").collect()
    assert [(r["d"], r["c"], r["h"]) for r in got] == [(True, False, 1), (False, True, 1), (False, False, 2)]
    assert got[0]["x"] == "0" * 31 + "1"


STATUS_CASES = [
    ({"timestamp": 5}, 3), ({"flags": 512}, 4), ({"id": 0}, 5), ({"id": 2**63 - 1}, 6), ({"flags": 12, "pending_id": 7}, 7), ({"debit_account_id": 0}, 8),
    ({"credit_account_id": 0}, 10), ({"debit_account_id": 2}, 12), ({"pending_id": 9}, 13), ({"flags": 4}, 14), ({"flags": 4, "pending_id": 100}, 16), ({"timeout": 3}, 17),
    ({"ledger": 0}, 19), ({"code": 0}, 20), ({"debit_account_id": 9}, 21), ({"credit_account_id": 9}, 22), ({"credit_account_id": 3}, 23), ({"ledger": 2}, 24),
    ({"flags": 4, "pending_id": 55}, 25), ({"flags": 64}, 64), ({}, CREATED), ({"flags": 2, "timeout": 2**62}, 53),
]


@pytest.mark.parametrize("request_,status", STATUS_CASES, ids=[str(s) for _, s in STATUS_CASES])
def test_status_codes(spark, plain, request_, status):
    assert fast(spark, plain, request_) == [status]
    if status != 4:
        assert folded(spark, plain, request_)[0] == [status]


def test_two_phase(spark, plain):
    rows = (
        {"flags": 2, "amount": 100}, {"flags": 4, "pending_id": 100, "amount": 40}, {"flags": 8, "pending_id": 100, "amount": 0}, {"flags": 4, "pending_id": 101},
        {"flags": 2, "amount": 7, "timeout": 1, "at": 2000}, {"flags": 4, "pending_id": 104, "amount": 7, "at": 2000 + 10**9}, {"flags": 2, "amount": 9, "at": 3000 + 10**9},
        {"flags": 8, "pending_id": 106, "amount": 9, "at": 4000 + 10**9}, {"flags": 4, "pending_id": 106, "amount": 9, "at": 5000 + 10**9}, {"flags": 2, "amount": 5, "at": 6000 + 10**9},
        {"flags": 4, "pending_id": 109, "amount": 6, "at": 7000 + 10**9}, {"flags": 8, "pending_id": 109, "amount": 4, "at": 8000 + 10**9},
    )
    wanted = [CREATED, CREATED, 33, 26, CREATED, 35, CREATED, CREATED, 34, CREATED, 31, 32]
    assert fast(spark, plain, *rows) == wanted
    assert folded(spark, plain, *rows)[0] == wanted


def test_duplicates(spark, plain):
    rows = ({"id": 7}, {"id": 7}, {"id": 7, "amount": 11}, {"id": 7, "code": 2}, {"id": 7, "flags": 2})
    wanted = [CREATED, 46, 39, 45, 36]
    assert fast(spark, plain, *rows) == wanted
    assert folded(spark, plain, *rows)[0] == wanted


def test_used_up_ids(spark, plain):
    """An id that failed for a passing reason is used up; one that failed for another may be asked again."""
    rows = ({"id": 7, "debit_account_id": 9}, {"id": 7}, {"id": 8, "ledger": 2}, {"id": 8}, {"id": 8}, {"id": 9, "flags": 4, "pending_id": 55}, {"id": 9, "flags": 4, "pending_id": 55})
    wanted = [21, 68, 24, CREATED, 46, 25, 68]
    assert fast(spark, plain, *rows) == wanted
    assert folded(spark, plain, *rows)[0] == wanted
    results = validate.create_transfers(requests(spark, *rows), plain, spark.createDataFrame([], TRANSFER_SCHEMA))
    used = validate.used_up_ids(results)
    assert sorted(r["id"] for r in used.collect()) == [7, 9]
    # In a later batch.
    assert fast(spark, plain, {"id": 7}, {"id": 10}, used_up=used) == [68, CREATED]


def test_against_existing_transfers(spark, plain):
    existing = ({"id": 100}, {"id": 101, "flags": 2, "amount": 50, "at": 2}, {"id": 102, "flags": 2, "amount": 60}, {"id": 103, "flags": 4, "pending_id": 102, "amount": 60})
    existing = [r | {"timestamp": 10 + n} for n, r in enumerate(existing)]
    rows = (
        {"id": 100, "timestamp": 0}, {"id": 100, "amount": 11}, {"id": 103, "flags": 4, "pending_id": 102, "amount": 60}, {"flags": 8, "pending_id": 102, "amount": 0}, {"flags": 4, "pending_id": 101, "amount": 51},
        {"flags": 4, "pending_id": 101, "amount": 50}, {"flags": 4, "pending_id": 101, "amount": 50}, {"flags": 4, "pending_id": 100}, {"flags": 4, "pending_id": 103}, {"id": 300, "flags": 2}, {"flags": 4, "pending_id": 300},
    )
    rows = [{"id": 200 + n} | r for n, r in enumerate(rows)]
    assert fast(spark, plain, *rows, existing=existing) == [46, 39, 46, 33, 31, CREATED, 33, 26, 26, CREATED, CREATED]


def test_imported_transfers(spark, plain):
    """A batch imports or doesn't; imported timestamps lie before the clock, after both accounts, and advance."""
    def imported(*rows):
        return [{"flags": 256} | r | {"at": r.get("timestamp", 0)} for r in rows]

    rows = imported({"timestamp": 10}, {"timestamp": 10}, {"timestamp": 9}, {"timestamp": 2}, {"timestamp": 1}, {"timestamp": 900}, {"timestamp": 0}, {"timestamp": 20, "debit_account_id": 9}, {"timestamp": 15}, {"timestamp": 16, "flags": 0})
    assert fast(spark, plain, *rows, clock=500) == [CREATED, 60, 60, 62, 61, 59, 58, 21, CREATED, 56]
    assert fast(spark, plain, {}, *imported({"timestamp": 10})) == [CREATED, 57]
    assert fast(spark, plain, *imported({"timestamp": 30}, {"timestamp": 50}), existing=[{"id": 1, "timestamp": 40}]) == [60, CREATED]


def test_batches_that_need_the_order_are_refused(spark, plain):
    closed = accounts(spark, {"id": 1, "timestamp": 1, "flags": 32}, {"id": 2, "timestamp": 2})
    cases = [
        (plain, ({"flags": 16},)), (plain, ({"flags": 66},)), (closed, ({},)), (plain, ({"id": 7}, {"id": 7, "flags": 4, "pending_id": 9})), (plain, ({"id": 7, "flags": 1}, {"id": 7})),
        (plain, ({"flags": 3}, {"code": 0}, {"flags": 4, "pending_id": 100})), (plain, ({"amount": AMOUNT_MAX}, {"amount": AMOUNT_MAX})),
    ]
    for accs, rows in cases:
        with pytest.raises(ValueError, match="ordered fold"):
            fast(spark, accs, *rows)
    # A resolver of an existing transfer on a closed account.
    assert validate.needs_order(requests(spark, {"id": 9, "flags": 4, "pending_id": 5, "debit_account_id": 0, "credit_account_id": 0}), closed, requests(spark, {"id": 5, "flags": 2}).select(*T)).count() >= 1
    assert validate.needs_order(requests(spark, {}, {"flags": 1}, {}), plain, spark.createDataFrame([], TRANSFER_SCHEMA)).count() == 0


def test_chains(spark, plain):
    rows = ({"flags": 1}, {"flags": 1, "code": 0}, {}, {}, {"flags": 1}, {}, {"flags": 1})
    wanted = [1, 20, 1, CREATED, CREATED, CREATED, 2]
    assert fast(spark, plain, *rows) == wanted
    assert folded(spark, plain, *rows)[0] == wanted


def test_fold_limits_balancing_closing_and_failed_ids(spark):
    accs = accounts(spark, {"id": 1, "timestamp": 1, "flags": 2}, {"id": 2, "timestamp": 2}, {"id": 3, "timestamp": 3})
    rows = (
        {"debit_account_id": 2, "credit_account_id": 1, "amount": 100}, {"amount": 70}, {"amount": 40}, {"amount": 30}, {"id": 102, "amount": 1},
        {"debit_account_id": 2, "credit_account_id": 1, "amount": 10}, {"flags": 16, "amount": 1000}, {"flags": 66, "amount": 0}, {"amount": 0, "debit_account_id": 2, "credit_account_id": 1},
        {"flags": 8, "pending_id": 107, "amount": 0}, {"amount": 0, "debit_account_id": 2, "credit_account_id": 1},
        {"flags": 1, "debit_account_id": 2, "credit_account_id": 1, "amount": 500}, {"amount": 501}, {"amount": 1},
        {"debit_account_id": 2, "credit_account_id": 3, "amount": AMOUNT_MAX}, {"debit_account_id": 2, "credit_account_id": 3, "amount": AMOUNT_MAX},
    )
    status, amount = folded(spark, accs, *rows)
    assert status == [CREATED, CREATED, 54, CREATED, 68, CREATED, CREATED, CREATED, 66, CREATED, CREATED, 1, 54, 54, 49, 49]
    assert amount[6] == 10 and amount[9] == 0


def test_fold_equals_fast_path(spark, plain):
    r, rows = random.Random(5), []
    for n in range(120):
        kind = r.random()
        row = {"amount": r.randint(1, 50), "at": 1000 + 10**9 * n}
        if kind < 0.4:
            row |= {"flags": 2, "timeout": r.choice([0, 3, 30])}
        elif kind < 0.8:
            row |= {"flags": r.choice([4, 8]), "pending_id": 100 + r.randint(0, max(0, n - 1)), "amount": r.choice([0, 5, 20])}
            row["pending_id"] += row["pending_id"] == 100 + n
        rows.append(row)
    # An id that fails only because of the state is not used again here, so both paths apply.
    assert fast(spark, plain, *rows) == folded(spark, plain, *rows)[0]


def test_account_batch(spark):
    existing = accounts(spark, {"id": 5, "timestamp": 5, "user_data_64": 7})
    rows = [{"id": 5, "user_data_64": 7}, {"id": 5, "user_data_64": 8}, {"id": 6}, {"id": 6}, {"id": 6, "code": 11}, {"id": 0}, {"id": 8, "flags": 6}, {"id": 9, "flags": 64}, {"id": 10, "flags": 1}, {"id": 0}, {"id": 11, "flags": 16, "timestamp": 3}, {"id": 12, "flags": 16, "timestamp": 9}]

    def run(rows, **options):
        at = F.row_number().over(Window.orderBy("n"))
        numbered = accounts(spark, *rows).withColumn("n", F.monotonically_increasing_id())
        batch = numbered.withColumns({"index": at.cast("long"), "batch_id": F.floor((at - 1) / 20)}).drop("n")
        return [r["status"] for r in validate.create_accounts(batch, existing, **options).orderBy("index").collect()]

    assert run(rows) == [21, 17, CREATED, 21, 20, 6, 8, 5, 1, 6, 23, 23]
    # A batch that imports: not after the clock, in order, and past what exists; the next batch goes on from there.
    imported = [{"id": 20 + n, "flags": 16, "timestamp": t} for n, t in enumerate((3, 9, 8, 70, 10, 0))] + [{"id": 40}, {"id": 21, "flags": 16, "timestamp": 11}]
    imported += [{"id": 50 + n, "flags": 16, "timestamp": 30} for n in range(12)] + [{"id": 80, "flags": 16, "timestamp": 29}, {"id": 81, "flags": 16, "timestamp": 31}]
    assert run(imported, clock=60) == [26, CREATED, 26, 25, CREATED, 24, 22, 21] + [CREATED] + [26] * 11 + [26, CREATED]


def test_change_event_pages(spark, sf):
    """A page of events has the balances that a run over all movements gives."""
    rows, accs = derived.two_phase(spark, sf), derived.accounts(spark, sf)
    moves = events.movements(rows, plans.NOW)
    every = {(r["timestamp"], r["transfer_id"]): r for r in events.account_events(moves, accs).collect()}
    times = sorted(t for t, _ in every)
    for f in (ChangeEventsFilter(limit=50), ChangeEventsFilter(times[300], times[700], limit=10_000), ChangeEventsFilter(times[-5], limit=3)):
        page = events.change_events(moves, rows, accs, f).collect()
        wanted = [t for t in times if t >= f.timestamp_min and (not f.timestamp_max or t <= f.timestamp_max)][: f.limit]
        assert [r["timestamp"] for r in page] == wanted
        for r in page:
            full = every[r["timestamp"], r["transfer_id"]]
            assert all(r[n] == full[n] for n in full.asDict())
            assert r["transfer_timestamp"] <= r["timestamp"] and r["dr_account_user_data_64"] is not None
    assert events.change_events(moves, rows, accs, ChangeEventsFilter()).count() == 0


def test_busy_accounts_join_by_day(spark, sf, tmp_path):
    """No row of events is dealt by its account alone, where accounts are too many to broadcast."""
    moves, accs = events.movements(derived.two_phase(spark, sf), plans.NOW), derived.accounts(spark, sf)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for make in (events.account_events, events.event_flags):
            plan = make(moves, accs)._jdf.queryExecution().executedPlan().toString()
            joins = [x for x in plan.splitlines() if "SortMergeJoin" in x and "known_id" in x]
            assert len(joins) == (1 if make is events.account_events else 2)
            # What joins accounts has one row a day.
            lines = plan.splitlines()
            for j in joins:
                below = lines[lines.index(j) + 1 : lines.index(j) + 12]
                assert any("Window" in x or "HashAggregate" in x for x in below)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_upper_median_of_large_keys(spark):
    rows = spark.range(60_001).select((F.col("id") % 2).alias("key"), (F.col("id") * 7919 % 60_001).alias("value")).unionByName(spark.createDataFrame([(7, 5), (8, 1), (8, 2), (None, 3), (9, None)], "key long, value long"))
    got = {r["key"]: r["median"] for r in audit.upper_median(rows, ["key"], "value").collect()}
    held = {k: sorted(n * 7919 % 60_001 for n in range(k, 60_001, 2)) for k in (0, 1)}
    assert got == {k: v[len(v) // 2] for k, v in held.items()} | {7: 5, 8: 2, None: 3}


def test_pages_are_bounded(spark):
    rows = generator.transfers(spark, 9000, 50)
    assert query.query(rows, QueryFilter(ledger=1, limit=100_000)).count() == 8190


def test_balances_agree(spark, sf):
    moves = events.movements(derived.two_phase(spark, sf), plans.NOW)
    total = {r["account_id"]: tuple(map(int, r[1:])) for r in events.totals(moves).collect()}
    last = combine.newest(events.running(moves).withColumn("v", F.struct("timestamp", "transfer_id", "side")), ["account_id"], "v")
    names = ("debits_pending", "debits_posted", "credits_pending", "credits_posted")
    assert total == {r["account_id"]: tuple(int(r[n]) for n in names) for r in last.collect()}
    assert all(x >= 0 for v in total.values() for x in v)
    # A transfer that is still pending has not been resolved, and the reverse.
    open_ = pending.pending_status(derived.two_phase(spark, sf), plans.NOW)
    assert open_.where("status = 1 AND resolved_at IS NOT NULL").count() == 0


def test_stream_expiry(spark, sf):
    moves = derived.two_phase(spark, sf)
    end = moves.agg(F.max("timestamp")).first()[0]
    wanted = {(r["id"], r["expires_at"]) for r in pending.due(moves, end - 10**6).collect()}
    got = {(r["pending_id"], r["expired_at"]) for r in plans.queries()["stream_expiry"](spark, sf).collect()}
    assert got == wanted


def test_expiry_in_any_order(spark, tmp_path):
    """A late resolver that is read before its pending transfer doesn't resolve it; one in time does, whatever the order; transfers without a timeout stay."""
    rows = requests(
        spark,
        {"id": 11, "flags": 4, "pending_id": 10, "timestamp": 9 * 10**9}, {"id": 10, "flags": 2, "timeout": 5, "timestamp": 10**9},
        {"id": 21, "flags": 8, "pending_id": 20, "timestamp": 5 * 10**9}, {"id": 20, "flags": 2, "timeout": 5, "timestamp": 10**9},
        {"id": 30, "flags": 2, "timestamp": 10**9}, {"id": 40, "flags": 2, "timeout": 2, "timestamp": 2 * 10**9, "amount": 7}, {"id": 43, "flags": 4, "pending_id": 42, "timestamp": 2 * 10**9},
        {"id": 50, "flags": 2, "timeout": 500, "timestamp": 2 * 10**9},
    ).select(*T)
    later = requests(spark, {"id": 41, "flags": 4, "pending_id": 40, "timestamp": 10 * 10**9}, {"id": 60, "flags": 2, "timeout": 1, "timestamp": 20 * 10**9}).select(*T)
    for part in (rows, later):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = flows.read_table(spark, f"{tmp_path}/in", rows.schema, 1)
    with flows.rocksdb(spark):
        out = flows.expiries(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    got = spark.read.schema(flows.EXPIRY_SCHEMA).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == [(10, 1, 10, 6 * 10**9), (40, 1, 7, 4 * 10**9)]


def test_fold_spreads_a_ledger(spark):
    """Requests of one ledger that results can't cross are several tasks' work; those under a limit stay together, in order."""
    accs = accounts(spark, *[{"id": n, "timestamp": n, "flags": 2 if n == 1 else 0} for n in range(1, 42)])
    rows = [{"debit_account_id": 2 + n, "credit_account_id": 41} for n in range(30)] + [{"debit_account_id": 41, "credit_account_id": 1, "amount": 15}, {"amount": 10}, {"amount": 10}]
    batch = requests(spark, *rows).withColumn("shape", F.lit(0)).withColumn("timestamp", F.col("at"))
    out = fold.create_transfers_fold(batch, accs, partitions=4).withColumn("task", F.spark_partition_id()).orderBy("index").collect()
    assert [r["status"] for r in out] == [CREATED] * 32 + [54]
    assert len({r["task"] for r in out}) > 1 and len({r["task"] for r in out[30:]}) == 1


def test_fold_query(spark, sf):
    got = plans.queries()["create_transfers_fold"](spark, sf).groupBy("status").count().collect()
    assert {r["status"] for r in got} >= {CREATED, 54} and sum(r["count"] for r in got) == derived.two_phase(spark, sf).count()


def test_number_columns_of_large_keys(spark, tmp_path):
    """Keys for which a long product overflows, against the SQL."""
    import duckdb
    from comparing import same_rows

    keys = [0, 1, 10_248, 10_249, 20_496, 20_497, 111_112, 150_000, 9_000_000, 54_000_000, 10**12]
    path = f"{tmp_path}/orders.parquet"
    spark.createDataFrame([(k, k % 900_000) for k in keys], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    same_rows(plans.queries()["number_columns"](spark, str(tmp_path)), c.sql(plans.oracle_sql()["number_columns"]))


def test_store_and_generator(spark, tmp_path):
    rows = generator.transfers(spark, 500, 20, "zipfian", "random")
    assert rows.select("id").distinct().count() == 500 and rows.where("debit_account_id = credit_account_id").count() == 0
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, generator.transfers(spark, 500, 20, "zipfian", "random").collect()))
    versions = rows.limit(50).withColumns({"version": F.lit(1), "deleted": F.lit(False)})
    store.append(versions, f"{tmp_path}/t")
    store.append(versions.limit(5).withColumns({"version": F.lit(2), "deleted": F.lit(True)}), f"{tmp_path}/t")
    assert store.latest(spark, f"{tmp_path}/t", ["id"]).count() == 45
    store.compact(spark, f"{tmp_path}/t", f"{tmp_path}/u", ["id"])
    assert spark.read.parquet(f"{tmp_path}/u").count() == 45


def test_weighted_sample_is_stable(spark, sf):
    q = plans.queries()["weighted_sample"]
    assert sorted(map(tuple, q(spark, sf).collect())) == sorted(map(tuple, q(spark, sf).collect()))
