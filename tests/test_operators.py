import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidefold.functions import backoff, requests
from tidefold.operators import dedup, expiry, handlers, leasing, records, replies, retention, stats
from tidefold.plans.views import at
from tidefold.schema import JOB as JOB_SCHEMA
from tidefold.schema import RECORD

T0 = dt.datetime(2024, 1, 1)
JOB = "job_id string, queue string, state string, run_at timestamp_ntz, priority int, created_at timestamp_ntz, lease_expiry timestamp_ntz, cancel_req boolean, attempt int, lease_token long"


def sec(n):
    return T0 + dt.timedelta(seconds=n)


def job(job_id, queue="default", state="pending", run_at=0, priority=0, created=0, expiry=None, cancel=False, attempt=0, token=0):
    return (job_id, queue, state, sec(run_at), priority, sec(created), sec(expiry) if expiry is not None else None, cancel, attempt, token)


def names(frame):
    return [r.job_id for r in frame.collect()]


def test_due_order(spark):
    jobs = spark.createDataFrame([job("j1", run_at=10), job("j2", run_at=5), job("j3", run_at=5, priority=10)], JOB)
    assert names(leasing.due_topk(jobs, at(sec(6)), 5).orderBy("rank")) == ["j3", "j2"]
    assert names(leasing.due_topk(jobs, at(sec(11)), 5).orderBy("rank")) == ["j3", "j2", "j1"]
    assert names(leasing.due_topk(jobs, at(sec(1)), 5)) == []


def test_queues_are_isolated_and_drained_in_list_order(spark):
    jobs = spark.createDataFrame([job(f"b{i:03d}", "bulk") for i in range(100)] + [job("c", "critical", priority=100)], JOB)
    assert names(leasing.lease_candidates(jobs, ["critical"], 5, at(T0))) == ["c"]
    assert names(leasing.lease_candidates(jobs, ["bulk", "critical", "bulk"], 3, at(T0)).orderBy("rank")) == ["b000", "b001", "b002"]
    assert names(leasing.lease_candidates(jobs, ["critical", "bulk"], 3, at(T0)).orderBy("rank")) == ["c", "b000", "b001"]
    assert [(r.command, r.job_id) for r in leasing.successive_leases(jobs, "bulk", [2, 1], at(T0)).orderBy("rank").collect()] == [(1, "b000"), (1, "b001"), (2, "b002")]


def test_applied_leases(spark):
    jobs = spark.createDataFrame([job("a"), job("b", attempt=1, token=1), job("z", run_at=99)], JOB)
    after = {r.job_id: r for r in leasing.apply_leases(jobs, leasing.lease_candidates(jobs, ["default"], 9, at(T0)), at(T0), 30, "w").collect()}
    assert (after["b"].state, after["b"].attempt, after["b"].lease_token, after["b"].lease_expiry, after["b"].worker_id) == ("leased", 2, 2, sec(30), "w")
    assert (after["z"].state, after["z"].attempt, after["z"].worker_id) == ("pending", 0, None)


def test_expiry_and_recovery(spark):
    jobs = spark.createDataFrame([job("j1", state="leased", expiry=20), job("j2", state="leased", expiry=10, cancel=True), job("p")], JOB)
    assert names(expiry.in_deadline_order(expiry.expired(jobs, at(sec(15))))) == ["j2"]
    assert names(expiry.in_deadline_order(expiry.expired(jobs, at(sec(25))))) == ["j2", "j1"]
    assert {r.job_id: r.state for r in expiry.apply_expiry(jobs, at(sec(25))).collect()} == {"j1": "pending", "j2": "cancelled", "p": "pending"}
    back = {r.job_id: r for r in expiry.reconcile(jobs, at(sec(3))).collect()}
    assert back["j1"].run_at == sec(3) and back["j1"].last_error == expiry.RECONCILED and back["p"].last_error == ""
    assert expiry.next_wake(jobs).first().next_wake == T0
    assert expiry.next_wake(jobs.where("false")).first().next_wake is None


def test_stats_and_metrics(spark):
    jobs = spark.createDataFrame([job("a", "email", created=-300, run_at=999), job("b", "email", "leased"), job("c", "email", "succeeded"), job("d", 'q"x', "dead")], JOB)
    found = {r.queue: r for r in stats.queue_stats(jobs, at(T0)).collect()}
    assert (found["email"].pending, found["email"].leased, found["email"].succeeded, found["email"].oldest_pending_age_us) == (1, 1, 1, 300_000_000)
    assert found['q"x'].oldest_pending_age_us == 0
    lines = [r.line for r in stats.metrics_lines(stats.queue_stats(jobs, at(T0))).collect()]
    assert lines[0].startswith("# HELP job_queue_depth") and 'job_queue_depth{queue="email",state="leased"} 1' in lines
    assert 'job_oldest_pending_age_seconds{queue="email"} 300.000' in lines and r'job_queue_depth{queue="q\"x",state="dead"} 1' in lines


def test_idempotency(spark):
    rows = spark.createDataFrame([(1, "k"), (2, "k"), (3, ""), (4, None), (5, "")], "job_id long, idem_key string")
    assert {r.job_id: (r.answered_id, r.accepted) for r in dedup.idempotent_submit(rows).collect()} == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True)}
    new, known = dedup.against_existing(spark.createDataFrame([(9, "k"), (10, "n"), (11, "")], rows.schema), rows)
    assert sorted(names(new)) == [10, 11] and [(r.job_id, r.existing_id) for r in known.collect()] == [(9, 1)]
    report = dedup.same_batch_duplicates(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (11, "b"), (12, "b")], rows.schema), F.floor(F.col("job_id") / 10)).collect()
    assert [(r.batch, r["keys"], r.orphans) for r in report] == [(0, 1, 1)]
    assert dedup.latest_per_key(rows, "idem_key", "job_id").where("idem_key = 'k'").first().job_id == 2


def test_backoff_bounds(spark):
    rows = spark.range(0, 30).select(F.col("id").cast("int").alias("a"))
    found = {r.a: r for r in rows.select("a", backoff.base_ms(F.col("a")).alias("base"), backoff.low_ms(F.col("a")).alias("low"), backoff.delay_ms(F.col("a"), 3).alias("delay")).collect()}
    assert found[1].base == 1000 and found[3].base == 4000 and found[12].base == 2_048_000 and found[13].base == found[0].base == found[29].base == 3_600_000
    assert all(r.low <= r.delay < r.base for r in found.values())


def test_request_validation(spark):
    bodies = ['{"type":"t"}', '{"type":"t","typo_field":1}', '{"queue":"q"}', "{", None, '{"type":"","queue":"q"}', '{"type":"t","queue":"","max_attempts":0,"run_at":"2024-01-01T00:00:05Z","payload":{"a":1},"idempotency_key":""}']
    rows = requests.submissions(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string"), now_us=77).orderBy("i").collect()
    assert [r.error for r in rows] == [None, "unknown field typo_field", "type is required", "bad json", "bad json", "type is required", None]
    assert (rows[0].queue, rows[0].max_attempts, rows[0].priority, rows[0].run_at_us) == ("default", 3, 0, 77)
    assert (rows[6].queue, rows[6].max_attempts, rows[6].idem_key, rows[6].run_at_us) == ("default", 3, None, 1_704_067_205_000_000)
    most, seconds, wait = spark.range(1).select(*requests.lease_limits(F.lit(None).cast("int"), F.lit(0), F.lit(99))).first()
    assert (most, seconds, wait) == (1, 30, 30)


def test_handler_outcomes(spark):
    registry = handlers.Registry()

    def email(job):
        if handlers.payload(job).get("fail"):
            raise OSError("connection reset")

    registry.register("email", lambda job: 1 / 0)
    registry.register("email", email)
    registry.register("crash", lambda job: 1 / 0)
    jobs = spark.createDataFrame([("email", "{}"), ("email", '{"fail":1}'), ("email", "{"), ("crash", "{}"), ("none", "{}")], "type string, payload string")
    found = [tuple(r)[2:] for r in registry.run(jobs).collect()]
    assert found[0] == (True, False, "") and found[1] == (False, True, "connection reset")
    assert found[2][:2] == (False, False) and found[2][2].startswith("permanent: invalid payload")
    assert found[3] == (False, True, "handler panic: division by zero") and found[4] == (False, False, handlers.NO_HANDLER)
    assert [r.type for r in handlers.without_handler(jobs, ["email", "crash"]).collect()] == ["none"]


def test_completions(spark):
    rows = spark.createDataFrame([(True, False, 1, False), (True, False, 1, True), (False, True, 1, False), (False, True, 1, True), (False, True, 3, True), (False, False, 1, True)], "ok boolean, again boolean, a int, c boolean")
    found = [tuple(r.r) for r in rows.select(handlers.completion(F.col("ok"), F.col("again"), F.col("a"), F.lit(3), F.col("c")).alias("r")).collect()]
    assert found == [("complete", "succeeded"), ("complete", "cancelled"), ("retry", "pending"), ("retry", "cancelled"), ("dead", "dead"), ("dead", "dead")]
    assert spark.range(1).select(handlers.heartbeat_interval_ms(F.lit(30_000)).alias("a"), handlers.heartbeat_interval_ms(F.lit(900)).alias("b")).first()[:] == (10_000, 500)


def test_reservations_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("s", "o1", 1, 4, 1), ("s", "o1", 1, 4, 2), ("s", "o1", 2, 4, 3), ("s", "o2", 1, 4, 4), ("s", "o3", 1, 2, 5), ("u", "o1", 1, 9, 6), ("u", "o1", 3, 9, 7)], "sku string, order_id string, token long, qty long, lsn long")
    found = [r.verdict for r in handlers.reservations_in_order(rows, 10, ["lsn"], f"file://{tmp_path}/r").orderBy("lsn").collect()]
    assert found == ["applied", "skipped", "applied", "insufficient stock", "applied", "skipped", "applied"]  # the sixth by its order's token at another sku
    assert len(list((tmp_path / "r").iterdir())) == 1


def decided_one_by_one(rows, initial):
    """(row, verdict) of (sku, order_id, token, qty, lsn) in order of arrival; sums and highest tokens pass over nulls."""
    left, highest, out = {}, {}, []
    for sku, order, token, qty, lsn in sorted(rows, key=lambda r: [(v is not None, v) for v in (r[4], r[1], r[0], r[2], r[3])]):
        stock, top = left.get(sku, initial), highest.get(order)
        verdict = "skipped" if None not in (top, token) and token <= top else "insufficient stock" if qty is not None and stock < qty else "applied"
        if verdict == "applied":
            left[sku] = stock - (qty or 0)
            highest[order] = token if top is None else max(top, top if token is None else token)
        out.append(((sku, order, token, qty, lsn), verdict))
    return sorted(out, key=str)


RESERVATION = "sku string, order_id string, token long, qty long, lsn long"


def test_reservations_of_odd_rows_are_those_of_deciding_one_by_one(spark, tmp_path):
    draw = random.Random(45)
    some = lambda *values: draw.choice(values)
    tables = {
        "empty": [],
        "hot sku": [("s", f"o{n % 150}", draw.randint(1, 5), draw.randint(1, 9), n) for n in range(600)],
        "hot order": [(f"s{n % 150}", "o", draw.randint(1, 500), draw.randint(1, 9), n) for n in range(600)],
        "tangle": [(f"s{draw.randint(0, 9)}", f"o{draw.randint(0, 30)}", draw.randint(1, 9), draw.randint(1, 9), draw.randint(0, 40)) for _ in range(600)],
        "odd": [(some("a", "b", "", None), some("x", "y", "z", None), some(None, *range(-3, 60)), some(None, *range(-4, 15)), some(None, *range(300))) for _ in range(600)],
        "repeats": [("s", "o", 2, 6, 1)] * 5 + [("s", "p", 1, 6, 1)] * 5 + [("t", "o", 2, 6, 1)] * 5,
    }
    for name, rows in tables.items():
        found = handlers.reservations_in_order(spark.createDataFrame(rows, RESERVATION), 25, ["lsn"], f"file://{tmp_path}/{name}")
        assert found.columns == ["sku", "order_id", "token", "qty", "lsn", "verdict"]
        assert sorted(((tuple(r)[:5], r.verdict) for r in found.collect()), key=str) == decided_one_by_one(rows, 25), name


def test_reservations_of_fractions(spark, tmp_path):
    rows = spark.createDataFrame([("s", "o1", 1, 1), ("s", "o2", 1, 2), ("s", "o3", 1, 3)], "sku string, order_id string, token int, lsn long").withColumn("qty", F.lit(1.25))
    for kind in ("decimal(9, 2)", "double"):
        found = handlers.reservations_in_order(rows.withColumn("qty", F.col("qty").cast(kind)), 3, ["lsn"], f"file://{tmp_path}/{kind[:3]}").orderBy("lsn").collect()
        assert [r.verdict for r in found] == ["applied", "applied", "insufficient stock"]


def test_long_chains_of_reservations_move_few_rows(spark, tmp_path):
    """A chain through twelve orders and skus, beside attempts that are settled at once, and these alone."""
    alone = [(f"a{n}", f"b{n}", 1, 1, n) for n in range(20_000)]
    chain = [r for k in range(12) for r in ((f"s{k}", f"o{k}", 2, 6, 30_000 + 2 * k), (f"s{k + 1}", f"o{k}", 1, 6, 30_001 + 2 * k))]

    def moved(rows, name):
        context = spark.sparkContext._jsc.sc()
        written = lambda: context.listenerBus().waitUntilEmpty() or context.statusStore().executorSummary("driver").totalShuffleWrite()
        before = written()
        found = handlers.reservations_in_order(spark.createDataFrame(rows, RESERVATION), 10, ["lsn"], f"file://{tmp_path}/{name}")
        assert sorted(((tuple(r)[:5], r.verdict) for r in found.collect()), key=str) == decided_one_by_one(rows, 10)
        return written() - before

    assert moved(alone + chain, "chain") < 1.5 * moved(alone, "alone")


def test_records_make_jobs(spark):
    ns = 10**9
    start = {"job_id": "a", "type": "t", "queue": "q", "payload": b"{}", "priority": 1, "state": "pending", "attempt": 0, "max_attempts": 3, "run_at_ns": ns, "lease_expiry_ns": None, "lease_token": 0, "worker_id": None, "cancel_req": False, "last_error": "", "idem_key": None, "created_at_ns": ns, "updated_at_ns": ns}
    job = lambda name, **more: tuple({**start, "job_id": name, **more}[f] for f in JOB_SCHEMA.names)
    rec = lambda lsn, kind, name, **more: tuple({"lsn": lsn, "type": kind, "flag": 0, "job_id": name, **more}.get(f) for f in RECORD.names)
    lease = {"worker_id": "w", "lease_expiry_ns": 9 * ns, "lease_token": 5, "attempt": 2}
    log = [
        rec(1, "submit", "a", job=job("a")), rec(2, "lease", "a", **lease), rec(3, "retry", "a", run_at_ns=7 * ns, error="later"),
        rec(4, "submit", "b", job=job("b")), rec(5, "lease", "b", **lease), rec(6, "cancel", "b"), rec(7, "retry", "b", run_at_ns=8 * ns, error="x"),
        rec(8, "submit", "c", job=job("c")), rec(9, "lease", "c", **lease), rec(10, "complete", "c", success=False, error="bad"),
        rec(11, "submit", "d", job=job("d")), rec(12, "cancel", "d"), rec(13, "lease", "x", **lease), rec(14, "submit", "e", job=job("e")), rec(15, "lease", "e", **lease), rec(16, "expire", "e", lease_token=5),
        rec(17, "submit", "f", job=job("f")), rec(18, "lease", "f", **lease), rec(19, "dead", "f", error="gone"), rec(20, "submit", "g", job=job("g")), rec(21, "lease", "g", **lease), rec(22, "cancel", "g"),
    ]
    table = spark.createDataFrame(log, RECORD)
    found = {r.job_id: r for r in records.jobs_after(table, None, 99).collect()}
    assert set(found) == set("abcdefg")
    brief = {k: (r.state, r.attempt, r.run_at_ns // ns, r.worker_id, r.cancel_req, r.last_error) for k, r in found.items()}
    assert brief == {"a": ("pending", 2, 7, None, False, "later"), "b": ("cancelled", 2, 1, None, True, ""), "c": ("dead", 2, 1, None, False, "bad"), "d": ("cancelled", 0, 1, None, False, ""), "e": ("pending", 2, 1, None, False, "lease expired"), "f": ("dead", 2, 1, None, False, "gone"), "g": ("leased", 2, 1, "w", True, "")}
    assert found["a"].lease_token == 5 and found["a"].updated_at_ns == 99 and found["a"].payload == b"{}"
    for cut in (0, 5, 10, 22):
        snapshot = records.jobs_after(table.where(F.col("lsn") <= cut), None, 99)
        assert sorted(map(tuple, records.jobs_after(table.where(F.col("lsn") > cut), snapshot, 99).collect()), key=str) == sorted(map(tuple, found.values()), key=str)
    after = {r.job_id: r for r in records.reconciled(records.jobs_after(table.where("lsn < 22")), 50).collect()}["g"]
    assert (after.state, after.run_at_ns, after.worker_id, after.last_error) == ("pending", 50, None, "lease reconciled on coordinator recovery")
    assert {r.job_id: r.state for r in records.reconciled(records.jobs_after(table), 50).collect()}["g"] == "cancelled"


def test_consecutive_leases_take_no_job_twice(spark):
    jobs = spark.createDataFrame([(i, "ab"[i % 2], "pending", dt.datetime(2024, 1, 1), 0) for i in range(8)], "job_id long, queue string, state string, run_at timestamp_ntz, priority int")
    found = leasing.consecutive_leases(jobs, [(["a"], 2), (["b", "a"], 5), (["a", "b"], 9)], F.lit("2024-01-02").cast("timestamp_ntz")).orderBy("command", "rank").collect()
    assert [(r.command, r.job_id) for r in found] == [(1, 0), (1, 2), (2, 1), (2, 3), (2, 5), (2, 7), (2, 4), (3, 6)]


def test_retention(spark):
    records = spark.createDataFrame([(i,) for i in range(1, 26)], "lsn long")
    plan = retention.replay_plan(retention.segment_ranges(records, F.floor((F.col("lsn") - 1) / 10)), 12, 25).orderBy("segment").collect()
    assert [(r.first_lsn, r.last_lsn, r.skip, r.drop) for r in plan] == [(1, 10, True, True), (11, 20, False, True), (21, 25, False, False)]
    assert [r.lsn for r in retention.replay(records, 24).collect()] == [24, 25]
    kept = retention.prune_snapshots(spark.createDataFrame([(9,), (100,), (50,)], "snapshot_lsn long")).where("kept").collect()
    assert sorted(r.snapshot_lsn for r in kept) == [50, 100]


@pytest.mark.parametrize("n", [0, 1, 37])
def test_lsn_assignment_is_dense(spark, n):
    rows = spark.createDataFrame([((i * 17) % 41, i) for i in range(n)], "arrival long, v long")
    found = [r.lsn for r in retention.assign_lsn(rows, "arrival", 100).orderBy("arrival").collect()]
    assert found == list(range(101, 101 + n))


def test_replies(spark):
    jobs = spark.createDataFrame([job("a", state="leased", cancel=True, token=2), job("b")], JOB)
    assert {r.job_id: r.state for r in replies.cancel_reply(jobs).collect()} == {"a": "cancelling", "b": "pending"}
    asked = spark.createDataFrame([("a", 2), ("a", 1), ("b", 0), ("x", 1)], "job_id string, lease_token long")
    assert {(r.job_id, r.lease_token): r.error for r in replies.guarded(asked, jobs).collect()} == {("a", 2): None, ("a", 1): "stale token", ("b", 0): "job not leased", ("x", 1): "job not found"}
    assert names(replies.lookup(jobs, "a")) == ["a"]
