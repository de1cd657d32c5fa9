"""The query catalogue over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions import backoff, ids, requests
from tidefold.functions.labels import cancel_label, is_terminal, micros, or_default, record_name, split_list, state_name, state_number, worker_name
from tidefold.operators import dedup, expiry, fold, handlers, leasing, records, replies, retention, stats
from tidefold.plans import views
from tidefold.plans.views import ATTEMPTS_SQL, COMMANDS_SQL, FOLD_SQL, JOBS_SQL, JOB_TYPES, NOW_JOBS, NOW_LOG, attempts_v, jobs_v, mutations_v

LEASE_QUEUES, LEASE_MAX, LEASE_S = ["email", "critical"], 50, 30
SNAPSHOT_LSN = 1000
REGISTERED = JOB_TYPES[:5]
NOW_SQL = f"TIMESTAMP '{NOW_JOBS.isoformat(' ')}'"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


_folders: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it is removed when the driver ends."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(where or f'file://{tempfile.gettempdir()}').rstrip('/')}/tidefold-{name}-{os.urandom(8).hex()}"
    _folders.append((spark, path))
    return path


@atexit.register
def _remove_folders() -> None:
    for spark, path in _folders:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone; a folder on the cluster is left to its owner's clean-up
            return


def jobs_sql(select: str) -> str:
    return f"WITH {JOBS_SQL} {select}"


def fold_sql(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {COMMANDS_SQL}, {FOLD_SQL}{more} {select}"


def attempts_sql(select: str, more: str = "") -> str:
    return f"WITH {ATTEMPTS_SQL}{more} {select}"


ORDER_SQL = "run_at, priority DESC, job_id"
DUE_SQL = f"state = 'pending' AND run_at <= {NOW_SQL}"
CANDIDATES_SQL = f"""(SELECT *, row_number() OVER (ORDER BY CASE queue WHEN 'email' THEN 1 ELSE 2 END, {ORDER_SQL}) AS rank
  FROM jobs_v WHERE {DUE_SQL} AND queue IN ('email', 'critical') QUALIFY rank <= {LEASE_MAX})"""


@query("q01_due_topk_per_queue", jobs_sql(f"""SELECT queue, job_id, priority, epoch_us(run_at) AS run_at_us,
  CAST(row_number() OVER (PARTITION BY queue ORDER BY {ORDER_SQL}) AS INTEGER) AS rank FROM jobs_v WHERE {DUE_SQL} QUALIFY rank <= 10"""))
def q01(spark: SparkSession, d: str) -> DataFrame:
    return leasing.due_topk(jobs_v(spark, d), views.at(NOW_JOBS), 10).select("queue", "job_id", "priority", micros(F.col("run_at")).alias("run_at_us"), "rank")


@query("q02_lease_multi_queue", jobs_sql(f"SELECT CAST(rank AS INTEGER) AS rank, queue, job_id, attempt + 1 AS attempt, lease_token + 1 AS lease_token FROM {CANDIDATES_SQL}"))
def q02(spark, d):
    taken = leasing.lease_candidates(jobs_v(spark, d), LEASE_QUEUES, LEASE_MAX, views.at(NOW_JOBS))
    return leasing.leased(taken, views.at(NOW_JOBS), LEASE_S, "w1").select("rank", "queue", "job_id", "attempt", "lease_token")


@query("q03_lease_apply", jobs_sql(f"""SELECT j.job_id, CASE WHEN c.job_id IS NULL THEN j.state ELSE 'leased' END AS state, j.attempt + (c.job_id IS NOT NULL)::INTEGER AS attempt,
  j.lease_token + (c.job_id IS NOT NULL)::INTEGER AS lease_token, epoch_us(CASE WHEN c.job_id IS NULL THEN j.lease_expiry ELSE {NOW_SQL} + INTERVAL {LEASE_S} SECONDS END) AS lease_expiry_us,
  CASE WHEN c.job_id IS NOT NULL THEN 'w1' END AS worker_id FROM jobs_v j LEFT JOIN {CANDIDATES_SQL} c ON c.job_id = j.job_id"""))
def q03(spark, d):
    jobs, now = jobs_v(spark, d), views.at(NOW_JOBS)
    after = leasing.apply_leases(jobs, leasing.lease_candidates(jobs, LEASE_QUEUES, LEASE_MAX, now), now, LEASE_S, "w1")
    return after.select("job_id", "state", "attempt", "lease_token", micros(F.col("lease_expiry")).alias("lease_expiry_us"), "worker_id")


@query("q04_successive_leases", jobs_sql(f"""SELECT CASE WHEN rank <= 5 THEN 1 WHEN rank <= 8 THEN 2 ELSE 3 END AS command, CAST(rank AS INTEGER) AS rank, job_id
  FROM (SELECT job_id, row_number() OVER (ORDER BY {ORDER_SQL}) AS rank FROM jobs_v WHERE {DUE_SQL} AND queue = 'bulk') WHERE rank <= 20"""))
def q04(spark, d):
    return leasing.successive_leases(jobs_v(spark, d), "bulk", [5, 3, 12], views.at(NOW_JOBS)).select("command", "rank", "job_id")


@query("q05_expired_leases", jobs_sql(f"SELECT job_id, queue, epoch_us(lease_expiry) AS lease_expiry_us FROM jobs_v WHERE state = 'leased' AND lease_expiry <= {NOW_SQL}"))
def q05(spark, d):
    return expiry.in_deadline_order(expiry.expired(jobs_v(spark, d), views.at(NOW_JOBS))).select("job_id", "queue", micros(F.col("lease_expiry")).alias("lease_expiry_us"))


@query("q05b_expired_count", jobs_sql(f"SELECT count(*) AS expired FROM jobs_v WHERE state = 'leased' AND lease_expiry <= {NOW_SQL}"))
def q05b(spark, d):
    return expiry.expired(jobs_v(spark, d), views.at(NOW_JOBS)).agg(F.count("*").alias("expired"))


@query("q06_expire_apply", jobs_sql(f"""SELECT job_id, CASE WHEN NOT hit THEN state WHEN cancel_req THEN 'cancelled' ELSE 'pending' END AS state, epoch_us(run_at) AS run_at_us,
  CASE WHEN hit THEN 'lease expired' ELSE '' END AS last_error FROM (SELECT *, coalesce(state = 'leased' AND lease_expiry <= {NOW_SQL}, false) AS hit FROM jobs_v)"""))
def q06(spark, d):
    return expiry.apply_expiry(jobs_v(spark, d), views.at(NOW_JOBS)).select("job_id", "state", micros(F.col("run_at")).alias("run_at_us"), "last_error")


STATS_SQL = f"""SELECT queue, {", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("pending", "leased", "succeeded", "dead", "cancelled"))},
  greatest(coalesce(max(epoch_us({NOW_SQL}) - epoch_us(created_at)) FILTER (state = 'pending'), 0), 0) AS oldest_pending_age_us FROM jobs_v GROUP BY queue"""


@query("q07_queue_stats", jobs_sql(STATS_SQL))
def q07(spark, d):
    return stats.queue_stats(jobs_v(spark, d), views.at(NOW_JOBS))


@query("q08_metrics_text", f"""WITH {JOBS_SQL}, s AS ({STATS_SQL}) SELECT unnest(['# HELP job_queue_depth Number of jobs in queue by state', '# TYPE job_queue_depth gauge',
  '# HELP job_oldest_pending_age_seconds Oldest pending job age in seconds', '# TYPE job_oldest_pending_age_seconds gauge']) AS line
  UNION ALL SELECT 'job_queue_depth{{queue="' || queue || '",state="' || state || '"}} ' || n FROM (UNPIVOT s ON pending, leased, succeeded, dead, cancelled INTO NAME state VALUE n)
  UNION ALL SELECT 'job_oldest_pending_age_seconds{{queue="' || queue || '"}} ' || format('{{:.3f}}', oldest_pending_age_us / 1e6) FROM s""")
def q08(spark, d):
    return stats.metrics_lines(q07(spark, d))


@query("q09_next_wake", jobs_sql("SELECT min(epoch_us(t)) AS next_wake_us FROM (SELECT run_at AS t FROM jobs_v WHERE state = 'pending' UNION ALL SELECT lease_expiry FROM jobs_v WHERE state = 'leased')"))
def q09(spark, d):
    return expiry.next_wake(jobs_v(spark, d)).select(micros(F.col("next_wake")).alias("next_wake_us"))


@query("q10_idempotent_submit", jobs_sql("SELECT job_id, idem_key, min(job_id) OVER (PARTITION BY idem_key) AS answered_id, row_number() OVER (PARTITION BY idem_key ORDER BY job_id) = 1 AS accepted FROM jobs_v"))
def q10(spark, d):
    return dedup.idempotent_submit(jobs_v(spark, d).select("job_id", "idem_key"))


@query("q11_same_batch_duplicates", jobs_sql("""SELECT batch, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS orphans FROM
  (SELECT *, row_number() OVER (PARTITION BY idem_key ORDER BY batch) AS k FROM (SELECT idem_key, job_id // 100 AS batch, count(*) AS n FROM jobs_v GROUP BY 1, 2)) WHERE k = 1 AND n > 1 GROUP BY batch"""))
def q11(spark, d):
    return dedup.same_batch_duplicates(jobs_v(spark, d), F.floor(F.col("job_id") / 100))


FOLDED = ["job_id", "state", "attempt", "token", "cancel_req", "accepted", "rejected"]


@query("q12_fold_final_state", fold_sql(f"SELECT {', '.join(FOLDED)} FROM fin WHERE state <> 'none'"))
def q12(spark, d):
    return fold.fold(mutations_v(spark, d)).where("state <> 'none'").select(*FOLDED)


@query("q13_transition_log", fold_sql("SELECT job_id, lsn, op, accepted, reason, before, state, attempt, token FROM log"))
def q13(spark, d):
    return fold.transitions(mutations_v(spark, d)).select("job_id", "lsn", "op", "accepted", "reason", "before", "state", "attempt", "token")


@query("q14_rejection_summary", fold_sql("SELECT op, coalesce(reason, 'accepted') AS verdict, count(*) AS n FROM log GROUP BY ALL"))
def q14(spark, d):
    return fold.rejections(fold.transitions(mutations_v(spark, d)))


@query("q15_running_leases", f"WITH {COMMANDS_SQL} SELECT job_id, lsn, op, CAST(sum(CASE WHEN op = 'lease' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS leases FROM cmd")
def q15(spark, d):
    return fold.running_counts(mutations_v(spark, d)).select("job_id", "lsn", "op", "leases")


@query("q16_recovery", fold_sql(f"SELECT {', '.join(FOLDED)} FROM fin WHERE state <> 'none'"))
def q16(spark, d):
    log = mutations_v(spark, d)
    return fold.recover(fold.fold(log.where(F.col("lsn") <= SNAPSHOT_LSN)), retention.replay(log, SNAPSHOT_LSN + 1)).where("state <> 'none'").select(*FOLDED)


@query("q17_lease_reconciliation", fold_sql("""SELECT job_id, CASE WHEN state <> 'leased' THEN state WHEN cancel_req THEN 'cancelled' ELSE 'pending' END AS state,
  CASE WHEN state = 'leased' THEN 'lease reconciled on coordinator recovery' ELSE '' END AS last_error, token FROM fin WHERE state <> 'none'"""))
def q17(spark, d):
    return expiry.reconcile(q12(spark, d), views.at(NOW_LOG)).select("job_id", "state", "last_error", "token")


@query("q18_latest_record_per_job", f"WITH {COMMANDS_SQL} SELECT job_id, max(lsn) AS lsn, arg_max(us, lsn) AS us, arg_max(op, lsn) AS op, arg_max(worker_id, lsn) AS worker_id FROM cmd GROUP BY job_id")
def q18(spark, d):
    return fold.latest(mutations_v(spark, d))


@query("q19_segment_ranges", f"""WITH {COMMANDS_SQL}, s AS (SELECT lsn // 500 AS segment, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS records FROM cmd GROUP BY 1)
  SELECT *, last_lsn < 1200 AS skip, segment < (SELECT max(segment) FROM s) AND last_lsn < 1000 AS drop FROM s""")
def q19(spark, d):
    return retention.replay_plan(retention.segment_ranges(mutations_v(spark, d), F.floor(F.col("lsn") / 500)), 1200, 1000)


@query("q20_eligible_transitions", fold_sql("""SELECT job_id, lsn, CASE WHEN accepted AND op = 'submit' THEN 'submit' WHEN expired THEN 'expire' ELSE 'retry' END AS why
  FROM log WHERE accepted AND op = 'submit' OR expired OR accepted AND op = 'fail' AND state = 'pending'"""))
def q20(spark, d):
    return fold.eligible(fold.transitions(mutations_v(spark, d)))


BASE_SQL = "CAST(least(1000 * power(2, CASE WHEN attempt < 1 THEN 16 ELSE least(attempt - 1, 16) END), 3600000) AS BIGINT)"


@query("q21_backoff_bounds", jobs_sql(f"""SELECT attempt, count(*) AS jobs, {BASE_SQL} AS high_ms, {BASE_SQL} // 2 AS low_ms FROM
  (SELECT CAST(job_id % 20 AS INTEGER) AS attempt FROM jobs_v) GROUP BY attempt"""))
def q21(spark, d):
    attempts = jobs_v(spark, d).groupBy((F.col("job_id") % 20).cast("int").alias("attempt")).agg(F.count("*").alias("jobs"))
    return attempts.select("attempt", "jobs", backoff.base_ms(F.col("attempt")).alias("high_ms"), backoff.low_ms(F.col("attempt")).alias("low_ms"))


@query("q22_retry_schedule", jobs_sql(f"SELECT job_id, epoch_us({NOW_SQL}) + 1000 * ({BASE_SQL} // 2) AS earliest_us FROM jobs_v WHERE state = 'leased' AND attempt < max_attempts"))
def q22(spark, d):
    failed = jobs_v(spark, d).where((F.col("state") == "leased") & (F.col("attempt") < F.col("max_attempts")))
    return failed.select("job_id", (F.lit(views.us(NOW_JOBS)) + 1000 * backoff.low_ms(F.col("attempt"))).alias("earliest_us"))


INTERVALS_SQL = """, iv AS (SELECT job_id, token, min(us) AS start_us, coalesce(min(us) FILTER (op IN ('ok', 'fail')), max(exp)) AS end_us
  FROM log WHERE accepted AND op IN ('lease', 'hb', 'ok', 'fail') GROUP BY job_id, token)"""


@query("q23_lease_intervals", fold_sql(f"SELECT *, start_us <= {views.us(NOW_LOG) - 86_400_000_000} AND end_us > {views.us(NOW_LOG) - 86_400_000_000} AS live FROM iv", INTERVALS_SQL))
def q23(spark, d):
    day_before = views.us(NOW_LOG) - 86_400_000_000
    return fold.lease_intervals(fold.transitions(mutations_v(spark, d))).withColumn("live", (F.col("start_us") <= day_before) & (F.col("end_us") > day_before))


@query("q24_cancel_labels", jobs_sql("SELECT job_id, CASE WHEN state = 'leased' AND cancel_req THEN 'cancelling' ELSE state END AS label, state IN ('succeeded', 'dead', 'cancelled') AS terminal FROM jobs_v"))
def q24(spark, d):
    return jobs_v(spark, d).select("job_id", cancel_label(F.col("state"), F.col("cancel_req")).alias("label"), is_terminal(F.col("state")).alias("terminal"))


@query("q25_complete_outcome", jobs_sql("""SELECT job_id, CASE WHEN ok THEN 'complete' WHEN again THEN 'retry' ELSE 'dead' END AS record,
  CASE WHEN ok OR again THEN CASE WHEN cancel_req THEN 'cancelled' WHEN ok THEN 'succeeded' ELSE 'pending' END ELSE 'dead' END AS state
  FROM (SELECT *, job_id % 3 = 0 AS ok, job_id % 3 = 1 AND attempt < max_attempts AS again FROM jobs_v WHERE state = 'leased')"""))
def q25(spark, d):
    key = F.col("job_id")
    result = handlers.completion(key % 3 == 0, key % 3 == 1, F.col("attempt"), F.col("max_attempts"), F.col("cancel_req"))
    return jobs_v(spark, d).where("state = 'leased'").select("job_id", result.alias("r")).select("job_id", "r.*")


@query("q26_handler_outcomes", attempts_sql("""SELECT type, flag = 'N' AND type <> 'search.index' AS success, flag = 'A' AND type <> 'search.index' AS retryable,
  CASE WHEN type = 'search.index' THEN 'no handler registered' WHEN flag = 'A' THEN 'retryable failure' WHEN flag = 'R' THEN 'permanent failure' ELSE '' END AS error, count(*) AS n FROM att GROUP BY ALL"""))
def q26(spark, d):
    registered = spark.createDataFrame([(t, True) for t in REGISTERED], "type string, known boolean")
    rows = attempts_v(spark, d).join(F.broadcast(registered), "type", "left")
    result = handlers.outcome(F.col("flag"), F.coalesce("known", F.lit(False)))
    return rows.select("type", result.alias("r")).groupBy("type", "r.success", "r.retryable", "r.error").agg(F.count("*").alias("n"))


@query("q26b_unhandled", attempts_sql("SELECT type, count(*) AS n FROM att WHERE type NOT IN (" + ", ".join(f"'{t}'" for t in REGISTERED) + ") GROUP BY type"))
def q26b(spark, d):
    return handlers.without_handler(attempts_v(spark, d), list(REGISTERED)).groupBy("type").agg(F.count("*").alias("n"))


@query("q27_email_at_most_once", attempts_sql("SELECT order_id, max(success::INTEGER) AS sent, count(*) AS attempts FROM att WHERE type = 'order.confirmation_email' GROUP BY order_id"))
def q27(spark, d):
    return handlers.emails_sent(attempts_v(spark, d).where(F.col("type") == JOB_TYPES[0]))


@query("q28_stock_left", attempts_sql("SELECT sku, 100000 - r AS stock, r AS reserved FROM (SELECT sku, CAST(coalesce(sum(qty) FILTER (success), 0) AS BIGINT) AS r FROM att GROUP BY sku)"))
def q28(spark, d):
    return handlers.stock_left(attempts_v(spark, d), 100_000)


@query("q28b_reserved_by_order", attempts_sql("SELECT order_id, CAST(sum(qty) AS BIGINT) AS reserved FROM att WHERE success GROUP BY order_id"))
def q28b(spark, d):
    return handlers.reserved_by_order(attempts_v(spark, d))


@query("q29_payment_first_capture", attempts_sql("""SELECT pay_key, arg_min(amount_cents, row(order_id, token, sku, amount_cents)) AS amount_cents, count(*) AS captures
  FROM att WHERE success GROUP BY pay_key"""))
def q29(spark, d):
    return handlers.first_capture(attempts_v(spark, d), ["order_id", "token", "sku", "amount_cents"])


@query("q30_counters", attempts_sql("SELECT count(*) FILTER (success) AS synced, count(*) FILTER (success AND qty > 25) AS indexed, count(DISTINCT order_id) FILTER (success) AS invoiced FROM att"))
def q30(spark, d):
    return handlers.counters(attempts_v(spark, d))


SNAPSHOTS_SQL = "SELECT DISTINCT lsn // 400 * 400 AS snapshot_lsn FROM cmd WHERE lsn >= 400"


@query("q31_snapshot_prune", f"WITH {COMMANDS_SQL}, s AS ({SNAPSHOTS_SQL}) SELECT snapshot_lsn, row_number() OVER (ORDER BY snapshot_lsn DESC) <= 2 AS kept FROM s")
def q31(spark, d):
    found = mutations_v(spark, d).where("lsn >= 400").select((F.floor(F.col("lsn") / 400) * 400).alias("snapshot_lsn")).distinct()
    return retention.prune_snapshots(found)


@query("q32_job_ids", """WITH b AS (SELECT o_orderkey AS k, epoch_ms(o_orderdate) AS ms, sha256('o|' || o_orderkey)[1:20] AS r FROM orders)
  SELECT k AS order_key, upper(lpad(to_hex(ms), 12, '0') || r) AS id_hex, ms AS time_ms, 26::INTEGER AS n_chars, true AS round_trip FROM b""")
def q32(spark, d):
    key = F.col("o_orderkey")
    ms = F.floor(micros(F.col("o_orderdate")) / 1000)
    rows = views.table(spark, d, "orders").select(key.alias("order_key"), ms.alias("ms"), ids.from_hash(ms, F.lit("o"), key.cast("string")).alias("id"))
    decoded = ids.decode(F.lower("id"))
    return rows.select("order_key", F.hex(decoded).alias("id_hex"), ids.time_ms(F.col("id")).alias("time_ms"), F.length("id").alias("n_chars"), (ids.encode(decoded) == F.col("id")).alias("round_trip"))


SUBMIT_BODY_SQL = """CASE k % 5 WHEN 0 THEN '{"type":"t' || k || '"}' WHEN 1 THEN '{"type":"t' || k || '","queue":"q","priority":' || (k % 7) || ',"max_attempts":' || (k % 4) || ',"idempotency_key":"i' || k || '"}'
  WHEN 2 THEN '{"queue":"q"}' WHEN 3 THEN '{"type":"t","typo_field":1}' ELSE '{"type":' END"""


@query("q33_submit_validation", f"""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  SELECT event_id, CASE k % 5 WHEN 2 THEN 'type is required' WHEN 3 THEN 'unknown field typo_field' WHEN 4 THEN 'bad json' END AS error,
    CASE WHEN k % 5 < 2 THEN 't' || k END AS type, CASE k % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'q' END AS queue, CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN k % 7 END AS priority,
    CASE WHEN k % 5 = 0 THEN 3 WHEN k % 5 = 1 THEN CASE WHEN k % 4 = 0 THEN 3 ELSE k % 4 END END AS max_attempts,
    CASE WHEN k % 5 < 2 THEN {views.us(NOW_LOG)} END AS run_at_us, CASE WHEN k % 5 = 1 THEN 'i' || k END AS idem_key FROM e""")
def q33(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    body = (
        F.when(k % 5 == 0, F.format_string('{"type":"t%d"}', k))
        .when(k % 5 == 1, F.format_string('{"type":"t%d","queue":"q","priority":%d,"max_attempts":%d,"idempotency_key":"i%d"}', k, k % 7, k % 4, k))
        .when(k % 5 == 2, '{"queue":"q"}').when(k % 5 == 3, '{"type":"t","typo_field":1}').otherwise('{"type":')
    )
    rows = views.table(spark, d, "events").select("event_id", body.alias("body"))
    return requests.submissions(rows, now_us=views.us(NOW_LOG)).drop("body")


@query("q34_payload_parse", """WITH e AS (SELECT event_id, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  SELECT event_id, CASE WHEN k % 9 = 0 THEN 'permanent: invalid payload' END AS error, CASE WHEN k % 9 <> 0 THEN k END AS k FROM e""")
def q34(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    cut = F.when(k % 9 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    rows = views.table(spark, d, "events").select("event_id", cut.alias("payload"))
    error = requests.payload_error(F.col("payload"), "k bigint")
    return rows.select("event_id", error.alias("error"), F.when(error.isNull(), F.from_json("payload", "k bigint")["k"]).alias("k"))


def ledger_records(spark: SparkSession, d: str) -> DataFrame:
    """A record of the binary ledger for each command."""
    from tidefold.schema import JOB, RECORD

    log = mutations_v(spark, d)
    kind = F.col("op")
    typ = F.when(kind == "submit", "submit").when(kind == "lease", "lease").when(kind == "hb", "expire").when(kind == "ok", "complete").when(kind == "fail", F.when(F.col("stale"), "dead").otherwise("retry")).otherwise("cancel")
    ns, job_id = F.col("us") * 1000, ids.from_hash(F.lit(0).cast("long"), F.col("job_id").cast("string"))
    full = {"job_id": job_id, "type": F.lit("t"), "queue": F.lit("default"), "payload": F.concat(F.lit("{}"), F.col("worker_id")).cast("binary"), "priority": F.lit(-3), "state": F.lit("pending"), "attempt": F.lit(0), "max_attempts": F.lit(3), "run_at_ns": ns, "lease_token": F.lit(0).cast("long"), "cancel_req": F.lit(False), "last_error": F.lit(""), "idem_key": F.col("worker_id"), "created_at_ns": ns, "updated_at_ns": ns}
    job = F.struct(*[full.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOB])
    only = lambda kinds, value: F.when(F.col("t").isin(*kinds), value)
    values = {
        "lsn": F.col("lsn"), "type": F.col("t"), "flag": F.lit(0), "job_id": job_id, "job": only(("submit",), job), "worker_id": only(("lease",), F.col("worker_id")),
        "lease_expiry_ns": only(("lease",), ns + fold.TTL_US * 1000), "lease_token": only(("lease", "expire"), F.col("lsn")), "attempt": only(("lease",), F.lit(1)),
        "success": only(("complete",), F.lit(True)), "run_at_ns": only(("retry",), ns), "error": only(("complete", "retry", "dead"), F.concat(F.lit("e"), F.col("worker_id"))),
    }
    return log.withColumn("t", typ).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in RECORD])


RECORDS_SQL = f"""WITH {COMMANDS_SQL}, r AS (SELECT *, CASE op WHEN 'hb' THEN 'expire' WHEN 'ok' THEN 'complete' WHEN 'fail' THEN CASE WHEN stale THEN 'dead' ELSE 'retry' END ELSE op END AS type,
  length(worker_id) AS w FROM cmd)"""
# bytes of a frame: 18, the id's 16, and the fields of the type
FRAME_BYTES_SQL = """34 + CASE type WHEN 'submit' THEN 4 + 1 + 4 + 7 + 4 + 2 + w + 1 + 1 + 2 + 2 + 8 + 8 + 8 + 4 + 1 + 4 + 4 + w + 8 + 8 WHEN 'lease' THEN 4 + w + 8 + 8 + 2
  WHEN 'complete' THEN 1 + 4 + 1 + w WHEN 'retry' THEN 8 + 4 + 1 + w WHEN 'dead' THEN 4 + 1 + w WHEN 'expire' THEN 8 ELSE 0 END"""


@query("q35_codec_roundtrip", f"{RECORDS_SQL} SELECT type, count(*) AS records, count(*) AS equal, CAST(sum({FRAME_BYTES_SQL}) AS BIGINT) AS bytes FROM r GROUP BY type")
def q35(spark, d):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from tidefold.sources import columnar

        def equal(a, b):
            if pa.types.is_struct(a.type):
                same = pa.repeat(pa.scalar(True), len(a))
                for x, y in zip(a.flatten(), b.flatten(), strict=True):
                    same = pc.and_(same, equal(x, y))
                return same
            return pc.or_(pc.and_(a.is_null(), b.is_null()), pc.fill_null(pc.equal(a, b), False))

        for batch in batches:
            if batch.num_rows:
                batch = batch.cast(columnar.RECORD_TYPE)
                raw, ends = columnar.encode(batch)
                back = columnar.decode(raw, *columnar.frame_ends(raw))
                same = pa.repeat(pa.scalar(True), batch.num_rows)
                for name in columnar.RECORD_TYPE.names:
                    same = pc.and_(same, equal(batch.column(name), back.column(name)))
                yield pa.RecordBatch.from_arrays([back.column("type"), same, pa.array(np.diff(ends, prepend=0))], names=["type", "same", "size"])

    rows = ledger_records(spark, d).mapInArrow(run, "type string, same boolean, size long")
    return rows.groupBy("type").agg(F.count("*").alias("records"), F.count(F.when(F.col("same"), True)).alias("equal"), F.sum("size").alias("bytes"))


CUTS = 40
SEGMENT_LSNS = 100


@query("q36_torn_tail_prefix", f"""{RECORDS_SQL}, s AS (SELECT lsn, (lsn - 1) // {SEGMENT_LSNS} AS segment, 16 + sum({FRAME_BYTES_SQL}) OVER (PARTITION BY (lsn - 1) // {SEGMENT_LSNS} ORDER BY lsn) AS ends FROM r),
  n AS (SELECT segment, max(ends) AS size FROM s GROUP BY segment), c AS (SELECT segment, i, CAST(16 + (size - 16) * i // {CUTS} AS BIGINT) AS cut FROM n, range(0, {CUTS + 1}) x(i))
  SELECT c.segment, c.cut, (SELECT count(*) FROM s WHERE s.segment = c.segment AND s.ends <= c.cut) AS recovered FROM c""")
def q36(spark, d):
    def run(key, group):
        import numpy as np
        import pyarrow as pa

        from tidefold.sources import codec, columnar

        batch = group.drop_columns(["segment"]).sort_by("lsn").combine_chunks().cast(columnar.RECORD_TYPE).to_batches()[0]
        data = codec.segment_header() + columnar.encode(batch)[0]
        cuts = np.array([16 + (len(data) - 16) * i // CUTS for i in range(CUTS + 1)])
        ends = columnar.frame_ends(data, 16)[1]  # one scan: a cut leaves the frames that end before it
        torn = columnar.read_segment(data[:int(cuts[CUTS // 2])], True)[0].num_rows  # and one segment is really cut
        recovered = np.searchsorted(ends, cuts, side="right")
        if torn != recovered[CUTS // 2]:
            raise ValueError("a torn segment is read otherwise than its frames end")
        return pa.table({"segment": pa.array([key[0].as_py()] * len(cuts), pa.int64()), "cut": pa.array(cuts, pa.int64()), "recovered": pa.array(recovered, pa.int64())})

    rows = ledger_records(spark, d).withColumn("segment", F.floor((F.col("lsn") - 1) / SEGMENT_LSNS))
    return rows.groupBy("segment").applyInArrow(run, "segment long, cut long, recovered long")


@query("q37_point_lookup", jobs_sql("SELECT job_id, queue, state, idem_key FROM jobs_v WHERE job_id = (SELECT max(job_id) FROM jobs_v)"))
def q37(spark, d):
    jobs = jobs_v(spark, d)
    last = jobs.agg(F.max("job_id").alias("job_id"))  # one row
    return jobs.join(F.broadcast(last), "job_id", "left_semi").select("job_id", "queue", "state", "idem_key")


@query("q37a_totals", jobs_sql("SELECT count(*) AS jobs, count(DISTINCT queue) AS queues FROM jobs_v"))
def q37a(spark, d):
    return stats.totals(jobs_v(spark, d))


@query("q37b_sorted_scan", jobs_sql("SELECT job_id, state FROM jobs_v"))
def q37b(spark, d):
    return replies.sorted_scan(replies.submit_reply(jobs_v(spark, d)))


@query("q37c_stuck_jobs", jobs_sql("SELECT job_id, attempt FROM jobs_v WHERE state = 'pending' AND attempt >= max_attempts"))
def q37c(spark, d):
    return stats.stuck(jobs_v(spark, d)).select("job_id", "attempt")


@query("q38_heartbeat_extension", fold_sql("SELECT job_id, lsn, exp AS lease_expiry_us, creq AS cancelled FROM log WHERE accepted AND op = 'hb'"))
def q38(spark, d):
    return fold.heartbeats(fold.transitions(mutations_v(spark, d)))


@query("q39_streaming_fold", SQL["q12_fold_final_state"])
def q39(spark, d):
    from tidefold.sources.tables import table_stream
    from tidefold.streaming.ledger import KeyedLedger

    folder = scratch(spark, "ledger")
    return KeyedLedger(spark, folder).run(views.commands_of(table_stream(spark, d, "events"))).where("state <> 'none'").select(*FOLDED)


@query("q40_mutations_since_snapshot", f"WITH {COMMANDS_SQL} SELECT count(*) FILTER (lsn > {SNAPSHOT_LSN}) AS mutations, count(*) FILTER (lsn > {SNAPSHOT_LSN}) >= 1000 AS snapshot_due FROM cmd")
def q40(spark, d):
    return retention.since_snapshot(mutations_v(spark, d), SNAPSHOT_LSN, 1000)


@query("q41_reply_projections", jobs_sql("""SELECT job_id, CASE WHEN state = 'leased' AND cancel_req THEN 'cancelling' ELSE state END AS state, list_position(['pending', 'leased', 'succeeded', 'dead', 'cancelled'], state)::INTEGER AS code,
  state AS by_code, epoch_us(run_at) - epoch_us(created_at) AS waited_us, 'submit' AS record, 'bulk' AS second_queue FROM jobs_v"""))
def q41(spark, d):
    jobs = jobs_v(spark, d)
    code = state_number(F.col("state"))
    return jobs.select("job_id", cancel_label(F.col("state"), F.col("cancel_req")).alias("state"), code.alias("code"), state_name(code).alias("by_code"), (micros(F.col("run_at")) - micros(F.col("created_at"))).alias("waited_us"), record_name(F.lit(1)).alias("record"), F.element_at(split_list(F.lit("default , bulk")), 2).alias("second_queue"))


@query("q41b_lease_replies", jobs_sql(f"""SELECT job_id, '{{"job_id":' || job_id || ',"type":"' || type || '","queue":"' || queue || '","priority":' || priority || ',"state":"leased","attempt":' || (attempt + 1) || ',"max_attempts":' || max_attempts || '}}' AS job, lease_token + 1 AS lease_token, epoch_us({NOW_SQL}) + {LEASE_S * 1_000_000} AS lease_expiry_us FROM {CANDIDATES_SQL}"""))
def q41b(spark, d):
    now = views.at(NOW_JOBS)
    taken = leasing.leased(leasing.lease_candidates(jobs_v(spark, d), LEASE_QUEUES, LEASE_MAX, now), now, LEASE_S, "w1")
    return replies.lease_reply(taken)


@query("q42_guarded_commands", jobs_sql("""SELECT c.job_id, c.lease_token, CASE WHEN j.job_id IS NULL THEN 'job not found' WHEN j.state <> 'leased' THEN 'job not leased' WHEN j.lease_token <> c.lease_token THEN 'stale token' END AS error
  FROM (SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS job_id, l_partkey % 4 AS lease_token FROM lineitem) c LEFT JOIN jobs_v j ON j.job_id = c.job_id"""))
def q42(spark, d):
    lines = views.table(spark, d, "lineitem")
    commands = lines.select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 100_000_000).otherwise(0)).alias("job_id"), (F.col("l_partkey") % 4).alias("lease_token"))
    return replies.guarded(commands, jobs_v(spark, d))


@query("q43_lsn_assignment", "SELECT event_id, row_number() OVER (ORDER BY event_id DESC) + 5000 AS lsn FROM events")
def q43(spark, d):
    arrivals = views.table(spark, d, "events").select("event_id", (-F.col("event_id")).alias("arrival"))
    return retention.assign_lsn(arrivals, "arrival", 5000).select("event_id", "lsn")


@query("q44_log_positions", f"WITH {COMMANDS_SQL} SELECT count(*) AS records, min(lsn) AS first_lsn, max(lsn) AS last_lsn, max(lsn) + 1 AS next_lsn FROM cmd")
def q44(spark, d):
    return retention.positions(mutations_v(spark, d))


STOCK = 150
ARRIVAL = ["amount_cents", "order_id", "token"]


@query("q45_reservations_in_order", f"""WITH RECURSIVE {ATTEMPTS_SQL}, a AS (SELECT row_number() OVER (ORDER BY {', '.join(ARRIVAL)}) AS seq, * FROM att WHERE type = '{JOB_TYPES[1]}'),
  r(seq, order_id, sku, token, qty, verdict, round, moved) AS (
    SELECT seq, order_id, sku, token, qty, 'none', 0, true FROM a
    UNION ALL
    SELECT seq, order_id, sku, token, qty, v, round + 1, bool_or(v <> verdict) OVER () FROM (
      SELECT *, CASE WHEN token <= coalesce(max(CASE WHEN verdict = 'applied' THEN token END) OVER (PARTITION BY order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 'skipped'
                     WHEN {STOCK} - coalesce(sum(CASE WHEN verdict = 'applied' THEN qty END) OVER (PARTITION BY sku ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < qty THEN 'insufficient stock'
                     ELSE 'applied' END AS v
      FROM r WHERE moved))
  SELECT sku, verdict, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM r WHERE NOT moved GROUP BY sku, verdict""")
def q45(spark, d):
    attempts = attempts_v(spark, d, JOB_TYPES[1]).select("order_id", "sku", "token", "qty", "amount_cents")
    rows = handlers.reservations_in_order(attempts, STOCK, ARRIVAL, scratch(spark, "reservations"))
    return rows.groupBy("sku", "verdict").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("q46_heartbeat_cadence", jobs_sql("SELECT job_id, greatest((job_id % 100) * 100 // 3, 500) AS interval_ms FROM jobs_v WHERE state = 'leased'"))
def q46(spark, d):
    return jobs_v(spark, d).where("state = 'leased'").select("job_id", handlers.heartbeat_interval_ms((F.col("job_id") % 100) * 100).alias("interval_ms"))


@query("q47_lease_limits", """SELECT event_id, CASE WHEN k % 4 > 0 THEN k % 4 ELSE 1 END AS most, CASE WHEN k % 50 > 0 THEN k % 50 ELSE 30 END AS lease_s, least(k, 30) AS wait_s
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def q47(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    most, lease_s, wait_s = requests.lease_limits(k % 4, k % 50, k)
    return views.table(spark, d, "events").select("event_id", most.alias("most"), lease_s.alias("lease_s"), wait_s.alias("wait_s"))


@query("q48_new_and_known_submissions", jobs_sql("""SELECT s.job_id, min(e.job_id) AS existing_id FROM (SELECT * FROM jobs_v WHERE job_id % 2 = 1) s
  LEFT JOIN (SELECT * FROM jobs_v WHERE job_id % 2 = 0) e ON e.idem_key = s.idem_key GROUP BY s.job_id"""))
def q48(spark, d):
    jobs = jobs_v(spark, d).select("job_id", "idem_key")
    new, known = dedup.against_existing(jobs.where("job_id % 2 = 1"), jobs.where("job_id % 2 = 0"))
    return new.select("job_id", F.lit(None).cast("long").alias("existing_id")).unionByName(known.select("job_id", "existing_id"))


def ledger_folder(spark: SparkSession, d: str, per_segment: int = 2000) -> tuple[str, DataFrame]:
    """A log written from the commands, and what was written by segment."""
    from tidefold.sources import log

    folder = scratch(spark, "log")
    written = log.write_segments(ledger_records(spark, d), folder, per_segment)
    return folder, spark.createDataFrame(written.collect(), written.schema)  # a row per segment


FROM_LSN = 1500


@query("q49_log_write_and_replay", f"""{RECORDS_SQL} SELECT type, count(*) AS records, min(lsn) AS first_lsn, max(lsn) AS last_lsn, CAST(sum(lsn) AS BIGINT) AS lsns, count(DISTINCT job_id) AS jobs,
  max(CASE WHEN type IN ('complete', 'retry', 'dead') THEN 'e' || worker_id END) AS error FROM r WHERE lsn >= {FROM_LSN} GROUP BY type""")
def q49(spark, d):
    from tidefold.sources import log

    folder, _ = ledger_folder(spark, d)
    return log.replay(spark, folder, FROM_LSN).groupBy("type").agg(F.count("*").alias("records"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.sum("lsn").alias("lsns"), F.count_distinct("job_id").alias("jobs"), F.max("error").alias("error"))


@query("q50_segments_written", f"""{RECORDS_SQL} SELECT min(lsn) AS first_lsn, count(*) AS records, CAST(16 + sum({FRAME_BYTES_SQL}) AS BIGINT) AS bytes FROM r GROUP BY (lsn - 1) // 2000""")
def q50(spark, d):
    return ledger_folder(spark, d)[1]


@query("q51_torn_log_replay", f"""WITH {COMMANDS_SQL}, n AS (SELECT max(lsn) AS top, count(*) AS n FROM cmd) SELECT 'garbage behind' AS log, n AS records, top AS last_lsn, top + 1 AS next_lsn FROM n
  UNION ALL SELECT 'last frame cut', n - 1, (SELECT max(lsn) FROM cmd, n WHERE lsn < top), (SELECT max(lsn) + 1 FROM cmd, n WHERE lsn < top) FROM n""")
def q51(spark, d):
    from tidefold.sources import files, log

    found = None
    for name, tear in (("garbage behind", lambda x: x + b"\x05\x01\x02\x03\x04"), ("last frame cut", lambda x: x[:-7])):
        folder, _ = ledger_folder(spark, d)
        newest = f"{folder}/{[x for x in files.listing(folder) if x.endswith('.wal')][-1]}"
        files.write_bytes(newest, tear(files.read_bytes(newest)))
        after = log.next_lsn(folder)
        rows = log.replay(spark, folder).agg(F.lit(name).alias("log"), F.count("*").alias("records"), F.max("lsn").alias("last_lsn"), F.lit(after).cast("long").alias("next_lsn"))
        found = rows if found is None else found.unionByName(rows)
    return found


# One step a record, as FOLD_SQL for commands: what a replay makes of each job.
APPLY_SQL = f"""n AS (SELECT *, us * 1000 AS ns, row_number() OVER (PARTITION BY job_id ORDER BY lsn) AS rn FROM r),
f(job_id, rn, state, attempt, run_at, exp, token, worker, creq, err) AS (
  SELECT DISTINCT job_id, 0::BIGINT, 'none', 0, 0::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::VARCHAR, false, '' FROM r
  UNION ALL
  SELECT f.job_id, n.rn,
    CASE WHEN type = 'submit' THEN 'pending' WHEN state = 'none' THEN state WHEN type = 'lease' THEN 'leased' WHEN type = 'dead' THEN 'dead'
         WHEN type IN ('complete', 'retry', 'expire') THEN CASE WHEN creq THEN 'cancelled' WHEN type = 'complete' THEN 'succeeded' ELSE 'pending' END
         WHEN type = 'cancel' AND state = 'pending' THEN 'cancelled' ELSE state END,
    CASE WHEN type = 'submit' THEN 0 WHEN state <> 'none' AND type = 'lease' THEN 1 ELSE attempt END,
    CASE WHEN type = 'submit' OR state <> 'none' AND type = 'retry' AND NOT creq THEN ns ELSE run_at END,
    CASE WHEN type = 'submit' THEN NULL WHEN state <> 'none' AND type = 'lease' THEN ns + {fold.TTL_US * 1000} ELSE exp END,
    CASE WHEN type = 'submit' THEN 0 WHEN state <> 'none' AND type = 'lease' THEN lsn ELSE token END,
    CASE WHEN type = 'submit' OR state = 'none' THEN NULL WHEN type = 'lease' THEN worker_id WHEN type = 'cancel' THEN worker ELSE NULL END,
    CASE WHEN type = 'submit' THEN false ELSE creq OR (type = 'cancel' AND state = 'leased') END,
    CASE WHEN type = 'submit' THEN '' WHEN state = 'none' THEN err WHEN type = 'dead' THEN 'e' || worker_id WHEN creq THEN err WHEN type = 'complete' THEN ''
         WHEN type = 'retry' THEN 'e' || worker_id WHEN type = 'expire' THEN 'lease expired' ELSE err END
  FROM f JOIN n ON n.job_id = f.job_id AND n.rn = f.rn + 1),
j AS (SELECT job_id, upper(lpad(to_hex(0), 12, '0') || sha256(job_id::VARCHAR)[1:20]) AS id_hex, state, attempt, run_at // 1000 AS run_at_us, exp // 1000 AS lease_expiry_us, token AS lease_token, worker AS worker_id, creq AS cancel_req, err AS last_error
  FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) = 1)"""
REPLAYED = ["id_hex", "state", "attempt", "run_at_us", "lease_expiry_us", "lease_token", "worker_id", "cancel_req", "last_error"]


def by_hex(jobs: DataFrame) -> DataFrame:
    us = lambda c: F.expr(f"{c} div 1000")
    return jobs.withColumns({"id_hex": F.hex(ids.decode(F.col("job_id"))), "run_at_us": us("run_at_ns"), "lease_expiry_us": us("lease_expiry_ns")}).select(*REPLAYED)


def saved(jobs: DataFrame, folder: str, lsn: int) -> None:
    """A binary snapshot of jobs; such files hold what one writer keeps in memory."""
    from tidefold.sources import snapshots

    rows = [r.asDict() for r in jobs.collect()]
    snapshots.save([{**r, "payload": bytes(r["payload"]) if r["payload"] else None} for r in rows], folder, lsn)


@query("q52_recovery_from_snapshot_and_log", f"""{RECORDS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, {APPLY_SQL} SELECT id_hex, attempt, lease_expiry_us, lease_token, cancel_req,
  CASE WHEN state <> 'leased' THEN state WHEN cancel_req THEN 'cancelled' ELSE 'pending' END AS state, CASE WHEN state = 'leased' AND NOT cancel_req THEN {views.us(NOW_LOG)} ELSE run_at_us END AS run_at_us,
  CASE WHEN state = 'leased' AND NOT cancel_req THEN 'lease reconciled on coordinator recovery' ELSE last_error END AS last_error, CASE WHEN state <> 'leased' THEN worker_id END AS worker_id FROM j WHERE state <> 'none'""")
def q52(spark, d):
    from tidefold.sources import log, snapshots

    folder, now = ledger_folder(spark, d)[0], views.us(NOW_LOG) * 1000
    saved(records.jobs_after(log.replay(spark, folder, 0, SNAPSHOT_LSN), None, now), f"{folder}/snapshots", SNAPSHOT_LSN)
    tail = log.replay(spark, folder, SNAPSHOT_LSN + 1)
    return by_hex(records.reconciled(records.jobs_after(tail, snapshots.as_frame(spark, f"{folder}/snapshots"), now), now))


@query("q53_snapshot_fallback", f"""{RECORDS_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace("FROM cmd)", f"FROM cmd WHERE lsn <= {SNAPSHOT_LSN // 2})")}, {APPLY_SQL} SELECT {', '.join(REPLAYED)} FROM j WHERE state <> 'none'""")
def q53(spark, d):
    from tidefold.sources import codec, files, snapshots

    folder, log = scratch(spark, "snapshots"), ledger_records(spark, d)
    for lsn in (SNAPSHOT_LSN // 2, SNAPSHOT_LSN):
        saved(records.jobs_after(log.where(F.col("lsn") <= lsn)), folder, lsn)
    newest = f"{folder}/{codec.snapshot_name(SNAPSHOT_LSN)}"
    data = bytearray(files.read_bytes(newest))
    data[len(data) // 2] ^= 255
    files.write_bytes(newest, bytes(data))
    return by_hex(snapshots.as_frame(spark, folder))


@query("q54_registry_run", SQL["q26_handler_outcomes"])
def q54(spark, d):
    def handle(job):
        flag = handlers.payload(job)["flag"]
        if flag == "R":
            raise handlers.PermanentError("permanent failure")
        if flag == "A":
            raise OSError("retryable failure")

    registry = handlers.Registry()
    for name in REGISTERED:
        registry.register(name, handle)
    jobs = attempts_v(spark, d).select("type", F.to_json(F.struct("order_id", "token", "flag")).alias("payload"))
    return registry.run(jobs).groupBy("type", "success", "retryable", "error").agg(F.count("*").alias("n"))


LEASES_SQL = f"SELECT job_id, us, op, token FROM log WHERE accepted AND op IN ('lease', 'hb', 'ok', 'fail')"


@query("q55_lease_timers", fold_sql("SELECT job_id, token, end_us AS expired_us FROM iv2 WHERE NOT answered AND end_us <= (SELECT max(us) FROM log WHERE accepted AND op IN ('lease', 'hb', 'ok', 'fail'))",
  """, iv2 AS (SELECT job_id, token, max(exp) AS end_us, count(*) FILTER (op IN ('ok', 'fail')) > 0 AS answered FROM log WHERE accepted AND op IN ('lease', 'hb', 'ok', 'fail') GROUP BY job_id, token)"""))
def q55(spark, d):
    from tidefold.streaming.ledger import run_lease_expiries

    folder = scratch(spark, "timers")
    log = fold.transitions(mutations_v(spark, d)).where(F.col("accepted") & F.col("op").isin("lease", "hb", "ok", "fail")).select("job_id", "us", "op", "token")
    return run_lease_expiries(spark, log, folder, fold.TTL_US // 1000)


@query("q56_request_validation", """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS c, event_id % 3 AS t FROM events)
  SELECT event_id, ['lease', 'heartbeat', 'complete'][t + 1] AS kind, CASE c WHEN 0 THEN 'bad json' WHEN 1 THEN 'unknown field extra' WHEN 2 THEN CASE WHEN t = 0 THEN 'worker_id is required' END END AS error FROM e""")
def q56(spark, d):
    k, t = F.get_json_object("props", "$.k").cast("int") % 5, F.col("event_id") % 3
    rest = F.when(t == 0, '"queues":["a"],"max":2,"lease_seconds":5,"wait_seconds":1').when(t == 1, '"lease_token":3,"lease_seconds":5').otherwise('"lease_token":3,"success":true,"error":"","retryable":false')
    body = F.when(k == 0, F.concat(F.lit("{"), rest)).when(k == 1, F.concat(F.lit('{"worker_id":"w","extra":1,'), rest, F.lit("}"))).when(k == 2, F.concat(F.lit("{"), rest, F.lit("}"))).otherwise(F.concat(F.lit('{"worker_id":"w",'), rest, F.lit("}")))
    rows = views.table(spark, d, "events").select("event_id", views.choose(t, ("lease", "heartbeat", "complete")).alias("kind"), body.alias("body"))
    found = F.lit(None).cast("string")
    for kind in ("lease", "heartbeat", "complete"):
        found = F.when(F.col("kind") == kind, requests.problem(F.col("body"), kind)).otherwise(found)
    return rows.select("event_id", "kind", found.alias("error"))


@query("q57_complete_replies", jobs_sql("SELECT job_id, state, attempt, epoch_us(run_at) AS run_at_us FROM jobs_v WHERE state IN ('succeeded', 'dead', 'cancelled')"))
def q57(spark, d):
    return replies.complete_reply(jobs_v(spark, d).where(is_terminal(F.col("state"))))


OVERLAPPING = [(["email", "bulk"], 30), (["bulk", "critical"], 40), (["critical", "email", "email"], 25)]


def _overlapping_sql() -> str:
    parts, taken = [], []
    for i, (queues, most) in enumerate(OVERLAPPING, 1):
        listed = list(dict.fromkeys(queues))
        order = f"list_position({listed!r}, queue), {ORDER_SQL}"
        gone = "".join(f" AND job_id NOT IN (SELECT job_id FROM {t})" for t in taken)
        parts.append(f"t{i} AS (SELECT {i} AS command, job_id, row_number() OVER (ORDER BY {order}) AS rank FROM jobs_v WHERE {DUE_SQL} AND list_contains({listed!r}, queue){gone} QUALIFY rank <= {most})")
        taken.append(f"t{i}")
    return f"WITH {JOBS_SQL}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM {t}" for t in taken)


@query("q58_overlapping_leases", _overlapping_sql())
def q58(spark, d):
    return leasing.consecutive_leases(jobs_v(spark, d), OVERLAPPING, views.at(NOW_JOBS)).select("command", "job_id", F.col("rank").cast("long").alias("rank"))


@query("q59_names_defaults_and_lists", """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  SELECT event_id, coalesce(['pending', 'leased', 'succeeded', 'dead', 'cancelled'][nullif(k % 9, 0)], 'state(' || (k % 9) || ')') AS state,
    coalesce(['submit', 'lease', 'complete', 'retry', 'dead', 'cancel', 'expire'][nullif(k % 10, 0)], 'record(' || (k % 10) || ')') AS record,
    CASE WHEN k % 4 = 0 THEN 3 ELSE k % 4 END AS attempts, 'q' || (k % 3) AS second, 2::INTEGER AS queues, CASE WHEN k % 2 = 0 THEN 'h-' || k ELSE 'w' || k END AS worker FROM e""")
def q59(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    queues = split_list(F.format_string(" a%d , q%d", k, k % 3))
    return views.table(spark, d, "events").select("event_id", state_name(k % 9).alias("state"), record_name(k % 10).alias("record"), or_default(k % 4, 3).alias("attempts"), F.element_at(queues, 2).alias("second"), F.size(queues).alias("queues"), worker_name(F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("w"), k.cast("string"))), F.lit("h"), k).alias("worker"))


@query("q60_signals_wake_waiters", f"""WITH {COMMANDS_SQL}, w AS (SELECT worker_id AS queue, lsn, row_number() OVER (PARTITION BY worker_id ORDER BY lsn) AS n FROM cmd WHERE op = 'lease'),
  s AS (SELECT worker_id AS queue, lsn, row_number() OVER (PARTITION BY worker_id ORDER BY lsn) AS n FROM cmd WHERE op = 'submit') SELECT s.queue, s.lsn AS signal, w.lsn AS waiter FROM s JOIN w ON w.queue = s.queue AND w.n = s.n""")
def q60(spark, d):
    rows = mutations_v(spark, d).withColumn("queue", F.col("worker_id"))
    return leasing.woken(rows.where("op = 'lease'"), rows.where("op = 'submit'"), "lsn")


@query("q61_ids_in_json", """SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 4 = 0 THEN upper(lpad(to_hex(epoch_ms(o_orderdate)), 12, '0') || sha256('o|' || o_orderkey)[1:20]) END AS id_hex, o_orderkey % 4 = 0 AS again FROM orders""")
def q61(spark, d):
    key = F.col("o_orderkey")
    made = ids.from_hash(F.floor(micros(F.col("o_orderdate")) / 1000), F.lit("o"), key.cast("string"))
    rows = views.table(spark, d, "orders").select(key.alias("order_key"), ids.to_json(ids.decode(made)).alias("json"))
    key = F.col("order_key")
    sent = F.when(key % 4 == 0, F.col("json")).when(key % 4 == 1, F.substring("json", 2, 26)).when(key % 4 == 2, F.lit('""')).otherwise(F.regexp_replace("json", '.{3}"$', '"'))
    read = ids.from_json(sent)
    return rows.select("order_key", F.hex(read).alias("id_hex"), F.coalesce(ids.to_json(read) == F.col("json"), F.lit(False)).alias("again"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q07(spark, sf_dir)
