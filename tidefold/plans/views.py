"""The driver's tables seen as jobs, commands and attempts; `SQL` is the same for DuckDB."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.labels import micros

JOB_TYPES = ("order.confirmation_email", "inventory.reserve", "payment.capture", "invoice.generate", "analytics.sync", "search.index")
NOW_JOBS, NOW_LOG = datetime.datetime(1998, 6, 1), datetime.datetime(2024, 1, 8)
EPOCH = datetime.datetime(1970, 1, 1)


def us(t: datetime.datetime) -> int:
    return (t - EPOCH) // datetime.timedelta(microseconds=1)


def at(t: datetime.datetime) -> Column:
    return F.lit(t.isoformat(" ")).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def choose(column: Column, names: tuple[str, ...]) -> Column:
    """names[column], as a chain of cases."""
    out = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        out = F.when(column == i, names[i]).otherwise(out)
    return out


def jobs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        key.alias("job_id"), choose(customer % 6, JOB_TYPES).alias("type"),
        F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "email").when(priority == "3-MEDIUM", "default").otherwise("bulk").alias("queue"),
        ((customer % 11).cast("int") - 5).alias("priority"), F.col("o_orderdate").alias("run_at"),
        (F.col("o_orderdate") - F.make_dt_interval((key % 5).cast("int"))).alias("created_at"),
        F.when(status == "O", "pending").when(status == "P", "leased").otherwise(choose(key % 3, ("succeeded", "dead", "cancelled"))).alias("state"),
        (key % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), (key % 4).alias("lease_token"),
        F.when(status == "P", F.col("o_orderdate") + F.make_dt_interval((key % 90).cast("int"))).alias("lease_expiry"),
        ((status == "P") & (key % 7 == 0)).alias("cancel_req"), F.concat(F.lit("idem-"), customer.cast("string"), F.lit("-"), priority).alias("idem_key"),
    )


def mutations_v(spark: SparkSession, sf_dir: str, until: datetime.datetime | None = NOW_LOG) -> DataFrame:
    return commands_of(table(spark, sf_dir, "events"), until)


def commands_of(events: DataFrame, until: datetime.datetime | None = NOW_LOG) -> DataFrame:
    """Commands in the rows of events, batch or stream."""
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    op = F.when(kind == "signup", "submit").when(kind == "view", "lease").when(kind == "purchase", "ok").when(kind == "error", "fail").when(k < 10, "cancel").otherwise("hb")
    rows = events.where(F.col("ts") < at(until)) if until else events
    return rows.select(F.col("user_id").alias("job_id"), (F.col("event_id") + 1).alias("lsn"), micros(F.col("ts")).alias("us"), op.alias("op"), (k % 10 == 0).alias("stale"), F.concat(F.lit("w"), (k % 3).cast("string")).alias("worker_id"))


MOST_WORDS = 1 << 22


def lines_of(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines whose order is among `orders`, by a bit for each order in words of 64 ids; all lines where the words are too many to broadcast."""
    n, least, most = orders.agg(F.count("o_orderkey"), F.min("o_orderkey"), F.max("o_orderkey")).first()
    if n and min(n, (most >> 6) - (least >> 6) + 1) > MOST_WORDS:
        return lines
    at = lambda key: F.col(key).bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at("o_orderkey"))
    words = orders.groupBy(F.shiftright("o_orderkey", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    met = lines.join(F.broadcast(words), F.shiftright("l_orderkey", 6) == F.col("word"))
    return met.where(F.getbit("bits", at("l_orderkey")) == 1).drop("word", "bits")


def attempts_v(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """Attempts, or those of one type; lines of other orders then go before lines and orders meet by shuffle."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if only is not None:
        orders = orders.where(choose(F.col("o_custkey") % 6, JOB_TYPES) == only)
        lines = lines_of(lines, orders)
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"), F.col("l_linenumber").cast("long").alias("token"),
        F.col("l_quantity").cast("int").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_cents"), F.col("l_returnflag").alias("flag"),
        (F.col("l_returnflag") == "N").alias("success"), choose(F.col("o_custkey") % 6, JOB_TYPES).alias("type"), F.concat(F.lit("pay-"), F.col("o_custkey").cast("string")).alias("pay_key"),
    )


def _case(expression: str, names: tuple[str, ...]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


JOBS_SQL = f"""jobs_v AS (SELECT o_orderkey AS job_id, {_case('o_custkey % 6', JOB_TYPES)} AS type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'email' WHEN '3-MEDIUM' THEN 'default' ELSE 'bulk' END AS queue,
  CAST(o_custkey % 11 AS INTEGER) - 5 AS priority, o_orderdate AS run_at, o_orderdate - to_days(CAST(o_orderkey % 5 AS INTEGER)) AS created_at,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'leased' ELSE {_case('o_orderkey % 3', ('succeeded', 'dead', 'cancelled'))} END AS state,
  CAST(o_orderkey % 4 AS INTEGER) AS attempt, 3 AS max_attempts, o_orderkey % 4 AS lease_token,
  CASE WHEN o_orderstatus = 'P' THEN o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) END AS lease_expiry,
  o_orderstatus = 'P' AND o_orderkey % 7 = 0 AS cancel_req, 'idem-' || o_custkey || '-' || o_orderpriority AS idem_key FROM orders)"""

COMMANDS_SQL = f"""cmd AS (SELECT user_id AS job_id, event_id + 1 AS lsn, epoch_us(ts) AS us,
  CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'lease' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'fail' ELSE CASE WHEN k < 10 THEN 'cancel' ELSE 'hb' END END AS op,
  k % 10 = 0 AS stale, 'w' || (k % 3) AS worker_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE ts < TIMESTAMP '{NOW_LOG.isoformat(" ")}')"""

ATTEMPTS_SQL = f"""att AS (SELECT l_orderkey AS order_id, l_partkey AS sku, CAST(l_linenumber AS BIGINT) AS token, CAST(l_quantity AS INTEGER) AS qty,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents, l_returnflag AS flag, l_returnflag = 'N' AS success,
  {_case('o_custkey % 6', JOB_TYPES)} AS type, 'pay-' || o_custkey AS pay_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

#: One row per command: a step of a recursion that knows only the job's row before it.
FOLD_SQL = """num AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY lsn) AS rn FROM cmd),
f(job_id, rn, lsn, us, op, reason, expired, before, state, attempt, token, exp, creq) AS (
  SELECT DISTINCT job_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', NULL::VARCHAR, false, '', 'none', 0, 0::BIGINT, 0::BIGINT, false FROM cmd
  UNION ALL
  SELECT job_id, rn, lsn, us, op, reason, expired, st,
    CASE WHEN reason IS NOT NULL THEN st WHEN op = 'submit' THEN 'pending' WHEN op = 'lease' THEN 'leased' WHEN op = 'hb' THEN st
         WHEN op = 'ok' THEN CASE WHEN creq THEN 'cancelled' ELSE 'succeeded' END
         WHEN op = 'fail' THEN CASE WHEN attempt >= 3 THEN 'dead' WHEN creq THEN 'cancelled' ELSE 'pending' END
         WHEN st = 'pending' THEN 'cancelled' ELSE st END,
    attempt + CASE WHEN reason IS NULL AND op = 'lease' THEN 1 ELSE 0 END,
    token + CASE WHEN reason IS NULL AND op = 'lease' THEN 1 ELSE 0 END,
    CASE WHEN reason IS NULL AND op IN ('lease', 'hb') THEN us + 43200000000 ELSE exp END,
    creq OR (reason IS NULL AND op = 'cancel' AND st = 'leased')
  FROM (SELECT *, CASE WHEN op = 'submit' THEN CASE WHEN st <> 'none' THEN 'exists' END WHEN st = 'none' THEN 'not_found'
                       WHEN op = 'lease' THEN CASE WHEN st <> 'pending' THEN 'not_pending' END
                       WHEN op = 'cancel' THEN CASE WHEN st IN ('succeeded', 'dead', 'cancelled') THEN 'terminal' END
                       WHEN st <> 'leased' THEN 'not_leased' WHEN stale THEN 'stale_token' END AS reason
        FROM (SELECT f.job_id, num.rn, num.lsn, num.us, num.op, num.stale, f.attempt, f.token, f.exp, f.creq,
                     f.state = 'leased' AND f.exp <= num.us AS expired,
                     CASE WHEN f.state = 'leased' AND f.exp <= num.us THEN CASE WHEN f.creq THEN 'cancelled' ELSE 'pending' END ELSE f.state END AS st
              FROM f JOIN num ON num.job_id = f.job_id AND num.rn = f.rn + 1))),
log AS (SELECT *, reason IS NULL AS accepted FROM f WHERE rn > 0),
fin AS (SELECT job_id, arg_max(state, rn) AS state, arg_max(attempt, rn) AS attempt, arg_max(token, rn) AS token, arg_max(exp, rn) AS exp,
               arg_max(creq, rn) AS cancel_req, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM log GROUP BY job_id)"""
