"""Validation of JSON requests: strict fields, required fields, defaults and clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.labels import or_default

# The fields of each request, and the required ones.
FIELDS = {
    "submit": ("type", "queue", "payload", "run_at", "priority", "max_attempts", "idempotency_key"),
    "lease": ("worker_id", "queues", "max", "lease_seconds", "wait_seconds"),
    "heartbeat": ("worker_id", "lease_token", "lease_seconds"),
    "complete": ("worker_id", "lease_token", "success", "error", "retryable"),
}
REQUIRED = {"submit": "type", "lease": "worker_id", "heartbeat": None, "complete": None}
SUBMIT = "type string, queue string, run_at string, priority int, max_attempts int, idempotency_key string"
# What each typed payload holds.
PAYLOADS = {
    "order.confirmation_email": "order_id string, email string, order_total bigint",
    "inventory.reserve": "order_id string, sku string, qty int",
    "payment.capture": "order_id string, amount_cents bigint, idempotency_key string",
    "invoice.generate": "order_id string",
}
DEFAULT_QUEUE, DEFAULT_ATTEMPTS, DEFAULT_MAX, DEFAULT_LEASE_S, MAX_WAIT_S = "default", 3, 1, 30, 30


def problem(body: Column, kind: str) -> Column:
    """Why a request is rejected, null if it isn't."""
    keys = F.json_object_keys(body)
    known = F.array(*[F.lit(x) for x in FIELDS[kind]])
    unknown = F.element_at(F.array_sort(F.array_except(keys, known)), 1)
    out = F.when(keys.isNull(), F.lit("bad json")).when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit("unknown field "), unknown))
    if (need := REQUIRED[kind]) is not None:
        out = out.when(F.coalesce(F.get_json_object(body, f"$.{need}"), F.lit("")) == "", F.lit(f"{need} is required"))
    return out


def submissions(requests: DataFrame, body: str = "body", now_us: int = 0) -> DataFrame:
    """Adds error and, for accepted rows, the submitted job's fields with defaults filled in."""
    bad = problem(F.col(body), "submit")
    job = F.from_json(F.when(bad.isNull(), F.col(body)), SUBMIT)
    rows = requests.withColumns({"error": bad, "job": job})
    run_at = F.coalesce(F.unix_micros(F.try_to_timestamp("job.run_at")), F.lit(now_us))
    ok = F.col("error").isNull()
    return rows.select(
        *requests.columns, "error", F.col("job.type").alias("type"),
        F.when(ok, or_default(F.col("job.queue"), DEFAULT_QUEUE)).alias("queue"),
        F.when(ok, F.coalesce(F.col("job.priority"), F.lit(0))).alias("priority"),
        F.when(ok, or_default(F.col("job.max_attempts"), DEFAULT_ATTEMPTS)).alias("max_attempts"),
        F.when(ok, run_at).alias("run_at_us"),
        F.when(ok, F.nullif(F.col("job.idempotency_key"), F.lit(""))).alias("idem_key"),
    )


def lease_limits(most: Column, lease_s: Column, wait_s: Column) -> tuple[Column, Column, Column]:
    """(max, lease_seconds, wait_seconds) with defaults; waits end after MAX_WAIT_S."""
    positive = lambda c, value: F.when(F.coalesce(c, F.lit(0)) > 0, c).otherwise(F.lit(value))
    return positive(most, DEFAULT_MAX), positive(lease_s, DEFAULT_LEASE_S), F.least(F.coalesce(wait_s, F.lit(0)), F.lit(MAX_WAIT_S))


def payload_error(payload: Column, schema: str) -> Column:
    """Why a payload can't be read as `schema` (a permanent failure), null if it can."""
    parsed = F.from_json(payload, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(payload.isNull() | F.json_object_keys(payload).isNull() | parsed["_corrupt_record"].isNotNull(), F.lit("permanent: invalid payload"))
