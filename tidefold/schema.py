"""Schemas of jobs and ledger records."""

from __future__ import annotations

from pyspark.sql import types as T

# States and record types by their numbers in the ledger.
STATES = {1: "pending", 2: "leased", 3: "succeeded", 4: "dead", 5: "cancelled"}
RECORD_TYPES = {1: "submit", 2: "lease", 3: "complete", 4: "retry", 5: "dead", 6: "cancel", 7: "expire"}
TERMINAL = ("succeeded", "dead", "cancelled")

#: Times are nanoseconds since the epoch (bigint), null where the ledger has its zero time: Spark's timestamps hold microseconds.
JOB = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("queue", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("state", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("max_attempts", T.IntegerType()),
    T.StructField("run_at_ns", T.LongType()),
    T.StructField("lease_expiry_ns", T.LongType()),
    T.StructField("lease_token", T.LongType()),
    T.StructField("worker_id", T.StringType()),
    T.StructField("cancel_req", T.BooleanType()),
    T.StructField("last_error", T.StringType()),
    T.StructField("idem_key", T.StringType()),
    T.StructField("created_at_ns", T.LongType()),
    T.StructField("updated_at_ns", T.LongType()),
])

RECORD = T.StructType([
    T.StructField("lsn", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("flag", T.IntegerType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("job", JOB),
    T.StructField("worker_id", T.StringType()),
    T.StructField("lease_expiry_ns", T.LongType()),
    T.StructField("lease_token", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("run_at_ns", T.LongType()),
    T.StructField("error", T.StringType()),
])
