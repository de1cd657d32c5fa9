"""Records of the binary ledger applied to jobs: replay after a restart.

A record says what was decided, so applying it asks no questions: a submission is the job, the others
change fields of a job that is there.  Each job's records are folded in LSN order by one JVM
expression; jobs of a snapshot are where the fold starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators.expiry import EXPIRED, RECONCILED
from tidefold.schema import JOB, RECORD


def applied(job: Column, record: Column, now_ns: Column) -> Column:
    """The job (JOB, null if there is none) after a record (RECORD)."""
    kind, stop = record["type"], job["cancel_req"]
    is_ = lambda *kinds: kind.isin(*kinds)
    ended = F.when(kind == "complete", F.when(record["success"], F.lit("succeeded")).otherwise("dead")).otherwise(F.lit("pending"))
    changed = {
        "state": F.when(kind == "lease", F.lit("leased")).when(kind == "dead", F.lit("dead")).when(is_("complete", "retry", "expire"), F.when(stop, F.lit("cancelled")).otherwise(ended))
        .when((kind == "cancel") & (job["state"] == "pending"), F.lit("cancelled")).otherwise(job["state"]),
        "attempt": F.when(kind == "lease", record["attempt"]).otherwise(job["attempt"]),
        "run_at_ns": F.when((kind == "retry") & ~stop, record["run_at_ns"]).otherwise(job["run_at_ns"]),
        "lease_expiry_ns": F.when(kind == "lease", record["lease_expiry_ns"]).otherwise(job["lease_expiry_ns"]),
        "lease_token": F.when(kind == "lease", record["lease_token"]).otherwise(job["lease_token"]),
        "worker_id": F.when(kind == "lease", record["worker_id"]).when(kind == "cancel", job["worker_id"]),
        "cancel_req": stop | ((kind == "cancel") & (job["state"] == "leased")),
        "last_error": F.when(kind == "dead", record["error"]).when((kind == "complete") & ~stop, F.when(record["success"], F.lit("")).otherwise(record["error"]))
        .when((kind == "retry") & ~stop, record["error"]).when((kind == "expire") & ~stop, F.lit(EXPIRED)).otherwise(job["last_error"]),
        "updated_at_ns": now_ns,
    }
    after = F.struct(*[changed.get(f.name, job[f.name]).cast(f.dataType).alias(f.name) for f in JOB])
    return F.when(kind == "submit", record["job"]).when(job.isNotNull(), after)


def jobs_after(records: DataFrame, start: DataFrame | None = None, now_ns: int = 0) -> DataFrame:
    """The jobs (JOB) after `records` (RECORD), from the jobs of a snapshot on; records of jobs that aren't there do nothing.

    A job's records meet in one task, as an array: snapshots keep such tails short."""
    names = [f.name for f in RECORD if f.name != "job_id"]
    tails = records.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("records"))
    kind = f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in JOB)}>"
    first = F.lit(None).cast(kind)
    if start is not None:
        tails = tails.join(start.select("job_id", F.struct(*JOB.names).cast(kind).alias("start")), "job_id", "full")
        first = F.col("start")
    steps = F.coalesce("records", F.array())
    job = F.aggregate(steps, first, lambda j, r: applied(j, r, F.lit(now_ns).cast("long")))
    return tails.select(job.alias("job")).where("job IS NOT NULL").select("job.*")


def reconciled(jobs: DataFrame, now_ns: int) -> DataFrame:
    """All jobs after a restart: leases have no holder any more, so their jobs are due at once, or cancelled if that was asked for."""
    held, stop = F.col("state") == "leased", F.col("cancel_req")
    return jobs.withColumns({
        "state": F.when(held, F.when(stop, "cancelled").otherwise("pending")).otherwise(F.col("state")),
        "run_at_ns": F.when(held & ~stop, F.lit(now_ns).cast("long")).otherwise(F.col("run_at_ns")),
        "last_error": F.when(held & ~stop, RECONCILED).otherwise(F.col("last_error")),
        "worker_id": F.when(~held, F.col("worker_id")),
    })
