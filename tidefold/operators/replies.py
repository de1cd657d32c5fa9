"""What callers get to see of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.labels import cancel_label, micros


def submit_reply(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "state")


def cancel_reply(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", cancel_label(F.col("state"), F.col("cancel_req")).alias("state"))


def complete_reply(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "state", "attempt", micros(F.col("run_at")).alias("run_at_us"))


def lease_reply(leased: DataFrame) -> DataFrame:
    """Each lease with its job as JSON, token and deadline."""
    job = F.to_json(F.struct("job_id", "type", "queue", "priority", "state", "attempt", "max_attempts"))
    return leased.select("job_id", job.alias("job"), "lease_token", micros(F.col("lease_expiry")).alias("lease_expiry_us"))


def lookup(jobs: DataFrame, job_id) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def sorted_scan(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("job_id")


def guarded(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """Heartbeats and reports against current jobs, with the reason of a refusal (null: accepted)."""
    rows = commands.join(jobs.select("job_id", F.col("state").alias("_state"), F.col("lease_token").alias("_token")), "job_id", "left")
    reason: Column = F.when(F.col("_state").isNull(), "job not found").when(F.col("_state") != "leased", "job not leased").when(F.col("_token") != F.col("lease_token"), "stale token")
    return rows.withColumn("error", reason).drop("_state", "_token")
