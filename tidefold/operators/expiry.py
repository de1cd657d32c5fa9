"""Lease deadlines: which have passed, what becomes of their jobs, and recovery after a restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPIRED = "lease expired"
RECONCILED = "lease reconciled on coordinator recovery"


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Leased jobs whose deadline has passed, all of them."""
    return jobs.where((F.col("state") == "leased") & (F.col("lease_expiry") <= now))


def in_deadline_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("lease_expiry", "job_id")


def released(cancel_req: Column) -> Column:
    """Where a job goes whose lease ends without an answer."""
    return F.when(cancel_req, F.lit("cancelled")).otherwise(F.lit("pending"))


def apply_expiry(jobs: DataFrame, now: Column) -> DataFrame:
    """All jobs after deadlines were enforced; run_at stays, the deadline stays on record."""
    hit = (F.col("state") == "leased") & (F.col("lease_expiry") <= now)
    return jobs.withColumns({
        "state": F.when(hit, released(F.col("cancel_req"))).otherwise(F.col("state")),
        "last_error": F.when(hit, F.lit(EXPIRED)).otherwise(F.col("last_error") if "last_error" in jobs.columns else F.lit("")),
    })


def reconcile(jobs: DataFrame, now: Column) -> DataFrame:
    """All jobs after a restart: whatever was leased goes back at once, due now."""
    hit = F.col("state") == "leased"
    out = {"state": F.when(hit, released(F.col("cancel_req"))).otherwise(F.col("state")), "last_error": F.when(hit, F.lit(RECONCILED)).otherwise(F.col("last_error") if "last_error" in jobs.columns else F.lit(""))}
    if "run_at" in jobs.columns:
        out["run_at"] = F.when(hit, now).otherwise(F.col("run_at"))
    if "worker_id" in jobs.columns:
        out["worker_id"] = F.when(~hit, F.col("worker_id"))
    return jobs.withColumns(out)


def next_wake(jobs: DataFrame) -> DataFrame:
    """One row: the earliest of pending run_at and leased deadlines, null if there is none."""
    at = F.when(F.col("state") == "pending", F.col("run_at")).when(F.col("state") == "leased", F.col("lease_expiry"))
    return jobs.agg(F.min(at).alias("next_wake"))
