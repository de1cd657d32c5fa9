"""Idempotent submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_key(key: Column) -> Column:
    return key.isNotNull() & (key != "")


def idempotent_submit(submissions: DataFrame, order: str = "job_id", key: str = "idem_key") -> DataFrame:
    """Adds accepted and answered_id: of submissions with one non-empty key the first is accepted and
    answers all.  The first per key comes from an aggregation that is partly done before the shuffle
    and a join whose hot keys adaptive execution splits, so one key may hold most rows."""
    keyed = submissions.where(has_key(F.col(key)))
    first = keyed.groupBy(key).agg(F.min(order).alias("answered_id"))
    rows = keyed.join(first, key).withColumn("accepted", F.col("answered_id") == F.col(order))
    keyless = submissions.where(~has_key(F.col(key))).withColumns({"answered_id": F.col(order), "accepted": F.lit(True)})
    return rows.unionByName(keyless)  # rows without key meet nobody, so they take no part in the join


def against_existing(submissions: DataFrame, jobs: DataFrame, key: str = "idem_key") -> tuple[DataFrame, DataFrame]:
    """(new submissions, submissions that an existing job answers, with that job's id as existing_id)."""
    known = jobs.where(has_key(F.col(key))).groupBy(key).agg(F.min("job_id").alias("existing_id"))
    return submissions.join(known, key, "left_anti"), submissions.join(known, key)


def same_batch_duplicates(submissions: DataFrame, batch: Column, order: str = "job_id", key: str = "idem_key") -> DataFrame:
    """Per batch: keys that are new in it and come more than once, and the jobs beyond the last of each.

    A writer that checks keys only against the state before the batch would accept them all and
    lose track of all but the last; this engine doesn't, and reports them."""
    keyed = submissions.where(has_key(F.col(key))).withColumn("batch", batch)
    per = keyed.groupBy(key, "batch").agg(F.count("*").alias("n"))
    first = per.groupBy(key).agg(F.min_by("n", "batch").alias("n"), F.min("batch").alias("batch"))
    return first.where("n > 1").groupBy("batch").agg(F.count("*").alias("keys"), F.sum(F.col("n") - 1).cast("long").alias("orphans"))


def latest_per_key(jobs: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key."""
    return jobs.groupBy(key).agg(F.max_by(F.struct(*[c for c in jobs.columns if c != key]), order).alias("r")).select(key, "r.*")
