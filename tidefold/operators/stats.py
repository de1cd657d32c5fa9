"""Reports over current jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.labels import micros
from tidefold.schema import STATES


def queue_stats(jobs: DataFrame, now: Column) -> DataFrame:
    """Per queue: jobs by state, and the age in microseconds of the oldest pending job, due or not (0 at least)."""
    counts = [F.count(F.when(F.col("state") == s, True)).alias(s) for s in STATES.values()]
    age = F.max(F.when(F.col("state") == "pending", micros(now) - micros(F.col("created_at"))))
    return jobs.groupBy("queue").agg(*counts, F.greatest(F.coalesce(age, F.lit(0)), F.lit(0)).cast("long").alias("oldest_pending_age_us"))


def metrics_lines(stats: DataFrame, prefix: str = "job") -> DataFrame:
    """The report as exposition text: (line_no, line), in order of metric, queue and state."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("queue", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    heads = [f"# HELP {prefix}_queue_depth Number of jobs in queue by state", f"# TYPE {prefix}_queue_depth gauge", f"# HELP {prefix}_oldest_pending_age_seconds Oldest pending job age in seconds", f"# TYPE {prefix}_oldest_pending_age_seconds gauge"]
    depth = F.array(*[F.struct(F.lit(2).alias("part"), F.lit(i).alias("place"), F.format_string(f'{prefix}_queue_depth{{queue=%s,state="{s}"}} %d', quoted, F.col(s)).alias("line")) for i, s in enumerate(STATES.values())])
    age = F.struct(F.lit(5).alias("part"), F.lit(0).alias("place"), F.format_string(f"{prefix}_oldest_pending_age_seconds{{queue=%s}} %.3f", quoted, F.col("oldest_pending_age_us") / 1e6).alias("line"))
    rows = stats.select("queue", F.inline(F.concat(depth, F.array(age))))
    fixed = stats.sparkSession.createDataFrame([("", p, 0, h) for p, h in zip((0, 1, 3, 4), heads, strict=True)], "queue string, part int, place int, line string")
    return rows.unionByName(fixed).orderBy("part", "queue", "place").select("line")


def totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("jobs"), F.count_distinct("queue").alias("queues"))


def stuck(jobs: DataFrame) -> DataFrame:
    """Pending jobs that have used up their attempts: expiry never checks them."""
    return jobs.where((F.col("state") == "pending") & (F.col("attempt") >= F.col("max_attempts")))
