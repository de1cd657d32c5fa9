"""Due jobs in lease order, and leases taken from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def lease_order() -> list[Column]:
    """Earlier run_at first; priority decides only between equal times, the id between equal priorities."""
    return [F.col("run_at").asc(), F.col("priority").desc(), F.col("job_id").asc()]


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Pending jobs whose time has come; both conditions reach the scan."""
    return jobs.where((F.col("state") == "pending") & (F.col("run_at") <= now))


def due_topk(jobs: DataFrame, now: Column, k: int) -> DataFrame:
    """The first k due jobs of every queue, with their rank there."""
    ranked = due(jobs, now).withColumn("rank", F.row_number().over(Window.partitionBy("queue").orderBy(*lease_order())))
    return ranked.where(F.col("rank") <= k)


def lease_candidates(jobs: DataFrame, queues: list[str], most: int, now: Column) -> DataFrame:
    """What one lease request over several queues takes: the listed queues are drained in list order
    under a common limit.  Adds queue_pos and the position in the reply (`rank`, from 1)."""
    listed = list(dict.fromkeys(queues))
    position = F.array_position(F.array(*[F.lit(q) for q in listed]), F.col("queue"))
    rows = due(jobs, now).where(F.col("queue").isin(*listed)).withColumn("queue_pos", position.cast("int"))
    order = [F.col("queue_pos").asc(), *lease_order()]
    taken = rows.orderBy(*order).limit(most)  # top-k; only `most` rows reach the window below
    return taken.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def successive_leases(jobs: DataFrame, queue: str, sizes: list[int], now: Column) -> DataFrame:
    """Which of several lease commands, one after the other on one queue, takes which job."""
    rows = due(jobs, now).where(F.col("queue") == queue).orderBy(*lease_order()).limit(sum(sizes))
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(*lease_order())))
    command, before = F.lit(len(sizes)), sum(sizes)
    for i in range(len(sizes) - 1, 0, -1):
        before -= sizes[i]
        command = F.when(F.col("rank") <= before, F.lit(i)).otherwise(command)
    return rows.withColumn("command", command)


def consecutive_leases(jobs: DataFrame, requests: list[tuple[list[str], int]], now: Column) -> DataFrame:
    """Which of several lease requests (queues, most), one after the other, takes which job (`command`, from 1, and `rank`).

    A request takes at most `most` jobs, so what earlier ones took is small and is broadcast against the next."""
    out, left = None, jobs
    for i, (queues, most) in enumerate(requests, 1):
        taken = lease_candidates(left, queues, most, now).withColumn("command", F.lit(i))
        out = taken if out is None else out.unionByName(taken)
        left = left.join(F.broadcast(taken.select("job_id")), "job_id", "left_anti")
    return out


def woken(waiters: DataFrame, signals: DataFrame, arrival: str) -> DataFrame:
    """Which signal wakes which waiter: on every queue each signal one, in the order they came (queue, signal, waiter)."""
    nth = F.row_number().over(Window.partitionBy("queue").orderBy(arrival))
    a = signals.select("queue", F.col(arrival).alias("signal"), nth.alias("n"))
    return a.join(waiters.select("queue", F.col(arrival).alias("waiter"), nth.alias("n")), ["queue", "n"]).drop("n")


def leased(taken: DataFrame, now: Column, seconds: int, worker_id: str) -> DataFrame:
    """Rows after their lease: attempt and token one higher, a new deadline, the worker's name."""
    return taken.withColumns({
        "state": F.lit("leased"), "attempt": F.col("attempt") + 1, "lease_token": F.col("lease_token") + 1,
        "lease_expiry": now + F.make_dt_interval(secs=F.lit(seconds)), "worker_id": F.lit(worker_id),
    })


def apply_leases(jobs: DataFrame, taken: DataFrame, now: Column, seconds: int, worker_id: str) -> DataFrame:
    """All jobs after a lease request; `taken` is bounded by the request's limit and so is broadcast."""
    mark = F.broadcast(taken.select("job_id", F.lit(True).alias("_taken")))
    rows = jobs.withColumn("worker_id", F.lit(None).cast("string")) if "worker_id" not in jobs.columns else jobs
    hit = F.coalesce("_taken", F.lit(False))
    return rows.join(mark, "job_id", "left").withColumns({
        "state": F.when(hit, "leased").otherwise(F.col("state")),
        "attempt": F.col("attempt") + hit.cast("int"), "lease_token": F.col("lease_token") + hit.cast("int"),
        "lease_expiry": F.when(hit, now + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col("lease_expiry")),
        "worker_id": F.when(hit, worker_id).otherwise(F.col("worker_id")),
    }).drop("_taken")
