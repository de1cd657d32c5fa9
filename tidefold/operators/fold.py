"""The ledger's state machine as a fold of commands in ledger order.

Commands (job_id, lsn, us, op, stale): submit, lease, hb, ok, fail, cancel.  `stale` commands show an
old fencing token.  A lease that has run out by a command's time ends just before that command.

Two forms with one meaning: `fold` is one expression over each job's sorted commands and stays in
the JVM; `transitions` streams sorted rows and holds one state per task, so histories of any length
fit, and says for every command what it did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.schema import TERMINAL

MAX_ATTEMPTS = 3
TTL_US = 12 * 3600 * 1_000_000
STATE = "state string, attempt int, token bigint, exp bigint, cancel_req boolean, accepted bigint, rejected bigint"
TRANSITION = "job_id bigint, lsn bigint, us bigint, op string, accepted boolean, reason string, expired boolean, before string, state string, attempt int, token bigint, exp bigint, cancel_req boolean"


def nothing() -> Column:
    """The state of a job that was never submitted."""
    zero = F.lit(0).cast("long")
    return F.struct(F.lit("none").alias("state"), F.lit(0).alias("attempt"), zero.alias("token"), zero.alias("exp"), F.lit(False).alias("cancel_req"), zero.alias("accepted"), zero.alias("rejected"))


def step(s: Column, c: Column, max_attempts: int, ttl_us: int) -> Column:
    """The state after command c in state s."""
    ended = F.when(s["cancel_req"], F.lit("cancelled")).otherwise(F.lit("pending"))
    now = F.when((s["state"] == "leased") & (s["exp"] <= c["us"]), ended).otherwise(s["state"])
    op = c["op"]
    submit, lease = (op == "submit") & (now == "none"), (op == "lease") & (now == "pending")
    fenced = (now == "leased") & ~c["stale"]
    beat, done, failed = (op == "hb") & fenced, (op == "ok") & fenced, (op == "fail") & fenced
    cancel = (op == "cancel") & now.isin("pending", "leased")
    retry = F.when(s["attempt"] < max_attempts, ended).otherwise(F.lit("dead"))
    state = (
        F.when(submit, F.lit("pending")).when(lease, F.lit("leased")).when(done, F.when(s["cancel_req"], F.lit("cancelled")).otherwise(F.lit("succeeded")))
        .when(failed, retry).when(cancel & (now == "pending"), F.lit("cancelled")).otherwise(now)
    )
    accepted = submit | lease | beat | done | failed | cancel
    return F.struct(
        state.alias("state"), (s["attempt"] + lease.cast("int")).alias("attempt"), (s["token"] + lease.cast("long")).alias("token"),
        F.when(lease | beat, c["us"] + ttl_us).otherwise(s["exp"]).alias("exp"),
        (s["cancel_req"] | (cancel & (now == "leased"))).alias("cancel_req"),
        (s["accepted"] + accepted.cast("long")).alias("accepted"), (s["rejected"] + (~accepted).cast("long")).alias("rejected"),
    )


def fold(commands: DataFrame, start: DataFrame | None = None, max_attempts: int = MAX_ATTEMPTS, ttl_us: int = TTL_US) -> DataFrame:
    """(job_id, state, ...) of every job after its commands, from `start` (a result of this function) on."""
    history = commands.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("lsn", "us", "op", "stale"))).alias("commands"))
    first = nothing()
    if start is not None:
        names = [f.split()[0] for f in STATE.split(", ")]
        history = history.join(start.select("job_id", F.struct(*names).cast(f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>").alias("start")), "job_id", "full")
        history = history.withColumn("commands", F.coalesce("commands", F.array().cast("array<struct<lsn:bigint,us:bigint,op:string,stale:boolean>>")))
        first = F.coalesce(F.col("start"), first)
    return history.select("job_id", F.aggregate("commands", first, lambda s, c: step(s, c, max_attempts, ttl_us)).alias("s")).select("job_id", "s.*")


def refusal(op: str, state: str, stale: bool) -> str | None:
    """Why a command is rejected in a state, None if it isn't."""
    if op == "submit":
        return None if state == "none" else "exists"
    if state == "none":
        return "not_found"
    if op == "lease":
        return None if state == "pending" else "not_pending"
    if op == "cancel":
        return "terminal" if state in TERMINAL else None
    if state != "leased":
        return "not_leased"
    return "stale_token" if stale else None


class State:
    """One job's state, and what a command makes of it: `step` for a single job in Python."""

    __slots__ = ("state", "attempt", "token", "exp", "cancel_req", "accepted", "rejected")

    def __init__(self, state: str = "none", attempt: int = 0, token: int = 0, exp: int = 0, cancel_req: bool = False, accepted: int = 0, rejected: int = 0):
        self.state, self.attempt, self.token, self.exp, self.cancel_req, self.accepted, self.rejected = state, attempt, token, exp, cancel_req, accepted, rejected

    def apply(self, us: int, op: str, stale: bool, max_attempts: int, ttl_us: int) -> tuple[str | None, bool, str]:
        """(reason of a rejection, whether a lease ended just before, the state then)."""
        ended = self.state == "leased" and self.exp <= us
        if ended:
            self.state = "cancelled" if self.cancel_req else "pending"
        before, reason = self.state, refusal(op, self.state, stale)
        if reason is not None:
            self.rejected += 1
            return reason, ended, before
        self.accepted += 1
        if op == "submit":
            self.state = "pending"
        elif op == "lease":
            self.state, self.attempt, self.token, self.exp = "leased", self.attempt + 1, self.token + 1, us + ttl_us
        elif op == "hb":
            self.exp = us + ttl_us
        elif op == "ok":
            self.state = "cancelled" if self.cancel_req else "succeeded"
        elif op == "fail":
            self.state = "dead" if self.attempt >= max_attempts else "cancelled" if self.cancel_req else "pending"
        elif self.state == "leased":
            self.cancel_req = True
        else:
            self.state = "cancelled"
        return None, ended, before

    def row(self) -> tuple:
        return self.state, self.attempt, self.token, self.exp, self.cancel_req, self.accepted, self.rejected


def transitions(commands: DataFrame, max_attempts: int = MAX_ATTEMPTS, ttl_us: int = TTL_US) -> DataFrame:
    """Every command with its verdict and the job's state before (after a lease's end) and after it."""

    def run(batches):
        import pyarrow as pa

        job, at = None, State()
        for batch in batches:
            out = []
            for j, lsn, us, op, stale in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if j != job:
                    job, at = j, State()
                reason, ended, before = at.apply(us, op, stale, max_attempts, ttl_us)
                out.append((j, lsn, us, op, reason is None, reason, ended, before, at.state, at.attempt, at.token, at.exp, at.cancel_req))
            if out:
                kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
                fields = [f.split() for f in TRANSITION.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    rows = commands.select("job_id", "lsn", "us", "op", "stale").repartition("job_id").sortWithinPartitions("job_id", "lsn")
    return rows.mapInArrow(run, TRANSITION)


def rejections(log: DataFrame) -> DataFrame:
    """Commands by operation and verdict."""
    return log.groupBy("op", F.coalesce("reason", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("n"))


def eligible(log: DataFrame) -> DataFrame:
    """Moments at which a job could be leased (again): its submission, a retry, a lease's end.

    A job that is cancelled as its lease ends counts too, as such a job also raises the signal."""
    why = F.when(F.col("accepted") & (F.col("op") == "submit"), "submit").when(F.col("expired"), "expire").when(F.col("accepted") & (F.col("op") == "fail") & (F.col("state") == "pending"), "retry")
    return log.withColumn("why", why).where("why IS NOT NULL").select("job_id", "lsn", "why")


def heartbeats(log: DataFrame) -> DataFrame:
    """Accepted heartbeats: the new deadline and whether the worker is told to stop."""
    return log.where(F.col("accepted") & (F.col("op") == "hb")).select("job_id", "lsn", F.col("exp").alias("lease_expiry_us"), F.col("cancel_req").alias("cancelled"))


def lease_intervals(log: DataFrame) -> DataFrame:
    """(job_id, token, start_us, end_us) of every lease: up to its answer, else its last deadline."""
    live = log.where(F.col("accepted") & F.col("op").isin("lease", "hb", "ok", "fail"))
    answered = F.min(F.when(F.col("op").isin("ok", "fail"), F.col("us")))
    return live.groupBy("job_id", "token").agg(F.min("us").alias("start_us"), F.coalesce(answered, F.max("exp")).alias("end_us"))


def live_at(intervals: DataFrame, us: int) -> DataFrame:
    return intervals.where((F.col("start_us") <= us) & (F.col("end_us") > us))


def running_counts(commands: DataFrame) -> DataFrame:
    """Leases asked for so far per job, as a running count: the token or attempt if all were granted."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("job_id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    return commands.withColumn("leases", F.sum((F.col("op") == "lease").cast("long")).over(so_far))


def latest(commands: DataFrame) -> DataFrame:
    """The last command of every job."""
    return commands.groupBy("job_id").agg(F.max_by(F.struct("lsn", "us", "op", "worker_id"), "lsn").alias("c")).select("job_id", "c.*")


def recover(snapshot: DataFrame, tail: DataFrame, **limits: int) -> DataFrame:
    """The state after a snapshot and the commands behind it."""
    return fold(tail, snapshot, **limits)
