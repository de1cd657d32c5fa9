"""The ledger as a stream: command batches folded into versioned state, and leases with timers."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidefold.operators.fold import MAX_ATTEMPTS, STATE, TTL_US, State, fold
from tidefold.sources import snapshots


class LedgerStream:
    """Folds every micro-batch into the state before it and writes the result as a new version.

    Versions are named by batch, so a batch that runs again after a failure starts from the same
    state and overwrites its own version: each command takes effect exactly once."""

    def __init__(self, spark: SparkSession, folder: str, max_attempts: int = MAX_ATTEMPTS, ttl_us: int = TTL_US, keep: int = 3, on_batch: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.folder, self.limits, self.keep, self.on_batch = spark, folder.rstrip("/"), {"max_attempts": max_attempts, "ttl_us": ttl_us}, keep, on_batch

    def before(self, batch_id: int) -> DataFrame | None:
        """The state that a batch starts from: the newest version below its own."""
        jvm = self.spark.sparkContext._jvm
        system = jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for version in range(batch_id, 0, -1):
            path = f"{self.folder}/state/snapshot_lsn={version:020d}"
            if system.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                return self.spark.read.parquet(path)
        return None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        snapshots.save_table(fold(batch, self.before(batch_id), **self.limits), f"{self.folder}/state", batch_id + 1)
        snapshots.prune_tables(self.spark, f"{self.folder}/state", self.keep)
        if self.on_batch:
            self.on_batch(batch, batch_id)

    def start(self, commands: DataFrame, every: str = "100 milliseconds"):
        """Fold what arrives, batch by batch, until the query is stopped."""
        return commands.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(processingTime=every).start()

    def run(self, commands: DataFrame) -> DataFrame | None:
        """Take in everything that is there, then give the current state."""
        query = commands.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return snapshots.newest_table(self.spark, f"{self.folder}/state")[0]


def fresh_keys(submissions: DataFrame, key: str = "idem_key", within: str | None = None, time: str = "ts") -> DataFrame:
    """A stream's first submission per key: for ever, or among those at most `within` apart; rows without key all pass.

    Times without zone are taken as UTC."""
    if within is not None:
        submissions = submissions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within)
    keyless = F.coalesce(F.col(key), F.lit("")) == ""
    keyed = submissions.where(~keyless)
    return (keyed.dropDuplicates([key]) if within is None else keyed.dropDuplicatesWithinWatermark([key])).unionByName(submissions.where(keyless))


class LeaseTimers(StatefulProcessor):
    """Per job: a lease starts or extends a timer, an answer ends it, and its end reports an expiry.

    Input rows (job_id, us, op, token); output (job_id, token, expired_us)."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "token bigint, deadline_us bigint")

    def _drop(self) -> None:
        if self.lease.exists():
            self.handle.deleteTimer(-(-self.lease.get()[1] // 1000))
            self.lease.clear()

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        ended = []
        for op, us, token in sorted(((r.op, r.us, r.token) for frame in rows for r in frame.itertuples()), key=lambda r: r[1]):
            held, deadline = self.lease.get() if self.lease.exists() else (None, None)
            if held is not None and deadline <= us:  # its time came between two rows of one batch
                ended.append((key[0], held, deadline))
                self._drop()
                held = None
            if op == "lease" or op == "hb" and held == token:
                self._drop()
                deadline = int(us) + self.ttl_ms * 1000
                self.lease.update((int(token), deadline))
                self.handle.registerTimer(-(-deadline // 1000))  # timers count milliseconds
            elif op in ("ok", "fail") and held == token:
                self._drop()
        yield pd.DataFrame(ended, columns=["job_id", "token", "expired_us"]).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        if self.lease.exists():
            token, deadline = self.lease.get()
            self.lease.clear()
            yield pd.DataFrame({"job_id": [key[0]], "token": [token], "expired_us": [deadline]})

    def close(self) -> None:
        pass


def lease_expiries(commands: DataFrame, ttl_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """Streaming expiries of leases by event time; needs the RocksDB state store."""
    rows = commands.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    return rows.groupBy("job_id").transformWithStateInPandas(LeaseTimers(ttl_ms), "job_id long, token long, expired_us long", "Append", "EventTime")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


class JobFold(StatefulProcessor):
    """Per job: its state is kept by the state store, so a batch reads and writes the jobs it touches only."""

    def __init__(self, max_attempts: int, ttl_us: int):
        self.max_attempts, self.ttl_us = max_attempts, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        at, last = State(*self.held.get()) if self.held.exists() else State(), 0
        for last, us, op, stale in sorted((int(r.lsn), int(r.us), r.op, bool(r.stale)) for frame in rows for r in frame.itertuples()):
            at.apply(us, op, stale, self.max_attempts, self.ttl_us)
        self.held.update(at.row())
        yield pd.DataFrame([(key[0], last, *at.row())], columns=["job_id", "lsn", *[f.split()[0] for f in STATE.split(", ")]])

    def close(self) -> None:
        pass


class KeyedLedger:
    """Folds a stream of commands with each job's state in the state store, and a changelog as output.

    A batch appends one row for each job it touches to the changelog (the sink's log makes that exactly
    once); the current state is each job's last row there.  `LedgerStream` rewrites all jobs instead and
    needs no state store."""

    def __init__(self, spark: SparkSession, folder: str, max_attempts: int = MAX_ATTEMPTS, ttl_us: int = TTL_US):
        self.spark, self.folder, self.limits = spark, folder.rstrip("/"), (max_attempts, ttl_us)

    def _start(self, commands: DataFrame, **trigger):
        changes = commands.select("job_id", "lsn", "us", "op", "stale").groupBy("job_id").transformWithStateInPandas(JobFold(*self.limits), f"job_id bigint, lsn bigint, {STATE}", "Append", "None")
        with rocksdb(self.spark):
            return changes.writeStream.format("parquet").option("path", f"{self.folder}/changes").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**trigger).start()

    def start(self, commands: DataFrame, every: str = "100 milliseconds"):
        """Fold what arrives, batch by batch, until the query is stopped."""
        return self._start(commands, processingTime=every)

    def run(self, commands: DataFrame) -> DataFrame:
        """Take in everything that is there, then give the current state."""
        self._start(commands, availableNow=True).awaitTermination()
        return self.state()

    def state(self) -> DataFrame:
        names = [f.split()[0] for f in STATE.split(", ")]
        log = self.spark.read.schema(f"job_id bigint, lsn bigint, {STATE}").parquet(f"{self.folder}/changes")
        return log.groupBy("job_id").agg(F.max_by(F.struct(*names), "lsn").alias("s")).select("job_id", "s.*")


def run_lease_expiries(spark: SparkSession, commands: DataFrame, folder: str, ttl_ms: int) -> DataFrame:
    """All expiries of the given commands up to their last moment, by a stream over them as files below `folder`."""
    commands.write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(commands.schema).parquet(f"{folder}/in")
    with rocksdb(spark):
        query = lease_expiries(arriving, ttl_ms).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("job_id long, token long, expired_us long").parquet(f"{folder}/out")
