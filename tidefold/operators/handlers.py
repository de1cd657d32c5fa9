"""Handlers: outcomes of job runs, a registry of functions, and the effects of the sample handlers."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_HANDLER = "no handler registered"


class PermanentError(Exception):
    """A failure that no retry can mend."""


class Registry:
    """Functions by job type; the last registration of a type counts."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable[[dict], None]] = {}

    def register(self, job_type: str, function: Callable[[dict], None]) -> None:
        self.functions[job_type] = function

    def run_one(self, job: dict) -> tuple[bool, bool, str]:
        """(success, retryable, error) of one job.

        A raised PermanentError is final, any OSError or ValueError is an error to retry, and
        everything else counts as a crash, which is retried as well."""
        function = self.functions.get(job["type"])
        if function is None:
            return False, False, NO_HANDLER
        try:
            function(job)
        except PermanentError as e:
            return False, False, str(e)
        except (OSError, ValueError) as e:
            return False, True, str(e)
        except Exception as e:
            return False, True, f"handler panic: {e}"
        return True, False, ""

    def run(self, jobs: DataFrame) -> DataFrame:
        """Adds the outcome of each job (columns type, payload and what functions read); a narrow pass."""
        functions = dict(self.functions)

        def work(batches):
            import pyarrow as pa

            registry = Registry()
            registry.functions = functions
            for batch in batches:
                outcomes = [registry.run_one(job) for job in batch.to_pylist()]
                columns = list(zip(*outcomes, strict=True)) or [(), (), ()]
                new = [pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "success", "retryable", "error"])

        schema = T.StructType([*jobs.schema, T.StructField("success", T.BooleanType()), T.StructField("retryable", T.BooleanType()), T.StructField("error", T.StringType())])
        return jobs.mapInArrow(work, schema)


def payload(job: dict) -> dict:
    """A job's JSON payload; unreadable ones are final failures."""
    try:
        out = json.loads(job["payload"])
    except (TypeError, ValueError) as e:
        raise PermanentError(f"permanent: invalid payload: {e}") from e
    if not isinstance(out, dict):
        raise PermanentError("permanent: invalid payload")
    return out


def without_handler(jobs: DataFrame, types: list[str]) -> DataFrame:
    return jobs.where(~F.col("type").isin(*types))


def outcome(flag: Column, registered: Column) -> Column:
    """The outcome of an attempt with result flag N (fine), A (failed for now) or R (failed for good)."""
    text = F.when(~registered, NO_HANDLER).when(flag == "A", "retryable failure").when(flag == "R", "permanent failure").otherwise("")
    return F.struct((registered & (flag == "N")).alias("success"), (registered & (flag == "A")).alias("retryable"), text.alias("error"))


def completion(success: Column, retryable: Column, attempt: Column, max_attempts: Column, cancel_req: Column) -> Column:
    """(record, state) that a report on a leased job leads to; a failure without retry ends dead even if a cancel was asked for."""
    again = ~success & retryable & (attempt < max_attempts)
    record = F.when(success, "complete").when(again, "retry").otherwise("dead")
    state = F.when(success, F.when(cancel_req, "cancelled").otherwise("succeeded")).when(again, F.when(cancel_req, "cancelled").otherwise("pending")).otherwise("dead")
    return F.struct(record.alias("record"), state.alias("state"))


def heartbeat_interval_ms(lease_ms: Column) -> Column:
    return F.greatest(F.floor(lease_ms / 3), F.lit(500)).cast("long")


def emails_sent(attempts: DataFrame) -> DataFrame:
    """Per order: 1 if any attempt succeeded; repeats send nothing."""
    return attempts.groupBy("order_id").agg(F.max(F.col("success").cast("int")).alias("sent"), F.count("*").alias("attempts"))


def stock_left(attempts: DataFrame, initial: int) -> DataFrame:
    """Per sku what successful reservations left of `initial`, by sums that are partly taken before the shuffle."""
    qty = F.sum(F.when(F.col("success"), F.col("qty")).otherwise(0)).cast("long")
    return attempts.groupBy("sku").agg((F.lit(initial) - qty).alias("stock"), qty.alias("reserved"))


def reserved_by_order(attempts: DataFrame) -> DataFrame:
    return attempts.where("success").groupBy("order_id").agg(F.sum("qty").cast("long").alias("reserved"))


def reservations_in_order(attempts: DataFrame, initial: int, order: list[str], folder: str) -> DataFrame:
    """Attempts with what came of them (`verdict`) when they arrive in the given order over all skus.

    An attempt is skipped where its order has one with the same or a higher token applied, whatever the
    sku; it fails for good where its sku's stock is short.  So each decision depends on earlier ones of its
    order and of its sku.  A round settles what follows from what is settled: by order which open attempts
    are skipped and which can't be, then by sku which of the latter the stock suffices for, whatever becomes of open
    ones before them.  After k rounds the first k decisions of any chain are settled, as is most else, so the
    result is that of deciding one by one.  Only open attempts go on to the next round, with the highest
    token and the quantity applied before them, and once those just applied that attempts of their order wait for.
    Rounds are parts of one table below `folder`; ties of `order` go by order_id, sku, token and qty."""
    spark, table, turn = attempts.sparkSession, f"{folder}/rounds", 0
    token, total = attempts.schema["token"].dataType, attempts.agg(F.sum("qty").alias("spent")).schema["spent"].dataType
    more = {"verdict": T.StringType(), "place": T.IntegerType(), "floor": token, "spent": total, "part": T.StringType()}
    schema = T.StructType([*attempts.schema, *(T.StructField(n, t) for n, t in more.items())])
    rows = attempts.withColumns({"verdict": F.lit(None).cast("string"), "floor": F.lit(None).cast(token), "spent": F.lit(0).cast(total)})
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("order_id").orderBy(*order, "sku", "token", "qty")))
    while True:
        path = f"{table}/round={turn}"
        by_sku = _by_order(rows).repartition("sku").sortWithinPartitions("sku", *order, "order_id", "place")
        by_sku.mapInArrow(_by_sku(initial, schema), schema).write.partitionBy("part").parquet(path)
        if turn:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/round={turn - 1}/part=open")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        rows = spark.read.schema(schema).parquet(path).where(F.col("part") != "settled")
        if rows.where(F.col("part") == "open").isEmpty():
            return spark.read.schema(schema).parquet(table).where(F.col("part") != "open").select(*attempts.columns, "verdict")
        rows, turn = rows.drop("part"), turn + 1


def _by_order(rows: DataFrame) -> DataFrame:
    """Open attempts: skipped ones, else the highest token applied before them (`floor`), whether they can't be
    skipped (`free`), and whether open ones that can be may wait for them (`awaited`)."""
    order = Window.partitionBy("order_id")
    before = order.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    token, is_open = F.col("token"), F.col("verdict").isNull()
    highest = lambda which: F.max(F.when(which, token)).over(before)
    rows = rows.withColumns({"floor": F.greatest("floor", highest(~is_open)), "ceiling": highest(is_open)})
    skipped, free = F.coalesce(token <= F.col("floor"), F.lit(False)), F.coalesce(token > F.greatest("floor", "ceiling"), F.lit(True))
    rows = rows.withColumn("free", free).withColumn("after", F.when(is_open & skipped, "skipped").otherwise(F.col("verdict")))
    waits = F.min(F.when(F.col("after").isNull() & ~F.col("free"), token)).over(order)
    rows = rows.withColumn("awaited", F.coalesce(token >= waits, F.lit(False))).where(is_open)
    return rows.drop("ceiling", "verdict").withColumnRenamed("after", "verdict")


def _by_sku(initial: int, schema: T.StructType) -> Callable:
    """A pass over attempts sorted by sku and arrival that holds one sku's bounds."""

    def run(batches):
        import pyarrow as pa

        sku, known = None, False
        for batch in batches:
            verdicts, spents, parts = [], [], []
            for s, qty, verdict, spent, free, awaited in zip(*[batch.column(n).to_pylist() for n in ("sku", "qty", "verdict", "spent", "free", "awaited")], strict=True):
                if s != sku or not known:
                    sku, known, applied, low, high = s, True, 0, 0, 0  # applied in this pass; the least and most that open ones may add
                if verdict is None:
                    left, spent = initial - spent - applied, spent + applied
                    if free and (qty is None or left - high >= qty):
                        verdict, applied = "applied", applied + (qty or 0)
                    elif qty is not None and left - low < qty:
                        verdict = "insufficient stock" if free else None  # not applied in any case
                    else:
                        low, high = low + min(qty or 0, 0), high + max(qty or 0, 0)
                verdicts.append(verdict)
                spents.append(spent if verdict is None else None)
                parts.append("open" if verdict is None else "awaited" if awaited and verdict == "applied" else "settled")
            new = {"verdict": pa.array(verdicts, pa.string()), "spent": pa.array(spents, batch.column("spent").type), "part": pa.array(parts, pa.string())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in schema.names], names=schema.names)

    return run


def first_capture(attempts: DataFrame, order: list[str]) -> DataFrame:
    """Per idempotency key the amount of its first successful capture."""
    first = F.min_by("amount_cents", F.struct(*order))
    return attempts.where("success").groupBy("pay_key").agg(first.alias("amount_cents"), F.count("*").alias("captures"))


def counters(attempts: DataFrame) -> DataFrame:
    """One row: successful runs, and orders with an invoice."""
    ok = F.col("success")
    return attempts.agg(F.count(F.when(ok, True)).alias("synced"), F.count(F.when(ok & (F.col("qty") > 25), True)).alias("indexed"), F.count_distinct(F.when(ok, F.col("order_id"))).alias("invoiced"))
