"""Segments and snapshots: ranges, what a replay may skip, what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_ranges(records: DataFrame, segment: Column) -> DataFrame:
    return records.groupBy(segment.alias("segment")).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count("*").alias("records"))


def replay_plan(segments: DataFrame, from_lsn: int, watermark: int) -> DataFrame:
    """Adds skip (a replay from from_lsn needn't read it) and drop (sealed and wholly before the watermark)."""
    newest = Window.orderBy(F.desc("segment"))  # a row per segment
    active = F.row_number().over(newest) == 1
    return segments.withColumns({"skip": (F.col("last_lsn") > 0) & (F.col("last_lsn") < from_lsn), "drop": ~active & (F.col("last_lsn") < watermark)})


def replay(records: DataFrame, from_lsn: int) -> DataFrame:
    """Records from an LSN on; the bound reaches the scan."""
    return records.where(F.col("lsn") >= from_lsn)


def positions(records: DataFrame) -> DataFrame:
    """One row: how many records there are, the first and last LSN, and the next one (1 for an empty log)."""
    last = F.max("lsn")
    return records.agg(F.count("*").alias("records"), F.min("lsn").alias("first_lsn"), last.alias("last_lsn"), (F.coalesce(last, F.lit(0)) + 1).alias("next_lsn"))


def prune_snapshots(snapshots: DataFrame, keep: int = 2) -> DataFrame:
    """Adds kept: the newest `keep` by LSN, whatever the names' order."""
    return snapshots.withColumn("kept", F.row_number().over(Window.orderBy(F.desc("snapshot_lsn"))) <= keep)


def since_snapshot(records: DataFrame, snapshot_lsn: int, every: int) -> DataFrame:
    """Records behind a snapshot, and whether the next one is due."""
    n = F.count(F.when(F.col("lsn") > snapshot_lsn, True))
    return records.agg(n.alias("mutations"), (n >= every).alias("snapshot_due"))


def assign_lsn(arrivals: DataFrame, order: str, base: int) -> DataFrame:
    """Dense LSNs from base + 1 in arrival order.

    Rows fall into ranges of `order` (a number without repeats) by quantiles of all rows and are
    numbered inside each; the ranges' counts, one row each, give their offsets.  So no single task
    numbers all rows."""
    n = max(int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = sorted(set(arrivals.approxQuantile(order, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []

    def part(low: int, high: int) -> Column:
        """The number of bounds below the row, known to be from low to high: a tree of comparisons."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(order) <= bounds[middle], part(low, middle)).otherwise(part(middle + 1, high))

    rows = arrivals.withColumn("_part", part(0, len(bounds)))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return numbered.join(F.broadcast(offsets), "_part").withColumn("lsn", F.lit(base) + F.col("_before") + F.col("_k")).drop("_part", "_before", "_k")
