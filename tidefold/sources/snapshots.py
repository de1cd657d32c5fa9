"""Snapshots of current jobs: one binary file each, or a versioned Parquet folder for large ledgers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from tidefold.schema import JOB
from tidefold.sources import codec, files


def save(jobs: list[dict], folder: str, lsn: int, keep: int = 2) -> None:
    """Write one snapshot file and delete all but the newest `keep`."""
    files.write_bytes(f"{folder}/{codec.snapshot_name(lsn)}", codec.encode_snapshot(jobs, lsn))
    for name in names(folder)[keep:]:
        files.remove(f"{folder}/{name}")


def names(folder: str) -> list[str]:
    """Snapshot files, newest first."""
    return sorted((n for n in files.listing(folder) if codec.snapshot_lsn(n) is not None), reverse=True)


def load_newest(folder: str) -> tuple[list[dict], int]:
    """(jobs, lsn) of the newest snapshot that is whole; none and 0 if there is none."""
    jobs, lsn = newest(folder)
    return list(jobs), lsn


def newest(folder: str) -> tuple[Iterator[dict], int]:
    """The same with jobs decoded as they are asked for."""
    for name in names(folder):
        try:
            return codec.snapshot_jobs(files.read_bytes(f"{folder}/{name}"))
        except codec.Corrupt:
            continue
    return iter(()), 0


def as_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of the newest whole snapshot, decoded on an executor."""

    def run(_):
        import pyarrow as pa

        jobs, _ = newest(folder)
        kinds = {"string": pa.string(), "binary": pa.binary(), "integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
        while some := list(islice(jobs, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([j[f.name] for j in some], kinds[f.dataType.typeName()]) for f in JOB], names=JOB.names)

    return spark.range(1).coalesce(1).mapInArrow(run, JOB)


def save_table(state: DataFrame, folder: str, lsn: int) -> str:
    """Write state as a Parquet folder of its own; Spark's _SUCCESS marks it as whole."""
    path = f"{folder.rstrip('/')}/snapshot_lsn={lsn:020d}"
    state.write.mode("overwrite").parquet(path)
    return path


def newest_table(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int]:
    """(state, lsn) of the newest whole Parquet snapshot."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None, 0
    found = [s.getPath() for s in system.listStatus(path) if s.getPath().getName().startswith("snapshot_lsn=")]
    whole = [p for p in found if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not whole:
        return None, 0
    newest = max(whole, key=lambda p: p.getName())
    return spark.read.parquet(newest.toString()), int(newest.getName().split("=")[1])


def prune_tables(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete all but the newest `keep` Parquet snapshots."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath() for s in system.listStatus(path) if s.getPath().getName().startswith("snapshot_lsn=")), key=lambda p: p.getName(), reverse=True)
    for p in found[keep:]:
        system.delete(p, True)
