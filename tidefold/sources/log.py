"""Binary segments as a Spark source and sink.

    replay(spark, folder, from_lsn=n)                        # one partition per segment
    write_segments(records, folder)                          # records with LSNs, see retention.assign_lsn
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidefold.schema import RECORD
from tidefold.sources import codec, files

SEGMENT_RECORDS = 250_000


class Segment(InputPartition):
    def __init__(self, path: str, last: bool):
        super().__init__(path)
        self.path, self.last = path, last


class LogReader(DataSourceReader):
    """Segments in LSN order; the bounds leave out whole segments by their names, and then single records.

    Bounds are options and not pushed filters: a relation keeps its reader, so a filter pushed by one
    query of a DataFrame would also hold for the next one."""

    def __init__(self, folder: str, low: int = 0, high: int | None = None):
        self.folder, self.low, self.high = folder, low, high

    def partitions(self) -> list[Segment]:
        found = sorted((lsn, name) for name in files.listing(self.folder) if (lsn := codec.segment_lsn(name)) is not None)
        out = []
        for i, (lsn, name) in enumerate(found):
            ends = found[i + 1][0] - 1 if i + 1 < len(found) else None
            if (ends is None or ends >= self.low) and (self.high is None or lsn <= self.high):
                out.append(Segment(f"{self.folder}/{name}", i + 1 == len(found)))
        return out

    def read(self, partition: Segment) -> Iterator:
        import pyarrow.compute as pc

        from tidefold.sources import columnar

        records, _ = columnar.read_segment(files.read_bytes(partition.path), partition.last)
        lsn = records.column("lsn")
        inside = pc.and_(pc.greater_equal(lsn, self.low), pc.less_equal(lsn, self.high if self.high is not None else (1 << 63) - 1))
        records = records.filter(inside)
        for at in range(0, records.num_rows, 10_000):
            yield records.slice(at, 10_000)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_log"

    def schema(self):
        return RECORD

    def reader(self, schema) -> LogReader:
        high = self.options.get("to_lsn")
        return LogReader(self.options["path"].rstrip("/"), int(self.options.get("from_lsn", 0)), int(high) if high else None)


def replay(spark: SparkSession, folder: str, from_lsn: int = 0, to_lsn: int | None = None) -> DataFrame:
    """Records from an LSN on, in a DataFrame; segments wholly outside the bounds aren't opened."""
    spark.dataSource.register(LogSource)
    reader = spark.read.format("ledger_log").option("from_lsn", from_lsn)
    return (reader if to_lsn is None else reader.option("to_lsn", to_lsn)).load(folder)


def next_lsn(folder: str) -> int:
    """One past the last valid record; 1 for an empty log."""
    names = [n for n in files.listing(folder) if codec.segment_lsn(n) is not None]
    if not names:
        return 1
    records, _ = codec.read_segment(files.read_bytes(f"{folder}/{names[-1]}"), True)
    return records[-1]["lsn"] + 1 if records else codec.segment_lsn(names[-1])


def write_segments(records: DataFrame, folder: str, per_segment: int = SEGMENT_RECORDS) -> DataFrame:
    """Write records (RECORD, with LSNs) as segments of `per_segment` LSNs; a row (first_lsn, records, bytes) each.

    A segment is one group of rows by lsn, so its size is bounded and a task that runs again writes
    the same file under the same name."""

    def run(key, group):
        import pyarrow as pa

        from tidefold.sources import columnar

        batch = group.drop_columns(["segment"]).sort_by("lsn").combine_chunks().cast(columnar.RECORD_TYPE).to_batches()[0]
        data = codec.segment_header() + columnar.encode(batch)[0]
        first = batch.column("lsn")[0].as_py()
        files.write_bytes(f"{folder}/{codec.segment_name(first)}", data)
        return pa.table({"first_lsn": pa.array([first], pa.int64()), "records": pa.array([batch.num_rows], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    keyed = records.withColumn("segment", F.floor((F.col("lsn") - 1) / per_segment))
    return keyed.groupBy("segment").applyInArrow(run, "first_lsn long, records long, bytes long")


def truncate(folder: str, watermark: int) -> list[str]:
    """Delete sealed segments that end before the watermark; the newest always stays."""
    names = [n for n in files.listing(folder) if codec.segment_lsn(n) is not None]
    gone = [n for n, after in zip(names, names[1:], strict=False) if codec.segment_lsn(after) - 1 < watermark]
    for n in gone:
        files.remove(f"{folder}/{n}")
    return gone
