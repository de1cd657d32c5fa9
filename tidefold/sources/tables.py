"""Tables that are one Parquet file or a folder of them, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the files of a table; a source of a single file is its folder with a filter on the name."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(path)
