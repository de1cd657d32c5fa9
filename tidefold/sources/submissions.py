"""Job submissions as JSON lines, in files or as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.requests import submissions


def read(spark: SparkSession, path: str, now_us: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) submissions; rejected ones with their body and the reason."""
    return split(submissions(spark.read.text(path).withColumnRenamed("value", "body"), now_us=now_us))


def stream(spark: SparkSession, path: str, now_us: int, files_per_batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """The same over files as they arrive; the source's rate limit stands for back pressure."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "body")
    return split(submissions(lines, now_us=now_us))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("error").isNull()
    return rows.where(ok).drop("error", "body"), rows.where(~ok).select("body", "error")
