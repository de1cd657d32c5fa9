"""Shared helpers: the cluster's shared folder, materialised tables, portable binary files."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_made: list[tuple[SparkSession, str]] = []  # folders of this process that may still be there


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in spark.checkpoint.dir.

    Only where the setting is absent and Spark runs in one process (unit tests, a laptop) a temporary
    folder is made and removed again at exit.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidefold-")
        atexit.register(shutil.rmtree, where[len("file://"):], True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's name; `tidy`, `remove` or the end of the driver removes the folder."""
    path = f"{shared_dir(spark)}/tidefold-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, paths) -> None:
    gone = set(paths)
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made[:] = [m for m in _made if m[1] not in gone]


@atexit.register
def _remove_all() -> None:
    for spark, path in list(_made):
        try:
            remove(spark, [path])
        except Exception:  # the session is gone; a folder on the cluster is left to its owner's clean-up
            return


def tidy(function):
    """Removes the folders that `function` made: all if it fails, else all that its result no longer reads.

    What the result reads stays until the driver ends, or until `remove`.  Folders of binary files are in no
    plan; those that the result's `_folders` names stay too.
    """

    @functools.wraps(function)
    def run(*args, **named):
        before = {path for _, path in _made}
        made = lambda: [(spark, path) for spark, path in _made if path not in before]
        try:
            out = function(*args, **named)
        except BaseException:
            for spark, path in made():
                remove(spark, [path])
            raise
        read = {part for f in out.inputFiles() for part in f.split("/") if part.startswith("tidefold-")} | set(getattr(out, "_folders", ()))
        for spark, path in made():
            if path.rpartition("/")[2] not in read:
                remove(spark, [path])
        return out

    return run


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def written(spark: SparkSession, name: str, make) -> DataFrame:
    """What `make()` returns, as a table of its own; folders that came up on the way are removed, on failure all."""
    before, path, done = {p for _, p in _made}, fresh_path(spark, name), False
    try:
        make().write.parquet(path)
        done = True
    finally:
        remove(spark, [p for _, p in _made if p not in before and not (done and p == path)])
    out = spark.read.parquet(path)
    out._path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove the folders of tables from `materialize` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, [table._path])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI, for executors that read or write binary files."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    return files.open_output_stream(path, compression=None)


def read_range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)


def open_input(uri: str):
    files, path = filesystem(uri)
    return files.open_input_file(path)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches bounded by bytes as well: 10,000 rows of text may be any size."""
    spark = df.sparkSession
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(4 << 20))
    return df.mapInArrow(function, schema)


def row_slices(batch, most_bytes: int = 4 << 20, column: str = "text"):
    """Parts of an Arrow batch whose texts stay near `most_bytes`; a single long text is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - 1) // most_bytes
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether `df` has at most `most_rows` rows; stops reading beyond that."""
    return df.limit(most_rows + 1).count() <= most_rows


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of `df`, those with the smallest hash of `key`; of equal ones those with the smallest hash of all columns.

    The bounds are found on hashes alone, so no task sends wide rows to be compared.  Whatever the keys,
    the same rows come out on every run: only among rows that are equal in all columns is the choice open.
    """
    h = F.xxhash64(key)

    def bound(column: Column, rows: DataFrame, n: int):
        return rows.select(column.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]

    last = bound(h, df, most) if most > 0 else None
    if last is None:
        return df.limit(0)
    n = df.where(h <= last).select(F.lit(1)).limit(most + 1).count()
    if n <= most:
        return df.where(h <= last)
    tie, sure = F.xxhash64(*df.columns), df.where(h < last)
    left = most - sure.count()
    cut = bound(tie, df.where(h == last), left)
    more = df.where((h == last) & (tie < cut))
    return sure.unionByName(more).unionByName(df.where((h == last) & (tie == cut)).limit(left - more.count()))
