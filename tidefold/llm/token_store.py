"""Token-id files: every document a zstandard frame of its own, compressed with one shared dictionary.

File layout (all integers little-endian):
  magic "TFTOK02\n" | version u32 | bytes per id u32 | sha256 of the dictionary (32 bytes)
  frames, one per document, in ascending doc_id order
  index: per document 5 x i64: doc_id, ids before it in this file, ids, file offset, frame bytes
  footer: documents u64 | those without doc_id (they come first) u64 | index offset u64 | crc32 of the index u32 | magic
The dictionary lies beside the files as `dictionary.zstd`; a reader refuses another one by its
hash.  With the index a short document is one ranged read.

Texts are tokenized and compressed in one narrow pass; only the frames are sorted by doc_id.  The
dictionary is trained before that, on `SAMPLE_PIECES` pieces of `PIECE` bytes, drawn by hash from the whole of `SAMPLE_DOCS`
documents, those with the smallest hash of doc_id.

Defined results: null text is empty, a document of the end id only; repeated doc_ids are kept as
documents of their own, ordered by a hash of their texts among each other; null doc_id sorts first; an
empty table gives no files and no rows; very long texts are frames like any other; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm import token_chunks
from tidefold.llm.common import fresh_path, hash_sample, map_arrow, materialize, open_input, open_output, read_range, release, row_slices, text_or_empty, tidy

MAGIC = b"TFTOK02\n"
HEAD = "<8sII32s"
FOOT = "<QQQI8s"
HEAD_BYTES, FOOT_BYTES = struct.calcsize(HEAD), struct.calcsize(FOOT)
SAMPLE_DOCS = 400
DICTIONARY_BYTES = 64 << 10
PIECE = 4096
SAMPLE_PIECES = 2000


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, dictionary: bytes | None = None) -> DataFrame:
    """doc_id, text_hash, salt (the row's number in its task), n_ids with the end id, and the ids, `width` bytes each; as frames if there is a dictionary.  One narrow pass over the text."""
    shared = None if dictionary is None else docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        import pyarrow as pa

        encoder, end, row = token_chunks.load(tokenizer_path), struct.pack("<I", end_id), 0
        pack = (lambda x: x) if shared is None else codec(shared.value)[0].compress
        for whole in batches:
            for batch in row_slices(whole):
                ids = [narrow(raw + end, width) for raw in encoder.encode(batch.column("text").to_pylist())]
                salt = range(row, row + len(ids))
                row += len(ids)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(salt, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(map(pack, ids), pa.binary())], names=["doc_id", "text_hash", "salt", "n_ids", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(rows, run, "doc_id long, text_hash long, salt long, n_ids long, ids binary")


def train_dictionary(rows: DataFrame, pieces: int = SAMPLE_PIECES, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from at most `pieces` pieces of the ids of some rows (doc_id, ids).

    Empty (plain zstandard) if the sample is too small to train on.
    """
    import zstandard

    cuts = rows.select("doc_id", "ids", F.posexplode(F.expr(f"sequence(1, greatest(octet_length(ids), 1), {PIECE})")).alias("k", "at"))
    cuts = cuts.select("doc_id", "k", F.expr(f"substring(ids, at, {PIECE})").alias("piece"))
    found = cuts.orderBy(F.xxhash64("doc_id", "k", "piece")).limit(pieces).select("piece").toArrow()
    try:
        return zstandard.train_dictionary(size, found.column("piece").to_pylist()).as_bytes()
    except zstandard.ZstdError:
        return b""


def narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def widen(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def codec(dictionary: bytes, level: int = 1):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if d:
        d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False), zstandard.ZstdDecompressor(dict_data=d)


class StoreFile:
    """Reader of one file: the offset index, and single documents by ranged reads."""

    def __init__(self, path: str, dictionary: bytes):
        self.handle = open_input(path)
        size = self.handle.size()
        magic, _, self.width, found = struct.unpack(HEAD, read_range(self.handle, 0, HEAD_BYTES))
        n, self.nulls, at, crc, end = struct.unpack(FOOT, read_range(self.handle, size - FOOT_BYTES, FOOT_BYTES))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is no token file")
        if found != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        raw = read_range(self.handle, at, n * 40)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"the index of {path} is damaged")
        self.index = np.frombuffer(raw, dtype="<i8").reshape(n, 5)
        self.unpack = codec(dictionary)[1].decompress

    def ids_at(self, row: int) -> bytes:
        offset, length = self.index[row, 3:5].tolist()
        return widen(self.unpack(read_range(self.handle, offset, length)), self.width)

    def find(self, doc_id: int) -> list[int]:
        """Rows of the index that hold `doc_id`."""
        column = self.index[self.nulls:, 0]
        return list(range(self.nulls + int(np.searchsorted(column, doc_id, "left")), self.nulls + int(np.searchsorted(column, doc_id, "right"))))


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Write `docs` (doc_id, text) as token files below `folder`; the manifest: part, path, n_docs, n_ids.

    Rows are range-partitioned by doc_id, so files follow each other in doc_id order.  Each task
    attempt writes a file of its own name and only attempts in the manifest count, so a lost
    executor's task is simply run again.
    """
    spark = docs.sparkSession
    width = 2 if max(len(token_chunks.load(tokenizer_path).begins), end_id + 1) <= 1 << 16 else 4
    sample = hash_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), "doc_id", SAMPLE_DOCS)
    dictionary = train_dictionary(encoded(sample, tokenizer_path, end_id, width))
    with open_output(f"{folder}/dictionary.zstd") as f:
        f.write(dictionary)
    ids = materialize(encoded(docs, tokenizer_path, end_id, width, dictionary), "frames")
    shared = spark.sparkContext.broadcast(dictionary)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["doc_id", "text_hash", "salt"]  # the latter two for rows that repeat a doc_id: they may be many
    rows = ids.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "n_ids", "ids")

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path, out, index, at, before, nulls = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok", None, [], HEAD_BYTES, 0, 0
        for batch in batches:
            if batch.num_rows and out is None:
                out = open_output(path)
                out.write(struct.pack(HEAD, MAGIC, 1, width, hashlib.sha256(shared.value).digest()))
            for doc, n_ids, frame in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out.write(frame)
                nulls += doc is None
                index.append((doc or 0, before, n_ids, at, len(frame)))
                at += len(frame)
                before += n_ids
        if out is not None:
            raw = np.array(index, dtype="<i8").tobytes()
            out.write(raw + struct.pack(FOOT, len(index), nulls, at, zlib.crc32(raw), MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [path], "n_docs": pa.array([len(index)], pa.int64()), "n_ids": pa.array([before], pa.int64())})

    manifest = materialize(map_arrow(rows, run, "part long, path string, n_docs long, n_ids long"), "tokens-manifest")
    release(ids)
    return manifest


def read(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        import pyarrow as pa

        with open_input(f"{folder}/dictionary.zstd") as f:
            dictionary = f.read()
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store = StoreFile(path, dictionary)
                for a in range(0, len(store.index), 2000):
                    part = store.index[a:a + 2000]
                    ids = [store.ids_at(a + i) for i in range(len(part))]
                    columns = [
                        pa.array(part[:, 0], pa.int64(), mask=np.arange(a, a + len(part)) < store.nulls),
                        pa.array(part[:, 1] + base, pa.int64()),
                        pa.array(part[:, 2], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([np.frombuffer(x, dtype="<i4").tolist() for x in ids], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                store.handle.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_arrow(files.repartition(spread, "path"), run, schema)


@tidy
def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all of `docs` to a new folder in the shared storage and read the files back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    out = read(write(docs, tokenizer_path, folder), folder)
    out._folders = {folder.rpartition("/")[2]}
    return out
