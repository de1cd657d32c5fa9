"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

A document's ids (with its end id) are cut only if they are more than a sequence; the pieces are
whole sequences but for the first.  A piece is placed into the open sequence for which the sum,
over the residual gaps, of the squared number of open sequences with that gap comes out
smallest; a new sequence is opened only where none has room.  Pieces are placed longest first,
which for this rule comes within a few sequences of the lower bound.

The rule looks at lengths alone, and a few thousand pieces already pack to within about 0.1 %.
So pieces are dealt by hash into shards of about `shard_pieces`, whose number grows with the
corpus, and each shard is packed by itself.  The hash takes in a number of the row's own, so
repeated rows are spread like any others.  Whole sequences need no placing: they take part in no
shard, so a corpus of books is no load for one task.

Defined results: null text is empty, one end id; repeated rows and null doc_ids are documents of
their own; very long texts become as many pieces as they need; ties of length are placed in order
of doc_id, piece and crc32; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm import token_chunks
from tidefold.llm.common import map_arrow, materialize, row_slices, text_or_empty, tidy

SEQUENCE = 1024
SHARD_PIECES = 8192


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` tokens."""
    first = total % capacity or capacity
    return [(0, min(first, total)), *((s, capacity) for s in range(first, total, capacity))]


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces with these lengths (1 to capacity), placed in the order given."""
    open_with = np.zeros(capacity + 1, dtype=np.int64)  # sequences by residual gap; a gap of 0 isn't open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, used = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        here = open_with[size:capacity]  # of gap size + k, for k = 0 ...
        if here.any():
            change = 2 * (open_with[:capacity - size] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = np.iinfo(np.int64).max
            left = int(change.argmin())
            at = stacks[size + left].pop()
            open_with[size + left] -= 1
            offset[i] = capacity - size - left
        else:
            at, used, left, offset[i] = used, used + 1, capacity - size, 0
        if left:
            open_with[left] += 1
            stacks[left].append(at)
        sequence[i] = at
    return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = SEQUENCE) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and salt, the row's number in its task; one narrow pass over the text."""

    def run(batches):
        import pyarrow as pa

        encoder, end, row = token_chunks.load(tokenizer_path), struct.pack("<I", end_id), 0
        for whole in batches:
            for batch in row_slices(whole):
                rows = []
                for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                    ids = raw + end
                    row += 1
                    rows += [(doc, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]), row) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                doc, k, s, n, crc, salt = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


@tidy
def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece of every document with its sequence_id and offset there."""
    rows = materialize(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    full, part = rows.where(F.col("length") == capacity), rows.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_pieces))
    part = part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(shards))).drop("salt")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}).select(columns)

    def run(key, group):
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = place(group["length"].to_numpy(), capacity)
        group["sequence_id"] = sequence + (int(key[0]) << 32)
        group["offset"] = offset
        return group.drop(columns="shard")

    packed = part.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(alone)
