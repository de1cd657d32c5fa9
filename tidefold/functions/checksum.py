"""CRC-32C (Castagnoli) of binary columns; Spark's own crc32 is the IEEE polynomial."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL = 0x82F63B78  # reflected


@functools.lru_cache(maxsize=1)
def tables() -> list[list[int]]:
    """tables()[k][b]: the checksum state that byte b leaves k bytes later."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), first >> np.uint32(1))
    out = [first]
    for _ in range(7):
        out.append((out[-1] >> np.uint32(8)) ^ first[out[-1] & np.uint32(255)])
    return [t.tolist() for t in out]


def crc32c(data: bytes, start: int = 0) -> int:
    t = tables()
    crc = start ^ 0xFFFFFFFF
    whole = len(data) & ~7
    for i in range(0, whole, 8):  # eight bytes a step
        x = int.from_bytes(data[i:i + 8], "little") ^ crc
        crc = t[7][x & 255] ^ t[6][x >> 8 & 255] ^ t[5][x >> 16 & 255] ^ t[4][x >> 24 & 255] ^ t[3][x >> 32 & 255] ^ t[2][x >> 40 & 255] ^ t[1][x >> 48 & 255] ^ t[0][x >> 56]
    for b in data[whole:]:
        crc = crc >> 8 ^ t[0][(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def crc32c_of_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of many slices of one byte array at once: slices take their steps of eight bytes together, the longest are last to end."""
    t = np.array(tables(), dtype=np.uint32)
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order].astype(np.int64), lengths[order].astype(np.int64)
    crc = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    n = int(np.searchsorted(-left, -8, side="right"))  # slices with eight bytes or more
    while n:
        x = data[at[:n, None] + np.arange(8)]
        x[:, :4] ^= crc[:n, None].view(np.uint8).reshape(n, 4)
        out = t[7][x[:, 0]]
        for k in range(1, 8):
            out ^= t[7 - k][x[:, k]]
        crc[:n] = out
        at[:n] += 8
        left[:n] -= 8
        n = int(np.searchsorted(-left[:n], -8, side="right"))
    for k in range(7):
        some = np.flatnonzero(left > k)
        if not len(some):
            break
        crc[some] = (crc[some] >> np.uint32(8)) ^ t[0][(crc[some] ^ data[at[some] + k]) & np.uint32(255)]
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c_of(column: Column) -> Column:
    """Of a binary column, by Arrow batches."""
    @F.pandas_udf("long")
    def compute(values: pd.Series) -> pd.Series:
        known = values.dropna()
        lengths = np.array([len(v) for v in known], dtype=np.int64)
        found = crc32c_of_slices(np.frombuffer(b"".join(known), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths)
        return pd.Series(found.astype("int64"), index=known.index, dtype="Int64").reindex(values.index)

    return compute(column)
