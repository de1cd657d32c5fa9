"""Hashed character n-grams of a text as numpy arrays."""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
SPACES = np.array([9, 10, 11, 12, 13], dtype=np.uint32)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points; line ends and tabs count as spaces."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    return np.where((points >= 9) & (points <= 13), np.uint32(32), points)


def hashed(points: np.ndarray, lengths: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket (0 to 2**bits - 1) of every n-gram of the given lengths; the text counts with a space at either end."""
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    out, h = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(lengths) + 1):
        if len(points) < n:
            break
        h = h[:len(points) - n + 1] * STEP + points[n - 1:]
        if n in lengths:
            mixed = (h ^ (h >> np.uint64(29))) * SPREAD
            out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
