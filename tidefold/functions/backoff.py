"""Retry backoff: exponential with a ceiling, half of it jittered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INITIAL_MS, MAX_MS, MAX_SHIFT = 1_000, 3_600_000, 16


def base_ms(attempt: Column, initial_ms: int = INITIAL_MS, max_ms: int = MAX_MS) -> Column:
    """initial * 2 ** min(attempt - 1, 16), at most max; attempt 0 counts as the largest shift."""
    doublings = F.when(attempt < 1, F.lit(MAX_SHIFT)).otherwise(F.least(attempt - 1, F.lit(MAX_SHIFT)))
    return F.least(F.lit(initial_ms) * F.pow(F.lit(2.0), doublings), F.lit(float(max_ms))).cast("long")


def low_ms(attempt: Column, **limits: int) -> Column:
    """The least delay; the real one is uniform from here up to, not including, base_ms."""
    return F.floor(base_ms(attempt, **limits) / 2).cast("long")


def delay_ms(attempt: Column, seed: int, **limits: int) -> Column:
    """One jittered delay per row."""
    base = base_ms(attempt, **limits)
    low = F.floor(base / 2)
    return F.when(low <= 0, base).otherwise(low + F.floor(F.rand(seed) * low)).cast("long")
