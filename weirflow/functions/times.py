"""Arithmetic on whole microseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def truncate(us: Column, step: int) -> Column:
    """The last multiple of step at or before us."""
    return us - F.pmod(us, F.lit(step))


def ceiling(us: Column, step: int) -> Column:
    """The first multiple of step at or after us."""
    return us + F.pmod(-us, F.lit(step))


def nearest(us: Column, step: int) -> Column:
    """The nearest multiple of step; halves go away from zero."""
    size = truncate(F.abs(us) + step // 2, step) if step % 2 == 0 else truncate(F.abs(us) * 2 + step, 2 * step) / 2
    return (F.when(us < 0, -1).otherwise(1) * size).cast("long")
