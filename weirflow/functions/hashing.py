"""Key hashing and key groups.

A key belongs to key group murmur3(key) mod n. Groups are dealt to ranges of almost equal size, one for each operator, so
that changing the number of operators moves whole groups.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_GROUPS = 256

# fixed values: constants of the published MurmurHash3 x86_32
_C1, _C2, _C5, _C6, _F1, _F2 = 0xCC9E2D51, 0x1B873593, 5, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def murmur3_32(keys: Iterable[bytes | None], seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86_32 of many keys at once; null keys hash like empty ones."""
    keys = [k or b"" for k in keys]
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    words = int(size.max(initial=0)) // 4 + 1
    u32 = np.uint32
    data = np.frombuffer(b"".join(k.ljust(words * 4, b"\0") for k in keys), "<u4").reshape(len(keys), words)
    turn = lambda x, r: (x << u32(r)) | (x >> u32(32 - r))
    with np.errstate(over="ignore"):
        h = np.full(len(keys), seed, u32)
        for w in range(words):
            mixed = turn(data[:, w] * u32(_C1), 15) * u32(_C2)
            whole = size >= 4 * w + 4
            h = np.where(whole, turn(h ^ mixed, 13) * u32(_C5) + u32(_C6), np.where(size > 4 * w, h ^ mixed, h))
        h = h ^ size.astype(u32)
        h = (h ^ (h >> u32(16))) * u32(_F1)
        h = (h ^ (h >> u32(13))) * u32(_F2)
        return h ^ (h >> u32(16))


@F.pandas_udf(T.LongType())
def _murmur3(keys: pd.Series) -> pd.Series:
    return pd.Series(murmur3_32(keys).astype(np.int64))


def murmur3(key: Column) -> Column:
    """The unsigned 32-bit hash of a string's or binary's bytes; null for null."""
    return F.when(key.isNotNull(), _murmur3(key.cast("binary")))


def key_group(key: Column, groups: int = KEY_GROUPS) -> Column:
    return (murmur3(key) % groups).cast("int")


def ranges(groups: int, parts: int) -> list[tuple[int, int]]:
    """`parts` half-open ranges over the groups; the first groups % parts ones are one larger."""
    small, large = divmod(groups, parts)
    ends = [small * (i + 1) + min(i + 1, large) for i in range(parts)]
    return list(zip([0, *ends], ends))


def range_index(group: Column, groups: int, parts: int) -> Column:
    """Which of ranges(groups, parts) a group lies in, without a lookup."""
    small, large = divmod(groups, parts)
    border = (small + 1) * large
    tail = F.lit(large) + F.floor((group - border) / max(1, small))
    return F.when(group < border, F.floor(group / (small + 1))).otherwise(tail).cast("int")


def range_table(spark: SparkSession, groups: int, parts: int) -> DataFrame:
    """range_no, group_start, group_end."""
    small, large = divmod(groups, parts)
    i = F.col("id")
    start = i * small + F.least(i, F.lit(large))
    return spark.range(parts).select(i.cast("int").alias("range_no"), start.cast("int").alias("group_start"), (start + small + F.when(i < large, 1).otherwise(0)).cast("int").alias("group_end"))


def assign_ranges(to: DataFrame, held: DataFrame) -> DataFrame:
    """to_no, from_no: the old ranges that overlap each new one. Both have range_no, group_start, group_end.

    Each range is spread over the groups it holds, so this is an equi-join; groups number a few hundred by design.
    """
    spread = lambda df, name: df.select(F.col("range_no").alias(name), F.explode(F.expr("case when group_end > group_start then sequence(group_start, group_end - 1) end")).alias("g"))
    return spread(to, "to_no").join(spread(held, "from_no"), "g").select("to_no", "from_no").distinct()


def owned(key: Column, start: int, end: int, groups: int = KEY_GROUPS) -> Column:
    """Whether a key's group lies in [start, end)."""
    return key_group(key, groups).between(start, end - 1)
