"""Totals over trailing periods for each key and day, days without activity included.

Sums over blocks of 1, 2, 4, 8, ... days are made by doubling: a block of 2n days is a block of n days plus the one that
ends n days before. Any window is then a sum of the blocks in its binary form, each shifted behind the one before.
All shifts use one partitioning and one order, so there is one shuffle and one sort whatever the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Days of a gap that are made at once.
SPAN = 4096


def daily_totals(events: DataFrame, value: Column | None = None) -> DataFrame:
    """event_key, day (days since 1970-01-01) and total: the events, or the sum of value, of each key's active days."""
    rows = events.where("event_key is not null and ts_us is not null")
    what = F.count(F.lit(1)) if value is None else F.sum(value)
    return rows.groupBy("event_key", F.expr(f"(ts_us - pmod(ts_us, {DAY_US})) div {DAY_US}").alias("day")).agg(what.alias("total"))


def rolling_totals(daily: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """event_key, day, total and, for each window of n days, total_n and average_n (total_n / n), for every day from a key's first to its last.

    daily has one row per key and day (daily_totals); several rows of one day are summed, null totals count as zero, null
    keys and days are left out. A window holds its own day and the n - 1 before; what lies before a key's first day is zero. A key has as
    many rows as days between its first and last, however many events it has, so hot keys aren't larger than others.
    """
    if any(n < 1 for n in windows):
        raise ValueError("a window holds at least one day")
    active = daily.where("event_key is not null and day is not null").groupBy("event_key", "day").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    along = Window.partitionBy("event_key").orderBy("day")
    gaps = active.withColumn("next", F.coalesce(F.lead("day").over(along), F.col("day") + 1))
    # a gap of any length, a stray date's too, in two steps: no row ever makes an array of more than SPAN days, or of one in SPAN of them
    last = F.col("next") - 1
    spans = gaps.select("event_key", "day", "total", "next", F.explode(F.sequence("day", last, F.lit(SPAN).cast("long"))).alias("_from"))
    each = spans.select("event_key", "day", "total", F.explode(F.sequence("_from", F.least(F.col("_from") + (SPAN - 1), last))).alias("each_day"))
    first = F.col("each_day") == F.col("day")
    dense = each.select("event_key", F.col("each_day").alias("day"), F.when(first, F.col("total")).otherwise(0).alias("total"), first.alias("active"))
    back = lambda name, days: F.coalesce(F.lag(name, days).over(along), F.lit(0)) if days else F.col(name)
    sums, size = dense.withColumn("block_1", F.col("total")), 1
    while size * 2 <= max(windows):
        sums = sums.withColumn(f"block_{size * 2}", F.col(f"block_{size}") + back(f"block_{size}", size))
        size *= 2
    out = sums
    for n in windows:
        parts, behind = [], 0
        for bit in reversed(range(n.bit_length())):
            if n >> bit & 1:
                parts.append(back(f"block_{1 << bit}", behind))
                behind += 1 << bit
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        out = out.withColumn(f"total_{n}", total)
    kept = [c for n in windows for c in (F.col(f"total_{n}"), (F.col(f"total_{n}") / n).alias(f"average_{n}"))]
    return out.select("event_key", "day", "active", "total", *kept)
