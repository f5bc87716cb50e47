"""Aggregates, state and windows of a keyed event stream, in batch form.

Events are rows with a key and a time in microseconds. "End of input" is the largest time; a timer fires only if it lies before it, as no later event
would move the watermark past it. Every aggregate reduces to (key, interval) on the map side before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.times import ceiling, truncate


def key_events(raw: DataFrame, *keyed: Column, where: Column | None = None) -> DataFrame:
    """Turns each row into as many events as there are `keyed` structs (key, ts_us, value); null structs are left out."""
    rows = raw if where is None else raw.where(where)
    return rows.select(F.explode(F.array_compact(F.array(*keyed))).alias("e")).select("e.*")


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, out: dict[str, Column], carry: dict[str, str], before: bool = False) -> DataFrame:
    """df with running aggregates, in `order` within `keys`, without putting a whole key into one task.

    `block` is a non-decreasing function of the order, such as the hour of a time. Rows are ordered only inside (keys, block); what
    comes before a block is the running aggregate of block totals. `out` maps a new column to the value it runs over
    and `carry` to "sum" or "max". Null values are skipped; nothing before a row gives its own value. With `before` a row's own value doesn't count yet, and
    nothing before a row gives null, or 0 for a sum.
    """
    fold = {"sum": F.sum, "max": F.max}
    rows = df.withColumn("_block", block)
    totals = rows.groupBy(*keys, "_block").agg(*[fold[carry[c]](v).alias(f"_t_{c}") for c, v in out.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", *[fold[carry[c]](f"_t_{c}").over(earlier).alias(f"_o_{c}") for c in out])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    match = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in [*keys, "_block"]]
    joined = rows.alias("_l").join(offsets.alias("_r"), match, "left").select("_l.*", *[f"_o_{c}" for c in out])
    merged = {c: F.coalesce(fold[carry[c]](v).over(inside), F.lit(0)) + F.coalesce(f"_o_{c}", F.lit(0)) if carry[c] == "sum" else F.greatest(F.max(v).over(inside), F.col(f"_o_{c}")) for c, v in out.items()}
    return joined.withColumns(merged).drop("_block", *[f"_o_{c}" for c in out])


def newest(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """keys and `value` of the row of each key that is last in order. Equal orders give any one of their values."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"))


def put_delete(df: DataFrame, keys: list[str], order: list[str], value: Column, deleted: Column) -> DataFrame:
    """The entries left after all puts and deletes: newest row wins, entries whose newest row is a delete don't come out."""
    last = newest(df, keys, order, F.struct(value.alias("v"), F.coalesce(deleted, F.lit(False)).alias("gone")))
    return last.where(~F.col("value.gone")).select(*keys, F.col("value.v").alias("value"))


def bucket_counts(df: DataFrame, key: str, ts_us: str, step: int) -> DataFrame:
    """key, bucket_us, n: events of each key in each step."""
    return df.groupBy(key, truncate(F.col(ts_us), step).alias("bucket_us")).agg(F.count(F.lit(1)).alias("n"))


def timers(df: DataFrame, key: str, due: Column) -> DataFrame:
    """key, timer_us: the timers that events set; equal ones are one timer."""
    return df.select(key, due.alias("timer_us")).distinct()


def end_of_input(df: DataFrame, ts_us: str) -> DataFrame:
    """One row: the largest time."""
    return df.agg(F.max(ts_us).alias("_end"))


def _fired(df: DataFrame, due: str, end: DataFrame) -> DataFrame:
    # `end` is one row by construction, a scalar rather than a second table
    return df.join(F.broadcast(end), F.col(due) < F.col("_end")).drop("_end")


def count_in_window(df: DataFrame, key: str, ts_us: str, size: int) -> DataFrame:
    """key, timer_us, n: right-closed windows whose timers events set.

    An event sets a timer at the end of its window of `size`, one on a border at the next border. A timer counts the events after the key's
    previous timer up to and with its own time, even if there are none.
    """
    ts = F.col(ts_us)
    groups = df.groupBy(key, (truncate(ts, size) + size).alias("timer_us")).agg(F.count(F.lit(1)).alias("own"), F.count(F.when(F.pmod(ts, F.lit(size)) == 0, 1)).alias("border"))
    along = Window.partitionBy(key).orderBy("timer_us")
    earlier, later = F.lag("timer_us").over(along), F.lead("timer_us").over(along)
    # events on a border count at the timer of that border if the key has one
    given = F.when(earlier == F.col("timer_us") - size, F.col("border")).otherwise(0)
    taken = F.when(later == F.col("timer_us") + size, F.lead("border").over(along)).otherwise(0)
    return _fired(groups.select(key, "timer_us", (F.col("own") - given + taken).alias("n")), "timer_us", end_of_input(df, ts_us))


def cumulative_counts(df: DataFrame, key: str, ts_us: str, step: int) -> DataFrame:
    """key, timer_us, n: at each end of a step with events, all of the key's events so far."""
    groups = df.groupBy(key, ceiling(F.col(ts_us), step).alias("timer_us")).agg(F.count(F.lit(1)).alias("own"))
    sofar = Window.partitionBy(key).orderBy("timer_us").rowsBetween(Window.unboundedPreceding, 0)
    return _fired(groups.select(key, "timer_us", F.sum("own").over(sofar).alias("n")), "timer_us", end_of_input(df, ts_us))


def sliding_counts(df: DataFrame, key: str, ts_us: str, size: int, step: int) -> DataFrame:
    """key, end_us, n: for every multiple of step before the end of input, the events of the `size` before it, where there are any."""
    if size % step:
        raise ValueError("size is a multiple of step")
    buckets = bucket_counts(df, key, ts_us, step)
    ends = buckets.select(key, "n", F.explode(F.sequence(F.col("bucket_us") + step, F.col("bucket_us") + size, F.lit(step))).alias("end_us"))
    return _fired(ends.groupBy(key, "end_us").agg(F.sum("n").alias("n")), "end_us", end_of_input(df, ts_us))


def min_watermark(df: DataFrame, upstream: Column, ts_us: str) -> DataFrame:
    """watermark_us: the least, over upstreams, of each one's largest time less a microsecond."""
    return df.groupBy(upstream.alias("_u")).agg(F.max(ts_us).alias("_m")).agg((F.min("_m") - 1).alias("watermark_us"))


def due_timers(timer_rows: DataFrame, watermark: DataFrame) -> DataFrame:
    """The timers at or before the one watermark row."""
    return timer_rows.join(F.broadcast(watermark), F.col("timer_us") <= F.col("watermark_us")).drop("watermark_us")


def prefix_scan(df: DataFrame, column: str, prefix: str | bytes) -> DataFrame:
    """The rows whose key begins with prefix, in key order."""
    return df.where(F.col(column).startswith(F.lit(prefix))).orderBy(column)


def available_splits(splits: DataFrame, split: str, parents: str, assigned: DataFrame | None = None) -> DataFrame:
    """The splits none of whose parents is still known, less those assigned (one column, named like split)."""
    known = splits.select(F.col(split).alias("_known"))
    waiting = splits.select(split, F.explode(parents).alias("_p")).join(known, F.col("_p") == F.col("_known"), "left_semi").select(split)
    free = splits.join(waiting, split, "left_anti")
    return free if assigned is None else free.join(assigned, split, "left_anti")


def set_added(column: Column, *values: Column) -> Column:
    """A set (an array without repeats) with more values; those it has stay where they are."""
    return F.array_union(column, F.array(*values))


def set_without(column: Column, *values: Column) -> Column:
    """A set with values taken out, in its own order."""
    return F.array_except(column, F.array(*values))
