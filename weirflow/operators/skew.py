"""Per-key work without stragglers, by fragment and replicate.

1. Loads: rows per hash bucket of keys, counted over all rows. A bucket's count is never below that of any key in it, and there
   are a fixed number of buckets, so the driver's share of the work has a bound whatever the number of keys.
2. Packing: a bucket larger than a task's fair share is split into proportionate shards; shards go, largest first, to the
   task with the least load so far.
3. Fragments: each row goes to one task of its bucket's. The matching side is replicated to just these tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: Most buckets a plan has, hence most rows that are collected and broadcast (about 100 bytes each).
MAX_BUCKETS = 65_536
#: Most partial results that an input task holds before it passes them on.
HELD = 65_536


class TaskPlan:
    """Which tasks each bucket of keys goes to."""

    def __init__(self, df: DataFrame, key: str, tasks: int | None = None, buckets: int | None = None) -> None:
        spark = df.sparkSession
        self.tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = min(MAX_BUCKETS, buckets or max(4096, 16 * self.tasks))
        loads = df.groupBy(self.bucket(df[key]).alias("bucket")).agg(F.count(F.lit(1)).alias("load")).collect()
        self.total = sum(r.load for r in loads)
        self.placed = pack({r.bucket: r.load for r in loads}, self.tasks)
        self.table = spark.createDataFrame(sorted(self.placed.items()), "bucket int, tasks array<int>")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def tasks_of(self, df: DataFrame, key: Column) -> DataFrame:
        """df with `_tasks`, null for keys in buckets without rows. The plan has at most MAX_BUCKETS rows, so it is broadcast."""
        return df.withColumn("_bucket", self.bucket(key)).join(F.broadcast(self.table), F.col("_bucket") == self.table["bucket"], "left").drop("_bucket", "bucket").withColumnRenamed("tasks", "_tasks")


def pack(loads: dict[int, int], tasks: int) -> dict[int, list[int]]:
    """Bucket -> its tasks. A bucket gets one shard for each fair share (total / tasks) it has begun."""
    share = max(1, ceil(sum(loads.values()) / tasks))
    shards = sorted(((ceil(load / n), bucket) for bucket, load in loads.items() for n in [max(1, ceil(load / share))] for _ in range(n)), reverse=True)
    free = [(0, t) for t in range(tasks)]
    placed: dict[int, list[int]] = {}
    for load, bucket in shards:
        used, task = heapq.heappop(free)
        placed.setdefault(bucket, []).append(task)
        heapq.heappush(free, (used + load, task))
    return placed


def _fragment(df: DataFrame, plan: TaskPlan, key: Column, spread: Column | None) -> DataFrame:
    which = F.pmod(F.xxhash64(F.monotonically_increasing_id() if spread is None else spread), F.size("_tasks"))
    return plan.tasks_of(df, key).withColumn("_task", F.get("_tasks", which.cast("int"))).drop("_tasks")


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of an input task, those of one key and task reduced to one, or to a few if there are many keys."""

    def reduced(parts: list[pa.Table]) -> pa.Table:
        each = pa.concat_tables(parts).group_by(["hot_key", "_task"], use_threads=False).aggregate([("n", "sum"), ("a", "min"), ("z", "max")])
        return pa.table({"hot_key": each["hot_key"], "_task": each["_task"], "n": each["n_sum"], "a": each["a_min"], "z": each["z_max"]})

    held: list[pa.Table] = []
    for b in batches:
        held.append(reduced([pa.Table.from_batches([b])]))
        if sum(t.num_rows for t in held) > HELD:
            held = [reduced(held)]
            if held[0].num_rows > HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from reduced(held).to_batches()


def key_stats(df: DataFrame, key: str, ts: Column, plan: TaskPlan | None = None, spread: Column | None = None) -> DataFrame:
    """hot_key, n_rows, first_us and last_us of every non-null key, over all its rows.

    Input tasks reduce their rows, what is left goes to the tasks of the plan, which reduce their fragments, and the few partial
    results of a split key are merged. ts is in
    microseconds; null times count as rows and are in neither bound.
    """
    plan = plan or TaskPlan(df, key)
    rows = df.select(df[key].alias("hot_key"), ts.alias("_us"), *([] if spread is None else [spread.alias("_spread")])).where("hot_key is not null")
    routed = _fragment(rows, plan, F.col("hot_key"), None if spread is None else F.col("_spread"))
    routed = routed.select("hot_key", "_task", F.lit(1).cast("long").alias("n"), F.col("_us").alias("a"), F.col("_us").alias("z"))
    if isinstance(routed.schema["hot_key"].dataType, AtomicType):  # Arrow groups by no others
        routed = routed.mapInArrow(_partials, routed.schema)
    parts = routed.repartitionById(plan.tasks, F.col("_task")).groupBy("hot_key", "_task").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"))
    return parts.groupBy("hot_key").agg(F.sum("n").alias("n_rows"), F.min("a").alias("first_us"), F.max("z").alias("last_us"))


def skew_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", plan: TaskPlan | None = None, spread: Column | None = None) -> DataFrame:
    """left joined to right on left_key = right_key ("inner" or "left"), where a few keys hold most rows of left.

    Comes out with all columns of left in a struct `l` and of right in a struct `r`, so clashing names do no harm. right's rows go to
    every task that has fragments of their key and to no other; right is meant to have few rows per key. Null keys match nothing. By
    default a row's fragment follows its place in the input, which is fixed for files and kept tables; for other inputs name a
    `spread` column that tells a key's rows apart.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    plan = plan or TaskPlan(left, left_key)
    packed = left.select(F.struct(*[left[c] for c in left.columns]).alias("l"), left[left_key].alias("_lk"), *([] if spread is None else [spread.alias("_spread")]))
    fragments = _fragment(packed, plan, F.col("_lk"), None if spread is None else F.col("_spread"))
    matching = right.select(F.struct(*[right[c] for c in right.columns]).alias("r"), right[right_key].alias("_rk")).where("_rk is not null")
    replicas = plan.tasks_of(matching, F.col("_rk")).withColumn("_at", F.explode(F.array_distinct("_tasks"))).drop("_tasks")
    fragments = fragments.repartitionById(plan.tasks, F.col("_task"))
    replicas = replicas.repartitionById(plan.tasks, F.col("_at"))
    # sizes are known to be right for a merge; a broadcast chosen at run time would make both shuffles useless
    return fragments.hint("merge").join(replicas, (F.col("_task") == F.col("_at")) & (F.col("_lk") == F.col("_rk")), how).select("l", "r")
