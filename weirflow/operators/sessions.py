"""Sessions: each key's events, parted by inactivity.

The events are range-partitioned and sorted by key and time, then each partition is read once, front to back,
holding one open session. A key with many events spans several partitions, so no task gets a whole hot key. Only the first
and the last session of a partition can go on in a neighbour; these, at most two per partition,
are joined up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAGMENT = "event_key string, session_start_us long, session_end_us long, n_events long, edge boolean"


def _scan(gap_us: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = start = end = None
        count, first = 0, True

        def out(keys: list, starts, ends, counts, edges) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(counts, pa.int64()), pa.array(edges, pa.bool_())],
                names=["event_key", "session_start_us", "session_end_us", "n_events", "edge"],
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch["event_key"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
            ts = batch["ts_us"].to_numpy(zero_copy_only=False)
            opens = np.ones(n, bool)
            opens[1:] = (codes[1:] != codes[:-1]) | (ts[1:] - ts[:-1] > gap_us)
            opens[0] = key is None or batch["event_key"][0].as_py() != key or int(ts[0]) - end > gap_us
            heads = np.flatnonzero(opens)
            if not len(heads):
                end, count = int(ts[-1]), count + n
                continue
            if key is not None:
                if heads[0]:
                    end, count = int(ts[heads[0] - 1]), count + int(heads[0])
                yield out([key], [start], [end], [count], [first])
                first = False
            if len(heads) > 1:
                edges = np.zeros(len(heads) - 1, bool)
                edges[0] = first
                first = False
                yield out(batch["event_key"].take(pa.array(heads[:-1])).to_pylist(), ts[heads[:-1]], ts[heads[1:] - 1], np.diff(heads), edges)
            key, start, end, count = batch["event_key"][int(heads[-1])].as_py(), int(ts[heads[-1]]), int(ts[-1]), n - int(heads[-1])
        if key is not None:
            yield out([key], [start], [end], [count], [True])

    return scan


def sessions(events: DataFrame, gap_us: int = 30 * 60 * 1_000_000) -> DataFrame:
    """event_key, session_start_us, session_end_us, duration_us and n_events of each session.

    events has event_key and ts_us (microseconds). An event more than gap_us after the key's previous one opens a
    new session; exactly gap_us later still belongs. Rows with a null key or time are in no session. Equal times are
    separate events of one session. An empty input gives no rows; further columns are ignored.
    """
    rows = events.where("event_key is not null and ts_us is not null").select("event_key", "ts_us")
    ordered = rows.repartitionByRange("event_key", "ts_us").sortWithinPartitions("event_key", "ts_us")
    parts = ordered.mapInArrow(_scan(gap_us), FRAGMENT)
    # inner sessions are whole: each is dealt to a group of its own, only edges of one key meet
    inner = F.when(~F.col("edge"), F.xxhash64("event_key", "session_start_us"))
    parts = parts.withColumn("inner", inner)
    along = Window.partitionBy("event_key", "inner").orderBy("session_start_us", "session_end_us")
    reach = F.max("session_end_us").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("session_start_us") - reach > gap_us), 1).otherwise(0)
    numbered = parts.withColumn("opens", opens).withColumn("nth", F.sum("opens").over(along))
    whole = numbered.groupBy("event_key", "inner", "nth").agg(
        F.min("session_start_us").alias("session_start_us"), F.max("session_end_us").alias("session_end_us"), F.sum("n_events").alias("n_events")
    )
    return whole.select("event_key", "session_start_us", "session_end_us", (F.col("session_end_us") - F.col("session_start_us")).alias("duration_us"), "n_events")
