"""Events that may be delivered several times, each counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.runtime import micros


def distinct_events(df: DataFrame, event_id: str, key: str, ts: str, arrival: str | None = None, keep_id: bool = False) -> DataFrame:
    """event_key, ts_us and arrival_us of every event: rows with one id are one event, at its earliest arrival.

    Rows whose key or time is null are no events. A null id identifies nothing, so each such row is an event of its own.
    Null arrivals count as later than all others; without an arrival column ties go to the earlier time. Copies
    collapse before the shuffle, so an event that holds many rows is no hot key. With keep_id the id comes out as well, as event_id.
    """
    arrived = micros(df[arrival]) if arrival else F.lit(None).cast("long")
    rows = df.where(df[key].isNotNull() & df[ts].isNotNull()).select(
        df[event_id].alias("id"),
        F.when(df[event_id].isNull(), F.monotonically_increasing_id()).alias("row_no"),
        F.coalesce(arrived, F.lit(2**63 - 1)).alias("arrival_us"),
        micros(df[ts]).alias("ts_us"),
        df[key].cast("string").alias("event_key"),
    )
    first = rows.groupBy("id", "row_no").agg(F.min(F.struct("arrival_us", "ts_us", "event_key")).alias("e"))
    return first.select(*([F.col("id").alias("event_id")] if keep_id else []), "e.event_key", "e.ts_us", F.when(F.col("e.arrival_us") < 2**63 - 1, F.col("e.arrival_us")).alias("arrival_us"))
