"""Counts per key and period of event time, corrected as late events arrive, up to a cut-off.

The counts are conflict-free counters. A counter belongs to a key and a period and has one part for each source, a hash bucket of
event ids, so that all deliveries of one event reach the same source and a hot key is spread over all sources. A part holds three numbers:
the source's events that had arrived when the period ended (on_time), before the cut-off (corrected), and ever (value). As an
event counts at its earliest arrival, none of them ever falls, in whatever order deliveries come; its version numbers the
source's changes. Two copies of a counter are merged by each source's maximum, and the count is the sum over sources. Merging is
commutative, associative and idempotent, so states may be sent again, late or in any order.

LateCounts keeps counters between runs, with the events they hold: a redelivery adds nothing, or moves its event to an earlier
arrival. Both lie by day of event time, and a run reads and writes only the days of its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.runtime import cut, micros
from weirflow.versions import Versions

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
COUNTER = ["event_key", "period_start_us", "source"]
_PARTS = ["version", "on_time", "corrected", "value"]
STATES = "event_key string, period_start_us long, source int, version long, on_time long, corrected long, value long"
HELD = "event_id string, event_key string, ts_us long, arrival_us long"


def source_states(events: DataFrame, period_us: int = HOUR_US, lateness_us: int = 6 * HOUR_US, sources: int = 8, source: Column | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """The counter states that the sources publish: event_key, period_start_us, source, version, on_time, corrected, value.

    events has event_key, ts_us, arrival_us and counts each event once; by its event_id, if there is one, an event
    finds its source, else and for null ids by its times. Events without an arrival time count as never arrived. Arrivals at the very end
    of a period are late, at the very cut-off (lateness_us after the end) too late. An event that the sources have counted already comes with
    was_us, the arrival it was counted at, if it has been found to have arrived earlier; with no such column, or null there, it is new.
    earlier are all states published so far, with as many sources; the sources go on from them, and come out with all their states.
    """
    rows = events.where("event_key is not null and ts_us is not null and arrival_us is not null")
    spread = F.xxhash64("ts_us", "arrival_us")
    if "event_id" in events.columns:
        spread = F.when(F.col("event_id").isNull(), spread).otherwise(F.xxhash64("event_id"))
    spread = F.pmod(spread, F.lit(sources)) if source is None else source
    start = F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(period_us))
    end = start + period_us

    def step(until: Column) -> Column:
        """What an event adds to the number of those that had arrived before `until`."""
        now = (F.col("arrival_us") < until).cast("long")
        return now - F.coalesce((F.col("was_us") < until).cast("long"), F.lit(0)) if "was_us" in events.columns else now

    new = F.col("was_us").isNull().cast("long") if "was_us" in events.columns else F.lit(1)
    steps = rows.select(
        "event_key", start.alias("period_start_us"), spread.cast("int").alias("source"), F.lit(1).cast("long").alias("version"), step(end).alias("on_time"), step(end + lateness_us).alias("corrected"), new.cast("long").alias("value")
    )
    if earlier is not None:
        steps = steps.unionByName(merge_states(earlier))
    return steps.groupBy(*COUNTER).agg(*[F.sum(c).alias(c) for c in _PARTS])


def merge_states(*states: DataFrame) -> DataFrame:
    """One copy of each state; what was sent again or in another order changes nothing."""
    whole = states[0]
    for more in states[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy(*COUNTER).agg(*[F.max(c).alias(c) for c in _PARTS])


def read_counts(states: DataFrame) -> DataFrame:
    """event_key, period_start_us, on_time, corrected, late and too_late of each key and period with an arrival.

    on_time counts what had arrived when the period ended, corrected what had before the cut-off, late is the
    difference, too_late came after the cut-off and is in neither. states holds one copy of each state (merge_states).
    """
    total = states.groupBy("event_key", "period_start_us").agg(*[F.sum(c).alias(c) for c in ("on_time", "corrected", "value")])
    return total.select(
        "event_key", "period_start_us", "on_time", "corrected", (F.col("corrected") - F.col("on_time")).alias("late"), (F.col("value") - F.col("corrected")).alias("too_late")
    )


class LateCounts:
    """Counters kept between runs, in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, period_us: int = HOUR_US, lateness_us: int = 6 * HOUR_US, sources: int = 8) -> None:
        self.spark, self.args = spark, (period_us, lateness_us, sources)
        # whole periods, about a day of them
        self.part_us = period_us * max(1, DAY_US // period_us)
        self.versions = Versions(spark, path)

    def apply(self, rows: DataFrame, event_id: str, key: str, ts: str, arrival: str) -> None:
        """Counts a run's deliveries and publishes the counters and the events in them at once.

        Rows with one id are one event, at its earliest arrival in this run or any before, provided its deliveries agree on the day. Runs may come in any order
        and be repeated; one that failed has left nothing to be seen and is run again. Rows whose key or time is null are no events. A null id
        identifies nothing: each such row is an event, and one more if its run is repeated. Null arrivals are never counted.
        """
        number, _, parts = self.versions.latest()
        of = lambda kind: {p.split("/")[1]: f for p, f in parts.items() if p.startswith(kind)}
        fresh = rows.where(rows[key].isNotNull() & rows[ts].isNotNull() & rows[arrival].isNotNull()).select(
            rows[event_id].cast("string").alias("event_id"),
            F.when(rows[event_id].isNull(), F.monotonically_increasing_id()).alias("row_no"),
            F.struct(micros(rows[arrival]).alias("arrival_us"), micros(rows[ts]).alias("ts_us"), rows[key].cast("string").alias("event_key")).alias("e"),
        )
        part = (F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(self.part_us))) / self.part_us
        # a run's events of an id collapse before the shuffle; those held are one each
        each = fresh.groupBy("event_id", "row_no").agg(F.min("e").alias("e"))
        if parts:
            each = cut(each.select("event_id", "row_no", "e.*").withColumn("part", part.cast("long")))
            # one row for each day of the run's events
            days = {str(r.part) for r in each.select("part").distinct().collect()}
            # held events of those days; a run's rows meet them by id
            held = self.versions.read(of("events/"), HELD, days)
            now = each.select("event_id", "row_no", F.struct("arrival_us", "ts_us", "event_key").alias("e"), F.lit(None).cast("long").alias("was_us"))
            then = held.select("event_id", F.lit(None).cast("long").alias("row_no"), F.struct("arrival_us", "ts_us", "event_key").alias("e"), F.col("arrival_us").alias("was_us"))
            each = now.unionByName(then).groupBy("event_id", "row_no").agg(F.min("e").alias("e"), F.min("was_us").alias("was_us"))
        else:
            each = each.withColumn("was_us", F.lit(None).cast("long"))
        version = self.versions.folder()
        at = f"{self.versions.path}/{version}"
        kept = each.select("event_id", "e.event_key", "e.ts_us", "e.arrival_us", "was_us").withColumn("part", part.cast("long"))
        # few files for each day, however many tasks; a day with most of the events is divided
        kept.hint("rebalance", "part").write.partitionBy("part").parquet(f"{at}/events")
        written = self.versions.subfolders(f"{version}/events", "part")
        if not written:
            return
        counted = self.versions.read(written, HELD + ", was_us long")
        moved = counted.where("was_us is null or arrival_us < was_us")
        period_us, lateness_us, sources = self.args
        earlier = {p: f for p, f in of("states/").items() if p in written}
        before = self.versions.read(earlier, STATES) if earlier else None
        states = source_states(moved, period_us, lateness_us, sources, earlier=before)
        if before is not None:
            states = merge_states(before, states)
        in_part = (F.col("period_start_us") - F.pmod(F.col("period_start_us"), F.lit(self.part_us))) / self.part_us
        states.withColumn("part", in_part.cast("long")).hint("rebalance", "part").write.partitionBy("part").parquet(f"{at}/states")
        new = {f"events/{p}": f for p, f in written.items()} | {f"states/{p}": f for p, f in self.versions.subfolders(f"{version}/states", "part").items()}
        self.versions.publish(number, parts | new)

    def states(self) -> DataFrame:
        """All counters, one copy of each."""
        return self.versions.read({p: f for p, f in self.versions.latest()[2].items() if p.startswith("states/")}, STATES)
