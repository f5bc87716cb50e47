"""A handler as a stateful streaming operator.

Events are shuffled by key once. A key's state is a log of pages of changed entries in the state store: a micro-batch reads it once and appends
a page of what changed, in one call each, and once it has grown to twice its entries it is written anew, so a change costs the same
however large a state is. The key's pending timers are entries too; Spark keeps one timer for each key, at the earliest, and one call of Python
handles all that are due. A key's events in a micro-batch are handled in order of (time, arrival).

Spark would drop rows older than the watermark. To handle late events, as the model says, the watermark runs on a column `wm_ts`, the
largest time seen so far in order of arrival (with_arrival_watermark makes it), so that no row is ever behind it. A stream without that
column runs on its own times, and Spark then drops what is late. With a delay of one
millisecond a timer fires once the largest time has passed it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weirflow.functions.times import truncate
from weirflow.model import Handler, KeyedEvent, Subject, int_key, key_int
from weirflow.operators.keyed import running
from weirflow.runtime import session_conf

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, value binary"
LOG = "page binary"
#: Namespace of pending timers; handlers can't have it, as theirs are declared by attribute.
TIMERS = ""
#: Changes that a log may hold beyond twice its entries, and those in one page.
SLACK, PAGE = 16, 10_000


def pages(changes: list[tuple[str, bytes, bytes | None]]) -> list[tuple[bytes]]:
    """Changes (namespace, key, value or None for an entry that has gone) as rows of a log."""
    return [(pickle.dumps(changes[i : i + PAGE], 4),) for i in range(0, len(changes), PAGE)]


def unpack(log) -> Iterator[tuple[str, bytes, bytes | None]]:
    """All changes of a log, oldest first."""
    for row in log:
        yield from pickle.loads(row[0])


def _due_ms(ts_us: int) -> int:
    return -(-ts_us // 1000)


class HandlerProcessor(StatefulProcessor):
    def __init__(self, handler: Handler) -> None:
        self.handler = handler

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", LOG)

    def _run(self, key: str, mark_ms: int, calls, fired: bool) -> Iterator[Row]:
        entries: dict = {}
        length = 0
        for name, entry, value in unpack(self.log.get()):
            length += 1
            if value is None:
                entries.pop((name, entry), None)
            else:
                entries[name, entry] = value
        timers = {key_int(k) for n, k in entries if n == TIMERS}
        armed = None if fired or not timers else _due_ms(min(timers))
        state = {at: v for at, v in entries.items() if at[0] != TIMERS}
        subject = Subject(key, (mark_ms + 1) * 1000 - 1, self.handler.state, state)
        gone = calls(subject, timers)
        changes = subject.changes()
        pending = (timers - gone) | subject.new_timers
        changes |= {(TIMERS, int_key(t)): None for t in timers - pending} | {(TIMERS, int_key(t)): b"" for t in pending - timers}
        if changes:
            live = len(subject.stored) + len(pending)
            if length + len(changes) <= 2 * live + SLACK:
                self.log.appendList(pages([(n, k, v) for (n, k), v in changes.items()]))
            elif live:
                self.log.put(pages([(n, k, v) for (n, k), v in subject.stored.items()] + [(TIMERS, int_key(t), b"") for t in sorted(pending)]))
            else:
                self.log.clear()
        wanted = _due_ms(min(pending)) if pending else None
        if wanted != armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        for v in subject.sent:
            yield Row(key=key, value=v)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = [(r.ts_us, (r.arrival or 0) if "arrival" in r else 0, bytes(r.value or b"")) for r in rows]
        events.sort(key=lambda e: e[:2])

        def calls(subject: Subject, _) -> set[int]:
            for ts, _, value in events:
                self.handler.on_event(subject, KeyedEvent(subject.key, ts, value))
            return set()

        return self._run(key[0], timerValues.getCurrentWatermarkInMs(), calls, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark_ms = timerValues.getCurrentWatermarkInMs()

        def calls(subject: Subject, timers: set[int]) -> set[int]:
            # timers set meanwhile lie after the watermark
            due = sorted(t for t in timers if _due_ms(t) <= mark_ms)
            for t in due:
                self.handler.on_timer(subject, t)
            return set(due)

        return self._run(key[0], mark_ms, calls, True)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A key's log as another query left it (savepoint.state_of)."""
        log = [(bytes(page),) for page in initialState.log]
        self.log.put(log)
        timers: set[int] = set()
        for name, entry, value in unpack(log):
            if name == TIMERS:
                (timers.discard if value is None else timers.add)(key_int(entry))
        if timers:
            self.handle.registerTimer(_due_ms(min(timers)))

    def close(self) -> None:
        pass


def settings(spark: SparkSession, partitions: int | None = None):
    """A block in which queries of handlers are started: the state store that they need, with changes written as logs, and the number of state
    partitions of a new checkpoint. A query keeps what held when it started."""
    conf = {"spark__sql__streaming__stateStore__providerClass": ROCKS, "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true"}
    return session_conf(spark, **conf, **({} if partitions is None else {"spark__sql__shuffle__partitions": str(partitions)}))


def with_arrival_watermark(df: DataFrame, ts_us: str, arrival: str, block: int = 1_000) -> DataFrame:
    """df (bounded) with wm_ts: the largest time up to each row in order of `arrival` (a whole number)."""
    seen = running(df.withColumn("_all", F.lit(0)), ["_all"], [arrival], truncate(F.col(arrival), block), {"_reach": F.col(ts_us)}, {"_reach": "max"})
    return seen.withColumn("wm_ts", F.timestamp_micros("_reach")).drop("_all", "_reach")


def process(events: DataFrame | Sequence[DataFrame], handler: Handler, initial: DataFrame | None = None) -> DataFrame:
    """key, value of everything the handler sends. events is a stream of key, ts_us, value, arrival (optional) and wm_ts; its query is started under settings().

    Several streams have a watermark each, and the least of them holds (spark.sql.streaming.multipleWatermarkPolicy is "min" by default). After a
    restart a stream holds the others back until it has rows again.
    `initial` (savepoint.state_of) is the state to begin with in a new checkpoint, which may have any number of partitions.
    """
    # a watermark starts at 0 and only rows after it are let in
    own = F.timestamp_micros(F.greatest("ts_us", F.lit(1000)))
    whole = None
    for stream in [events] if isinstance(events, DataFrame) else events:
        mark = F.coalesce(F.greatest("wm_ts", F.timestamp_micros(F.lit(1000))), own) if "wm_ts" in stream.columns else own
        marked = stream.withColumn("wm_ts", mark).withWatermark("wm_ts", "1 millisecond")
        whole = marked if whole is None else whole.unionByName(marked)
    return whole.groupBy("key").transformWithState(
        statefulProcessor=HandlerProcessor(handler), outputStructType=OUT, outputMode="Append", timeMode="EventTime", initialState=None if initial is None else initial.groupBy("key")
    )


def keyed(raw: DataFrame, handler: Handler, column: str = "value") -> DataFrame:
    """key, ts_us, value of the events a handler makes of raw records, next to raw's other columns. Runs in Arrow batches and keeps their order."""
    others = [c for c in raw.columns if c != column]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields if f.name != column)

    def expand(batches):
        for b in batches:
            made = [(i, e.key, e.ts_us, e.value) for i, r in enumerate(b[column]) for e in handler.key_events(bytes(r))]
            at, *columns = zip(*made) if made else ((), (), (), ())
            yield pd.concat([b[others].iloc[list(at)].reset_index(drop=True), pd.DataFrame(dict(zip(("key", "ts_us", "value"), map(list, columns))))], axis=1)

    return raw.mapInPandas(expand, (fields + ", " if fields else "") + "key string, ts_us long, value binary")
