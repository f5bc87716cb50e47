"""Catalogue queries run as streams: the event table is replayed through stateful streaming operators until it is read, and must give the
rows of the batch query of the same name."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.handlers import HOUR, CountWindow
from weirflow.model import Handler, LongCodec
from weirflow.plans import streams
from weirflow.runtime import filesystem, partitions_for, scratch
from weirflow.streaming import processor, savepoint

STEPS = 2


class _Replay:
    """Events written once in order of arrival: each file lies behind the one before, in arrival and in time of change. show() lets a stream see more of them."""

    def __init__(self, events: DataFrame) -> None:
        self.spark = events.sparkSession
        self.at = scratch(self.spark, "replay")
        marked = processor.with_arrival_watermark(events, "ts_us", "arrival")
        marked.repartitionByRange(max(STEPS, partitions_for(128 << 20, events)), "arrival").write.parquet(f"{self.at}/all")
        self.schema = marked.schema
        self.fs, folder = filesystem(self.spark, f"{self.at}/all")
        self.files = sorted((s.getPath() for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".parquet")), key=lambda p: p.getName())
        self.each, self.shown = max(1, -(-len(self.files) // STEPS)), 0

    def show(self, share: float, folder: str = "in") -> DataFrame:
        """A stream over a folder that now holds the files up to `share` of all, those shown before left out."""
        to = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{folder}")
        self.fs.mkdirs(to)
        upto = round(share * len(self.files))
        for n in range(self.shown, upto):
            self.fs.setTimes(self.files[n], (n + 1) * 10_000, -1)
            self.fs.rename(self.files[n], to)
        self.shown = upto
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.each).parquet(f"{self.at}/{folder}")

    def drain(self, stream: DataFrame, handler: Handler, checkpoint: str = "checkpoint", out: str = "out", partitions: int | None = None, initial: DataFrame | None = None) -> None:
        with processor.settings(self.spark, partitions):
            writer = processor.process(stream, handler, initial).writeStream.option("checkpointLocation", f"{self.at}/{checkpoint}").option("path", f"{self.at}/{out}")
            query = writer.format("parquet").trigger(availableNow=True).start()
        query.awaitTermination()

    def sent(self, out: str = "out") -> DataFrame:
        return self.spark.read.schema(processor.OUT).parquet(f"{self.at}/{out}")


def _replay(spark: SparkSession, events: DataFrame, handler: Handler) -> DataFrame:
    """key, value of everything the handler sends for events (key, ts_us, value, arrival), read in STEPS micro-batches or so."""
    r = _Replay(events)
    r.drain(r.show(1.0), handler)
    return r.sent()


def _events(spark: SparkSession, d: str, value) -> DataFrame:
    return streams.events(spark, d).select(F.col("user_id").cast("string").alias("key"), "ts_us", value.cast("binary").alias("value"), F.col("event_id").alias("arrival"))


class UserSum(Handler):
    """Running total of a user's cents, with the event it belongs to."""

    state = {"sum": LongCodec()}

    def on_event(self, subject, event):
        e = json.loads(event.value)
        total = subject.get("sum", 0) + e["cents"]
        subject.put("sum", total)
        subject.send(json.dumps({"event_id": e["event_id"], "total": total}))


def _sums(sent: DataFrame) -> DataFrame:
    row = F.from_json(F.col("value").cast("string"), "event_id long, total long")
    return sent.select(row["event_id"].alias("event_id"), F.col("key").cast("long").alias("user_id"), row["total"].alias("total"))


def stream_running_sum(spark: SparkSession, d: str) -> DataFrame:
    return _sums(_replay(spark, _events(spark, d, F.to_json(F.struct("event_id", "cents"))), UserSum()))


class TimedCountWindow(CountWindow):
    """CountWindow that sends the window's end too."""

    def count(self, key, ts_us, n):
        return json.dumps({"Count": n, "T": ts_us})


def _windows(sent: DataFrame) -> DataFrame:
    row = F.from_json(F.col("value").cast("string"), "Count long, T long")
    return sent.select(F.col("key").cast("long").alias("user_id"), row["T"].alias("timer_us"), row["Count"].alias("n"))


def stream_count_in_window(spark: SparkSession, d: str) -> DataFrame:
    return _windows(_replay(spark, _events(spark, d, F.lit("")), TimedCountWindow(2 * HOUR)))


def stream_restart_sum(spark: SparkSession, d: str) -> DataFrame:
    """The running sum by a query that ends halfway, and goes on from its checkpoint when more has come."""
    r = _Replay(_events(spark, d, F.to_json(F.struct("event_id", "cents"))))
    for share in (0.5, 1.0):
        r.drain(r.show(share), UserSum())
    return _sums(r.sent())


def stream_savepoint_sum(spark: SparkSession, d: str) -> DataFrame:
    """The running sum by a query of which a savepoint is made halfway; another query begins with it and does the rest."""
    r = _Replay(_events(spark, d, F.to_json(F.struct("event_id", "cents"))))
    r.drain(r.show(0.5), UserSum(), "first")
    savepoint.restore(spark, savepoint.save(spark, f"{r.at}/first", f"{r.at}/saved"), f"{r.at}/second")
    r.drain(r.show(1.0), UserSum(), "second")
    return _sums(r.sent())


def stream_rescale_windows(spark: SparkSession, d: str) -> DataFrame:
    """Count windows by a query whose state and timers are taken over, halfway, by one with another number of state partitions."""
    r = _Replay(_events(spark, d, F.lit("")))
    r.drain(r.show(0.5, "first"), TimedCountWindow(2 * HOUR), "before", "out-before", partitions=4)
    saved = savepoint.save(spark, f"{r.at}/before", f"{r.at}/saved")
    r.drain(r.show(1.0, "second"), TimedCountWindow(2 * HOUR), "after", "out-after", partitions=3, initial=savepoint.state_of(spark, saved))
    return _windows(r.sent("out-before").unionByName(r.sent("out-after")))


class LastByType(Handler):
    """A user's last amount by type of event, an entry for each; an error deletes the purchase. Sends, for every event, how many entries there are and their sum."""

    state = {"last": LongCodec()}

    def on_event(self, subject, event):
        e = json.loads(event.value)
        subject.put("last", e["event_type"].encode(), e["cents"])
        if e["event_type"] == "error":
            subject.delete("last", b"purchase")
        held = [n for _, n in subject.entries("last")]
        subject.send(json.dumps({"event_id": e["event_id"], "n": len(held), "cents": sum(held)}))


def stream_state_entries(spark: SparkSession, d: str) -> DataFrame:
    sent = _replay(spark, _events(spark, d, F.to_json(F.struct("event_id", "event_type", "cents"))), LastByType())
    row = F.from_json(F.col("value").cast("string"), "event_id long, n long, cents long")
    return sent.select(row["event_id"].alias("event_id"), F.col("key").cast("long").alias("user_id"), row["n"].alias("n_entries"), row["cents"].alias("cents"))


_TYPES = ("click", "error", "signup", "view")
_ENTRIES = (
    streams._E
    + ", l as (select event_id, user_id, "
    + ", ".join(f"last_value(case when event_type = '{t}' then cents end ignore nulls) over w {t}" for t in _TYPES)
    + ", last_value(case when event_type = 'purchase' then cents when event_type = 'error' then -1 end ignore nulls) over w bought from e "
    + "window w as (partition by user_id order by ts_us, event_id rows unbounded preceding)) select event_id, user_id, "
    + " + ".join(f"({t} is not null)::bigint" for t in _TYPES)
    + " + (coalesce(bought, -1) >= 0)::bigint n_entries, "
    + " + ".join(f"coalesce({t}, 0)" for t in _TYPES)
    + " + greatest(coalesce(bought, 0), 0) cents from l"
)

QUERIES = {f.__name__: f for f in (stream_running_sum, stream_count_in_window, stream_state_entries, stream_restart_sum, stream_savepoint_sum, stream_rescale_windows)}
SQL = {
    "stream_running_sum": streams.SQL["running_sum"],
    "stream_count_in_window": streams.SQL["count_in_window"],
    "stream_state_entries": _ENTRIES,
    "stream_restart_sum": streams.SQL["running_sum"],
    "stream_savepoint_sum": streams.SQL["running_sum"],
    "stream_rescale_windows": streams.SQL["count_in_window"],
}
