"""Ready-made handlers: running sum, count, right-closed count window, sliding window, cumulative count."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from weirflow.model import Handler, JsonCodec, KeyedEvent, LongCodec, int_key, key_int

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MS, SECOND, MINUTE, HOUR = 1_000, 1_000_000, 60_000_000, 3_600_000_000


def parse_time(text: str) -> int:
    """Microseconds of an RFC 3339 time."""
    return (datetime.fromisoformat(text.replace("Z", "+00:00")) - _EPOCH) // timedelta(microseconds=1)


def format_time(us: int) -> str:
    return (_EPOCH + timedelta(microseconds=us)).strftime("%Y-%m-%dT%H:%M:%SZ")


class PassThrough(Handler):
    """Sends every record as it came."""

    def key_events(self, raw):
        return [KeyedEvent(raw.decode("latin-1"), 0, raw)]

    def on_event(self, subject, event):
        subject.send(event.value)


class RunningSum(Handler):
    """The sum of 8-byte numbers of one key, sent on every event; an empty value counts as 0."""

    state = {"sum": LongCodec()}

    def key_events(self, raw):
        return [KeyedEvent("static", 0, raw)]

    def on_event(self, subject, event):
        total = subject.get("sum", 0) + int.from_bytes(event.value, "big", signed=True)
        subject.put("sum", total)
        subject.send(total.to_bytes(8, "big", signed=True))


class RunningCount(Handler):
    """The number of events of one key as {"Sum": n}, sent on every event."""

    state = {"sum": JsonCodec()}

    def key_events(self, raw):
        return [KeyedEvent("static", 0, raw)]

    def on_event(self, subject, event):
        n = subject.get("sum", 0) + 1
        subject.put("sum", n)
        subject.send(json.dumps({"Sum": n}, separators=(",", ":")))


class CountWindow(Handler):
    """Events of a user per right-closed window; records are {"UserID", "Timestamp"}. Empty windows whose timer was set are sent too.

    An entry holds the number of events up to and with one window's end, after the window before.
    """

    state = {"windows": LongCodec()}

    def __init__(self, size_us: int = 2 * MS) -> None:
        self.size = size_us

    def key_events(self, raw):
        r = json.loads(raw)
        return [KeyedEvent(r["UserID"], parse_time(r["Timestamp"]), raw)]

    def on_event(self, subject, event):
        end = int_key(event.ts_us + -event.ts_us % self.size)
        subject.put("windows", end, subject.entry("windows", end, 0) + 1)
        subject.set_timer(event.ts_us - event.ts_us % self.size + self.size)

    def on_timer(self, subject, ts_us):
        due = [(k, n) for k, n in subject.entries("windows") if key_int(k) <= ts_us]
        for k, _ in due:
            subject.delete("windows", k)
        subject.send(self.count(subject.key, ts_us, sum(n for _, n in due)))

    def count(self, key: str, ts_us: int, n: int) -> str:
        return json.dumps({"UserID": key, "Count": n}, separators=(",", ":"))


class SlidingWindow(Handler):
    """Events of a key in the hour before each minute; records are {"key", "timestamp"}. An entry holds the number of events in a minute.

    Without new events a key's windows go on at the minute after the watermark, so minutes the watermark jumps over are skipped.
    """

    state = {"window-state": LongCodec()}

    def key_events(self, raw):
        r = json.loads(raw)
        return [KeyedEvent(r["key"], parse_time(r["timestamp"]), raw)]

    def on_event(self, subject, event):
        minute = event.ts_us - event.ts_us % MINUTE
        subject.put("window-state", int_key(minute), subject.entry("window-state", int_key(minute), 0) + 1)
        subject.set_timer(minute + MINUTE)

    def on_timer(self, subject, ts_us):
        end = ts_us - ts_us % MINUTE
        kept = []
        for k, n in subject.entries("window-state"):
            if key_int(k) >= end - HOUR:
                kept.append((key_int(k), n))
            else:
                subject.delete("window-state", k)
        if kept:
            total = sum(n for m, n in kept if m < end)
            subject.send(json.dumps({"key": subject.key, "sum": total, "interval": f"{format_time(end - HOUR)}/{format_time(end)}"}, separators=(",", ":")))
            subject.set_timer((subject.watermark_us + MINUTE) // MINUTE * MINUTE)


class CumulativeCount(Handler):
    """All events of one key so far, sent at the end of each second with events; records are {"Timestamp"}."""

    state = {"sum": JsonCodec()}

    def key_events(self, raw):
        return [KeyedEvent("static", parse_time(json.loads(raw)["Timestamp"]), raw)]

    def on_event(self, subject, event):
        subject.put("sum", subject.get("sum", 0) + 1)
        subject.set_timer(-(-event.ts_us // SECOND) * SECOND)

    def on_timer(self, subject, ts_us):
        subject.send(json.dumps({"Sum": subject.get("sum", 0)}, separators=(",", ":")))
