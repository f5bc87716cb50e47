"""Events from an HTTP service: GET {addr}/topics/{topic}/{cursor} gives {"Events": [base64], "Status", "Cursor"}; "eoi" ends the input.

`format("httpapi")` with the options addr and topic. A topic is one ordered log with one cursor, so it is one split.
"""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

from pyspark.sql import Column
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from weirflow.sources.retry import TerminalError, with_retries

TIMEOUT = 1.0


def check_address(addr: str) -> str:
    parts = urlsplit(addr)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError(f"not an HTTP address: {addr!r}")
    return addr.rstrip("/")


def is_address(column: Column) -> Column:
    """check_address for a column: whether it would pass."""
    return column.rlike(r"^https?://[^/?#\s]+")


def fetch(addr: str, topic: str, cursor: int) -> tuple[list[bytes], int, bool]:
    """(events, next cursor, whether the input has ended)."""

    def get() -> dict:
        try:
            with urllib.request.urlopen(f"{addr}/topics/{quote(topic, safe='')}/{cursor}", timeout=TIMEOUT) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code in (400, 401, 403, 404):
                raise TerminalError(f"{addr}: status {e.code}") from e
            raise

    page = with_retries(get)
    return [base64.b64decode(e) for e in page.get("Events") or []], int(page.get("Cursor", cursor)), page.get("Status") == "eoi"


def read_all(addr: str, topic: str, cursor: int = 0) -> Iterator[tuple]:
    """(cursor after it, event) of what is there now."""
    while True:
        events, after, ended = fetch(addr, topic, cursor)
        yield from ((after, e) for e in events)
        if ended or not events:
            return
        cursor = after


class _Reader(DataSourceReader):
    def __init__(self, addr: str, topic: str) -> None:
        self.addr, self.topic = addr, topic

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        return read_all(self.addr, self.topic)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, addr: str, topic: str, start: dict) -> None:
        self.addr, self.topic, self.start = addr, topic, start

    def initialOffset(self):
        return self.start

    def read(self, start):
        events, after, _ = fetch(self.addr, self.topic, start["cursor"])
        return iter([(after, e) for e in events]), {"cursor": after}

    def readBetweenOffsets(self, start, end):
        cursor, out = start["cursor"], []
        while cursor < end["cursor"]:
            events, after, _ = fetch(self.addr, self.topic, cursor)
            if after <= cursor:
                break
            out += [(after, e) for e in events]
            cursor = after
        return iter(out)


class HttpApiSource(DataSource):
    @classmethod
    def name(cls):
        return "httpapi"

    def schema(self):
        return "cursor long, value binary"

    def _place(self) -> tuple[str, str]:
        topic = self.options.get("topic", "")
        if not topic or "," in topic:
            raise ValueError("exactly one topic")
        return check_address(self.options.get("addr", "")), topic

    def reader(self, schema):
        return _Reader(*self._place())

    def simpleStreamReader(self, schema):
        return _Stream(*self._place(), json.loads(self.options.get("startOffset", '{"cursor": 0}')))
