"""Records to an HTTP service: POST {addr}/topics/{Topic} with a JSON list of base64 payloads, those of up to `batch` (500) records of one topic in a row.

`format("httpapi-sink")`, option addr, input column `value` with JSON {"Topic", "Data"} (weirflow.functions.codecs.sink_record). Delivery is at least
once: a task that is run again sends its records again.
"""

from __future__ import annotations

import json
import urllib.request
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from weirflow.sources.httpapi import TIMEOUT, check_address


BATCH = 500


def _record(value: str | bytes) -> tuple[str, str]:
    record = json.loads(value)
    if not record.get("Topic"):
        raise ValueError("a record has no topic")
    return record["Topic"], record.get("Data", "")


def _send(addr: str, topic: str, payloads: list[str]) -> None:
    body = json.dumps(payloads).encode()
    request = urllib.request.Request(f"{addr}/topics/{quote(topic, safe='')}", body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=TIMEOUT):  # a status of 400 or more raises
        pass


def post(addr: str, value: str | bytes) -> None:
    topic, data = _record(value)
    _send(addr, topic, [data])


class _Write:
    def __init__(self, addr: str, batch: int = BATCH) -> None:
        self.addr, self.batch = addr, batch

    def write(self, iterator):
        held: list[str] = []
        topic = None
        for row in iterator:
            to, data = _record(row["value"] if not isinstance(row["value"], bytearray) else bytes(row["value"]))
            if held and (to != topic or len(held) >= self.batch):
                _send(self.addr, topic, held)
                held = []
            topic = to
            held.append(data)
        if held:
            _send(self.addr, topic, held)
        return WriterCommitMessage()


class _Writer(_Write, DataSourceWriter):
    pass


class _StreamWriter(_Write, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        pass

    def abort(self, messages, batchId):
        pass


class HttpApiSink(DataSource):
    @classmethod
    def name(cls):
        return "httpapi-sink"

    def schema(self):
        return "value string"

    def _place(self) -> tuple[str, int]:
        return check_address(self.options.get("addr", "")), int(self.options.get("batch", BATCH))

    def writer(self, schema, overwrite):
        return _Writer(*self._place())

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(*self._place())
