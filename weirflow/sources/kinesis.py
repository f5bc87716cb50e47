"""Events from a stream of shards that split and merge.

`format("kinesis")` reads through a client named by the option `client`, as module:function (weirflow.sources.kinesis:boto3_client by default); the
function gets the options and returns an object with

    list_shards(next_token) -> (shards with shard_id, start, end, parents; next_token or None)
    get_shard_iterator(shard_id, after) -> iterator; after is a sequence number or None for the shard's beginning
    get_records(iterator, limit) -> (records as dicts of sequence_number, partition_key, data, timestamp; next iterator or None at the shard's end)

Each shard is one input partition; a child is read only when none of its parents is still to be read, so a key's records keep their order across splits and
merges. The driver only lists shards. How far a task of a micro-batch has read its shard it claims in the folder of the option `progress`, in one
step and before any record goes out: a task that is run again, or beside another one, finds the claim and gives the very same records. The next
micro-batch begins where the claims end, and an offset holds the positions that its micro-batch begins at.
"""

from __future__ import annotations

import importlib
import json
import os
import re
import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weirflow.sources.retry import TerminalError, with_retries

HASH_KEYS = 1 << 128
_ARN = re.compile(r"^arn:[a-z0-9-]+:kinesis:[a-z0-9-]+:\d{12}:stream/[A-Za-z0-9_.-]+$")
#: Error codes that retrying can't mend; all others may be retried.
TERMINAL_CODES = {"AccessDeniedException", "InvalidArgumentException"}
EXPIRED = "ExpiredIteratorException"
#: Empty pages in a row after which a task has read what there is.
EMPTY_PAGES = 3


def check_arn(arn: str) -> str:
    if not _ARN.match(arn):
        raise ValueError(f"not the name of a stream: {arn!r}")
    return arn


@dataclass
class Shard:
    shard_id: str
    start: int = 0
    end: int = HASH_KEYS - 1
    parents: list[str] = field(default_factory=list)


def runner_index(start: int, end: int, runners: int) -> int:
    """The runner for a shard: where the middle of its hash keys lies, in as many equal parts as there are runners, as the nearest double says."""
    return min(runners - 1, int((start + end) // 2 * runners / HASH_KEYS))


def runner_of(runners: int):
    """runner_index for columns of decimal strings, which are too long for a decimal type."""

    @F.pandas_udf(T.IntegerType())
    def place(start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([runner_index(int(a), int(z), runners) if a is not None and z is not None else None for a, z in zip(start, end)], dtype="Int32")

    return place


class ShardTracker:
    """Known and assigned shards; a shard is available when it isn't assigned and none of its parents is known any more."""

    def __init__(self, shards: list[Shard] = (), last: str | None = None) -> None:
        self.known: dict[str, Shard] = {}
        self.assigned: set[str] = set()
        self.last = last
        self.add(shards)

    def add(self, shards) -> None:
        self.known |= {s.shard_id: s for s in shards}

    def assign(self, shards) -> None:
        self.assigned |= {s.shard_id for s in shards}
        self.last = shards[-1].shard_id if shards else self.last

    def finish(self, ids) -> None:
        for i in ids:
            self.known.pop(i, None)
            self.assigned.discard(i)

    def available(self) -> list[Shard]:
        return [s for s in self.known.values() if s.shard_id not in self.assigned and not any(p in self.known for p in s.parents)]


class Progress:
    """Claims below a folder that driver and executors share: a path they all have mounted, or a URI that pyarrow reads."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.removeprefix("file://").rstrip("/")
        self.local = "://" not in self.folder

    def _remote(self, name: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.folder}/{name}")

    def claim(self, name: str, text: str) -> str:
        """What the claim of this name says: `text`, unless there was one before."""
        if self.local:
            at = f"{self.folder}/{name}"
            os.makedirs(os.path.dirname(at), exist_ok=True)
            mine = f"{at}.{os.getpid()}.{time.monotonic_ns()}"
            with open(mine, "w") as f:
                f.write(text)
            try:
                os.link(mine, at)  # fails if the name is taken; the file is whole when it appears
            except FileExistsError:
                pass
            os.remove(mine)
            return self.read(name) or text
        held = self.read(name)
        if held is None:  # an object store has no claim in one step: speculation must be off there
            store, at = self._remote(name)
            with store.open_output_stream(at) as out:
                out.write(text.encode())
        return held or text

    def read(self, name: str) -> str | None:
        try:
            if self.local:
                with open(f"{self.folder}/{name}") as f:
                    return f.read()
            store, at = self._remote(name)
            with store.open_input_stream(at) as held:
                return held.read().decode()
        except FileNotFoundError:
            return None

    def drop(self, name: str) -> None:
        if self.local:
            import shutil

            shutil.rmtree(f"{self.folder}/{name}", ignore_errors=True)
        else:
            store, at = self._remote(name)
            store.delete_dir_contents(at, missing_dir_ok=True)


class ShardReader:
    """Reads one shard on from a sequence number. An iterator that has expired is replaced by one after the last record read."""

    def __init__(self, client, shard: str, after: str | None) -> None:
        self.client, self.shard, self.after = client, shard, after
        self.iterator: str | None = None
        self.ended = False

    def _call(self, f, *args):
        def go():
            try:
                return f(*args)
            except Exception as e:
                code = getattr(e, "code", type(e).__name__)
                if code in TERMINAL_CODES:
                    raise TerminalError(str(e)) from e
                if code == EXPIRED:
                    return EXPIRED
                raise

        return with_retries(go)

    def page(self, limit: int) -> list[dict]:
        """The next records, none if there are none now."""
        while not self.ended:
            if self.iterator is None:
                self.iterator = self._call(self.client.get_shard_iterator, self.shard, self.after)
            got = self._call(self.client.get_records, self.iterator, limit)
            if got == EXPIRED:
                self.iterator = None
                continue
            records, self.iterator = got
            self.ended = self.iterator is None
            if records:
                self.after = records[-1]["sequence_number"]
            return records
        return []


class _ShardRead(InputPartition):
    def __init__(self, shard: str, after: str | None, claim: str) -> None:
        super().__init__(shard)
        self.shard, self.after, self.claim = shard, after, claim


class _Stream(DataSourceStreamReader):
    """Offset: {"n": number of the read, "from": {shard: {"at": last sequence number before it or None, "done": bool}}}."""

    def __init__(self, options: dict) -> None:
        self.options, self.batch = options, int(options.get("batch", 10_000))
        self.seconds, self.poll, self.discovery = (float(options.get(k, v)) for k, v in (("seconds", 30), ("poll", 1), ("discoveryInterval", 10)))
        self.progress = Progress(options["progress"])
        self.begin = json.loads(options["startOffset"]) if "startOffset" in options else None
        self.end: dict | None = None
        self.asked = False
        self.idle_until = self.listed_at = float("-inf")
        self.listed: list[Shard] = []

    def _client(self):
        module, _, name = self.options.get("client", "weirflow.sources.kinesis:boto3_client").partition(":")
        return getattr(importlib.import_module(module), name)(dict(self.options))

    def _shards(self, now: bool) -> list[Shard]:
        """All shards there are, page by page; asked for again after the discovery interval, or now."""
        if now or time.monotonic() - self.listed_at >= self.discovery:
            client, token, found = self._client(), None, []
            while True:
                page, token = with_retries(lambda: client.list_shards(token))  # noqa: B023
                found += [Shard(s.shard_id, s.start, s.end, list(s.parents)) for s in page]
                if not token:
                    break
            self.listed, self.listed_at = found, time.monotonic()
        return self.listed

    def _claims(self, offset: dict) -> tuple[dict, bool, bool]:
        """(positions after a read, whether it read anything, whether a shard has ended in it)."""
        at, read, ended = dict(offset["from"]), False, False
        for shard, p in offset["from"].items():
            held = None if p["done"] else self.progress.read(f"{offset['n']}/{shard}")
            if held is not None:
                at[shard] = json.loads(held)
                read, ended = read or at[shard] != p, ended or at[shard]["done"]
        return at, read, ended

    def initialOffset(self):
        return {"n": 0, "from": {}}

    def latestOffset(self):
        if self.end is None:
            at, read, ended, n = {}, True, True, 0
            if self.begin is not None:
                at, n = self._claims(self.begin)[0], self.begin["n"]
        else:
            if time.monotonic() < self.idle_until:
                return self.end
            at, read, ended = self._claims(self.end)
            n = self.end["n"]
            if self.asked and not read and self.idle_until == float("-inf"):
                # nothing came of this reader's last read: the query may rest before the shards are looked at again
                self.idle_until = time.monotonic() + self.poll
                return self.end
        self.idle_until = float("-inf")
        shards = self._shards(ended)
        known = {s.shard_id for s in shards}
        at = {s: p for s, p in at.items() if s in known or not p["done"]}
        tracker = ShardTracker(shards)
        tracker.finish([s for s, p in at.items() if p["done"]])
        for shard in tracker.available():
            at.setdefault(shard.shard_id, {"at": None, "done": False})
        self.end, self.asked = {"n": n + 1, "from": at}, True
        return self.end

    def partitions(self, start, end):
        self.end = end if self.end is None or end["n"] > self.end["n"] else self.end
        if start == end:
            return []
        return [_ShardRead(s, p["at"], f"{end['n']}/{s}") for s, p in end["from"].items() if not p["done"]]

    def read(self, partition):
        reader = ShardReader(self._client(), partition.shard, partition.after)
        held = self.progress.read(partition.claim)
        records: list[dict] = []
        if held is None:
            until, empty = time.monotonic() + self.seconds, 0
            while not reader.ended and len(records) < self.batch and empty < EMPTY_PAGES and time.monotonic() < until:
                page = reader.page(self.batch - len(records))
                empty = 0 if page else empty + 1
                records += page
            held = self.progress.claim(partition.claim, json.dumps({"at": reader.after, "done": reader.ended}))
        last = json.loads(held)["at"]
        if last == partition.after:
            return
        while True:
            for r in records:
                yield partition.shard, r["sequence_number"], r["partition_key"], r["data"], r["timestamp"]
                if r["sequence_number"] == last:
                    return
            # another task claimed more, or this one is a repetition
            records = reader.page(self.batch)
            if not records and reader.ended:
                raise TerminalError(f"{partition.shard}: record {last} is no longer there")

    def commit(self, end):
        self.progress.drop(str(end["n"] - 2))


class KinesisSource(DataSource):
    @classmethod
    def name(cls):
        return "kinesis"

    def schema(self):
        return "shard_id string, sequence_number string, partition_key string, value binary, ts timestamp"

    def streamReader(self, schema):
        check_arn(self.options.get("streamArn", ""))
        if not self.options.get("progress"):
            raise ValueError("progress must name a folder that driver and executors share, one for each checkpoint")
        return _Stream(dict(self.options))


def boto3_client(options: dict):
    """The service's own client, where its library is installed. Options: streamArn, endpoint, region."""
    try:
        import boto3
    except ImportError as e:
        raise TerminalError("boto3 isn't installed; name another client") from e
    return _Boto3(boto3.client("kinesis", endpoint_url=options.get("endpoint"), region_name=options.get("region")), options["streamArn"])


class _Boto3:
    def __init__(self, service, arn: str) -> None:
        self.service, self.arn = service, arn

    def _ask(self, name: str, **args) -> dict:
        try:
            return getattr(self.service, name)(**args)
        except Exception as e:
            code = getattr(e, "response", {}).get("Error", {}).get("Code")
            if code is None:
                raise
            raise _named(code)(str(e)) from e

    def list_shards(self, next_token):
        answer = self._ask("list_shards", **({"NextToken": next_token} if next_token else {"StreamARN": self.arn}))
        parents = lambda s: [p for p in (s.get("ParentShardId"), s.get("AdjacentParentShardId")) if p]
        shards = [Shard(s["ShardId"], int(s["HashKeyRange"]["StartingHashKey"]), int(s["HashKeyRange"]["EndingHashKey"]), parents(s)) for s in answer["Shards"]]
        return shards, answer.get("NextToken")

    def get_shard_iterator(self, shard_id, after):
        place = {"ShardIteratorType": "TRIM_HORIZON"} if after is None else {"ShardIteratorType": "AFTER_SEQUENCE_NUMBER", "StartingSequenceNumber": after}
        return self._ask("get_shard_iterator", StreamARN=self.arn, ShardId=shard_id, **place)["ShardIterator"]

    def get_records(self, iterator, limit):
        answer = self._ask("get_records", StreamARN=self.arn, ShardIterator=iterator, Limit=limit)
        records = [{"sequence_number": r["SequenceNumber"], "partition_key": r["PartitionKey"], "data": r["Data"], "timestamp": r["ApproximateArrivalTimestamp"]} for r in answer["Records"]]
        return records, answer.get("NextShardIterator")


def _named(code: str) -> type[Exception]:
    return type(code, (Exception,), {"code": code})
