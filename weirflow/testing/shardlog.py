"""A stream of shards kept as files, as a client for the Kinesis source: <path>/shards.json and <path>/shard=<id>/*.parquet, one file for each shard with sequence_number,
partition_key, data and at_us, sorted by sequence number."""

from __future__ import annotations

import glob
import json
from bisect import bisect_right
from datetime import datetime, timedelta, timezone
from functools import lru_cache

from weirflow.sources.kinesis import Shard

PAGE = 3
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@lru_cache(maxsize=64)
def _records(path: str, shard: str) -> tuple[list[str], list[tuple[int, str]], list[tuple]]:
    """(sequence numbers, their sort keys, partition key and data and time of each)."""
    import pyarrow.parquet as pq

    found = glob.glob(f"{path}/shard={shard}/*.parquet")
    if not found:
        return [], [], []
    t = pq.ParquetFile(found[0]).read().to_pydict()
    return t["sequence_number"], [(len(n), n) for n in t["sequence_number"]], [(k, d, _EPOCH + timedelta(microseconds=us or 0)) for k, d, us in zip(t["partition_key"], t["data"], t["at_us"])]


class ShardLog:
    """Closed shards: each ends with its last record."""

    def __init__(self, path: str) -> None:
        self.path = path

    def list_shards(self, next_token):
        with open(f"{self.path}/shards.json") as f:
            shards = [Shard(s["shard_id"], int(s["start"]), int(s["end"]), s["parents"]) for s in json.load(f)]
        first = int(next_token or 0)
        return shards[first : first + PAGE], str(first + PAGE) if first + PAGE < len(shards) else None

    def get_shard_iterator(self, shard_id, after):
        return f"{shard_id}/{after or ''}"

    def get_records(self, iterator, limit):
        shard, _, after = iterator.rpartition("/")
        numbers, keys, rest = _records(self.path, shard)
        first = bisect_right(keys, (len(after), after)) if after else 0
        page = [{"sequence_number": n, "partition_key": k, "data": d, "timestamp": t} for n, (k, d, t) in zip(numbers[first : first + limit], rest[first : first + limit])]
        return page, None if first + limit >= len(numbers) else f"{shard}/{page[-1]['sequence_number']}"


def client(options: dict) -> ShardLog:
    return ShardLog(options["path"])
