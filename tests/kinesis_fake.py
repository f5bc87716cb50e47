"""A stream of shards in a JSON file, so that every process sees the same one."""

import hashlib
import json
from datetime import datetime, timezone
from types import SimpleNamespace

from weirflow.sources.kinesis import HASH_KEYS


class Fake:
    def __init__(self, path):
        self.path = path

    def load(self):
        with open(self.path) as f:
            return json.load(f)

    def save(self, s):
        with open(self.path, "w") as f:
            json.dump(s, f)

    def create(self, n):
        borders = [HASH_KEYS * i // n for i in range(n + 1)]
        self.save({"next": 1, "shards": [{"id": f"shardId-{i:012d}", "start": str(a), "end": str(z - 1), "parents": [], "open": True, "records": []} for i, (a, z) in enumerate(zip(borders, borders[1:]))]})

    def put(self, key, data):
        s = self.load()
        at = int(hashlib.md5(key.encode()).hexdigest(), 16)
        shard = next(x for x in s["shards"] if x["open"] and int(x["start"]) <= at <= int(x["end"]))
        shard["records"].append([f"{s['next']:020d}", key, data])
        s["next"] += 1
        self.save(s)

    def _reshard(self, parents, spans):
        s = self.load()
        for x in s["shards"]:
            if x["id"] in parents:
                x["open"] = False
        for a, z in spans:
            s["shards"].append({"id": f"shardId-{len(s['shards']):012d}", "start": str(a), "end": str(z), "parents": list(parents), "open": True, "records": []})
        self.save(s)

    def split(self, shard_id):
        x = next(x for x in self.load()["shards"] if x["id"] == shard_id)
        a, z = int(x["start"]), int(x["end"])
        self._reshard([shard_id], [(a, (a + z) // 2), ((a + z) // 2 + 1, z)])

    def merge(self, one, two):
        by = {x["id"]: x for x in self.load()["shards"]}
        self._reshard([one, two], [(min(int(by[i]["start"]) for i in (one, two)), max(int(by[i]["end"]) for i in (one, two)))])

    def list_shards(self, next_token):
        """Three shards a page."""
        shards, first = self.load()["shards"], int(next_token or 0)
        page = [SimpleNamespace(shard_id=x["id"], start=int(x["start"]), end=int(x["end"]), parents=x["parents"]) for x in shards[first : first + 3]]
        self.count("list")
        return page, str(first + 3) if first + 3 < len(shards) else None

    def count(self, what):
        """Calls so far, over all processes."""
        with open(f"{self.path}.{what}", "a") as f:
            f.write("x")
            return f.tell()

    def get_shard_iterator(self, shard_id, after):
        self.count("iterators")
        return f"{shard_id}/{after or ''}"

    def get_records(self, iterator, limit):
        """Every fifth call finds its iterator expired, every seventh the service busy."""
        n = self.count("reads")
        if n % 5 == 0:
            raise Coded("ExpiredIteratorException")
        if n % 7 == 0:
            raise Coded("ProvisionedThroughputExceededException")
        shard_id, _, after = iterator.partition("/")
        x = next(x for x in self.load()["shards"] if x["id"] == shard_id)
        rest = [r for r in x["records"] if not after or r[0] > after]
        page = [{"sequence_number": n, "partition_key": k, "data": d.encode(), "timestamp": datetime(2025, 1, 1, tzinfo=timezone.utc)} for n, k, d in rest[:limit]]
        ended = not x["open"] and len(rest) <= limit
        return page, None if ended else f"{shard_id}/{page[-1]['sequence_number'] if page else after}"


class Coded(Exception):
    def __init__(self, code):
        super().__init__(code)
        self.code = code


def client(options):
    return Fake(options["path"] if "path" in options else options["Path"])


def denied(options):
    f = Fake(options["path"] if "path" in options else options["Path"])
    f.get_records = lambda *_: (_ for _ in ()).throw(Coded("AccessDeniedException"))
    return f
