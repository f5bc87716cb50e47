import base64
import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from kinesis_fake import Fake

from weirflow import config, handlers, registry
from weirflow.config import Connector, JobConfig
from weirflow.sources import kafka, kinesis, retry, stdio
from weirflow.streaming.job import Job

ARN = "arn:aws:kinesis:us-east-1:123456789012:stream/events"


@pytest.fixture
def service():
    """Topics over HTTP: GET a page from a cursor on, POST a list of payloads."""
    topics: dict[str, list[str]] = {}

    class Serve(BaseHTTPRequestHandler):
        page_size, bounded, posts = 2, True, []

        def do_GET(self):
            _, _, topic, cursor = self.path.split("/")
            page = topics.get(topic, [])[int(cursor) : int(cursor) + self.page_size]
            after = int(cursor) + len(page)
            ended = self.bounded and after >= len(topics.get(topic, []))
            body = json.dumps({"Events": page, "Status": "eoi" if ended else "more", "Cursor": after}).encode()
            self.send_response(404 if topic == "gone" else 200)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.posts.append(len(sent))
            topics.setdefault(self.path.split("/")[2], []).extend(sent)
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Serve)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    topics_of = type("Topics", (dict,), {"serve": Serve})
    topics = topics_of()
    yield f"http://127.0.0.1:{server.server_port}", topics
    server.shutdown()


def encoded(*values):
    return [base64.b64encode(v.encode()).decode() for v in values]


def test_httpapi_source_batch_and_stream(spark, service, tmp_path):
    addr, topics = service
    registry.register(spark)
    topics["in"] = encoded("a", "b", "c", "d", "e")
    read = spark.read.format("httpapi").option("addr", addr).option("topic", "in")
    assert [bytes(r.value) for r in read.load().collect()] == [b"a", b"b", b"c", b"d", b"e"]

    def go():
        stream = spark.readStream.format("httpapi").option("addr", addr).option("topic", "in").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(bytes(r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert go() == [b"a", b"b", b"c", b"d", b"e"]
    topics["in"] += encoded("f")
    assert go() == [b"a", b"b", b"c", b"d", b"e", b"f"]
    with pytest.raises(Exception, match="exactly one topic"):
        spark.read.format("httpapi").option("addr", addr).load().collect()
    with pytest.raises(retry.TerminalError):
        from weirflow.sources.httpapi import fetch

        fetch(addr, "gone", 0)


def test_job_from_http_to_http(spark, service, tmp_path):
    addr, topics = service
    topics["events"] = [base64.b64encode((n).to_bytes(8, "big")).decode() for n in (1, 1, 2)]
    text = json.dumps({"job": {"keyGroupCount": 2}, "sources": [{"id": "in", "httpApi": {"addr": {"param": "ADDR"}, "topics": ["events"]}}], "sinks": [{"id": "out", "httpApi": {"addr": {"value": addr}}}]})

    class Sums(handlers.RunningSum):
        def on_event(self, subject, event):
            super().on_event(subject, event)
            subject.sent[-1] = json.dumps({"Topic": "sums", "Data": base64.b64encode(subject.sent[-1]).decode()}).encode()

    job = Job.from_json(Sums(), text, {"ADDR": addr})
    assert config.load(job.to_json()) == job.conf
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        q = job.start(spark, checkpoint=str(tmp_path / "c"), once=False)
        q.processAllAvailable()
        saved = job.create_savepoint(str(tmp_path / "saved"))
        assert q.isActive
    finally:
        job.query.stop()
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sorted(int.from_bytes(base64.b64decode(x), "big") for x in topics["sums"]) == [1, 2, 4]
    assert saved.startswith(str(tmp_path / "saved"))


def test_http_source_without_an_end_and_other_pages(spark, service, tmp_path):
    addr, topics = service
    registry.register(spark)
    topics.serve.page_size, topics.serve.bounded = 3, False
    topics["in"] = encoded(*"abcdefg")
    read = spark.read.format("httpapi").option("addr", addr).option("topic", "in").load()
    assert [bytes(r.value).decode() for r in read.collect()] == list("abcdefg")
    q = spark.readStream.format("httpapi").option("addr", addr).option("topic", "in").load().writeStream.format("memory").queryName("without_end").start()
    q.processAllAvailable()
    topics["in"] += encoded("h")
    q.processAllAvailable()
    q.stop()
    assert sorted(bytes(r.value).decode() for r in spark.table("without_end").collect()) == list("abcdefgh")


def test_http_sink_sends_lists(spark, service):
    addr, topics = service
    registry.register(spark)
    rows = [(json.dumps({"Topic": "x" if k < 7 else "y", "Data": encoded(str(k))[0]}),) for k in range(10)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.format("httpapi-sink").mode("append").option("addr", addr).option("batch", 5).save()
    assert topics["x"] == encoded(*"0123456") and topics["y"] == encoded(*"789") and topics.serve.posts == [5, 2, 3]


def test_http_sink_needs_a_topic(spark, service):
    from weirflow.sinks.httpapi import post

    with pytest.raises(ValueError, match="no topic"):
        post(service[0], json.dumps({"Data": ""}))


def test_embedded(spark):
    registry.register(spark)
    batch = spark.read.format("embedded").option("splits", 2).option("batch", 3).option("reads", 2).load()
    assert sorted((r.split_no, int(r.value)) for r in batch.collect()) == [(0, n) for n in (0, 2, 4, 6, 8, 10)] + [(1, n) for n in (1, 3, 5, 7, 9, 11)]
    q = spark.readStream.format("embedded").option("splits", 2).option("batch", 3).load().writeStream.format("memory").queryName("embedded_numbers").start()
    while (q.lastProgress or {"batchId": 0})["batchId"] < 2:
        q.awaitTermination(1)
        assert q.exception() is None
    q.stop()
    got = sorted(int(r.value) for r in spark.table("embedded_numbers").collect())
    assert got == list(range(len(got))) and len(got) >= 12


def kinesis_stream(spark, fake, progress, **more):
    return spark.readStream.format("kinesis").options(streamArn=ARN, client="kinesis_fake:client", path=fake.path, progress=str(progress), batch=7, poll=0.3, **more).load()


def test_kinesis_order_across_shard_lineage(spark, tmp_path):
    fake = Fake(str(tmp_path / "stream.json"))
    fake.create(2)
    registry.register(spark)
    n, batches = 0, []

    def put(count):
        nonlocal n
        for _ in range(count):
            fake.put(f"key-{n % 5}", str(n))
            n += 1

    def go():
        stream = kinesis_stream(spark, fake, tmp_path / "progress")
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, k: batches.append([(r.shard_id, r.partition_key, int(bytes(r.value)), r.sequence_number) for r in df.collect()])).start()
        q.processAllAvailable()
        q.stop()

    put(30), go()
    fake.split("shardId-000000000000"), put(30)
    fake.merge("shardId-000000000002", "shardId-000000000003"), put(30)
    go(), go()
    rows = [r for b in batches for r in b]
    assert sorted(r[2] for r in rows) == list(range(90))  # none twice, none left out, over restarts, expired iterators and a busy service
    by_key = {}
    for b in batches:
        for _, key, value, _ in sorted(b, key=lambda r: r[3]):
            by_key.setdefault(key, []).append(value)
    # in the order of micro-batches, and inside one of sequence numbers of a key's one shard
    assert all(v == sorted(v) for v in by_key.values()) and len(by_key) == 5
    assert all(len({r[0] for r in b if r[1] == key}) <= 1 for b in batches for key in by_key)
    assert max(len([r for r in b if r[0] == s]) for b in batches for s in {r[0] for r in b}) <= 7


def test_kinesis_claims_make_tasks_repeat_themselves(tmp_path):
    fake = Fake(str(tmp_path / "stream.json"))
    fake.create(1)
    for k in range(10):
        fake.put("k", str(k))
    s = kinesis._Stream({"streamArn": ARN, "client": "kinesis_fake:client", "path": fake.path, "progress": str(tmp_path / "p"), "batch": "4", "poll": "0"})
    start, end = s.initialOffset(), s.latestOffset()
    (part,) = s.partitions(start, end)
    first = [r[1] for r in s.read(part)]
    fake.put("k", "more")
    again = kinesis._Stream(s.options)
    assert [r[1] for r in again.read(part)] == first and len(first) == 4
    # a task beside it that has read less, or more, goes by the claim
    for batch in ("2", "9"):
        other = kinesis._Stream(s.options | {"batch": batch})
        assert [r[1] for r in other.read(part)] == first
    assert s.partitions(end, end) == []
    following = s.latestOffset()
    assert following["from"]["shardId-000000000000"]["at"] == first[-1]
    # a new reader that is told where the query stood goes on from there, as does one that starts at a savepoint's offset
    again.partitions(end, end)
    assert again.latestOffset() == following
    assert kinesis._Stream(s.options | {"startOffset": json.dumps(end)}).latestOffset()["from"] == following["from"]
    with pytest.raises(retry.TerminalError, match="AccessDenied"):
        list(kinesis._Stream(s.options | {"client": "kinesis_fake:denied", "progress": str(tmp_path / "q")}).read(part))
    with pytest.raises(ValueError, match="progress"):
        source = kinesis.KinesisSource({"streamArn": ARN})
        source.streamReader(None)


def test_kinesis_lists_shards_by_page_and_interval(tmp_path):
    fake = Fake(str(tmp_path / "stream.json"))
    fake.create(8)
    s = kinesis._Stream({"client": "kinesis_fake:client", "path": fake.path, "progress": str(tmp_path / "p"), "discoveryInterval": "100"})
    assert len(s._shards(False)) == 8
    calls = fake.count("list")
    s._shards(False)
    assert fake.count("list") == calls + 1  # the counter's own call only
    assert len(s._shards(True)) == 8 and fake.count("list") > calls + 3


def test_service_client_by_a_stub():
    class Service:
        def list_shards(self, **a):
            return {"Shards": [{"ShardId": "a", "HashKeyRange": {"StartingHashKey": "0", "EndingHashKey": "9"}, "ParentShardId": "p"}], "NextToken": None if "NextToken" in a else "t"}

        def get_shard_iterator(self, **a):
            return {"ShardIterator": a["ShardIteratorType"] + a.get("StartingSequenceNumber", "")}

        def get_records(self, **a):
            if a["ShardIterator"] == "bad":
                e = Exception("expired")
                e.response = {"Error": {"Code": "ExpiredIteratorException"}}
                raise e
            return {"Records": [{"SequenceNumber": "1", "PartitionKey": "k", "Data": b"d", "ApproximateArrivalTimestamp": None}]}

    c = kinesis._Boto3(Service(), ARN)
    shards, token = c.list_shards(None)
    assert (shards[0].shard_id, shards[0].end, shards[0].parents, token, c.list_shards("t")[1]) == ("a", 9, ["p"], "t", None)
    assert c.get_shard_iterator("a", None) == "TRIM_HORIZON" and c.get_shard_iterator("a", "5") == "AFTER_SEQUENCE_NUMBER5"
    assert c.get_records("x", 5) == ([{"sequence_number": "1", "partition_key": "k", "data": b"d", "timestamp": None}], None)
    with pytest.raises(Exception, match="expired") as e:
        c.get_records("bad", 5)
    assert e.value.code == kinesis.EXPIRED


def test_shard_tracker_and_assignment():
    s = kinesis.Shard
    t = kinesis.ShardTracker([s("a"), s("b"), s("c", parents=["a"]), s("d", parents=["a", "b"]), s("e", parents=["gone"])])
    assert [x.shard_id for x in t.available()] == ["a", "b", "e"]
    t.assign([t.known["a"]])
    assert [x.shard_id for x in t.available()] == ["b", "e"] and t.last == "a"
    t.finish(["a"])
    assert [x.shard_id for x in t.available()] == ["b", "c", "e"]
    t.finish(["b"])
    assert [x.shard_id for x in t.available()] == ["c", "d", "e"]
    parts = [kinesis.HASH_KEYS * i // 4 for i in range(5)]
    assert [kinesis.runner_index(a, z - 1, 2) for a, z in zip(parts, parts[1:])] == [0, 0, 1, 1]
    assert kinesis.runner_index(kinesis.HASH_KEYS - 2, kinesis.HASH_KEYS - 1, 3) == 2


def test_stdio():
    read = lambda data, d=b"\n": list(stdio.records(io.BytesIO(data), d))
    assert read(b"a\nb\nc") == [b"a", b"b", b"c"]
    assert read(b"a||b||", b"||") == [b"a", b"b"]
    assert read(b"") == [] and read(b"\n\n") == [b"", b""]
    assert read(b"x" * 65_536 + b"\ny") == [b"x" * 65_536, b"y"]
    with pytest.raises(ValueError):
        read(b"x" * 65_537 + b"\n")
    with pytest.raises(ValueError):
        read(b"a", b"")


def test_stdio_job(spark, tmp_path):
    from weirflow.sinks.stdio import write

    (tmp_path / "in").write_bytes(b"one;two;three")
    df = stdio.read_files(spark, str(tmp_path / "in"), ";")
    out = io.BytesIO()
    write(df, stream=out)
    assert sorted([out.getvalue()[i : i + 3] for i in (0, 3)]) == [b"one", b"two"] and out.getvalue() == b"onetwothree"
    assert [bytes(r.value) for r in stdio.read_stdin(spark, b";", io.BytesIO(b"a;b")).collect()] == [b"a", b"b"]


def test_retries():
    waits, left = [], [3]

    def read():
        left[0] -= 1
        if left[0]:
            raise OSError("again")
        return "done"

    assert retry.with_retries(read, sleep=waits.append) == "done" and waits == [0.1, 0.2]
    for error in (retry.TerminalError, retry.EndOfInput):
        with pytest.raises(error):
            retry.with_retries(lambda: (_ for _ in ()).throw(error()), sleep=waits.append)
    waits.clear()
    with pytest.raises(OSError):
        retry.with_retries(lambda: (_ for _ in ()).throw(OSError()), 12, waits.append)
    assert waits[-1] == 10.0


def test_config(monkeypatch):
    doc = {"job": {"workerCount": {"param": "N"}}, "sources": [{"id": "s", "kinesis": {"streamArn": {"param": "ARN"}, "endpoint": {"value": "http://localhost:1"}}}], "sinks": [{"id": "k", "httpApi": {"addr": "http://sink"}}]}
    c = config.load(json.dumps(doc), {"ARN": ARN, "N": "2"})
    assert (c.worker_count, c.source.options["streamArn"], c.source.options["endpoint"], c.sink.kind, c.key_groups) == (2, ARN, "http://localhost:1", "httpapi", 256)
    monkeypatch.setenv("WEIRFLOW_PARAM_N", "3")
    assert config.load(json.dumps(doc), {"ARN": ARN}).worker_count == 3
    monkeypatch.setenv("WEIRFLOW_PARAM_N", "")
    with pytest.raises(config.ConfigError, match='no value .* parameter "N"'):
        config.load(json.dumps(doc), {"ARN": ARN})
    with pytest.raises(config.ConfigError, match="whole number"):
        config.load(json.dumps(doc), {"ARN": ARN, "N": "many"})
    with pytest.raises(config.ConfigError, match="no connector"):
        config.load(json.dumps({"sources": [{"ftp": {}}]}))
    with pytest.raises(config.ConfigError, match="one source.*one sink"):
        config.load(json.dumps({}))
    with pytest.raises(config.ConfigError, match="name of a stream.*HTTP address"):
        config.load(json.dumps({"sources": [{"kinesis": {"streamArn": "x"}}], "sinks": [{"httpApi": {"addr": "x"}}]}))
    with pytest.raises(config.ConfigError, match="no JSON"):
        config.load("{")
    with pytest.raises(ValueError, match="brokers"):
        kafka.options([], ["t"], "g")
    assert kafka.options(["a:1", "b:2"], ["t"], "g")["kafka.bootstrap.servers"] == "a:1,b:2"
    assert JobConfig(Connector("stdio"), Connector("stdio")).key_groups == 256
