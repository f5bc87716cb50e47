import json
import os

import pytest
from harness import SF, assert_same
from pyspark.sql import functions as F

from weirflow import handlers, interp
from weirflow.config import Connector, JobConfig
from weirflow.plans import replays
from weirflow.streaming import processor, savepoint
from weirflow.streaming.job import Job


@pytest.mark.parametrize("name", list(replays.QUERIES))
def test_stream_gives_the_batch_rows(spark, name):
    assert assert_same(replays.QUERIES[name](spark, SF), replays.SQL[name]) > 0


def user_event(ms):
    return json.dumps({"UserID": "user-1", "Timestamp": f"1970-01-01T00:00:00.{ms:03d}Z"}).encode()


def slide(key, time):
    return json.dumps({"key": key, "timestamp": f"2025-01-01T{time}Z"}).encode()


class Replay:
    """A folder of steps, each one micro-batch of raw records with the largest time so far."""

    def __init__(self, spark, path, handler):
        self.spark, self.path, self.handler, self.n, self.top = spark, str(path), handler, 0, 0

    def step(self, *records):
        rows = []
        for r in records:
            self.top = max([self.top, *(e.ts_us for e in self.handler.key_events(r))])
            rows.append((bytearray(r), self.n * 1000 + len(rows), self.top))
        df = self.spark.createDataFrame(rows, "value binary, arrival long, wm long").withColumn("wm_ts", F.timestamp_micros("wm")).drop("wm")
        df.coalesce(1).write.mode("append").parquet(self.path)
        self.n += 1
        return self

    def stream(self):
        return self.spark.readStream.schema("value binary, arrival long, wm_ts timestamp").option("maxFilesPerTrigger", 1).parquet(self.path)


def run(spark, handler, replay, checkpoint, name, from_savepoint=None):
    job = Job(handler, JobConfig(Connector("stdio"), Connector("memory"), key_groups=2))
    q = job.start(spark, replay.stream(), checkpoint=str(checkpoint), from_savepoint=from_savepoint, name=name)
    q.awaitTermination()
    # a memory sink can't be recovered: every run has its own table
    return job, [bytes(r.value) for r in spark.table(name).collect()]


def test_count_window_and_restart(spark, tmp_path):
    h = handlers.CountWindow()
    counts = lambda sent: [json.loads(s)["Count"] for s in sent]
    events = [user_event(ms) for ms in (1, 2, 3, 4, 5, 6, 100)]
    assert counts(interp.run(h, events)) == counts(interp.run(h, events, every=99)) == [2, 2, 2, 0]
    whole = Replay(spark, tmp_path / "a", h).step(*events)
    assert counts(run(spark, h, whole, tmp_path / "ca", "whole")[1]) == [2, 2, 2, 0]


def test_restart_from_checkpoint_and_savepoint(spark, tmp_path):
    h = handlers.CountWindow()
    out = tmp_path / "out"
    replay = Replay(spark, tmp_path / "in", h).step(*[user_event(ms) for ms in (1, 2, 3)])
    job = Job(h, JobConfig(Connector("stdio"), Connector("memory"), key_groups=2))

    def go(checkpoint):
        q = job.results(replay.stream()).writeStream.option("checkpointLocation", str(checkpoint)).format("parquet").option("path", str(out)).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    got = lambda: sorted(json.loads(bytes(r.value))["Count"] for r in spark.read.parquet(f"{out}/*.parquet").collect())
    q = go(tmp_path / "c1")
    first = got()
    saved = savepoint.create(q, str(tmp_path / "c1"), str(tmp_path / "saved"))
    replay.step(*[user_event(ms) for ms in (4, 5, 6, 100)])
    go(tmp_path / "c1")
    assert got() == [0, 2, 2, 2] and len(first) < 4
    assert savepoint.newest(spark, str(tmp_path / "c1")) > savepoint.newest(spark, saved) >= 0
    # the savepoint goes on from the third event, into a folder of its own
    out = tmp_path / "again"
    savepoint.restore(spark, saved, str(tmp_path / "c2"))
    go(tmp_path / "c2")
    assert got() == [0, 2, 2, 2][: 4 - len(first)] or sorted(first + got()) == [0, 2, 2, 2]
    with pytest.raises(FileExistsError):
        savepoint.restore(spark, saved, str(tmp_path / "c2"))


SLIDING = [
    [slide("user1", "10:00:00"), slide("user1", "10:00:01"), slide("user1", "10:01:00"), slide("user1", "10:01:01")],
    [slide("user2", "10:30:00")],
    [slide("user2", "11:00:00")],
]


def ends(sent, key="user1"):
    return [(r["interval"][-9:-4], r["sum"]) for r in map(json.loads, sent) if r["key"] == key]


def test_sliding_window(spark, tmp_path):
    h = handlers.SlidingWindow()
    i, top = interp.Interpreter(h), 0
    for step in SLIDING:
        for r in step:
            top = max([top, *(e.ts_us for e in i.raw(r))])
            i.watermark(top - 1)
    assert ends(i.sent)[:3] == [("10:01", 2), ("10:02", 4), ("10:30", 4)]
    replay = Replay(spark, tmp_path / "in", h)
    for step in SLIDING:
        replay.step(*step)
    _, sent = run(spark, h, replay, tmp_path / "c", "sliding")
    assert ends(sent)[:3] == [("10:01", 2), ("10:02", 4), ("10:30", 4)]


def test_late_events_are_kept(spark, tmp_path):
    h = handlers.RunningCount()

    class Counted(handlers.RunningCount):
        def key_events(self, raw):
            r = json.loads(raw)
            return [handlers.KeyedEvent(r["UserID"], handlers.parse_time(r["Timestamp"]), raw)]

    h = Counted()
    replay = Replay(spark, tmp_path / "in", h).step(user_event(900)).step(user_event(1), user_event(2))
    assert [json.loads(s)["Sum"] for s in run(spark, h, replay, tmp_path / "c", "late")[1]] == [1, 2, 3]


def test_running_sum_over_savepoint():
    one = (1).to_bytes(8, "big")
    first, second = interp.Interpreter(handlers.RunningSum()), interp.Interpreter(handlers.RunningSum())
    for _ in range(2):
        first.raw(one)
    second.restore(first.snapshot())
    for _ in range(2):
        second.raw(one)
    assert [int.from_bytes(s, "big") for s in first.sent + second.sent] == [1, 2, 3, 4]
    first.raw(b"")
    assert int.from_bytes(first.sent[-1], "big") == 2


def test_rescale_from_one_to_two_and_back():
    one = lambda k: handlers.KeyedEvent(k, 0, (1).to_bytes(8, "big"))
    whole = interp.Interpreter(handlers.RunningSum())
    for k in "abcd":
        whole.event(one(k))
    parts = [interp.Interpreter(handlers.RunningSum()) for _ in range(2)]
    for n, p in enumerate(parts):
        p.restore(whole.snapshot(), owns=lambda k: ord(k) % 2 == n)
        assert set(p.state) == {k for k in "abcd" if ord(k) % 2 == n}
    parts[0].event(one("b"))
    merged = interp.Interpreter(handlers.RunningSum())
    merged.restore(*(p.snapshot() for p in parts))
    merged.event(one("b"))
    assert int.from_bytes(merged.sent[-1], "big") == 3


def test_timers():
    class Log(handlers.Handler):
        def on_event(self, subject, event):
            subject.set_timer(int(event.value))

        def on_timer(self, subject, ts_us):
            subject.send(f"{subject.key}{ts_us}")

    i = interp.Interpreter(Log(), ("sr1", "sr2"))
    for key, t in (("a", 30), ("a", 10), ("b", 20), ("a", 10)):
        i.event(handlers.KeyedEvent(key, 0, str(t).encode()))
    i.watermark(25, "sr1")
    assert i.sent == []
    i.watermark(20, "sr2")
    assert i.sent == [b"a10", b"b20"]
    i.event(handlers.KeyedEvent("a", 0, b"20"))
    i.watermark(40, "sr1"), i.watermark(40, "sr2")
    assert i.sent == [b"a10", b"b20", b"a30"]


def test_cumulative_count_and_test_run():
    h = handlers.CumulativeCount()
    at = lambda s: json.dumps({"Timestamp": f"1970-01-01T00:00:{s}Z"}).encode()
    assert [json.loads(s)["Sum"] for s in interp.run(h, [at("00.5"), at("01"), at("01.2"), at("05")])] == [3, 4]  # counts events that came before the watermark passed the second
    t = interp.TestRun(handlers.CountWindow())
    for ms in (1, 2):
        t.add_event(handlers.KeyedEvent("u", ms * 1000, user_event(ms)))
    t.add_watermark()
    assert [json.loads(s)["Count"] for s in t.run().sent] == [2]


def test_command_line(tmp_path):
    import base64
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    commands = [{"event": {"key": "u", "ts_us": 1000, "value": base64.b64encode(user_event(1)).decode()}}, {"event": {"key": "u", "ts_us": 2000, "value": ""}}, {"watermark": True}, {"run": True}]
    r = subprocess.run([sys.executable, "-m", "weirflow", "testrun", "--handler", "weirflow.handlers:CountWindow"], input="\n".join(map(json.dumps, commands)), capture_output=True, text=True, cwd=root, timeout=120)
    first = json.loads(r.stdout.splitlines()[0])
    assert json.loads(base64.b64decode(first["sent"])) == {"UserID": "u", "Count": 2}
    assert "weirflow" in subprocess.run([sys.executable, "-m", "weirflow", "version"], capture_output=True, text=True, cwd=root, timeout=120).stdout


ONE = (1).to_bytes(8, "big")


def sums(spark, out):
    return sorted(int.from_bytes(bytes(r.value), "big") for r in spark.read.schema("key string, value binary").parquet(str(out)).collect())


def sum_job(path, groups=2):
    return Job(handlers.RunningSum(), JobConfig(Connector("stdio"), Connector("parquet", options={"path": str(path)}), key_groups=groups))


def test_restart_without_a_checkpoint_reads_again(spark, tmp_path):
    replay = Replay(spark, tmp_path / "in", handlers.RunningSum()).step(ONE, ONE)
    for k in range(2):
        # a folder of its own, as a file sink takes a second batch 0 for the first one again
        sum_job(tmp_path / f"out{k}").start(spark, replay.stream(), checkpoint=str(tmp_path / f"c{k}")).awaitTermination()
    assert sums(spark, tmp_path / "out0") + sums(spark, tmp_path / "out1") == [1, 2, 1, 2]  # at least once


def test_savepoint_of_a_running_job_and_other_key_groups(spark, tmp_path):
    replay = Replay(spark, tmp_path / "in", handlers.RunningSum()).step(*[ONE] * 10)
    job = sum_job(tmp_path / "out")
    q = job.start(spark, replay.stream(), checkpoint=str(tmp_path / "c"), once=False)
    try:
        q.processAllAvailable()
        saved = job.create_savepoint(str(tmp_path / "saved"))
        assert q.isActive
        replay.step(*[ONE] * 10)
        q.processAllAvailable()
    finally:
        q.stop()
    assert sums(spark, tmp_path / "out")[-1] == 20
    # the same groups go on from the savepoint's place in the input, in a folder of their own
    got = []
    savepoint.restore(spark, saved, str(tmp_path / "c2"))
    with processor.settings(spark, 2):
        again = job.results(replay.stream()).writeStream.option("checkpointLocation", str(tmp_path / "c2")).foreachBatch(lambda df, _: got.extend(int.from_bytes(bytes(r.value), "big") for r in df.collect()))
        again.trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == list(range(11, 21))
    # from two groups to one and to three; a folder of files can't be told where to begin, so the rest comes by itself
    rest = Replay(spark, tmp_path / "rest", handlers.RunningSum()).step(*[ONE] * 10)
    for groups in (1, 3):
        out = tmp_path / f"groups{groups}"
        sum_job(out, groups).start(spark, rest.stream(), checkpoint=str(tmp_path / f"g{groups}"), from_savepoint=saved).awaitTermination()
        assert sums(spark, out) == list(range(11, 21))
        assert savepoint.offsets(spark, str(tmp_path / f"g{groups}"))[0] == groups
    # and once more, from three to two
    last = Replay(spark, tmp_path / "last", handlers.RunningSum()).step(*[ONE] * 10)
    sum_job(tmp_path / "two").start(spark, last.stream(), checkpoint=str(tmp_path / "t"), from_savepoint=str(tmp_path / "g3")).awaitTermination()
    assert sums(spark, tmp_path / "two")[-1] == 30


def test_rescaled_source_goes_on_from_its_offset(spark, tmp_path):
    sums_of = lambda spark, out: sorted(int(bytes(r.value)) for r in spark.read.schema("key string, value binary").parquet(str(out)).collect())

    class Number(handlers.Handler):
        def key_events(self, raw):
            return [handlers.KeyedEvent(raw.decode()[-1], 0, raw)]

        def on_event(self, subject, event):
            subject.send(event.value)

    def go(groups, **more):
        job = Job(Number(), JobConfig(Connector("embedded", options={"splitCount": 2, "batchSize": 5}), Connector("parquet", options={"path": str(tmp_path / f"out{groups}")}), key_groups=groups))
        q = job.start(spark, once=False, **more)
        while (q.lastProgress or {"batchId": -1})["batchId"] < 1:
            q.awaitTermination(1)
            assert q.exception() is None
        q.stop()
        return job

    first = go(2, checkpoint=str(tmp_path / "a"))
    go(3, checkpoint=str(tmp_path / "b"), from_savepoint=first.create_savepoint(str(tmp_path / "s")))
    one, two = (sums_of(spark, tmp_path / f"out{g}") for g in (2, 3))
    assert one == list(range(len(one))) and two == list(range(two[0], two[0] + len(two))) and 0 < two[0] <= len(one) and len(two) >= 20


def test_entries_are_one_state_in_both_engines(spark, tmp_path):
    class Book(handlers.Handler):
        """Commands: put NS KEY VALUE, del NS KEY, list NS."""

        state = {"a": handlers.LongCodec(), "b": handlers.JsonCodec()}

        def key_events(self, raw):
            return [handlers.KeyedEvent("k", 0, raw)]

        def on_event(self, subject, event):
            what, ns, *rest = event.value.decode().split()
            if what == "put":
                subject.put(ns, rest[0].encode(), int(rest[1]) if ns == "a" else [int(rest[1])])
            elif what == "del":
                subject.delete(ns, rest[0].encode())
            else:
                subject.send(repr(subject.entries(ns)))

    steps = [["put a x 1", "put a y 2", "put b x 7", "list a"], ["del a x", "list a", "put a x 5", "put a z 9", "del a z"], ["list a", "list b", "del a y", "del a x", "del b x", "list a"]]
    i = interp.Interpreter(Book())
    for s in steps:
        for c in s:
            i.raw(c.encode())
    want = [x.decode() for x in i.sent]
    assert want == ["[(b'x', 1), (b'y', 2)]", "[(b'y', 2)]", "[(b'x', 5), (b'y', 2)]", "[(b'x', [7])]", "[]"] and i.state["k"] == {}
    replay = Replay(spark, tmp_path / "in", Book())
    for s in steps:
        replay.step(*[c.encode() for c in s])
    assert [x.decode() for x in run(spark, Book(), replay, tmp_path / "c", "book")[1]] == want
    with pytest.raises(ValueError, match="255"):
        i._call("k", lambda s: s.put("n" * 256, 1))


def test_a_log_is_written_anew_when_it_has_grown(spark, tmp_path):
    replay = Replay(spark, tmp_path / "in", handlers.RunningSum())
    for _ in range(25):
        replay.step(ONE)
    _, sent = run(spark, handlers.RunningSum(), replay, tmp_path / "c", "grown")
    assert int.from_bytes(sent[-1], "big") == 25
    pages = savepoint.state_of(spark, str(tmp_path / "c")).first().log
    assert len(pages) <= 18


def test_metrics(spark, tmp_path):
    from weirflow.streaming.metrics import Metrics

    metrics = Metrics()
    spark.streams.addListener(metrics)
    try:
        replay = Replay(spark, tmp_path / "in", handlers.RunningSum()).step(ONE, ONE)
        run(spark, handlers.RunningSum(), replay, tmp_path / "c", "measured")
        import time

        until = time.time() + 20
        while time.time() < until and metrics.get("weirflow_queries_active") > 0 or metrics.get("weirflow_batches_total", 'query="measured"') < 1:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(metrics)
    assert metrics.get("weirflow_rows_total", 'query="measured"') == 2 and metrics.get("weirflow_queries_active") == 0
    text = metrics.text()
    assert 'weirflow_batch_seconds_bucket{query="measured",part="addBatch",le="+Inf"}' in text and "# TYPE weirflow_batch_seconds histogram" in text


def test_topology(spark, tmp_path):
    from weirflow.config import ConfigError
    from weirflow.streaming.job import Topology

    t = Topology(key_groups=2)
    source = t.new_source("in", "stdio", key_event=lambda raw: [handlers.KeyedEvent("all", 0, raw)])
    operator = t.new_operator("sum", lambda node: handlers.RunningSum())
    sink = t.new_sink("out", "parquet", path=str(tmp_path / "out"))
    with pytest.raises(ConfigError, match="must be connected"):
        t.job()
    source.connect(operator).connect(sink)
    with pytest.raises(ConfigError, match="connected already"):
        source.connect(operator)
    with pytest.raises(ConfigError, match="can't be connected"):
        source.connect(sink)
    job = t.job()
    replay = Replay(spark, tmp_path / "in", job.handler).step(ONE, ONE, ONE)
    job.start(spark, replay.stream(), checkpoint=str(tmp_path / "c")).awaitTermination()
    assert sums(spark, tmp_path / "out") == [1, 2, 3] and {r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"all"}
    with pytest.raises(ConfigError, match="exactly one sink"):
        Topology().job()


def test_savepoint_command(spark, tmp_path, capsys):
    from weirflow import __main__ as cli

    replay = Replay(spark, tmp_path / "in", handlers.RunningSum()).step(ONE)
    sum_job(tmp_path / "out").start(spark, replay.stream(), checkpoint=str(tmp_path / "c")).awaitTermination()
    cli.main(["savepoint", str(tmp_path / "c"), str(tmp_path / "saved")])
    saved = capsys.readouterr().out.strip()
    assert savepoint.newest(spark, saved) == savepoint.newest(spark, str(tmp_path / "c")) >= 0
    with pytest.raises(FileNotFoundError):
        savepoint.save(spark, str(tmp_path / "nothing"), str(tmp_path / "saved"), wait=0.1)


def test_the_slowest_of_two_streams_holds_timers_back(spark, tmp_path):
    class Alarm(handlers.Handler):
        """Sends a timer's time when it fires."""

        def on_event(self, subject, event):
            subject.set_timer(event.ts_us + 1_000_000)

        def on_timer(self, subject, ts_us):
            subject.send(str(ts_us // 1_000_000))

    def put(name, *seconds):
        rows = [("k", t * 1_000_000, bytearray(b"")) for t in seconds]
        spark.createDataFrame(rows, "key string, ts_us long, value binary").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    got = []
    put("a", 10, 20, 30, 100), put("b", 15)
    streams = [spark.readStream.schema("key string, ts_us long, value binary").parquet(str(tmp_path / n)) for n in "ab"]
    with processor.settings(spark, 2):
        q = processor.process(streams, Alarm()).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: got.extend(int(bytes(r.value)) for r in df.collect())).start()
    try:
        q.processAllAvailable()
        assert sorted(got) == [11]  # the other stream is at 100
        put("b", 40)
        q.processAllAvailable()
        assert sorted(got) == [11, 16, 21, 31]
    finally:
        q.stop()
