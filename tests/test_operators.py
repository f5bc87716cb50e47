import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.operators import changefeed, dedup, incremental, keyed, late, rolling, sessions, skew
from weirflow.operators.events import distinct_events

MIN, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def rows(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=repr)


# --- copies of messages


def test_range_set():
    rng = np.random.default_rng(0)
    for _ in range(20):
        have, seen = dedup.RangeSet(), set()
        for _ in range(10):
            numbers = rng.integers(0, 60, 15)
            want = []
            for n in numbers.tolist():
                want.append(n not in seen)
                seen.add(n)
            assert have.accept(numbers).tolist() == want
            assert (have.lo[1:] > have.hi[:-1] + 1).all() and {n for a, z in zip(have.lo, have.hi) for n in range(a, z + 1)} == seen


def brute_repeats(data):
    best = {}
    for o, p, s in data:
        i = identity(p, s)
        if i is not None and (i not in best or o < best[i]):
            best[i] = o
    return sorted(o for o, p, s in data if identity(p, s) is not None and best[identity(p, s)] != o)


def identity(p, s):
    if p is None or s is None:
        return None
    t = s.strip().lstrip("+")
    return (p, int(t)) if t.isdigit() else (p, s.strip())


def test_repeats_against_brute_force(spark):
    rng = random.Random(1)
    spell = lambda n: rng.choice([str(n), f"{n:08d}", f" {n}", f"{n} ", f"+{n}"])
    data = []
    for o in range(6_000):
        p = "hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", "c", ""])
        s = rng.choice([spell(rng.randrange(300)), spell(rng.randrange(65_500, 65_560)), spell(10**20 + rng.randrange(5)), "x7", "", None, spell(7)])
        data.append((o, p, s))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "o long, p string, s string").repartition(5)
    marked = dedup.mark_repeats(df.withColumn("is_repeat", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("n", F.lit(2)), "p", "s", "o")
    assert sorted(r.row.o for r in marked.where("is_repeat").collect()) == brute_repeats(data)
    assert marked.count() == len(data) and marked.first().row.is_repeat == "clash"
    assert dedup.drop_repeats(df, "p", "s", "o").count() == len(data) - len(brute_repeats(data))
    assert dedup.mark_repeats(df.limit(0), "p", "s", "o").count() == 0


def test_small_batches_and_long_groups(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [(o, "p" if o % 7 else "q", str(o % 40) if o % 11 else "odd") for o in range(400)]
        df = spark.createDataFrame(data, "o long, p string, s string").repartition(3)
        assert sorted(r.row.o for r in dedup.mark_repeats(df, "p", "s", "o").where("is_repeat").collect()) == brute_repeats(data)
        ev = [("a", t * 10 * MIN) for t in range(50)] + [("b", t * 40 * MIN) for t in range(9)]
        got = rows(sessions.sessions(spark.createDataFrame(ev, "event_key string, ts_us long")))
        assert got == sorted([("a", 0, 490 * MIN, 490 * MIN, 50)] + [("b", t * 40 * MIN, t * 40 * MIN, 0, 1) for t in range(9)], key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ranges_between_runs(spark):
    schema = "o long, p string, s string"
    first = spark.createDataFrame([(0, "a", "1"), (1, "a", "2"), (2, "a", "65535"), (3, "a", "65536"), (4, "b", "odd"), (5, "a", "2")], schema)
    accepted, seen = dedup.accept_batch(first, "p", "s", "o")
    assert sorted(r.o for r in accepted.collect()) == [0, 1, 2, 3, 4]
    assert rows(seen) == sorted([("a", 1, 2, None), ("a", 65535, 65535, None), ("a", 65536, 65536, None), ("b", None, None, "odd")], key=repr)
    second = spark.createDataFrame([(6, "a", "3"), (7, "a", "02"), (8, "b", "odd"), (9, "c", "1"), (10, "b", "65536"), (11, "a", "65536")], schema)
    accepted, seen = dedup.accept_batch(second, "p", "s", "o", seen)
    assert sorted(r.o for r in accepted.collect()) == [6, 9, 10]
    assert ("a", 1, 3, None) in rows(seen) and ("b", None, None, "odd") in rows(seen) and len(rows(seen)) == 6
    accepted, again = dedup.accept_batch(second, "p", "s", "o", seen)
    assert accepted.count() == 0 and rows(again) == rows(seen)


# --- new records only


def test_positions(spark):
    states = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "a", 9), (3, "a", 7), (4, "a", 50), (3, "b", None), (3, "c", 4), (3, "c", 6), (3, None, 1), (9, "d", 1)], "checkpoint_id long, s string, n long")
    checkpoints = spark.createDataFrame([(1, "completed"), (2, "completed"), (3, "completed"), (3, "completed"), (4, "failed"), (5, None)], "checkpoint_id long, status string")
    got = {r.split_id: r.next_position for r in incremental.committed_positions(states, checkpoints, F.col("s"), F.col("n")).collect()}
    assert got == {"a": 7, "b": incremental.LOWEST, "c": 4}


def test_runs_replay_and_skip_nothing(spark, tmp_path):
    log, sink = incremental.RunLog(spark, str(tmp_path / "log")), str(tmp_path / "sink")
    make = lambda data: spark.createDataFrame(data, "split_id string, record_position long, body string")
    none = spark.createDataFrame([], "split_id string, next_position long")
    old = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 7, "z"), (None, 1, "n"), ("a", None, "n")]
    assert log.pending() is None and log.positions() is None
    run, plan = log.plan(incremental.plan_intervals(make(old), none))
    assert run == 0 and rows(plan) == [("a", incremental.LOWEST, 2), ("b", incremental.LOWEST, 7)]
    # a failure here: new records come in, the plan stays
    more = make([*old, ("a", 3, "w"), ("c", 1, "v")])
    assert incremental.RunLog(spark, str(tmp_path / "log")).pending() == 0
    done = incremental.run_once(more, none, log, sink)
    assert rows(done.select("split_id", "record_position")) == [("a", 1), ("a", 2), ("b", 7)]
    assert log.last_committed() == 0 and {r.split_id: r.next_position for r in log.positions().collect()} == {"a": 3, "b": 8}
    incremental.run_once(more, log.positions(), log, sink)
    assert rows(incremental.read_sink(spark, sink).select("split_id", "record_position")) == [("a", 1), ("a", 2), ("a", 3), ("b", 7), ("c", 1)]
    assert incremental.plan_intervals(more, log.positions()).count() == 0
    assert incremental.plan_intervals(more.limit(0), none).count() == 0


# --- sessions, late events, rolling totals


def events(spark, data):
    return spark.createDataFrame(data, "event_key string, ts_us long, arrival_us long")


def test_sessions_against_a_plain_loop(spark):
    rng = random.Random(2)
    data = [(rng.choice([None, "hot", "hot", "a", ""]), rng.choice([None, *[rng.randrange(0, 40 * DAY, 7 * MIN)] * 9]), None) for _ in range(9_000)]
    want, by = [], defaultdict(list)
    for k, t, _ in data:
        if k is not None and t is not None:
            by[k].append(t)
    for k, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > 30 * MIN:
                want.append((k, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        want.append((k, start, last, last - start, n))
    assert rows(sessions.sessions(events(spark, data).repartition(6))) == sorted(want, key=repr)
    assert sessions.sessions(events(spark, [])).count() == 0
    assert rows(sessions.sessions(events(spark, [("k", 0, 0), ("k", 30 * MIN, 0), ("k", 60 * MIN + 1, 0)]))) == [("k", 0, 30 * MIN, 30 * MIN, 2), ("k", 60 * MIN + 1, 60 * MIN + 1, 0, 1)]


def test_events_count_once(spark):
    at = lambda h: datetime(2011, 1, 1, h)
    df = spark.createDataFrame([(1, "a", at(1), at(3)), (1, "a", at(1), at(2)), (1, "a", at(1), None), (2, None, at(1), at(1)), (3, "b", None, at(1)), (None, "c", at(1), at(1)), (None, "c", at(1), at(1)), (4, "d", at(5), None)], "id long, k string, ts timestamp_ntz, seen timestamp_ntz")
    got = distinct_events(df.withColumn("arrival_us", F.lit(0)).withColumn("row_no", F.lit(1)), "id", "k", "ts", "seen")
    base = int(datetime(2011, 1, 1).timestamp()) * 1_000_000
    assert [(k, (t - base) // HOUR, a and (a - base) // HOUR) for k, t, a in rows(got)] == [("a", 1, 2), ("c", 1, 1), ("c", 1, 1), ("d", 5, None)]


def test_late_counts(spark):
    data = [("a", 0, 1), ("a", 5, HOUR - 1), ("a", 5, HOUR), ("a", 9, 7 * HOUR - 1), ("a", 9, 7 * HOUR), ("a", -1, 0), ("b", HOUR, None), (None, 1, 1), ("c", None, 1)]
    states = late.source_states(events(spark, data))
    got = rows(late.read_counts(late.merge_states(states)))
    assert got == [("a", -HOUR, 0, 1, 1, 0), ("a", 0, 2, 4, 2, 1)]
    # states sent again, in parts and in any order
    parts = states.randomSplit([0.5, 0.5], 4)
    assert rows(late.read_counts(late.merge_states(parts[1], states, parts[0], parts[1]))) == got
    assert rows(late.read_counts(late.source_states(events(spark, data), sources=1))) == got
    assert late.read_counts(late.merge_states(late.source_states(events(spark, [])))).count() == 0
    ten = late.read_counts(late.source_states(events(spark, [("a", 0, 14 * MIN), ("a", 0, 16 * MIN), ("a", 0, 19 * MIN)]), 10 * MIN, 5 * MIN))
    assert rows(ten) == [("a", 0, 0, 1, 1, 2)]


def test_rolling_totals(spark):
    rng = random.Random(3)
    counts = {(k, d): rng.randrange(1, 9) for k in "ab" for d in rng.sample(range(-40, 90), 25)}
    daily = spark.createDataFrame([(k, d, n) for (k, d), n in counts.items()] + [(None, 1, 1), ("a", None, 1), ("n", 3, None)], "event_key string, day long, total long")
    windows = (1, 7, 30, 31, 5)
    got = rolling.rolling_totals(daily, windows).collect()
    seen = {(r.event_key, r.day): r for r in got}
    assert len(seen) == len(got) and seen.pop(("n", 3)).total_30 == 0
    for k in "ab":
        days = [d for kk, d in counts if kk == k]
        assert sorted(d for kk, d in seen if kk == k) == list(range(min(days), max(days) + 1))
    for (k, d), r in seen.items():
        assert r.total == counts.get((k, d), 0) and r.active == ((k, d) in counts)
        for n in windows:
            want = sum(counts.get((k, d - b), 0) for b in range(n))
            assert r[f"total_{n}"] == want and abs(r[f"average_{n}"] - want / n) < 1e-12
    assert rolling.rolling_totals(daily.limit(0)).count() == 0
    with pytest.raises(ValueError):
        rolling.rolling_totals(daily, (0,))
    days = rolling.daily_totals(events(spark, [("a", 0, 0), ("a", DAY - 1, 0), ("a", DAY, 0), ("a", -1, 0), (None, 1, 0)]))
    assert rows(days) == [("a", -1, 1), ("a", 0, 2), ("a", 1, 1)]


# --- change feed


def test_feed_against_a_dict(spark, tmp_path):
    rng = random.Random(4)
    feed = []
    for seq in range(3_000):
        key = b"hot" if rng.random() < 0.4 else rng.choice([b"", b"a", b"a\0", b"A", None])
        gone = rng.choice([True, False, False, None])
        feed.append((rng.choice(["o1", "o2", None]), key, rng.choice([None, b"", bytes([rng.randrange(256)]) * 3]), seq, gone))
    feed += rng.choices(feed, k=1_500)
    rng.shuffle(feed)
    want = {}
    for o, k, v, s, g in feed:
        if (o, k) not in want or s > want[o, k][1]:
            want[o, k] = (v, s, bool(g))
    make = lambda data: spark.createDataFrame([(o, bytearray(k) if k is not None else None, bytearray(v) if v is not None else None, s, g) for o, k, v, s, g in data], "owner string, state binary, batch binary, seq_num long, gone boolean")
    args = ("owner", "state", "batch", "seq_num", "gone")
    done = changefeed.apply_feed(make(feed).repartition(4), *args, step_rows=100)
    expect = sorted(((o, k, *x) for (o, k), x in want.items()), key=repr)
    assert rows(done) == expect
    # the same feed in two parts, the newer one first, with tombstones kept between
    first = changefeed.apply_feed(make(feed[2_000:]), *args)
    at = changefeed.publish(first, str(tmp_path / "store"))
    assert rows(changefeed.apply_feed(make(feed[:2_000]), *args, state=changefeed.read_published(spark, str(tmp_path / "store")), buckets=3)) == expect
    changefeed.publish(done, str(tmp_path / "store"))
    assert rows(changefeed.live(changefeed.read_published(spark, str(tmp_path / "store")))) == [x for x in expect if not x[4]]
    assert rows(spark.read.parquet(at)) == rows(first)
    assert changefeed.apply_feed(make([]), *args).count() == 0
    ties = changefeed.apply_feed(make([("o", b"k", b"1", 5, False), ("o", b"k", b"2", 5, False), ("o", b"j", b"3", 1, True), ("o", b"j", b"9", 1, False), ("o", b"i", b"1", None, False)]), *args)
    assert rows(ties) == [("o", b"i", b"1", -(2**63), False), ("o", b"j", b"3", 1, True), ("o", b"k", b"2", 5, False)]


# --- skew


def test_packing_of_keys():
    placed = skew.pack({0: 1_000, **{b: 10 for b in range(1, 101)}}, 10)
    assert len(placed[0]) == 5 and all(len(placed[b]) == 1 for b in range(1, 101))
    load = [0] * 10
    for b, tasks in placed.items():
        for t in tasks:
            load[t] += (1_000 if b == 0 else 10) / len(tasks)
    assert max(load) <= 1.1 * min(load)
    assert skew.pack({}, 4) == {}


def test_skewed_stats_and_join(spark):
    left = [("hot" if i % 3 else f"k{i % 17}" if i % 5 else None, i, i % 100) for i in range(3_000)]
    right = [("hot", 1, 10), ("hot", 1, 10), ("k3", 2, 20), ("nobody", 3, 30), (None, 4, 40)]
    a = spark.createDataFrame(left, "k string, x long, r long")
    b = spark.createDataFrame(right, "k string, x long, l long")
    got = skew.skew_join(a, b, "k", "k")
    want = sorted((k, x, x2) for k, x, _ in left for k2, x2, _ in right if k is not None and k == k2)
    assert rows(got.select("l.k", "l.x", F.col("r.x").alias("x2"))) == sorted(want, key=repr)
    outer = skew.skew_join(a, b, "k", "k", "left", spread=F.col("x"))
    assert outer.where("r is null").count() == sum(k not in ("hot", "k3") for k, _, _ in left)
    stats = {r.hot_key: (r.n_rows, r.first_us, r.last_us) for r in skew.key_stats(a, "k", F.col("x")).collect()}
    by = defaultdict(list)
    for k, x, _ in left:
        if k is not None:
            by[k].append(x)
    assert stats == {k: (len(v), min(v), max(v)) for k, v in by.items()}
    # the hot key's rows really go to several tasks
    plan = skew.TaskPlan(a, "k", tasks=8)
    hot = plan.placed[plan.table.sparkSession.range(1).select(plan.bucket(F.lit("hot"))).first()[0]]
    assert len(hot) >= 5
    assert skew.key_stats(a.limit(0), "k", F.col("x")).count() == 0 and skew.skew_join(a.limit(0), b, "k", "k").count() == 0
    with pytest.raises(ValueError):
        skew.skew_join(a, b, "k", "k", "full")


# --- keyed catalogue


def test_running_over_blocks(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), t, rng.choice([None, 1, -5, 3])) for t in range(500)]
    df = spark.createDataFrame(data, "k string, t long, v long").repartition(4)
    got = {(r.k, r.t): (r.s, r.m) for r in keyed.running(df, ["k"], ["t"], F.expr("t div 50"), {"s": F.col("v"), "m": F.col("v")}, {"s": "sum", "m": "max"}).collect()}
    total, top = defaultdict(int), defaultdict(lambda: None)
    for k, t, v in data:
        total[k] += v or 0
        top[k] = v if top[k] is None else top[k] if v is None else max(v, top[k])
        assert got[k, t] == (total[k], top[k])


def test_count_window_example(spark):
    df = spark.createDataFrame([("u", ms * 1000) for ms in (1, 2, 3, 4, 5, 6, 100)], "k string, t long")
    assert [r.n for r in keyed.count_in_window(df, "k", "t", 2_000).orderBy("timer_us").collect()] == [2, 2, 2, 0]
    assert keyed.count_in_window(df.limit(0), "k", "t", 2_000).count() == 0
    assert keyed.sliding_counts(df.limit(0), "k", "t", 2_000, 1_000).count() == 0


def test_splits(spark):
    shards = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["gone"]), ("d", None)], "s string, p array<string>")
    assert rows(keyed.available_splits(shards, "s", "p").select("s")) == [("a",), ("c",), ("d",)]
    taken = spark.createDataFrame([("a",)], "s string")
    assert rows(keyed.available_splits(shards, "s", "p", taken).select("s")) == [("c",), ("d",)]


def test_late_counts_go_on_from_earlier_states(spark):
    rng = random.Random(9)
    data = [(i, rng.choice("ab"), rng.randrange(3 * HOUR), rng.randrange(12 * HOUR)) for i in range(400)]
    frame = lambda d: spark.createDataFrame(d, "event_id long, event_key string, ts_us long, arrival_us long")
    whole = late.source_states(frame(data))
    rng.shuffle(data)
    first = late.source_states(frame(data[:150]))
    second = late.source_states(frame(data[150:]), earlier=first)
    want = rows(late.read_counts(whole))
    assert rows(late.read_counts(late.merge_states(second, first))) == want and rows(late.read_counts(second)) == want
    assert rows(second) == rows(whole)
    # an event's source depends on its id alone
    ids = frame([(i, "a", 0, t) for i in range(40) for t in (1, 2 * HOUR, 5 * HOUR)])
    each = [{(r.event_key, r.source, r.value) for r in late.source_states(ids.where(F.col("arrival_us") == t)).collect()} for t in (1, 2 * HOUR, 5 * HOUR)]
    assert each[0] == each[1] == each[2]
    null = late.source_states(frame([(None, "a", 0, 1), (None, "a", 0, 2)]))
    assert rows(late.read_counts(null)) == [("a", 0, 2, 2, 0, 0)]


def test_events_keep_their_id(spark):
    at = lambda h: datetime(2011, 1, 1, h)
    df = spark.createDataFrame([(1, "a", at(1), at(3)), (1, "a", at(1), at(2)), (None, "c", at(1), at(1))], "id long, k string, ts timestamp_ntz, seen timestamp_ntz")
    got = distinct_events(df, "id", "k", "ts", "seen", keep_id=True)
    assert got.columns == ["event_id", "event_key", "ts_us", "arrival_us"] and sorted(r.event_id or 0 for r in got.collect()) == [0, 1]


def test_key_stats_run_where_the_plan_says(spark):
    rng = random.Random(4)
    data = [(k, rng.choice([None, rng.randrange(1_000)])) for k in ["hot"] * 3_000 + [f"k{n}" for n in range(300)] * 3 + [None] * 50]
    df = spark.createDataFrame(data, "k string, x long").repartition(4)
    plan = skew.TaskPlan(df, "k", tasks=8)
    stats = skew.key_stats(df, "k", F.col("x"), plan)
    ran = stats._jdf.queryExecution().executedPlan().toString()
    assert ran.count("shufflepartitionidpassthrough") == 1 and ran.count("Exchange hashpartitioning") == 1
    want = defaultdict(list)
    for k, x in data:
        if k is not None:
            want[k].append(x)
    times = lambda v: [x for x in v if x is not None] or [None]
    assert rows(stats) == sorted(((k, len(v), min(times(v)), max(times(v))) for k, v in want.items()), key=repr)
