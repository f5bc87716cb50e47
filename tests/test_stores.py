"""What is kept between runs: buckets of a feed, counters of late events, positions, ranges of seen numbers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import rows

from weirflow.functions.numbers import digits_of, sortable_decimal
from weirflow.operators import changefeed, dedup, incremental, late
from weirflow.runtime import input_bytes, partitions_for, session_conf
from weirflow.versions import Versions

FEED = "o string, k binary, v binary, s long, g boolean"
ARGS = ("o", "k", "v", "s", "g")


def feed(spark, data):
    return spark.createDataFrame([(o, None if k is None else bytearray(k), None if v is None else bytearray(v), s, g) for o, k, v, s, g in data], FEED)


def newest(data):
    want = {}
    for o, k, v, s, g in data:
        if (o, k) not in want or s > want[o, k][1]:
            want[o, k] = (v, s, bool(g))
    return sorted(((o, k, *x) for (o, k), x in want.items()), key=repr)


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.latest() == (-1, {}, {}) and v.vacuum() == 0
    first, second = v.folder(), v.folder()
    for n, f in enumerate((first, second)):
        spark.range(4).select(F.col("id"), (F.col("id") % 2).alias("p")).where(F.lit(n == 0) | (F.col("p") == 1)).write.partitionBy("p").parquet(f"{v.path}/{f}")
    assert v.publish(-1, v.subfolders(first, "p"), {"n": 1}) == 0
    with pytest.raises(FileExistsError):
        v.publish(-1, {})
    assert v.publish(0, v.latest()[2] | v.subfolders(second, "p")) == 1
    number, notes, parts = v.latest()
    assert (number, notes, sorted(parts)) == (1, {}, ["0", "1"]) and parts["0"].startswith(first) and parts["1"].startswith(second)
    assert v.vacuum(keep=2) == 0 and v.vacuum(keep=1) == 1
    assert sorted(r.id for r in v.read(parts, "id long").collect()) == [0, 1, 2, 3]
    assert [r.id for r in v.read(parts, "id long", {"0", "9"}).orderBy("id").collect()] == [0, 2] and v.read(parts, "id long", set()).count() == 0


def test_store_writes_only_touched_buckets(spark, tmp_path):
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, b"", *[bytes([n]) for n in range(60)]]), rng.choice([None, b"x" * rng.randrange(30)]), s, rng.random() < 0.2) for s in range(2_000)]
    rng.shuffle(data)
    store = changefeed.Store(spark, str(tmp_path / "s"), buckets=16)
    assert store.read().count() == 0 and store.apply(feed(spark, []), *ARGS) == []
    assert len(store.apply(feed(spark, data[:1_500]), *ARGS)) == 16
    before = store.versions.latest()[2]
    touched = store.apply(feed(spark, [x for x in data[1_500:] if x[1] in (b"\x01", b"\x02")]), *ARGS)
    after = store.versions.latest()[2]
    assert 0 < len(touched) < 10 and {int(p) for p in after if after[p] != before[p]} == set(touched)
    store.apply(feed(spark, data[1_000:]), *ARGS)
    store.apply(feed(spark, data[1_000:]), *ARGS)
    assert rows(store.read()) == newest(data)
    assert store.apply(feed(spark, []), *ARGS) == []
    store.versions.vacuum(1)
    assert rows(store.read()) == newest(data) and rows(changefeed.live(store.read())) == [x for x in newest(data) if not x[4]]


def test_a_bucket_larger_than_its_database(spark):
    # 400,000 entries of 200 bytes, one bucket: ten times what DuckDB may take
    big = spark.range(400_000).select(F.lit("o").alias("o"), F.encode(F.col("id").cast("string"), "utf-8").alias("k"), F.encode(F.repeat(F.lit("v"), 200), "utf-8").alias("v"), (F.col("id") + 1).alias("s"), (F.col("id") % 10 == 0).alias("g"))
    done = changefeed.apply_feed(big.unionByName(big.withColumn("s", F.col("s") - 1)), *ARGS, buckets=1, memory="60MB", chunk_bytes=2 << 20)
    got = done.agg(F.count(F.lit(1)), F.sum("seq_num"), F.sum(F.col("is_deleted").cast("int")), F.countDistinct("entry_k")).first()
    assert tuple(got) == (400_000, 400_000 * 400_001 // 2, 40_000, 400_000)


@pytest.mark.parametrize("chunk", [1, 500, 1 << 30])
def test_chunks_end_between_entries(spark, chunk):
    rng = random.Random(chunk)
    data = [("hot", b"k", b"v", s, False) for s in range(3_000)] + [("o", bytes([rng.randrange(40)]), bytes([rng.randrange(250)]), s, rng.random() < 0.3) for s in range(3_000)]
    rng.shuffle(data)
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="37"):
        assert rows(changefeed.apply_feed(feed(spark, data).repartition(3), *ARGS, buckets=2, step_rows=50, chunk_bytes=chunk)) == newest(data)


def test_partitions_have_no_cap_and_add_inputs_up(spark, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    size = input_bytes(t)
    assert 0 < size < 10 << 20
    joined = t.join(t.withColumnRenamed("id", "x"), F.col("id") == F.col("x"))
    assert input_bytes(joined) == 2 * size
    assert partitions_for(1, t) == 3 * size + 1 and partitions_for(1 << 40, t) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([("ab", 1), (None, 2)]), "a string, b long")
    assert input_bytes(unknown) is None and partitions_for(1, unknown) == 2 + 2 * 8 + 1


# --- late events


def deliveries(rng, n):
    base = datetime(2011, 1, 1)
    out = []
    for i in range(n):
        ts = base + timedelta(minutes=rng.randrange(3 * 24 * 60))
        for _ in range(rng.choice([1, 1, 2, 4])):
            out.append((i, rng.choice("ab") if i % 17 else None, ts, ts + timedelta(minutes=rng.choice([1, 30, 100, 500, 5_000]))))
    return [(i, "ab"[i % 2] if k else None, t, a) for i, k, t, a in out]


def counted(spark, path, runs):
    c = late.LateCounts(spark, str(path))
    for r in runs:
        df = spark.createDataFrame(r, "event_id long, k string, ts timestamp_ntz, seen timestamp_ntz").withColumn("arrival_us", F.lit("clash"))
        c.apply(df, "event_id", "k", "ts", "seen")
    return rows(late.read_counts(c.states())), c


def test_any_runs_give_the_same_counts(spark, tmp_path):
    rng = random.Random(7)
    data = deliveries(rng, 300)
    first = {}
    for i, k, t, a in data:
        if k is not None:
            first[i] = min(first.get(i, (a, t, k)), (a, t, k))
    want = {}
    for a, t, k in first.values():
        hour = t.replace(minute=0)
        end, c = hour + timedelta(hours=1), want.setdefault((k, hour), [0, 0, 0])
        c[0] += a < end
        c[1] += a < end + timedelta(hours=6)
        c[2] += 1
    us = lambda h: int((h - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    want = sorted(((k, us(h), on, cor, cor - on, n - cor) for (k, h), (on, cor, n) in want.items()), key=repr)
    with session_conf(spark, spark__sql__session__timeZone="UTC"):
        assert counted(spark, tmp_path / "one", [data])[0] == want
        rng.shuffle(data)
        got, c = counted(spark, tmp_path / "many", [data[200:], data[:120], data[200:], [], data[100:], data])
        assert got == want
        # states of a reader that is behind change nothing
        stale = c.states().sample(0.5, 3).withColumn("value", F.col("value") - 1).where("value > 0")
        assert rows(late.read_counts(late.merge_states(stale, c.states(), stale))) == want
        assert counted(spark, tmp_path / "none", [[]])[0] == []


def test_an_earlier_arrival_moves_its_event(spark, tmp_path):
    at = datetime(2011, 1, 1, 10, 30)
    run = lambda *minutes: [(1, "a", at, at + timedelta(minutes=m)) for m in minutes]
    with session_conf(spark, spark__sql__session__timeZone="UTC"):
        for k, (runs, want) in enumerate([([run(600)], (0, 0, 0, 1)), ([run(600), run(60)], (0, 1, 1, 0)), ([run(600), run(60), run(5), run(700)], (1, 1, 0, 0)), ([run(5), run(60, 5)], (1, 1, 0, 0))]):
            assert counted(spark, tmp_path / str(k), runs)[0][0][2:] == want
        null = counted(spark, tmp_path / "null", [[(None, "a", at, at), (None, "a", at, at), (2, "a", at, None)]])[0]
        assert [r[2:] for r in null] == [(2, 2, 0, 0)]


# --- positions and numbers


LONG = "4959033827149025660855969253836157109592157598913600000"


def test_numbers_of_any_length_sort(spark):
    texts = ["0", "9", "10", " 7 ", "+12", "007", "", "x", None, LONG + "9", LONG + "10", "1" * 70, "-1", "1.5", "٣"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sortable_decimal(F.col("t")).alias("s"))
    got = [(int(r.d), r.d) for r in df.where("s is not null").orderBy("s").select(digits_of(F.col("s")).alias("d")).collect()]
    assert [n for n, _ in got] == sorted([0, 9, 10, 7, 12, 7, int(LONG + "9"), int(LONG + "10"), int("1" * 70)]) and all(str(n) == d for n, d in got)


def test_long_numbers_and_cursors(spark, tmp_path):
    number = sortable_decimal(F.col("n"))
    records = spark.createDataFrame([("s", n) for n in (LONG + "8", LONG + "9", LONG + "10", "5", "0" + LONG + "9")], "split_id string, n string").withColumn("record_position", number)
    cursor = spark.createDataFrame([("s", LONG + "8")], "split_id string, n string").select("split_id", incremental.after(number, records.schema["record_position"].dataType).alias("next_position"))
    log = incremental.RunLog(spark, str(tmp_path / "log"))
    done = incremental.run_once(records, cursor, log, str(tmp_path / "sink"))
    assert sorted(r.d for r in done.select(digits_of(F.col("record_position")).alias("d")).collect()) == [LONG + "10", LONG + "9"]
    assert incremental.plan_intervals(records, log.positions()).count() == 0
    everything = incremental.run_once(records, cursor.limit(0), log, str(tmp_path / "sink"))
    assert sorted(digits for (digits,) in everything.select(digits_of(F.col("record_position"))).collect()) == [LONG + "8", "5"]


def test_log_keeps_positions_of_idle_splits_and_little_else(spark, tmp_path):
    log, sink = incremental.RunLog(spark, str(tmp_path / "log")), str(tmp_path / "sink")
    make = lambda data: spark.createDataFrame(data, "split_id string, record_position long")
    incremental.run_once(make([("a", 1), ("b", 5)]), spark.createDataFrame([], "split_id string, next_position long"), log, sink)
    for n in (6, 7, 8):
        incremental.run_once(make([("a", 1), ("b", n)]), log.positions(), log, sink)
    assert rows(log.positions()) == [("a", 2), ("b", 9)]
    assert log._ids("plans") == log._ids("commits") == [3]
    # a run that is sent back delivers only what the sink lacks
    again = incremental.run_once(make([("a", 0), ("a", 1), ("b", 6), ("c", 1)]), spark.createDataFrame([], "split_id string, next_position long"), log, sink)
    assert rows(again.select("split_id", "record_position")) == [("a", 0), ("c", 1)]
    assert rows(incremental.read_sink(spark, sink, log).select("split_id", "record_position")) == [("a", 0), ("a", 1), ("b", 5), ("b", 6), ("b", 7), ("b", 8), ("c", 1)]
    incremental.run_once(make([("b", 8), ("b", 9)]), log.positions(), log, sink)
    assert log.positions().where("split_id = 'b'").first().next_position == 10 and incremental.read_sink(spark, sink, log).where("split_id = 'b'").count() == 5
    # the log's own word for its ends
    ends = spark.createDataFrame([("a", 1), ("z", 4)], "split_id string, last_position long")
    assert rows(incremental.plan_intervals(make([]), log.positions(), ends)) == [("z", incremental.LOWEST, 4)]


def test_start_filter_only_drops_what_was_read(spark):
    positions = spark.createDataFrame([("t", 0, 10), ("t", 1, 4), ("u", 0, 7)], "topic string, part int, next_position long")
    records = spark.createDataFrame([(t, p, n) for t in ("t", "u", "v") for p in (0, 1) for n in range(12)], "topic string, part int, n long")
    kept = {tuple(r) for r in records.where(incremental.start_filter(positions, "topic", "part", "n", "next_position")).collect()}
    known = {("t", 0): 10, ("t", 1): 4, ("u", 0): 7}
    due = {(t, p, n) for t, p, n in map(tuple, records.collect()) if n >= known.get((t, p), -1)}
    assert due <= kept and ("t", 1, 3) not in kept and ("u", 0, 6) not in kept and ("u", 1, 0) in kept
    assert incremental.start_filter(positions.limit(0), "topic", "part", "n", "next_position") is None


def test_ranges_of_long_numbers(spark):
    schema = "o long, p string, s string"
    first = spark.createDataFrame([(n, "a", f"{LONG}{n:03d}") for n in range(5)] + [(9, "a", "2"), (10, "a", f"0{LONG}003"), (11, "a", "7" + f"{LONG}003")], schema)
    accepted, seen = dedup.accept_batch(first, "p", "s", "o")
    assert sorted(r.o for r in accepted.collect()) == [0, 1, 2, 3, 4, 9, 11]
    low = int((LONG + "000")[-18:])
    assert rows(seen) == sorted([("a", low, low + 4, (LONG + "000")[:-18]), ("a", low + 3, low + 3, "7" + (LONG + "000")[:-18]), ("a", 2, 2, None)], key=repr)
    second = spark.createDataFrame([(20, "a", f"{LONG}004"), (21, "a", f"{LONG}005"), (22, "a", f"{low + 1}"), (23, "b", f"{LONG}001")], schema)
    accepted, seen = dedup.accept_batch(second, "p", "s", "o", seen)
    assert sorted(r.o for r in accepted.collect()) == [21, 22, 23]
    assert ("a", low, low + 5, (LONG + "000")[:-18]) in rows(seen)


def test_a_stray_date_makes_no_huge_array(spark):
    from weirflow.operators import rolling

    daily = spark.createDataFrame([("a", 0, 3), ("a", 2, 1), ("a", 3_000_000, 5), ("b", -5, 2), ("b", 4_095, 1)], "event_key string, day long, total long")
    got = rolling.rolling_totals(daily)
    assert {r.event_key: (r.n, r.t, r.z) for r in got.groupBy("event_key").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t"), F.sum("total_7").alias("z")).collect()} == {"a": (3_000_001, 9, 4 * 7 + 5), "b": (4_101, 3, 2 * 7 + 1)}
    assert [tuple(r)[1:4] for r in got.where("event_key = 'a' and (day in (0, 1, 2, 9) or day > 2999999)").orderBy("day").collect()] == [(0, True, 3), (1, False, 0), (2, True, 1), (9, False, 0), (3_000_000, True, 5)]
