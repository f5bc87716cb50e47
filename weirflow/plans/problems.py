"""Queries of the general data problems, each over its whole tables, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.numbers import canonical_decimal, digits_of, sortable_decimal, whole_number
from weirflow.operators import changefeed, dedup, incremental, late, rolling, sessions, skew
from weirflow.operators.events import distinct_events
from weirflow.runtime import micros, scratch, table


def _events(spark: SparkSession, d: str, keep_id: bool = False) -> DataFrame:
    return distinct_events(table(spark, d, "sliding_events"), "event_id", "event_key", "event_ts", "approximate_arrival_timestamp", keep_id)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Redelivered records: every delivery but the first of each message."""
    records = table(spark, d, "kinesis_records")
    marked = dedup.mark_repeats(records, "partition_key", "sequence_number", "delivery_id", keep=["delivery_id"])
    return marked.where("is_repeat").select("row.delivery_id")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """One delivery of each message."""
    records = table(spark, d, "kinesis_records").drop("record_data")
    kept = dedup.drop_repeats(records, "partition_key", "sequence_number", "delivery_id", keep=["delivery_id", "shard_id", "partition_key", "sequence_number"])
    return kept.select("delivery_id", "shard_id", "partition_key", whole_number(F.col("sequence_number")).alias("sequence_no"))


def p1_payload(spark: SparkSession, d: str) -> DataFrame:
    """One delivery of each message with its payload, which travels along; its digest comes out."""
    kept = dedup.drop_repeats(table(spark, d, "kinesis_records"), "partition_key", "sequence_number", "delivery_id", keep=["delivery_id", "record_data"])
    return kept.select("delivery_id", F.md5("record_data").alias("digest"))


def _kafka_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(records, positions) of the Kafka job, by offset. The scan skips row groups that lie before all positions of a topic."""
    split = F.concat_ws(":", "topic_name", F.col("split_partition").cast("string"))
    placed = F.col("topic_name").isNotNull() & F.col("split_partition").isNotNull()
    states = table(spark, d, "split_states").where(placed).withColumn("split", F.struct("topic_name", "split_partition"))
    known = incremental.committed_positions(states, table(spark, d, "job_checkpoints"), F.col("split"), F.col("split_offset"))
    known = known.select("split_id.*", F.concat_ws(":", "split_id.topic_name", F.col("split_id.split_partition").cast("string")).alias("split_id"), "next_position")
    records = table(spark, d, "kafka_records").where(placed)
    start = incremental.start_filter(known, "topic_name", "split_partition", "record_offset", "next_position")
    records = records if start is None else records.where(start)
    return records.withColumns({"split_id": split, "record_position": F.col("record_offset")}), known.select("split_id", "next_position")


def _kinesis_log(spark: SparkSession, d: str, number=sortable_decimal) -> tuple[DataFrame, DataFrame]:
    """(records, positions) of the Kinesis job, by sequence number in sortable form."""
    cursor = incremental.after(number(F.col("shard_cursor")), T.StringType())
    positions = incremental.committed_positions(table(spark, d, "shard_states"), table(spark, d, "job_checkpoints"), F.col("shard_id"), cursor)
    records = table(spark, d, "kinesis_records")
    return records.withColumns({"split_id": F.col("shard_id"), "record_position": number(F.col("sequence_number"))}), positions


def _run(spark: SparkSession, logs: tuple[DataFrame, DataFrame], fail: bool = False) -> DataFrame:
    """split_id, record_position of what a run delivers: planned ahead, read, sunk and committed. With `fail` a first attempt stops halfway."""
    at = scratch(spark, "runs")
    log = incremental.RunLog(spark, f"{at}/log")
    if fail:
        _, plan = log.plan(incremental.plan_intervals(*logs))
        incremental.read_intervals(logs[0], plan).select("split_id", "record_position").limit(100).write.parquet(f"{at}/sink/run=0")
        # the next attempt is told other positions, but the plan stands
        logs = logs[0], logs[1].limit(0)
    return incremental.run_once(*logs, log, f"{at}/sink", columns=[])


def _both(spark: SparkSession, d: str, fail: bool = False) -> DataFrame:
    kafka, kinesis = (_run(spark, logs(spark, d), fail) for logs in (_kafka_log, _kinesis_log))
    # a number beyond a long is an error here, never a record less
    return kafka.unionByName(kinesis.withColumn("record_position", digits_of(F.col("record_position")).cast("long")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records still to be read, as one run of each job delivers them to its sink."""
    return _both(spark, d)


def p2_replay(spark: SparkSession, d: str) -> DataFrame:
    """The same after a run that failed between its plan and its commit, and is run again."""
    return _both(spark, d, fail=True)


def p2_again(spark: SparkSession, d: str) -> DataFrame:
    """How many records the sinks hold, and how many of them twice, after a second run is told to start over: the sinks refuse what they have."""
    out = None
    for name, (records, positions) in (("kafka", _kafka_log(spark, d)), ("kinesis", _kinesis_log(spark, d))):
        at = scratch(spark, "runs")
        log = incremental.RunLog(spark, f"{at}/log")
        for _ in range(2):
            incremental.run_once(records, positions, log, f"{at}/sink", columns=[])
        held = incremental.read_sink(spark, f"{at}/sink", log)
        each = held.groupBy("split_id", "record_position").agg(F.count(F.lit(1)).alias("n"))
        each = each.agg(F.count(F.lit(1)).alias("n_records"), F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated")).select(F.lit(name).alias("log"), "*")
        out = each if out is None else out.unionByName(each)
    return out


_LONG_PREFIX = "49590338271490256608559692538361571095"


def _lengthened(number: Column) -> Column:
    """Sortable form of a number that keeps its order but has 56 digits if it has more than three."""
    digits = canonical_decimal(number)
    return sortable_decimal(F.when(F.length(digits) > 3, F.concat(F.lit(_LONG_PREFIX), F.lpad(digits, 18, "0"))).otherwise(digits))


def p2_long(spark: SparkSession, d: str) -> DataFrame:
    """Kinesis records still to be read when numbers and cursors have up to 56 digits, as those of the service do."""
    due = _run(spark, _kinesis_log(spark, d, _lengthened))
    return due.select("split_id", digits_of(F.col("record_position")).alias("record_position"))


def p2_plan(spark: SparkSession, d: str) -> DataFrame:
    """What the next run is to read of each split."""
    records, positions = _kafka_log(spark, d)
    kafka = incremental.plan_intervals(records, positions)
    kafka = kafka.select("split_id", F.when(F.col("first_position") != incremental.LOWEST, F.col("first_position")).alias("first_position"), "last_position")
    records, positions = _kinesis_log(spark, d)
    kinesis = incremental.plan_intervals(records, positions)
    first = F.when(F.col("first_position") != "", F.rtrim(digits_of(F.col("first_position"))).cast("long") + 1)
    return kafka.unionByName(kinesis.select("split_id", first.alias("first_position"), digits_of(F.col("last_position")).cast("long").alias("last_position")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by 30 minutes of inactivity."""
    return sessions.sessions(_events(spark, d)).select("event_key", "session_start_us", "session_end_us")


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with duration and number of events."""
    return sessions.sessions(_events(spark, d))


_FEED = ("operator_id", "entry_k", "entry_v", "seq_num", "is_deleted")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    store = changefeed.Store(spark, scratch(spark, "store"))
    store.apply(table(spark, d, "kv_entries"), *_FEED)
    return changefeed.live(store.read())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The current entry of every key of every operator's store."""
    return _entries(spark, d).select(F.col("owner").alias("operator_id"), "seq_num")


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """The current entries with key and value in hexadecimal."""
    return _entries(spark, d).select(F.col("owner").alias("operator_id"), F.hex("entry_k").alias("k_hex"), F.hex("entry_v").alias("v_hex"), "seq_num")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """The current entries after three runs that each bring a third of the feed into the stored buckets, the newest third first and one third twice."""
    feed, store = table(spark, d, "kv_entries"), changefeed.Store(spark, scratch(spark, "store"))
    for run in (2, 0, 1, 0):
        store.apply(feed.where(F.col("feed_pos") % 3 == run), *_FEED)
    return changefeed.live(store.read()).select(F.col("owner").alias("operator_id"), F.hex("entry_k").alias("k_hex"), F.hex("entry_v").alias("v_hex"), "seq_num")


_ARRIVALS = ("event_id", "event_key", "event_ts", "approximate_arrival_timestamp")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    counters = late.LateCounts(spark, scratch(spark, "counters"))
    counters.apply(table(spark, d, "sliding_events"), *_ARRIVALS)
    return late.read_counts(counters.states())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Hours whose count is corrected by late events."""
    return _counts(spark, d).where("late > 0").select("event_key", F.col("period_start_us").alias("hour_start_us"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per key and hour: on time, corrected, late and too late."""
    return _counts(spark, d).withColumnRenamed("period_start_us", "hour_start_us")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    """The counts after four runs from stored counters, which get the deliveries in no order at all: those of one event lie in different runs, and one run comes twice."""
    rows, counters = table(spark, d, "sliding_events"), late.LateCounts(spark, scratch(spark, "counters"))
    run = F.pmod(F.xxhash64(*_ARRIVALS), F.lit(3))
    for n in (2, 0, 1, 0):
        counters.apply(rows.where(run == n), *_ARRIVALS)
    return late.read_counts(counters.states()).withColumnRenamed("period_start_us", "hour_start_us")


_TABLES = (("kinesis_records", "partition_key", "approximate_arrival_timestamp"), ("sliding_events", "event_key", "event_ts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least one hundredth of a table's rows."""
    found = None
    for name, key, ts in _TABLES:
        df = table(spark, d, name)
        plan = skew.TaskPlan(df, key)
        hot = skew.key_stats(df, key, micros(ts), plan).where(F.col("n_rows") * 100 >= plan.total)
        hot = hot.select(F.lit(name).alias("table_name"), "hot_key")
        found = hot if found is None else found.unionByName(hot)
    return found


def p6_key_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, first and last time of every key of both tables."""
    stats = None
    for name, key, ts in _TABLES:
        each = skew.key_stats(table(spark, d, name), key, micros(ts)).select(F.lit(name).alias("table_name"), "hot_key", "n_rows", "first_us", "last_us")
        stats = each if stats is None else stats.unionByName(each)
    return stats


def p6_halves(spark: SparkSession, d: str) -> DataFrame:
    """How many of a key's rows lie in the second half of its time span: every row joined to its key's bounds."""
    df = table(spark, d, "kinesis_records")
    plan = skew.TaskPlan(df, "partition_key")
    bounds = skew.key_stats(df, "partition_key", micros("approximate_arrival_timestamp"), plan)
    rows = df.select("partition_key", micros("approximate_arrival_timestamp").alias("us"), "delivery_id")
    joined = skew.skew_join(rows, bounds, "partition_key", "hot_key", plan=plan, spread=F.col("delivery_id"))
    second = (F.col("l.us") - F.col("r.first_us")) * 2 > F.col("r.last_us") - F.col("r.first_us")
    return joined.groupBy(F.col("l.partition_key").alias("hot_key")).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(second, 1)).alias("n_second_half"))


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(rolling.daily_totals(_events(spark, d))).withColumn("event_day", F.date_from_unix_date(F.col("day").cast("int")).cast("string"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Days without an event whose week still runs at twice the pace of the month (compared in whole numbers)."""
    return _rolled(spark, d).where("not active and total_7 != 0 and total_7 * 30 >= 2 * 7 * total_30").select("event_key", "event_day")


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals and daily averages of the trailing 7 and 30 days."""
    average = lambda n: F.round(F.col(f"total_{n}") * 1000 / n).cast("long").alias(f"milli_average_{n}")
    return _rolled(spark, d).select("event_key", "event_day", F.col("total").alias("n_events"), "total_7", average(7), "total_30", average(30))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_kept, p1_payload, p2_found, p2_plan, p2_replay, p2_again, p2_long, p3_found, p3_sessions, p4_found, p4_entries, p4_runs, p5_found, p5_counts, p5_runs, p6_found, p6_key_stats, p6_halves, p7_found, p7_totals)
}

_EVENTS = """events_once as (
    select event_id, min(event_key) event_key, epoch_us(min(event_ts)) ts_us, epoch_us(min(approximate_arrival_timestamp)) arrival_us
    from sliding_events where event_key is not null and event_ts is not null group by event_id
)"""
_SESSIONS = f"""with {_EVENTS}, steps as (
    select *, case when ts_us - lag(ts_us) over w <= 1800000000 then 0 else 1 end opens from events_once window w as (partition by event_key order by ts_us)
), numbered as (select *, sum(opens) over (partition by event_key order by ts_us rows unbounded preceding) nth from steps)
"""
_POSITIONS = r"""with done as (select checkpoint_id from job_checkpoints where status = 'completed'), positions as (
    select topic_name || ':' || split_partition split_id, arg_max(split_offset, checkpoint_id) first_position from split_states where checkpoint_id in (from done) group by 1
    union all
    select shard_id, arg_max(coalesce(cast(nullif(trim(shard_cursor), '') as bigint) + 1, -1), checkpoint_id) from shard_states where checkpoint_id in (from done) group by 1
), records as (
    select topic_name || ':' || split_partition split_id, record_offset record_position from kafka_records
    union all
    select shard_id, cast(trim(sequence_number) as bigint) from kinesis_records
)
"""
_COUNTS = f"""with {_EVENTS}, placed as (
    select event_key, ts_us // 3600000000 * 3600000000 hour_start_us, arrival_us from events_once
), counts as (
    select event_key, hour_start_us, count(*) filter (arrival_us < hour_start_us + 3600000000) on_time, count(*) filter (arrival_us < hour_start_us + 7 * 3600000000) corrected, count(*) n
    from placed group by all
)
"""
_ROLLED = f"""with {_EVENTS}, daily as (
    select event_key, cast(make_timestamp(ts_us) as date) d, count(*) n from events_once group by all
), spans as (
    select event_key, unnest(generate_series(min(d), max(d), interval 1 day))::date d from daily group by event_key
), rolled as (
    select s.event_key, strftime(s.d, '%Y-%m-%d') event_day, daily.n is not null active, coalesce(daily.n, 0) n_events,
        cast(sum(coalesce(daily.n, 0)) over (w rows 6 preceding) as bigint) total_7, cast(sum(coalesce(daily.n, 0)) over (w rows 29 preceding) as bigint) total_30
    from spans s left join daily using (event_key, d) window w as (partition by s.event_key order by s.d)
)
"""
_LIVE = """select operator_id, entry_k, arg_max(is_deleted, seq_num) gone, arg_max(hex(entry_v), seq_num) v_hex, arg_max(entry_v is null, seq_num) v_null, max(seq_num) seq_num from kv_entries group by operator_id, entry_k"""

SQL = {
    "p1_found": "select delivery_id from kinesis_records qualify row_number() over (partition by partition_key, cast(trim(sequence_number) as bigint) order by delivery_id) > 1",
    "p1_kept": "select delivery_id, shard_id, partition_key, cast(trim(sequence_number) as bigint) sequence_no from kinesis_records qualify row_number() over (partition by partition_key, cast(trim(sequence_number) as bigint) order by delivery_id) = 1",
    "p1_payload": "select delivery_id, md5(record_data) digest from kinesis_records qualify row_number() over (partition by partition_key, cast(trim(sequence_number) as bigint) order by delivery_id) = 1",
    "p2_found": _POSITIONS + "select distinct r.split_id, record_position from records r left join positions p using (split_id) where first_position is null or record_position >= first_position",
    "p2_plan": _POSITIONS
    + "select split_id, nullif(any_value(first_position), -1) first_position, max(record_position) last_position from records left join positions using (split_id) group by split_id having any_value(first_position) is null or max(record_position) >= any_value(first_position)",
    "p2_replay": _POSITIONS + "select distinct r.split_id, record_position from records r left join positions p using (split_id) where first_position is null or record_position >= first_position",
    "p2_again": _POSITIONS
    + "select case when r.split_id like '%:%' then 'kafka' else 'kinesis' end log, count(distinct (r.split_id, record_position)) n_records, 0::bigint n_repeated from records r left join positions p using (split_id) where first_position is null or record_position >= first_position group by 1",
    "p2_long": _POSITIONS
    + f"""select distinct r.split_id, case when record_position > 999 then '{_LONG_PREFIX}' || lpad(record_position::varchar, 18, '0') else record_position::varchar end record_position
        from records r left join positions p using (split_id) where r.split_id not like '%:%' and (first_position is null or record_position >= first_position)""",
    "p3_found": _SESSIONS + "select event_key, min(ts_us) session_start_us, max(ts_us) session_end_us from numbered group by event_key, nth",
    "p3_sessions": _SESSIONS + "select event_key, min(ts_us) session_start_us, max(ts_us) session_end_us, max(ts_us) - min(ts_us) duration_us, count(*) n_events from numbered group by event_key, nth",
    "p4_found": f"select operator_id, seq_num from ({_LIVE}) where not gone",
    "p4_entries": f"select operator_id, hex(entry_k) k_hex, case when not v_null then v_hex end v_hex, seq_num from ({_LIVE}) where not gone",
    "p4_runs": f"select operator_id, hex(entry_k) k_hex, case when not v_null then v_hex end v_hex, seq_num from ({_LIVE}) where not gone",
    "p5_found": _COUNTS + "select event_key, hour_start_us from counts where corrected > on_time",
    "p5_counts": _COUNTS + "select event_key, hour_start_us, on_time, corrected, corrected - on_time late, n - corrected too_late from counts",
    "p5_runs": _COUNTS + "select event_key, hour_start_us, on_time, corrected, corrected - on_time late, n - corrected too_late from counts",
    "p6_found": " union all ".join(f"select '{t}' table_name, {k} hot_key from {t} where {k} is not null group by {k} having count(*) * 100 >= (select count(*) from {t})" for t, k, _ in _TABLES),
    "p6_key_stats": " union all ".join(f"select '{t}' table_name, {k} hot_key, count(*) n_rows, epoch_us(min({ts})) first_us, epoch_us(max({ts})) last_us from {t} where {k} is not null group by {k}" for t, k, ts in _TABLES),
    "p6_halves": """with b as (select partition_key, epoch_us(min(approximate_arrival_timestamp)) a, epoch_us(max(approximate_arrival_timestamp)) z from kinesis_records group by 1)
        select partition_key hot_key, count(*) n_rows, count(*) filter ((epoch_us(approximate_arrival_timestamp) - a) * 2 > z - a) n_second_half from kinesis_records join b using (partition_key) group by 1""",
    "p7_found": _ROLLED + "select event_key, event_day from rolled where not active and total_7 <> 0 and total_7 * 30 >= 14 * total_30",
    "p7_totals": _ROLLED + "select event_key, event_day, n_events, total_7, cast(round(total_7 * 1000 / 7) as bigint) milli_average_7, total_30, cast(round(total_30 * 1000 / 30) as bigint) milli_average_30 from rolled",
}
