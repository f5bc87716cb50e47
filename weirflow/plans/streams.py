"""Queries of the keyed-stream catalogue in batch form, each next to the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import codecs, hashing
from weirflow.functions.times import DAY, HOUR, MINUTE
from weirflow.functions.times import ceiling, nearest, truncate
from weirflow.operators import keyed
from weirflow.runtime import micros, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event stream: key is user_id, times in microseconds, money in cents."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "props", micros("ts").alias("ts_us"), F.round(F.col("value") * 100).cast("long").alias("cents"))


_E = "with e as (select event_id, user_id, event_type, props, epoch_us(ts) ts_us, cast(round(value * 100) as bigint) cents from events) "


@query(_E + "select event_id, user_id, ts_us, cents from e")
def pass_through(spark, d):
    return events(spark, d).select("event_id", "user_id", "ts_us", "cents")


@query(_E + "select user_id as \"key\", ts_us, cents as value from e where event_type = 'purchase'")
def key_event_filter(spark, d):
    return keyed.key_events(events(spark, d), F.struct(F.col("user_id").alias("key"), "ts_us", F.col("cents").alias("value")), where=F.col("event_type") == "purchase")


@query(_E + "select 'u' || user_id as \"key\", ts_us, event_id as value from e union all select event_type, ts_us, event_id from e where event_type <> 'view'")
def key_event_flatmap(spark, d):
    by_user = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "ts_us", F.col("event_id").alias("value"))
    by_type = F.struct(F.col("event_type").alias("key"), "ts_us", F.col("event_id").alias("value"))
    return keyed.key_events(events(spark, d), by_user, F.when(F.col("event_type") != "view", by_type))


@query("select event_id, md5(event_type) as \"key\" from events")
def raw_key(spark, d):
    return table(spark, d, "events").select("event_id", F.md5(F.col("event_type").cast("binary")).alias("key"))


@query("select event_id, cast(json_extract(props, '$.n') as bigint) n, coalesce(cast(json_extract(props, '$.k') as bigint), -1) k from events")
def json_decode(spark, d):
    parsed = F.from_json("props", "n long, k long")
    return table(spark, d, "events").select("event_id", parsed["n"].alias("n"), F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


@query(_E + "select event_id, user_id, cast(sum(cents) over (partition by user_id order by ts_us, event_id rows unbounded preceding) as bigint) total from e")
def running_sum(spark, d):
    sums = keyed.running(events(spark, d), ["user_id"], ["ts_us", "event_id"], truncate(F.col("ts_us"), 30 * DAY), {"total": F.col("cents")}, {"total": "sum"})
    return sums.select("event_id", "user_id", "total")


@query(_E + "select event_id, user_id, '{\"Sum\":' || count(*) over (partition by user_id order by ts_us, event_id rows unbounded preceding) || '}' total from e")
def running_count_json(spark, d):
    counts = keyed.running(events(spark, d), ["user_id"], ["ts_us", "event_id"], truncate(F.col("ts_us"), 30 * DAY), {"n": F.lit(1)}, {"n": "sum"})
    return counts.select("event_id", "user_id", F.to_json(F.struct(F.col("n").cast("long").alias("Sum"))).alias("total"))


@query(_E + "select event_id, cast(sum(cents) over (order by ts_us, event_id rows unbounded preceding) as bigint) total from e")
def uniform_key_sum(spark, d):
    one = events(spark, d).withColumn("key", F.lit("static"))
    return keyed.running(one, ["key"], ["ts_us", "event_id"], truncate(F.col("ts_us"), HOUR), {"total": F.col("cents")}, {"total": "sum"}).select("event_id", "total")


@query(_E + "select user_id, event_type, arg_max(cents, (ts_us, event_id)) value from e group by all")
def final_state(spark, d):
    return keyed.newest(events(spark, d), ["user_id", "event_type"], ["ts_us", "event_id"], F.col("cents"))


@query(_E + "select user_id, arg_max(cents, (ts_us, event_id)) value from e group by all having arg_max(event_type, (ts_us, event_id)) <> 'error'")
def state_put_delete(spark, d):
    return keyed.put_delete(events(spark, d), ["user_id"], ["ts_us", "event_id"], F.col("cents"), F.col("event_type") == "error")


@query(_E + "select event_type || ':' || user_id as \"key\", max(event_id) value from e where event_type || ':' || user_id like 'purchase:1%' group by all")
def prefix_scan(spark, d):
    entries = keyed.newest(events(spark, d).withColumn("key", F.concat_ws(":", "event_type", F.col("user_id").cast("string"))), ["key"], ["event_id"], F.col("event_id"))
    return keyed.prefix_scan(entries, "key", "purchase:1")


@query(_E + f"select user_id, ts_us // {MINUTE} * {MINUTE} bucket_us, count(*) n from e group by all")
def bucket_counts(spark, d):
    return keyed.bucket_counts(events(spark, d), "user_id", "ts_us", MINUTE)


@query(
    _E
    + f""", t as (select user_id, timer_us, lag(timer_us) over (partition by user_id order by timer_us) previous from (select distinct user_id, ts_us // {2 * HOUR} * {2 * HOUR} + {2 * HOUR} timer_us from e))
    select user_id, timer_us, (select count(*) from e where e.user_id = t.user_id and ts_us <= timer_us and (previous is null or ts_us > previous)) n
    from t where timer_us < (select max(ts_us) from e)"""
)
def count_in_window(spark, d):
    return keyed.count_in_window(events(spark, d), "user_id", "ts_us", 2 * HOUR)


@query(
    _E
    + f""", g as (select user_id, (ts_us + {HOUR - 1}) // {HOUR} * {HOUR} timer_us, count(*) own from e group by all)
    select user_id, timer_us, n from (select user_id, timer_us, cast(sum(own) over (partition by user_id order by timer_us) as bigint) n from g) where timer_us < (select max(ts_us) from e)"""
)
def cumulative_per_interval(spark, d):
    return keyed.cumulative_counts(events(spark, d), "user_id", "ts_us", HOUR)


_SLIDING = (
    _E
    + f""", b as (select user_id, ts_us // {HOUR} * {HOUR} b, count(*) n from e group by all), w as (select user_id, n, unnest(generate_series(b + {HOUR}, b + {DAY}, {HOUR})) end_us from b),
    s as (select user_id, end_us, cast(sum(n) as bigint) n from w where end_us < (select max(ts_us) from e) group by all) """
)


@query(_SLIDING + "select user_id, end_us, n from s")
def sliding_window(spark, d):
    return keyed.sliding_counts(events(spark, d), "user_id", "ts_us", DAY, HOUR)


@query(_SLIDING + f"select user_id, n, strftime(make_timestamp(end_us - {DAY}), '%Y-%m-%dT%H:%M:%SZ') || '/' || strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%SZ') as \"interval\" from s")
def sliding_window_intervals(spark, d):
    counts = keyed.sliding_counts(events(spark, d), "user_id", "ts_us", DAY, HOUR)
    return counts.select("user_id", "n", F.concat_ws("/", codecs.rfc3339(F.col("end_us") - DAY), codecs.rfc3339(F.col("end_us"))).alias("interval"))


_TIMERS = _E + f", t as (select distinct user_id, ts_us // {DAY} * {DAY} + {DAY} timer_us from e)"


@query(_TIMERS + " select user_id, timer_us from t")
def coalesced_timers(spark, d):
    return keyed.timers(events(spark, d), "user_id", truncate(F.col("ts_us"), DAY) + DAY)


@query(_TIMERS + " select user_id, min(timer_us) timer_us from t group by all")
def earliest_timers(spark, d):
    return coalesced_timers(spark, d).groupBy("user_id").agg(F.min("timer_us").alias("timer_us"))


@query("select job_name, max(checkpoint_id) checkpoint_id from job_checkpoints where status = 'completed' group by all")
def latest_checkpoint(spark, d):
    done = table(spark, d, "job_checkpoints").where(F.col("status") == "completed")
    return done.groupBy("job_name").agg(F.max("checkpoint_id").alias("checkpoint_id"))


@query("select event_type, min(event_id) event_id, bool_and(value >= 0.01) all_paid, arg_min(user_id, event_id) user_id from events group by all")
def unique_and_every(spark, d):
    """The first event of each type, and whether every one of a type has a value."""
    rows = table(spark, d, "events").groupBy("event_type")
    return rows.agg(F.min("event_id").alias("event_id"), F.every(F.col("value") >= 0.01).alias("all_paid"), F.min_by("user_id", "event_id").alias("user_id"))


@query(_TIMERS + ", w as (select min(m) - 1 watermark_us from (select max(ts_us) m from e group by event_id % 4)) select user_id, timer_us from t, w where timer_us <= watermark_us")
def due_timers(spark, d):
    e = events(spark, d)
    mark = keyed.min_watermark(e, F.pmod("event_id", F.lit(4)), "ts_us")
    return keyed.due_timers(keyed.timers(e, "user_id", truncate(F.col("ts_us"), DAY) + DAY), mark)


@query(_E + "select min(m) - 1 watermark_us from (select max(ts_us) m from e group by event_id % 4)")
def min_watermark(spark, d):
    return keyed.min_watermark(events(spark, d), F.pmod("event_id", F.lit(4)), "ts_us")


_ARRIVAL = "(event_id * 7919) % 1000003"


@query(_E + f"select event_id, ts_us, watermark_us from (select event_id, ts_us, max(ts_us) over (order by {_ARRIVAL}, event_id rows unbounded preceding) - 1 watermark_us from e) where ts_us <= watermark_us")
def late_events(spark, d):
    """Events at or before the watermark they arrive at, in a scrambled order of arrival; they are kept, never dropped."""
    e = events(spark, d).withColumn("arrival", F.expr(_ARRIVAL)).withColumn("stream", F.lit(0))
    seen = keyed.running(e, ["stream"], ["arrival", "event_id"], F.expr("arrival div 1000"), {"reach": F.col("ts_us")}, {"reach": "max"})
    return seen.where("ts_us < reach").select("event_id", "ts_us", (F.col("reach") - 1).alias("watermark_us"))


@query(_E + "select event_id, '{\"Topic\":\"' || event_type || '\",\"Data\":\"' || base64(encode(props)) || '\"}' record from e")
def sink_encode(spark, d):
    return table(spark, d, "events").select("event_id", codecs.sink_record(F.col("event_type"), F.col("props")).alias("record"))


@query(
    """with f as (select event_id, string_split(event_type || ';' || user_id || ';', ';') p from events), r as (select event_id, p, unnest(generate_series(1, len(p) - 1)) i from f)
    select event_id, cast(i - 1 as integer) nth, p[i] record from r"""
)
def framing_split(spark, d):
    text = F.concat("event_type", F.lit(";"), F.col("user_id").cast("string"), F.lit(";"))
    return table(spark, d, "events").select("event_id", F.posexplode(codecs.frames(text, ";")).alias("nth", "record"))


@query(_E + "select event_id, lpad(upper(to_hex(cents)), 16, '0') as sum_hex, cents, lpad(upper(to_hex(ts_us * 1000)), 16, '0') as time_hex from e")
def binary_codecs(spark, d):
    e = events(spark, d)
    return e.select("event_id", F.hex(codecs.long_to_bytes(F.col("cents"))).alias("sum_hex"), codecs.bytes_to_long(codecs.long_to_bytes(F.col("cents"))).alias("cents"), F.hex(codecs.micros_to_bytes(F.col("ts_us"))).alias("time_hex"))


@query(_E + f"select event_id, ts_us // {MINUTE} * {MINUTE} minute_us, (ts_us + {MINUTE - 1}) // {MINUTE} * {MINUTE} ceiling_us, (ts_us + {MINUTE // 2}) // {MINUTE} * {MINUTE} nearest_us, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ') rfc from e")
def time_functions(spark, d):
    ts = F.col("ts_us")
    return events(spark, d).select("event_id", truncate(ts, MINUTE).alias("minute_us"), ceiling(ts, MINUTE).alias("ceiling_us"), nearest(ts, MINUTE).alias("nearest_us"), codecs.rfc3339(ts).alias("rfc"))


@query("select cast(s as integer) split_no, cast(r as integer) read_no, cast(s + 3 * (r * 1000 + j) as varchar) value from generate_series(0, 2) a(s), generate_series(0, 1) b(r), generate_series(0, 999) c(j)")
def embedded_numbers(spark, d):
    from weirflow.sources.embedded import numbers

    return numbers(spark, splits=3, batch=1000, reads=2)


@query("select topic_name, split_partition, cast((row_number() over (order by topic_name, split_partition) - 1) % 3 as integer) runner from (select distinct topic_name, split_partition from kafka_records)")
def round_robin_splits(spark, d):
    from pyspark.sql import Window

    splits = table(spark, d, "kafka_records").select("topic_name", "split_partition").distinct()
    # splits are as few as a log has partitions
    nth = F.row_number().over(Window.orderBy("topic_name", "split_partition")) - 1
    return splits.select("topic_name", "split_partition", F.pmod(nth, F.lit(3)).cast("int").alias("runner"))


_RANGES = "select cast(i as integer) range_no, cast(i * {s} + least(i, {l}) as integer) group_start, cast(i * {s} + least(i, {l}) + {s} + (case when i < {l} then 1 else 0 end) as integer) group_end from generate_series(0, {n} - 1) t(i)"


@query(_RANGES.format(s=36, l=4, n=7))
def key_group_ranges(spark, d):
    return hashing.range_table(spark, 256, 7)


@query(f"select a.range_no to_no, b.range_no from_no from ({_RANGES.format(s=36, l=4, n=7)}) a join ({_RANGES.format(s=51, l=1, n=5)}) b on a.group_start < b.group_end and b.group_start < a.group_end")
def assign_ranges(spark, d):
    return hashing.assign_ranges(hashing.range_table(spark, 256, 7), hashing.range_table(spark, 256, 5))


_KNOWN = "with known as (select * from shards where shard_id not in (select shard_id from shard_states where is_finished and shard_id is not null))"


@query(_KNOWN + " select shard_id from known k where not exists (select 1 from (select unnest(k.parent_shard_ids) p) where p in (select shard_id from known))")
def available_shards(spark, d):
    finished = table(spark, d, "shard_states").where("is_finished").select("shard_id")
    known = table(spark, d, "shards").join(finished, "shard_id", "left_anti")
    return keyed.available_splits(known, "shard_id", "parent_shard_ids").select("shard_id")


@query("select shard_id, cast(least(3, floor((cast(hash_key_start as double) + cast(hash_key_end as double)) / 2 / pow(2, 128) * 4)) as integer) runner from shards")
def shard_assignment(spark, d):
    from weirflow.sources.kinesis import runner_of

    return table(spark, d, "shards").select("shard_id", runner_of(4)("hash_key_start", "hash_key_end").alias("runner"))


@query(
    """with k as (select distinct operator_id, hex(entry_k) h from kv_entries), s as (select *, cast('0x' || h[7:14] as bigint) n from k), t as (select *, cast('0x' || h[15 + 2 * n : 16 + 2 * n] as bigint) m from s)
    select operator_id, cast('0x' || h[1:4] as integer) key_group, decode(unhex(h[15 : 14 + 2 * n])) subject, decode(unhex(h[17 + 2 * n : 16 + 2 * n + 2 * m])) namespace, h[17 + 2 * n + 2 * m :] entry_hex from t"""
)
def state_key_layout(spark, d):
    keys = table(spark, d, "kv_entries").select("operator_id", "entry_k").distinct()
    part = codecs.parse_state_key(F.col("entry_k"))
    return keys.select("operator_id", part["key_group"].alias("key_group"), part["subject"].cast("string").alias("subject"), part["namespace"].cast("string").alias("namespace"), F.hex(part["entry"]).alias("entry_hex"))


@query("select operator_id, subject, namespace, count(*) n_entries from (" + SQL["state_key_layout"] + ") group by all")
def state_entries_by_namespace(spark, d):
    return state_key_layout(spark, d).groupBy("operator_id", "subject", "namespace").agg(F.count(F.lit(1)).alias("n_entries"))


@query("select distinct shard_id from shards where shard_id not in (select shard_id from shard_states where is_finished and shard_id is not null)")
def split_difference(spark, d):
    """Shards less those that are finished."""
    finished = table(spark, d, "shard_states").where("is_finished").select("shard_id")
    return table(spark, d, "shards").select("shard_id").subtract(finished)


@query("select 'kafka' log, topic_name || ':' || split_partition split_id, epoch_us(record_ts) us from kafka_records union all select 'kinesis', shard_id, epoch_us(approximate_arrival_timestamp) from kinesis_records")
def merge_sorted(spark, d):
    kafka = table(spark, d, "kafka_records").select(F.lit("kafka").alias("log"), F.concat_ws(":", "topic_name", F.col("split_partition").cast("string")).alias("split_id"), micros("record_ts").alias("us"))
    kinesis = table(spark, d, "kinesis_records").select(F.lit("kinesis").alias("log"), F.col("shard_id").alias("split_id"), micros("approximate_arrival_timestamp").alias("us"))
    return kafka.unionByName(kinesis).orderBy("us", "log", "split_id")


def _murmur3_sql(source: str, column: str) -> str:
    """Common table expressions that end in hashed(text, h): MurmurHash3 x86_32 of the UTF-8 bytes of each text in `column` of `source`, block by block."""
    turn = lambda x, r: f"((({x}) << {r}) & 4294967295) | (({x}) >> {32 - r})"
    times = lambda x, c: f"(({x})::hugeint * {c} % 4294967296)::bigint"
    k1 = times(turn(times("w", 3432918353), 15), 461845907)
    mixed = f"({times(turn(f'xor(h, {k1})', 13), 5)} + 3864292196) % 4294967296"
    return f"""recursive texts as (select distinct {column} as text, hex(encode({column})) x from {source} where {column} is not null),
    blocks as (select text, length(x) // 2 n, i, ('0x' || rpad(x[8 * i + 7 : 8 * i + 8], 2, '0') || rpad(x[8 * i + 5 : 8 * i + 6], 2, '0') || rpad(x[8 * i + 3 : 8 * i + 4], 2, '0') || rpad(x[8 * i + 1 : 8 * i + 2], 2, '0'))::bigint w
        from (select text, x, unnest(generate_series(0, length(x) // 8)) i from texts)),
    steps as (
        select text, n, -1::bigint i, 0::bigint h from blocks where i = 0
        union all
        select b.text, b.n, b.i, case when 4 * b.i + 4 <= b.n then {mixed} when 4 * b.i < b.n then xor(h, {k1}) else h end from steps s join blocks b on b.text = s.text and b.i = s.i + 1
    ),
    f0 as (select text, xor(arg_max(h, i), any_value(n)) h from steps group by text), f1 as (select text, {times("xor(h, h >> 16)", 2246822507)} h from f0),
    f2 as (select text, {times("xor(h, h >> 13)", 3266489909)} h from f1), hashed as (select text, xor(h, h >> 16) h from f2)"""


_USERS = _murmur3_sql("(select user_id::varchar k from events)", "k")
_PLACED = f"with {_USERS}, placed as (select text, (h % 256)::integer key_group from hashed)"
_OPERATOR = "(case when key_group < 148 then key_group // 37 else 4 + (key_group - 148) // 36 end)::integer"


@query(_PLACED + f" select key_group, {_OPERATOR} operator_no, count(distinct text) n_keys, count(*) n_events from placed join events on user_id::varchar = text group by all")
def key_group_placement(spark, d):
    """Keys and events of each key group and operator."""
    keys = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    placed = keys.withColumn("key_group", hashing.key_group(F.col("user_id").cast("string")))
    return placed.groupBy("key_group").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_events").alias("n_events")).withColumn("operator_no", hashing.range_index(F.col("key_group"), 256, 7))


@query(f"with {_murmur3_sql('sliding_events', 'event_key')} select text as event_key, h as hash from hashed")
def key_hashes(spark, d):
    """The hash of every event key."""
    keys = table(spark, d, "sliding_events").where("event_key is not null").select("event_key").distinct()
    return keys.select("event_key", hashing.murmur3(F.col("event_key")).alias("hash"))


@query(_PLACED + " select user_id, event_id from placed join events on user_id::varchar = text where key_group between 37 and 110")
def owned_events(spark, d):
    """Events of the keys that the operator with groups 37 to 110 owns."""
    return events(spark, d).where(hashing.owned(F.col("user_id").cast("string"), 37, 111)).select("user_id", "event_id")


@query(_PLACED + f""", t as (select distinct user_id, ts_us // {DAY} * {DAY} + {DAY} us from ({_E.removeprefix("with e as ").strip()}))
    select user_id, us timer_us, lpad(upper(to_hex(key_group)), 4, '0') || '01' || lpad(upper(to_hex(us * 1000)), 16, '0') || hex(encode(user_id::varchar)) key_hex from t join placed on user_id::varchar = text""")
def timer_key_layout(spark, d):
    """Stored keys of daily timers: their byte order is time order inside a key group."""
    subject = F.col("user_id").cast("string")
    key = codecs.timer_key(hashing.key_group(subject), F.col("timer_us"), subject)
    return coalesced_timers(spark, d).select("user_id", "timer_us", F.hex(key).alias("key_hex"))


@query(_PLACED + """, s as (select distinct user_id, event_type from events) select user_id, event_type, lpad(upper(to_hex(key_group)), 4, '0') || '00' || lpad(upper(to_hex(length(user_id::varchar))), 8, '0') || hex(encode(user_id::varchar))
    || '04' || hex(encode('type')) || hex(encode(event_type)) key_hex from s join placed on user_id::varchar = text""")
def state_key_encoding(spark, d):
    """Stored keys of a state entry for each user and type of event."""
    entries, subject = events(spark, d).select("user_id", "event_type").distinct(), F.col("user_id").cast("string")
    key = codecs.state_key(hashing.key_group(subject), subject, F.lit("type"), F.col("event_type"))
    return entries.select("user_id", "event_type", F.hex(key).alias("key_hex"))


@query(_E + f"""select event_id, min(m) watermark_us from (
    select a.event_id, u.u, (select max(ts_us) from e where event_id % 4 = u.u and event_id <= a.event_id) - 1 m from (select event_id from e where event_id % 97 = 0) a, (values (0), (1), (2), (3)) u(u)) group by event_id having count(m) = 4""")
def composite_watermark(spark, d):
    """The watermark over four upstreams at every 97th event: the least of what each of them has reached, once all have begun. The step is the interval of ticks."""
    e = events(spark, d).withColumn("one", F.lit(0))
    reach = {f"u{k}": F.when(F.pmod("event_id", F.lit(4)) == k, F.col("ts_us")) for k in range(4)}
    seen = keyed.running(e, ["one"], ["event_id"], F.expr("event_id div 1000"), reach, dict.fromkeys(reach, "max"))
    ticks = seen.where("event_id % 97 = 0 and u0 is not null and u1 is not null and u2 is not null and u3 is not null")
    return ticks.select("event_id", (F.least(*reach) - 1).alias("watermark_us"))


@query(_E + f"select event_id, timer_us from (select event_id, ts_us // {HOUR} * {HOUR} + {HOUR} timer_us, max(ts_us) over (order by {_ARRIVAL}, event_id rows between unbounded preceding and 1 preceding) - 1 mark from e) where mark is null or timer_us > mark")
def guarded_timers(spark, d):
    """Timers that events set, in a scrambled order of arrival: one that the watermark has reached already isn't set."""
    e = events(spark, d).withColumn("arrival", F.expr(_ARRIVAL)).withColumn("stream", F.lit(0))
    seen = keyed.running(e, ["stream"], ["arrival", "event_id"], F.expr("arrival div 1000"), {"reach": F.col("ts_us")}, {"reach": "max"}, before=True)
    timed = seen.withColumn("timer_us", truncate(F.col("ts_us"), HOUR) + HOUR)
    return timed.where("reach is null or timer_us > reach - 1").select("event_id", "timer_us")


@query("select key_word, list_sort(list(distinct event_type)) kept from (select props k, event_type, 'k' || (event_id % 5) key_word from events where event_type not in ('error', 'view') union all select props, 'added', 'k' || (event_id % 5) from events) group by 1")
def set_add_without(spark, d):
    """Sets of types by key: with one added and two taken out."""
    sets = table(spark, d, "events").groupBy(F.concat(F.lit("k"), F.pmod("event_id", F.lit(5)).cast("string")).alias("key_word")).agg(F.collect_set("event_type").alias("s"))
    return sets.select("key_word", F.array_sort(keyed.set_without(keyed.set_added(F.col("s"), F.lit("added")), F.lit("error"), F.lit("view"))).alias("kept"))


@query("select event_type, cast(sum(event_id) as bigint) reduced, count(*) n from events group by all")
def reduce_by_key(spark, d):
    """A fold over each type's events, in partial results first."""
    return table(spark, d, "events").groupBy("event_type").agg(F.sum("event_id").alias("reduced"), F.count(F.lit(1)).alias("n"))


@query(r"select doc_id, regexp_full_match(url, 'https?://[^/?#\s]+.*') valid from documents")
def address_checks(spark, d):
    """Which page addresses a source or sink would take: a scheme of HTTP and a host."""
    from weirflow.sources.httpapi import is_address

    return table(spark, d, "documents").select("doc_id", is_address(F.col("url")).alias("valid"))
