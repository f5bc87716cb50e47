"""Applying a feed of puts and deletes, repeated and out of order, to rebuild a table's current state.

Rows are dealt to buckets by entry. Each bucket has a task with an embedded DuckDB: rows are upserted in steps, a conflict
is resolved by comparing the stored sequence with the new one, and deletes stay as tombstones, so an older put that arrives
later can't bring an entry back. Each Arrow batch is first reduced to its newest row per entry on the map side, so an entry with a
third of all rows sends one row per batch.

A bucket may have any size: its rows come sorted by a hash of the entry, and once DuckDB holds CHUNK_BYTES of whole entries they are
exported and the next ones begin, so a task's memory has a bound whatever lies in its bucket.

A Store keeps the state by bucket. A run reads, upserts and writes only the buckets its feed touches, and publishes them together
with the untouched ones of older runs in one manifest (weirflow.versions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.runtime import cut, partitions_for
from weirflow.versions import Versions

#: Bytes in memory of the rows dealt to one bucket of a new store.
BUCKET_BYTES = 1 << 30
#: Bytes of rows that a task's DuckDB takes before it exports its entries, and those that one step hands to it.
CHUNK_BYTES, STEP_BYTES = 32 << 20, 8 << 20
STATE = "owner string, entry_k binary, entry_v binary, seq_num long, is_deleted boolean"

_NEWEST = """
    select owner, entry_k, max(struct_pack(s := seq_num, d := is_deleted, n := entry_v is not null, v := coalesce(entry_v, ''::blob))) e
    from batch group by all
"""
_TABLE = """
    create table state (
        owner_null boolean, owner varchar, k_null boolean, entry_k blob, entry_v blob, seq_num bigint, is_deleted boolean,
        primary key (owner_null, owner, k_null, entry_k)
    )
"""
_UPSERT = f"""
    insert into state
    select owner is null, coalesce(owner, ''), entry_k is null, coalesce(entry_k, ''::blob), case when e.n then e.v end, e.s, e.d from ({_NEWEST})
    on conflict do update set entry_v = excluded.entry_v, seq_num = excluded.seq_num, is_deleted = excluded.is_deleted
    where excluded.seq_num > state.seq_num
       or excluded.seq_num = state.seq_num
          and (excluded.is_deleted, excluded.entry_v is not null, coalesce(excluded.entry_v, ''::blob)) > (state.is_deleted, state.entry_v is not null, coalesce(state.entry_v, ''::blob))
"""
_EXPORT = "select case when not owner_null then owner end as owner, case when not k_null then entry_k end as entry_k, entry_v, seq_num, is_deleted from state"
_COLUMNS = ["owner", "entry_k", "entry_v", "seq_num", "is_deleted"]


def _database(memory: str):
    import duckdb

    db = duckdb.connect(":memory:")
    db.execute(f"set threads = 1; set memory_limit = '{memory}'; set temp_directory = ''; set preserve_insertion_order = false")
    return db


def _arrow(relation) -> pa.Table:
    table = relation.to_arrow_table() if hasattr(relation, "to_arrow_table") else relation.arrow()
    return table.read_all() if isinstance(table, pa.RecordBatchReader) else table


_SCHEMA = pa.schema([("owner", pa.string()), ("entry_k", pa.binary()), ("entry_v", pa.binary()), ("seq_num", pa.int64()), ("is_deleted", pa.bool_())])


def _plain(table: pa.Table) -> list[pa.RecordBatch]:
    return table.select(_COLUMNS).cast(_SCHEMA).to_batches()


def _reduce(memory: str):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database(memory)
        for b in batches:
            db.register("batch", pa.Table.from_batches([b]))
            yield from _plain(_arrow(db.sql(f"select owner, entry_k, case when e.n then e.v end entry_v, e.s seq_num, e.d is_deleted from ({_NEWEST})")))
            db.unregister("batch")

    return reduce


def _upsert(memory: str, step_rows: int, chunk_bytes: int):
    """Rows sorted by (bucket, place) to the newest of each entry. Places are hashes of entries: all rows of an entry stand together."""

    def upsert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database(memory)
        held: list[pa.RecordBatch] = []
        waiting = inside = 0  # bytes of held, and of what DuckDB has taken since it was empty

        def apply() -> None:
            nonlocal waiting, inside
            if held:
                db.register("batch", pa.Table.from_batches(held))
                db.execute(_UPSERT)
                db.unregister("batch")
                inside += waiting
                held.clear()
                waiting = 0

        def export(bucket: int) -> Iterator[pa.RecordBatch]:
            nonlocal inside
            apply()
            for b in _plain(_arrow(db.sql(_EXPORT))):
                yield b.append_column("bucket", pa.array(np.full(b.num_rows, bucket, np.int32)))
            db.execute("drop table state")
            db.execute(_TABLE)
            inside = 0

        db.execute(_TABLE)
        now: tuple[int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            bucket, place = b["bucket"].to_numpy(), b["place"].to_numpy()
            rows = b.select(_COLUMNS)
            # stretches of one bucket; a chunk may end where the place changes
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, z in zip(edges, np.append(edges[1:], len(bucket))):
                if now is not None and now[0] != bucket[a]:
                    yield from export(now[0])
                elif now is not None and inside + waiting >= chunk_bytes:
                    changes = np.flatnonzero(place[a:z] != np.append(now[1], place[a : z - 1]))
                    if len(changes):
                        if changes[0]:
                            held.append(rows.slice(a, int(changes[0])))
                        yield from export(now[0])
                        a = a + int(changes[0])
                part = rows.slice(a, int(z - a))
                held.append(part)
                waiting += part.get_total_buffer_size() * part.num_rows // max(1, b.num_rows)
                now = (int(bucket[z - 1]), int(place[z - 1]))
                if waiting >= STEP_BYTES or sum(x.num_rows for x in held) >= step_rows:
                    apply()
        if now is not None:
            yield from export(now[0])

    return upsert


def _rows(feed: DataFrame, owner: str, key: str, value: str, seq: str, deleted: str, memory: str) -> DataFrame:
    """A feed's rows in the state's form, each Arrow batch reduced to its newest row of every entry."""
    rows = feed.select(
        feed[owner].cast("string").alias("owner"),
        feed[key].cast("binary").alias("entry_k"),
        feed[value].cast("binary").alias("entry_v"),
        F.coalesce(feed[seq].cast("long"), F.lit(-(2**63))).alias("seq_num"),
        F.coalesce(feed[deleted], F.lit(False)).alias("is_deleted"),
    )
    return rows.mapInArrow(_reduce(memory), STATE)


def _place() -> Column:
    return F.xxhash64("owner", "entry_k")


def _bucket(buckets: int) -> Column:
    return F.pmod(_place(), F.lit(buckets)).cast("int")


def _upserted(rows: DataFrame, memory: str, step_rows: int, chunk_bytes: int) -> DataFrame:
    """The state and bucket of rows that are dealt to tasks by bucket already."""
    placed = rows.withColumn("place", _place()).sortWithinPartitions("bucket", "place")
    return placed.mapInArrow(_upsert(memory, step_rows, chunk_bytes), STATE + ", bucket int")


def apply_feed(feed: DataFrame, owner: str, key: str, value: str, seq: str, deleted: str, state: DataFrame | None = None, buckets: int | None = None, memory: str = "600MB", step_rows: int = 100_000, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """owner, entry_k, entry_v, seq_num, is_deleted of the newest row of each (owner, key), tombstones included.

    `state` is an earlier result; it takes part like a feed. Of equal sequences a delete wins, then the larger value (null
    is smallest). A null sequence is older than any other, a null deleted flag is no delete. Null owners and null keys
    are values like others; keys compare byte by byte. Values of deletes are kept as they came. An empty feed gives no rows.
    `buckets` defaults to one for each BUCKET_BYTES of the input.
    """
    rows = _rows(feed, owner, key, value, seq, deleted, memory)
    if state is not None:
        rows = rows.unionByName(state.select(*_COLUMNS))
    n = buckets or partitions_for(BUCKET_BYTES, feed, *([] if state is None else [state]))
    dealt = rows.withColumn("bucket", _bucket(n)).repartitionById(n, F.col("bucket"))
    return _upserted(dealt, memory, step_rows, chunk_bytes).drop("bucket")


def live(state: DataFrame) -> DataFrame:
    """The entries that are no tombstones."""
    return state.where(~F.col("is_deleted"))


class Store:
    """A table's state in buckets below a folder all executors share. The number of buckets is fixed by the first run, from its feed's size unless given."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, memory: str = "600MB", step_rows: int = 100_000, chunk_bytes: int = CHUNK_BYTES) -> None:
        self.spark, self.buckets, self.limits = spark, buckets, (memory, step_rows, chunk_bytes)
        self.versions = Versions(spark, path)

    def apply(self, feed: DataFrame, owner: str, key: str, value: str, seq: str, deleted: str) -> list[int]:
        """Brings a feed in and publishes the outcome whole; returns the buckets it touched.

        Rules for rows are those of apply_feed. Before the manifest is there nothing of a run can be seen, so a run that fails is simply
        run again, and a feed that comes twice changes nothing.
        """
        number, notes, held = self.versions.latest()
        buckets = notes.get("buckets") or self.buckets or partitions_for(BUCKET_BYTES, feed)
        rows = _rows(feed, owner, key, value, seq, deleted, self.limits[0]).withColumn("bucket", _bucket(buckets))
        if not held:
            dealt = rows.repartitionById(buckets, F.col("bucket"))
        else:
            rows = cut(rows)
            # as many rows as there are buckets at most
            touched = {str(r.bucket) for r in rows.select("bucket").distinct().collect()}
            if not touched:
                return []
            old = self.versions.read(held, STATE, touched)
            dealt = rows.unionByName(old.withColumn("bucket", _bucket(buckets))).repartition(len(touched), "bucket")
        version = self.versions.folder()
        _upserted(dealt, *self.limits).write.partitionBy("bucket").parquet(f"{self.versions.path}/{version}")
        written = self.versions.subfolders(version, "bucket")
        self.versions.publish(number, held | written, {"buckets": buckets})
        return sorted(map(int, written))

    def read(self) -> DataFrame:
        """The state as of the newest version, tombstones included; a store without versions is empty."""
        return self.versions.read(self.versions.latest()[2], STATE)


def publish(state: DataFrame, path: str) -> str:
    """Makes a whole state the newest version below path; returns the version's folder. Readers see the old version or the new one, whole."""
    versions = Versions(state.sparkSession, path)
    number, version = versions.latest()[0], versions.folder()
    state.write.parquet(f"{versions.path}/{version}")
    versions.publish(number, {"all": version})
    return f"{versions.path}/{version}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version's state."""
    versions = Versions(spark, path)
    return versions.read(versions.latest()[2], STATE)
