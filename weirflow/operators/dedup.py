"""Messages delivered more than once: exactly one copy of each comes out.

A message is identified by its producer and the number the producer gave it. Per producer the numbers seen
so far are kept as disjoint ranges: an uncovered number is accepted once and its range merged in. A number of more than 18 digits
has its ranges by its last 18 digits, among the numbers of its producer that begin alike. Identifiers that are no numbers are looked up exactly, by
producer and spelling.

How it runs: every Arrow batch of a map task first marks the copies it can see itself, so a message that makes
up a third of all rows sends one row per batch to its range task and its other copies are dealt out evenly. Rows
are then shuffled by producer and block of BLOCK numbers and sorted by order of delivery; one pass holds
the ranges of one block at a time, so memory doesn't grow with a producer. Ranges kept between runs
are cut at block borders for the same reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.numbers import canonical_decimal
from weirflow.runtime import cut

#: Digits of a number that ranges are made of; those before them go with the producer.
DIGITS = 18
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
_FIRST, _LAST = -(2**63), 2**63 - 1

RANGE_SCHEMA = T.StructType(
    [
        T.StructField("producer", T.StringType()),
        T.StructField("range_lo", T.LongType()),
        T.StructField("range_hi", T.LongType()),
        T.StructField("spelling", T.StringType()),
    ]
)


class RangeSet:
    """Disjoint closed ranges of whole numbers, no two of them adjacent."""

    def __init__(self) -> None:
        self.lo = np.empty(0, np.int64)
        self.hi = np.empty(0, np.int64)

    def covers(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.lo):
            return np.zeros(len(numbers), bool)
        at = np.searchsorted(self.lo, numbers, "right") - 1
        return (at >= 0) & (numbers <= self.hi[np.maximum(at, 0)])

    def add(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Merges ranges in; they may touch, overlap and repeat."""
        if not len(lo):
            return
        lo, hi = np.concatenate([self.lo, lo]), np.concatenate([self.hi, hi])
        order = np.argsort(lo, kind="stable")
        lo, reach = lo[order], np.maximum.accumulate(hi[order])
        starts = np.ones(len(lo), bool)
        starts[1:] = lo[1:] > reach[:-1] + 1
        ends = np.append(np.flatnonzero(starts)[1:] - 1, len(lo) - 1)
        self.lo, self.hi = lo[starts], reach[ends]

    def accept(self, numbers: np.ndarray) -> np.ndarray:
        """Which of the numbers, in this order, are met for the first time; they count as seen afterwards."""
        fresh = ~self.covers(numbers)
        firsts = np.zeros(len(numbers), bool)
        firsts[np.unique(numbers, return_index=True)[1]] = True
        fresh &= firsts
        new = numbers[fresh]
        self.add(new, new)
        return fresh


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values get equal codes, in order of appearance; -1 is null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _longs(column: pa.Array, null: int) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def _mark_local_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each batch, all copies of an identifier but the first delivered are known to be repeats."""
    for batch in batches:
        producer, spelling = _codes(batch["p"]), _codes(batch["x"])
        number, order = _longs(batch["n"], -1), _longs(batch["o"], _LAST)
        ranked = np.lexsort((order, spelling, number, producer))
        same = np.zeros(len(ranked), bool)
        for values in (producer, number, spelling):
            values = values[ranked]
            step = np.zeros(len(ranked), bool)
            step[1:] = values[1:] != values[:-1]
            same |= step
        known = np.zeros(len(ranked), bool)
        known[ranked] = ~same
        if len(ranked):
            known[ranked[0]] = False
        known &= (producer >= 0) & ((number >= 0) | (spelling >= 0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known)], names=[*batch.schema.names, "known"])


def _accept_uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by producer, block, spelling and order; emits each row marked, and the ranges of every block left behind."""
    open_group: tuple | None = None
    seen = RangeSet()
    spelled = False
    row_type = None

    def ranges_out(ranges: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*ranges))
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(ranges), row_type), pa.nulls(len(ranges), pa.bool_()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            names=["row", "is_repeat", *RANGE_SCHEMA.names],
        )

    def left_behind() -> list[tuple]:
        if open_group is None:
            return []
        producer, block, spelling = open_group
        if block is None:
            return [(producer, None, None, spelling)] if spelled else []
        return [(producer, int(a), int(b), spelling) for a, b in zip(seen.lo + block * BLOCK, seen.hi + block * BLOCK)]

    for batch in batches:
        row_type = batch.schema.field("row").type
        size = batch.num_rows
        if not size:
            continue
        known = batch["known"].to_numpy(zero_copy_only=False).astype(bool)
        stored = _longs(batch["hi"], -1) >= 0
        producer, spelling = _codes(batch["p"]), _codes(batch["x"])
        number, high, block = _longs(batch["n"], -1), _longs(batch["hi"], -1), _longs(batch["b"], -1)
        is_stored = batch["s"].to_numpy(zero_copy_only=False).astype(bool)
        named = (producer >= 0) & ((number >= 0) | (spelling >= 0)) & ~known
        repeat = known.copy()
        at = np.flatnonzero(named)
        if len(at):
            starts = np.ones(len(at), bool)
            for values in (producer, block, spelling):
                values = values[at]
                starts[1:] &= values[1:] == values[:-1]
            starts[1:] = ~starts[1:]
            heads = at[starts]
            group = np.cumsum(starts) - 1
            keys = [(batch["p"][int(i)].as_py(), int(block[i]) if block[i] >= 0 else None, batch["x"][int(i)].as_py()) for i in heads[[0, -1]]]
            carried = keys[0] == open_group
            if not carried:
                if out := left_behind():
                    yield ranges_out(out)
                seen, spelled = RangeSet(), False
            # all blocks of this batch in one number line, a gap of one block between any two
            base = group * (2 * BLOCK)
            offset = number[at] & (BLOCK - 1)
            counted = number[at] >= 0
            old = stored[at] & counted
            seen.add((base + offset)[old], (base + (high[at] & (BLOCK - 1)))[old])
            fresh = counted & ~old
            repeat[at[fresh]] = ~seen.accept((base + offset)[fresh])
            exact = ~counted
            if exact.any():
                later = ~starts & exact
                if carried and spelled and exact[0]:
                    later[0] = True
                repeat[at[later]] = True
            # ranges of the blocks that are done; the last one may go on in the next batch
            last = group[-1]
            line = seen.lo // (2 * BLOCK)
            done, stay = line < last, line == last
            out = []
            if done.any():
                names, beginnings = (batch[c].take(pa.array(heads[line[done]])).to_pylist() for c in ("p", "x"))
                shift = block[heads[line[done]]] * BLOCK - line[done] * (2 * BLOCK)
                out += zip(names, (seen.lo[done] + shift).tolist(), (seen.hi[done] + shift).tolist(), beginnings)
            closed = heads[:-1][number[heads[:-1]] < 0]
            if len(closed):
                out += zip(batch["p"].take(pa.array(closed)).to_pylist(), [None] * len(closed), [None] * len(closed), batch["x"].take(pa.array(closed)).to_pylist())
            if out:
                yield ranges_out(out)
            seen.lo, seen.hi = seen.lo[stay] - last * 2 * BLOCK, seen.hi[stay] - last * 2 * BLOCK
            open_group, spelled = keys[1], keys[1][1] is None
        fed = pa.array(~is_stored)
        marked = pa.RecordBatch.from_arrays(
            [batch["row"], pa.array(repeat), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.string())],
            names=["row", "is_repeat", *RANGE_SCHEMA.names],
        )
        yield marked.filter(fed)
    if out := left_behind():
        yield ranges_out(out)


def _run(df: DataFrame, producer: str, sequence: str, order: str, keep: list[str] | None, seen: DataFrame | None) -> DataFrame:
    rows = df.select(
        F.struct(*[df[c] for c in (df.columns if keep is None else keep)]).alias("row"),
        df[producer].cast("string").alias("p"),
        df[sequence].cast("string").alias("x"),
        df[order].cast("long").alias("o"),
    )
    rows = rows.withColumn("d", canonical_decimal(F.col("x"))).withColumn("n", F.substring("d", -DIGITS, DIGITS).cast("long"))
    # beside a number x is how it begins, if it has more digits, else it is the spelling
    beginning = F.when(F.length("d") > DIGITS, F.substring(F.col("d"), F.lit(1), F.length("d") - DIGITS))
    rows = rows.withColumn("x", F.when(F.col("n").isNull(), F.trim("x")).otherwise(beginning)).drop("d")
    schema = T.StructType([*rows.schema.fields, T.StructField("known", T.BooleanType())])
    rows = rows.mapInArrow(_mark_local_copies, schema)
    rows = rows.withColumn("hi", F.lit(None).cast("long")).withColumn("s", F.lit(False))
    if seen is not None:
        block = F.explode_outer(F.when(F.col("range_lo").isNotNull(), F.sequence(F.shiftright("range_lo", BLOCK_BITS), F.shiftright("range_hi", BLOCK_BITS))))
        old = seen.select("producer", "range_lo", "range_hi", "spelling", block.alias("blk")).select(
            F.lit(None).cast(rows.schema["row"].dataType).alias("row"),
            F.col("producer").alias("p"),
            F.col("spelling").alias("x"),
            F.lit(_FIRST).alias("o"),
            F.greatest("range_lo", F.col("blk") * BLOCK).alias("n"),
            F.lit(False).alias("known"),
            F.least("range_hi", F.col("blk") * BLOCK + (BLOCK - 1)).alias("hi"),
            F.lit(True).alias("s"),
        )
        rows = rows.unionByName(old)
    placed = ~F.col("known") & F.col("p").isNotNull() & (F.col("n").isNotNull() | F.col("x").isNotNull())
    rows = rows.withColumn("b", F.shiftright("n", BLOCK_BITS)).withColumn("o", F.coalesce("o", F.lit(_LAST)))
    route = F.when(placed, F.xxhash64("p", "b", "x")).otherwise(F.xxhash64("o", F.monotonically_increasing_id()))
    rows = rows.withColumn("route", route).repartition("route").sortWithinPartitions("p", "b", "x", "o", F.desc("s")).drop("route")
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType, True), T.StructField("is_repeat", T.BooleanType()), *RANGE_SCHEMA.fields])
    return rows.mapInArrow(_accept_uncovered, out)


def mark_repeats(df: DataFrame, producer: str, sequence: str, order: str, keep: list[str] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Every row of df with `is_repeat`: false for the copy of each message that is to be kept.

    The copy kept is the one lowest in `order` (null orders come last; of equal orders any one is kept). Numbers
    are compared as numbers of any length, whatever white space, plus sign or zeros they are spelled with; what is no whole
    number is compared by its trimmed spelling. Rows whose producer or
    sequence is null have no identity and are never repeats. `seen` holds ranges of earlier runs
    (see new_ranges). `keep` names the columns to come out (all by default), in a struct `row` so that any name may
    be used. An empty df gives no rows.
    """
    return _run(df, producer, sequence, order, keep, seen).where("is_repeat is not null").select("row", "is_repeat")


def drop_repeats(df: DataFrame, producer: str, sequence: str, order: str, keep: list[str] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The rows of mark_repeats that are no repeats, with df's own columns."""
    return mark_repeats(df, producer, sequence, order, keep, seen).where(~F.col("is_repeat")).select("row.*")


def accept_batch(df: DataFrame, producer: str, sequence: str, order: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One run of a feed: (rows accepted, ranges seen after it). Both come from one computation kept in the shared folder."""
    whole = cut(_run(df, producer, sequence, order, None, seen))
    accepted = whole.where(~F.col("is_repeat")).select("row.*")
    ranges = whole.where("is_repeat is null").select(*RANGE_SCHEMA.names)
    if seen is not None:
        # blocks without a row in this run keep their ranges through the same pass: stored ranges are rows of it
        ranges = ranges.distinct()
    return accepted, ranges
