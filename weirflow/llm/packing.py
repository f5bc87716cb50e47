"""Filling containers of a fixed capacity with texts, by the sum of squares.

A text is placed where the sum, over all residual gaps, of the squared number of open containers with that gap becomes
smallest. Texts are dealt to packing groups by a hash of their id and place in the input. A task packs its groups one after another and holds
the gap counts and the sizes of one group's texts. A group's size is a parameter, so its share of unfilled containers is small
at every scale; a task's memory doesn't grow with the corpus, and there are TASK_GROUPS times fewer tasks than groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.runtime import cut

CAPACITY = 2048
GROUP_TOKENS = 4_000_000
#: Groups that one task packs, one after another.
TASK_GROUPS = 256
_GROUP_SHIFT = 40
SCHEMA = "container_id long, doc_id long, piece_no int, first_token long, n_tokens long"


class SumOfSquares:
    """Open containers by residual gap."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def place(self, size: int) -> int:
        """The container that gets a text of 1 to capacity tokens."""
        cap, count = self.capacity, self.count
        # change of the sum when a container leaves gap h for gap h - size; leaving for 0 closes it
        change = 1 - 2 * count[size:cap]
        change[1:] += 2 * count[1 : cap - size] + 1
        fresh = 2 * count[cap - size] + 1 if size < cap else 0
        used = count[size:cap] > 0
        best = -1
        if used.any():
            change[~used] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if change[best] > fresh:
                best = -1
        if best < 0:
            number, gap = self.containers, cap
            self.containers += 1
        else:
            gap = size + best
            number = self.open[gap].pop()
            count[gap] -= 1
        left = gap - size
        if left:
            self.open[left].append(number)
            count[left] += 1
        return number


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(container, text, piece, first token, tokens) of all pieces of one group's texts, in the order given; text is the place in it.

    A text over the capacity is cut into full containers and a rest, which is placed like a text. Texts without
    tokens take no room and lie in the first container.
    """
    packer = SumOfSquares(capacity)
    box, who, piece, first, n = [], [], [], [], []

    def put(i, p, at, size, number) -> None:
        who.append(i), piece.append(p), first.append(at), n.append(size), box.append(number)

    for i, size in enumerate(sizes.tolist()):
        if size == 0:
            packer.containers = max(1, packer.containers)
            put(i, 0, 0, 0, 0)
            continue
        p = at = 0
        while size - at > capacity:
            put(i, p, at, capacity, packer.place(capacity))
            p, at = p + 1, at + capacity
        put(i, p, at, size - at, packer.place(size - at))
    return np.array(box, np.int64), np.array(who, np.int64), np.array(piece, np.int32), np.array(first, np.int64), np.array(n, np.int64)


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """container_id, doc_id, piece_no, first_token, n_tokens: every text's place.

    sizes has doc_id (long) and n_tokens. A text has one piece unless it is larger than the capacity. Null sizes count as 0, and rows of
    the same doc_id are separate texts and don't crowd into one group. The same input in the same partitions gives the same containers. An empty input gives no rows.
    """
    kept = cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    # an empty text counts as one token here, so that groups of empty texts have a bound too
    total = kept.agg(F.sum(F.greatest("n_tokens", F.lit(1)))).first()[0] or 0
    groups = max(1, ceil(total / group_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def packed() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            box, row, piece, first, n = pack_group(rows["n_tokens"].to_numpy(), capacity)
            arrays = [pa.array((now << _GROUP_SHIFT) + box), rows["doc_id"].take(pa.array(row)).combine_chunks(), *map(pa.array, (piece, first, n))]
            yield pa.RecordBatch.from_arrays(arrays, names=["container_id", "doc_id", "piece_no", "first_token", "n_tokens"])

        for b in batches:
            group = b["g"].to_numpy()
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []
            for a, z in zip(edges, [*edges[1:], len(group)]):
                if held and group[a] != now:
                    yield from packed()
                now = int(group[a])
                held.append(b.slice(a, z - a))
        if held:
            yield from packed()

    placed = kept.withColumn("g", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    # a task has whole groups; larger texts come first, which leaves small ones to fill gaps
    tasks = min(groups, max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(groups / TASK_GROUPS)))
    each = placed.repartitionById(tasks, F.pmod("g", F.lit(tasks))).sortWithinPartitions("g", F.desc("n_tokens"), "doc_id")
    return each.mapInArrow(run, SCHEMA)
