"""A source that counts: split i of n gives the decimal strings i, i + n, i + 2n, ...

`format("embedded")` with the options splits (1), batch (1000, numbers for each split and read) and reads (batch mode: reads in all, 1).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def numbers(spark: SparkSession, splits: int = 1, batch: int = 1000, reads: int = 1) -> DataFrame:
    """split_no, read_no, value: what `reads` reads of all splits give, without a Python worker."""
    n = F.col("id")
    rows = spark.range(splits * batch * reads)
    split = n % splits
    return rows.select(split.cast("int").alias("split_no"), F.expr(f"id div {splits * batch}").cast("int").alias("read_no"), n.cast("string").alias("value"))


class _Piece(InputPartition):
    def __init__(self, split: int, first: int, last: int) -> None:
        super().__init__(split)
        self.split, self.first, self.last = split, first, last


def _emit(piece: _Piece, splits: int) -> Iterator[tuple]:
    for k in range(piece.first, piece.last):
        yield piece.split, str(piece.split + splits * k)


class _Options:
    def __init__(self, options: dict) -> None:
        self.splits, self.batch, self.reads = (int(options.get(k, v)) for k, v in (("splits", 1), ("batch", 1000), ("reads", 1)))
        self.start = json.loads(options.get("startOffset", '{"given": 0}'))
        if min(self.splits, self.batch, self.reads) < 1:
            raise ValueError("splits, batch and reads are at least 1")


class _Reader(DataSourceReader):
    def __init__(self, o: _Options) -> None:
        self.o = o

    def partitions(self):
        return [_Piece(s, 0, self.o.batch * self.o.reads) for s in range(self.o.splits)]

    def read(self, partition):
        return _emit(partition, self.o.splits)


class _Stream(DataSourceStreamReader):
    """One read of every split per trigger. The offset is the number of values each split has given."""

    def __init__(self, o: _Options) -> None:
        self.o, self.given = o, None

    def initialOffset(self):
        return self.o.start

    def latestOffset(self):
        self.given = (self.o.start["given"] if self.given is None else self.given) + self.o.batch
        return {"given": self.given}

    def partitions(self, start, end):
        self.given = max(self.given or 0, end["given"])
        return [_Piece(s, start["given"], end["given"]) for s in range(self.o.splits)]

    def read(self, partition):
        return _emit(partition, self.o.splits)

    def commit(self, end):
        pass


class EmbeddedSource(DataSource):
    @classmethod
    def name(cls):
        return "embedded"

    def schema(self):
        return "split_no int, value string"

    def reader(self, schema):
        return _Reader(_Options(self.options))

    def streamReader(self, schema):
        return _Stream(_Options(self.options))
