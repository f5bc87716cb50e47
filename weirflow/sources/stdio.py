"""Delimited records from a byte stream or from files."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

MAX_RECORD = 64 * 1024


def records(stream: BinaryIO, delimiter: bytes = b"\n", limit: int = MAX_RECORD) -> Iterator[bytes]:
    """What stands between delimiters; an unterminated last record is kept. A record over the limit is an error."""
    if not delimiter:
        raise ValueError("the delimiter has at least one byte")
    held = b""
    while True:
        block = stream.read(MAX_RECORD)
        *whole, held = (held + block).split(delimiter)
        for r in whole if block else [*whole, *([held] if held else [])]:
            if len(r) > limit:
                raise ValueError(f"a record has more than {limit} bytes")
            yield r
        if not block:
            return
        if len(held) > limit + len(delimiter):
            raise ValueError(f"a record has more than {limit} bytes")


def read_stdin(spark: SparkSession, delimiter: bytes = b"\n", stream: BinaryIO | None = None) -> DataFrame:
    """value: the records of standard input, which is the driver's own and read to its end."""
    return spark.createDataFrame([(bytearray(r),) for r in records(stream or sys.stdin.buffer, delimiter)], "value binary")


def read_files(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    """value: the records of files, split by the executors."""
    return spark.read.option("lineSep", delimiter).text(path).selectExpr("cast(value as binary) as value")
