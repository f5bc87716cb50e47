"""Values to a byte stream, as they are, without added line ends."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame


def write(df: DataFrame, column: str = "value", stream=None) -> None:
    """Rows go through the driver one partition at a time; meant for small results."""
    out = stream or sys.stdout.buffer
    for row in df.select(df[column].cast("binary").alias("v")).toLocalIterator():
        if row.v is not None:
            out.write(bytes(row.v))
    out.flush()


def each_batch(column: str = "value", stream=None):
    """For writeStream.foreachBatch."""
    return lambda df, _: write(df, column, stream)
