"""Connectors by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weirflow.sinks.httpapi import HttpApiSink
from weirflow.sources.embedded import EmbeddedSource
from weirflow.sources.httpapi import HttpApiSource
from weirflow.sources.kinesis import KinesisSource

#: Names a configuration may use for its source and its sink.
SOURCES = ("kinesis", "httpapi", "embedded", "stdio", "kafka")
SINKS = ("httpapi", "stdio", "kafka", "memory", "parquet")


def register(spark: SparkSession) -> None:
    """Makes the Python connectors known to a session."""
    for c in (EmbeddedSource, HttpApiSource, KinesisSource, HttpApiSink):
        spark.dataSource.register(c)
