"""Options for Spark's own Kafka connector, which has the same envelope: topic, partition, offset, key, value, timestamp, headers.

The connector's jar must be on the cluster's class path; it isn't part of this package.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def options(brokers: Sequence[str], topics: Sequence[str], group: str) -> dict[str, str]:
    for name, value in (("brokers", brokers), ("topics", topics), ("consumer group", group)):
        if not value or any(not v for v in value):
            raise ValueError(f"{name} must be given")
    return {"kafka.bootstrap.servers": ",".join(brokers), "subscribe": ",".join(topics), "kafka.group.id": group, "includeHeaders": "true", "startingOffsets": "earliest"}


def read_stream(spark: SparkSession, brokers: Sequence[str], topics: Sequence[str], group: str, start: str | None = None) -> DataFrame:
    """`start` is an offset as the connector notes it, {topic: {partition: offset}} in JSON."""
    own = options(brokers, topics, group) | ({} if start is None else {"startingOffsets": start})
    return spark.readStream.format("kafka").options(**own).load()


def write_stream(df: DataFrame, brokers: Sequence[str], topic: str, checkpoint: str):
    """A started query that sends df's value column to one topic."""
    return df.select("value").writeStream.format("kafka").option("kafka.bootstrap.servers", ",".join(brokers)).option("topic", topic).option("checkpointLocation", checkpoint).start()
