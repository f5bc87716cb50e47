"""Tables sent through the connectors and back, each next to the SQL that states what must come out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import registry
from weirflow.functions import codecs
from weirflow.functions.numbers import canonical_decimal
from weirflow.runtime import filesystem, micros, scratch, table
from weirflow.testing import httpservice


def http_round(spark: SparkSession, d: str) -> DataFrame:
    """Every event through the HTTP sink to a service on this machine, and back through the HTTP source as a stream."""
    registry.register(spark)
    at = scratch(spark, "http")
    with httpservice.serve(httpservice.Topics(page_size=20_000)) as addr:
        record = codecs.sink_record(F.lit("events"), F.concat_ws("|", "event_id", "event_type"))
        table(spark, d, "events").select(record.alias("value")).write.format("httpapi-sink").mode("append").option("addr", addr).save()
        q = spark.readStream.format("httpapi").options(addr=addr, topic="events").load().writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").start()
        q.processAllAvailable()
        q.stop()
    part = F.split(F.col("value").cast("string"), "\\|")
    return spark.read.schema("cursor long, value binary").parquet(f"{at}/out").select(part[0].cast("long").alias("event_id"), part[1].alias("event_type"))


def kinesis_round(spark: SparkSession, d: str) -> DataFrame:
    """All messages of all shards through the Kinesis source, parents before children, several reads a shard, and the number of the micro-batch each came in."""
    registry.register(spark)
    at = scratch(spark, "kinesis").removeprefix("file://")
    number = canonical_decimal(F.col("sequence_number"))
    records = table(spark, d, "kinesis_records").select(F.col("shard_id").alias("shard"), number.alias("sequence_number"), "partition_key", F.col("record_data").alias("data"), micros("approximate_arrival_timestamp").alias("at_us"))
    one = records.groupBy("shard", "sequence_number").agg(*[F.min(c).alias(c) for c in ("partition_key", "data", "at_us")])
    shards = table(spark, d, "shards").select("shard_id", F.col("hash_key_start").alias("start"), F.col("hash_key_end").alias("end"), F.col("parent_shard_ids").alias("parents")).distinct()
    one.repartition("shard").sortWithinPartitions("shard", F.length("sequence_number"), "sequence_number").write.partitionBy("shard").parquet(f"{at}/log")
    rows = [r.asDict() for r in shards.orderBy("shard_id").collect()]  # as few as a stream has shards
    fs, _ = filesystem(spark, at)
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/log/shards.json"), True)
    out.write(bytearray(json.dumps([{**r, "parents": list(r["parents"] or [])} for r in rows]).encode()))
    out.close()
    stream = spark.readStream.format("kinesis").options(streamArn="arn:aws:kinesis:local:000000000000:stream/log", client="weirflow.testing.shardlog:client", path=f"{at}/log", progress=f"{at}/claims", batch=20_000, poll=1)
    kept = stream.load().select("shard_id", "sequence_number", "partition_key", F.md5("value").alias("digest"))
    q = kept.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(kept.schema).parquet(f"{at}/out").select("shard_id", F.col("sequence_number").cast("long").alias("sequence_no"), "partition_key", "digest")


QUERIES = {f.__name__: f for f in (http_round, kinesis_round)}
SQL = {
    "http_round": "select event_id, event_type from events",
    "kinesis_round": "select shard_id, cast(trim(sequence_number) as bigint) sequence_no, min(partition_key) partition_key, md5(min(record_data)) digest from kinesis_records group by 1, 2",
}
