"""A job: one source, one handler, one sink."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import config, registry
from weirflow.model import Handler, KeyedEvent
from weirflow.runtime import scratch
from weirflow.sinks import stdio as stdio_sink
from weirflow.sources import kafka, stdio
from weirflow.streaming import processor, savepoint


class Job:
    """Built in code or from a configuration document.

    Keys are spread over as many state partitions as there are key groups, fixed for the life of a checkpoint; executors may come and go.
    """

    def __init__(self, handler: Handler, conf: config.JobConfig) -> None:
        self.handler, self.conf = handler, conf
        self.query = None
        self.checkpoint = ""

    @classmethod
    def from_json(cls, handler: Handler, text: str, params: dict[str, str] | None = None) -> Job:
        return cls(handler, config.load(text, params))

    def to_json(self) -> str:
        names = {v: k for k, v in config._KINDS.items()}
        connector = lambda c: {"id": c.id, names[c.kind]: c.options}
        job = {"workerCount": {"value": self.conf.worker_count}, "keyGroupCount": self.conf.key_groups, "workingStorageLocation": {"value": self.conf.working_storage}, "savepointStorageLocation": {"value": self.conf.savepoint_storage}}
        return json.dumps({"job": job, "sources": [connector(self.conf.source)], "sinks": [connector(self.conf.sink)]})

    def read(self, spark: SparkSession, start: str | None = None) -> DataFrame:
        """The source as a stream of raw records, from its beginning or from an offset of a savepoint on."""
        registry.register(spark)
        o, kind = self.conf.source.options, self.conf.source.kind
        begin = {} if start is None else {"startOffset": start}
        if kind == "httpapi":
            return spark.readStream.format("httpapi").options(addr=o["addr"], topic=o["topics"][0], **begin).load()
        if kind == "embedded":
            stream = spark.readStream.format("embedded").options(splits=o.get("splitCount", 1), batch=o.get("batchSize", 1000), **begin).load()
            return stream.withColumn("value", F.col("value").cast("binary"))
        if kind == "kinesis":
            # claims lie in the checkpoint, so that a savepoint has them too
            own = {"progress": f"{self.checkpoint}/claims"} | {k: str(v) for k, v in o.items()}
            return spark.readStream.format("kinesis").options(**own, **begin).load()
        if kind == "kafka":
            return kafka.read_stream(spark, o["brokers"], o["topics"], o["consumerGroup"], start)
        at = scratch(spark, "stdin")
        stdio.read_stdin(spark, o.get("delimiter", "\n").encode()).write.parquet(at)
        return spark.readStream.schema("value binary").parquet(at)

    def results(self, raw: DataFrame, initial: DataFrame | None = None) -> DataFrame:
        """key, value of what the handler sends for a stream of raw records."""
        raw = raw.select("value", *[c for c in ("arrival", "wm_ts") if c in raw.columns])
        return processor.process(processor.keyed(raw, self.handler), self.handler, initial)

    def start(self, spark: SparkSession, raw: DataFrame | None = None, checkpoint: str | None = None, from_savepoint: str | None = None, once: bool = True, name: str = "results"):
        """Starts the query; `once` ends it when what is there now is read. Returns the streaming query.

        A savepoint with another number of key groups than the job has is taken over key by key into a new checkpoint, and the source goes on
        from the savepoint's offset; a stream given as `raw` has to begin there itself.
        """
        self.checkpoint = checkpoint or scratch(spark, "job")
        begin, state = None, None
        if from_savepoint:
            groups, ends = savepoint.offsets(spark, from_savepoint)
            if groups == self.conf.key_groups:
                savepoint.restore(spark, from_savepoint, self.checkpoint)
            else:
                begin, state = ends[0], savepoint.state_of(spark, from_savepoint)
                savepoint.copy_claims(spark, from_savepoint, self.checkpoint)
        o, kind = self.conf.sink.options, self.conf.sink.kind
        with processor.settings(spark, self.conf.key_groups):
            out = self.results(self.read(spark, begin) if raw is None else raw, state)
            if kind == "httpapi":
                out = out.select(F.col("value").cast("string").alias("value"))
            writer = out.writeStream.outputMode("append").option("checkpointLocation", self.checkpoint)
            if once:
                writer = writer.trigger(availableNow=True)
            if kind == "httpapi":
                writer = writer.format("httpapi-sink").option("addr", o["addr"])
            elif kind == "stdio":
                writer = writer.foreachBatch(stdio_sink.each_batch())
            elif kind == "kafka":
                writer = writer.format("kafka").option("kafka.bootstrap.servers", ",".join(o["brokers"])).option("topic", o["topic"])
            elif kind == "parquet":
                writer = writer.format("parquet").option("path", o["path"])
            else:
                writer = writer.format("memory").queryName(name)
            self.query = writer.start()
        return self.query

    def create_savepoint(self, folder: str | None = None) -> str:
        """Of the running query, which goes on, or of one that has ended."""
        return savepoint.create(self.query, self.checkpoint, folder or self.conf.savepoint_storage)


class Node:
    """A source, operator or sink of a Topology."""

    def __init__(self, topology: Topology, kind: str, id: str, what) -> None:
        self.topology, self.kind, self.id, self.what = topology, kind, id, what
        self.next: Node | None = None

    def connect(self, other: Node) -> Node:
        if (self.kind, other.kind) not in (("source", "operator"), ("operator", "sink")) or self.topology is not other.topology:
            raise config.ConfigError(f"a {self.kind} can't be connected to a {other.kind}")
        if self.next is not None:
            raise config.ConfigError(f"{self.id} is connected already")
        self.next = other
        return other


class Topology:
    """A job put together in code: one source, one operator, one sink.

        t = Topology(key_groups=8)
        source = t.new_source("in", "httpapi", key_event=parse, addr=..., topics=["events"])
        operator = t.new_operator("count", lambda node: CountWindow())
        source.connect(operator).connect(t.new_sink("out", "stdio"))
        t.job().start(spark)
    """

    def __init__(self, worker_count: int = 1, key_groups: int = 256, working_storage: str = "", savepoint_storage: str = "") -> None:
        self.about = {"worker_count": worker_count, "key_groups": key_groups, "working_storage": working_storage, "savepoint_storage": savepoint_storage}
        self.nodes: list[Node] = []

    def _add(self, *args) -> Node:
        self.nodes.append(Node(self, *args))
        return self.nodes[-1]

    def new_source(self, id: str, kind: str, key_event: Callable[[bytes], Iterable[KeyedEvent]] | None = None, **options) -> Node:
        """key_event makes keyed events of a raw record; without it the operator's handler does."""
        return self._add("source", id, (config.Connector(kind, id, options), key_event))

    def new_operator(self, id: str, handler: Handler | Callable[[Node], Handler]) -> Node:
        return self._add("operator", id, handler)

    def new_sink(self, id: str, kind: str, **options) -> Node:
        return self._add("sink", id, config.Connector(kind, id, options))

    def job(self) -> Job:
        by = {k: [n for n in self.nodes if n.kind == k] for k in ("source", "operator", "sink")}
        wrong = [f"exactly one {k}, not {len(n)}" for k, n in by.items() if len(n) != 1]
        if wrong:
            raise config.ConfigError("; ".join(wrong))
        source, operator, sink = (by[k][0] for k in by)
        if source.next is not operator or operator.next is not sink:
            raise config.ConfigError("the source must be connected to the operator and the operator to the sink")
        handler = operator.what if isinstance(operator.what, Handler) else operator.what(operator)
        connector, key_event = source.what
        if key_event is not None:
            handler.key_events = key_event
        job = Job(handler, config.JobConfig(connector, sink.what, **self.about))
        config.load(job.to_json())  # checks the connectors
        return job
