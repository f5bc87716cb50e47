"""Savepoints: a copy of everything a query needs to go on, made while it runs.

Spark's checkpoint folder holds offsets, commits and state. Files in it are written whole and kept for many micro-batches, so a savepoint is a copy
of what belongs to the newest commit, whatever the query does meanwhile. Restoring copies it to a fresh folder, so a savepoint can be used any
number of times. A checkpoint has a fixed number of state partitions; with another number a job begins a new one from the savepoint's state and offsets.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.runtime import filesystem


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Names of all whole files below a folder, relative to it."""
    fs, at = filesystem(spark, folder)
    out = []
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("."):  # being written
            continue
        out += [f"{name}/{n}" for n in _files(spark, f"{folder}/{name}")] if s.isDirectory() else [name]
    return out


def _copy(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    from_fs, _ = filesystem(spark, source)
    to_fs, b = filesystem(spark, target)
    if to_fs.exists(b):
        raise FileExistsError(target)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path

    def one(name: str) -> None:
        at = path(f"{target}/{name}")
        to_fs.mkdirs(at.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, path(f"{source}/{name}"), to_fs, at, False, conf)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(one, names))


def _of(number: int, name: str) -> bool:
    """Whether a checkpoint's file belongs to micro-batch `number` or an earlier one. State and source files of later ones do no harm."""
    folder, _, rest = name.partition("/")
    return folder not in ("offsets", "commits") or not rest.isdigit() or int(rest) <= number


def save(spark: SparkSession, checkpoint: str, folder: str, wait: float = 60.0) -> str:
    """Copies the newest committed state of a checkpoint folder, in use or not, for whose first commit it waits; returns the savepoint's path."""
    checkpoint = checkpoint.rstrip("/")
    until = time.monotonic() + wait
    while (number := newest(spark, checkpoint)) < 0:
        if time.monotonic() > until:
            raise FileNotFoundError(f"{checkpoint} has no commit")
        time.sleep(0.1)
    target = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    _copy(spark, checkpoint, target, [n for n in _files(spark, checkpoint) if _of(number, n)])
    return target


def create(query, checkpoint: str, folder: str) -> str:
    """A savepoint of a query, which goes on running if it runs; returns the savepoint's path."""
    if query.exception():
        raise RuntimeError("a failed query has no savepoint") from query.exception()
    return save(SparkSession.active(), checkpoint, folder)


def restore(spark: SparkSession, savepoint: str, checkpoint: str) -> str:
    """Makes a checkpoint folder, which must not exist, from a savepoint."""
    fs, at = filesystem(spark, savepoint)
    if not fs.exists(at):
        raise FileNotFoundError(savepoint)
    _copy(spark, savepoint.rstrip("/"), checkpoint.rstrip("/"), _files(spark, savepoint.rstrip("/")))
    return checkpoint


def newest(spark: SparkSession, checkpoint: str) -> int:
    """The last committed micro-batch of a checkpoint folder; -1 if there is none."""
    fs, at = filesystem(spark, f"{checkpoint.rstrip('/')}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n) for n in names if n.isdigit()), default=-1)


def offsets(spark: SparkSession, savepoint: str) -> tuple[int, list[str]]:
    """(state partitions, each source's offset as JSON) of the newest commit."""
    number = newest(spark, savepoint)
    fs, at = filesystem(spark, f"{savepoint.rstrip('/')}/offsets/{number}")
    stream = fs.open(at)
    try:
        _, about, *ends = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    return int(json.loads(about)["conf"]["spark.sql.shuffle.partitions"]), ends


def copy_claims(spark: SparkSession, savepoint: str, checkpoint: str) -> None:
    """What tasks of a source noted beside a checkpoint (weirflow.sources.kinesis), for a new checkpoint that goes on from the savepoint's offset."""
    source = f"{savepoint.rstrip('/')}/claims"
    fs, at = filesystem(spark, source)
    if fs.exists(at):
        _copy(spark, source, f"{checkpoint.rstrip('/')}/claims", _files(spark, source))


def state_of(spark: SparkSession, savepoint: str) -> DataFrame:
    """key, log of every key's state of a handler, timers included: what processor.process takes as `initial`."""
    states = spark.read.format("statestore").option("stateVarName", "log").option("flattenCollectionTypes", "false").load(savepoint)
    return states.select(F.col("key.key").alias("key"), F.transform("list_value", lambda row: row["page"]).alias("log"))
