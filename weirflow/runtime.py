"""Session helpers: where shared files go, how large an input is, how tables are read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "weirflow", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster sets its own master."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what the cluster names in spark.checkpoint.dir. Only where that is unset, as in local tests,
    a temporary folder is made and used for the rest of the session.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set(CHECKPOINT_DIR, named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder. What a query leaves there is removed when the driver's JVM ends."""
    named = f"{shared_dir(spark)}/weirflow/{purpose}-{uuid.uuid4().hex}"
    fs, at = filesystem(spark, named)
    # a folder that isn't there yet can't be marked, so it is made first
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{named}/at"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder: used twice without being computed twice, and safe if executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings (dots written as __) that hold inside the block only."""
    named = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: What the planner gives for an input whose size it can't know.
_UNKNOWN = 1 << 62


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of all files and tables a DataFrame is made from, added up, as the planner knows them; None if one of them is unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return None if any(s >= _UNKNOWN for s in sizes) else sum(sizes)


def counted_bytes(df: DataFrame) -> int:
    """Bytes of a DataFrame's values, by one pass over it that sends a number per task: strings and binaries by length, others as 8 each."""
    long = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    each = F.lit(8 * (len(df.columns) - len(long)))
    for name in long:
        each = each + F.coalesce(F.octet_length(df[name]), F.lit(0))
    return df.agg(F.sum(each)).first()[0] or 0


def partitions_for(bytes_each: int, *inputs: DataFrame, inflation: float = 3.0) -> int:
    """How many partitions keep each near bytes_each of these inputs, at least spark.sql.shuffle.partitions.

    inflation is how much larger rows are in memory than in a column file. An input of unknown size is counted.
    """
    size = 0
    for df in inputs:
        known = input_bytes(df)
        size += counted_bytes(df) if known is None else int(known * inflation)
    return max(int(inputs[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), size // bytes_each + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its timestamps carry no zone and mean UTC; they come out as instants, whatever the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    if not plain:
        return df
    with session_conf(spark, spark__sql__session__timeZone="UTC"):  # a cast takes the zone that holds when it is made
        return df.withColumns({c: F.col(c).cast("timestamp") for c in plain})


def micros(column: Column | str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp. One without a zone counts in the session's zone."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))
