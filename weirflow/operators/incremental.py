"""Processing only new or changed records, by the log's own positions.

Each split (a Kafka partition, a Kinesis shard) is a log with ascending positions. A run
1. takes each split's position from the last successful checkpoint that knows the split,
2. writes a plan ahead of any work: split, first and last position (both included),
3. reads exactly the planned intervals and hands them to a sink that keeps one record per split and position,
4. marks the plan as committed, with the positions that hold from then on.
A run that finds a plan without a commit replays that plan instead of making a new one, so a failure between
2 and 4 neither skips nor repeats records.

Positions are whole numbers or text that sorts as they do (weirflow.functions.numbers.sortable_decimal, for numbers of any length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.runtime import filesystem

LOWEST = -(2**63)


def lowest(kind: T.DataType) -> Column:
    """A position at or before all others of its type."""
    return F.lit("" if isinstance(kind, T.StringType) else LOWEST).cast(kind)


def after(position: Column, kind: T.DataType) -> Column:
    """The first position behind this one. Sortable text of a number never begins with that of another, so any longer text will do."""
    return F.concat(position, F.lit(" ")) if isinstance(kind, T.StringType) else position + 1


def committed_positions(states: DataFrame, checkpoints: DataFrame, split_id: Column, next_position: Column, success: str = "completed") -> DataFrame:
    """split_id, next_position: the first position each split has still to be read from.

    states has checkpoint_id and whatever the two expressions use; checkpoints has checkpoint_id and status. A
    split's state is the one in its highest successful checkpoint, even if positions went back. A null
    next_position means that nothing was read. Of unequal rows for a split in one checkpoint the lowest
    position holds, so that nothing is skipped. States without a split or without a successful checkpoint are ignored.
    """
    done = checkpoints.where(F.col("status") == success).select(F.col("checkpoint_id").alias("done_id")).distinct()
    rows = states.select("checkpoint_id", split_id.alias("split_id"), next_position.alias("next_position"))
    rows = rows.withColumn("next_position", F.coalesce("next_position", lowest(rows.schema["next_position"].dataType)))
    rows = rows.where("split_id is not null").join(done, F.col("checkpoint_id") == F.col("done_id"), "left_semi")
    least = rows.groupBy("split_id", "checkpoint_id").agg(F.min("next_position").alias("next_position"))
    return least.groupBy("split_id").agg(F.max_by("next_position", "checkpoint_id").alias("next_position"))


def last_positions(records: DataFrame) -> DataFrame:
    """split_id, last_position of a log that can't be asked for its ends: they are looked for in its records.

    records has split_id and record_position; rows where one of them is null stand nowhere in a log.
    """
    return records.where("split_id is not null").groupBy("split_id").agg(F.max("record_position").alias("last_position"))


def plan_intervals(records: DataFrame, positions: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """split_id, first_position, last_position of what is due now; splits with nothing due don't come out.

    `ends` (split_id, last_position) is what the log itself says about its ends; without it records are searched (last_positions).
    """
    kind = records.schema["record_position"].dataType
    planned = (last_positions(records) if ends is None else ends).join(positions, "split_id", "left")
    planned = planned.select("split_id", F.coalesce("next_position", lowest(kind)).alias("first_position"), "last_position")
    return planned.where("last_position >= first_position")


def read_intervals(records: DataFrame, plan: DataFrame) -> DataFrame:
    """The records inside the plan's intervals, with all their columns.

    The plan has one row per split. Read back from its file its size is known to the planner, which broadcasts it
    only below spark.sql.autoBroadcastJoinThreshold and otherwise uses a shuffled join whose hot splits are divided at run time.
    """
    p = plan.select(F.col("split_id").alias("_split"), F.col("first_position").alias("_first"), F.col("last_position").alias("_last"))
    due = (F.col("split_id") == F.col("_split")) & F.col("record_position").between(F.col("_first"), F.col("_last"))
    return records.join(p, due).drop("_split", "_first", "_last")


#: Most groups of splits that start_filter makes a condition of.
MAX_STARTS = 256


def start_filter(splits: DataFrame, group: str, member: str, position: str, next_position: str) -> Column | None:
    """A condition on a log's own columns that only records before all of their group's positions fail, for the scan to skip whole row groups by.

    splits has a row per split: group and member (a topic and its partition), next_position. Records of other groups or members
    pass, as do some already read; read_intervals decides. With more than MAX_STARTS groups there is
    no such condition (None), which changes no row.
    """
    starts = splits.groupBy(group).agg(F.min(next_position).alias("low"), F.collect_set(member).alias("members"))
    starts = starts.where(F.col(group).isNotNull()).limit(MAX_STARTS + 1).collect()
    if not starts or len(starts) > MAX_STARTS:
        return None
    passes = ~F.col(group).isin([r[group] for r in starts])
    for r in starts:
        passes = passes | ((F.col(group) == r[group]) & (~F.col(member).isin(r["members"]) | (F.col(position) >= r["low"])))
    return passes


class RunLog:
    """Plans and commits in a folder of the shared file system. One driver at a time may use a log.

    A plan counts once its folder holds Spark's _SUCCESS marker, a commit once its marker file exists; both
    appear in one step, so readers never see half of one. A plan also carries the positions of the splits that have nothing due, hence only
    the newest has to be kept.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs, _ = filesystem(spark, self.path)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _ids(self, kind: str) -> list[int]:
        folder = self._at(kind)
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def last_committed(self) -> int:
        return max(self._ids("commits"), default=-1)

    def pending(self) -> int | None:
        """The run that was planned but not committed, if there is one."""
        last = self.last_committed()
        return max((r for r in self._ids("plans") if r > last and self._fs.exists(self._at(f"plans/{r}/_SUCCESS"))), default=None)

    def plan(self, fresh: DataFrame) -> tuple[int, DataFrame]:
        """(run, plan): the pending plan if there is one, else `fresh`, written before it is used."""
        run, whole = self.pending(), fresh
        if run is None:
            run, before = self.last_committed() + 1, self.positions()
            if before is not None:
                whole = fresh.join(before.withColumnRenamed("next_position", "kept_position"), "split_id", "full")
            whole.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/plans/{run}")
        return run, self.spark.read.schema(fresh.schema).parquet(f"{self.path}/plans/{run}").where("last_position is not null")

    def commit(self, run: int) -> None:
        """Marks a run as done; plans and commits before it are no longer needed and go."""
        self._fs.create(self._at(f"commits/{run}"), True).close()
        for kind in ("commits", "plans"):
            for old in self._ids(kind):
                if old < run:
                    self._fs.delete(self._at(f"{kind}/{old}"), True)

    def positions(self) -> DataFrame | None:
        """split_id, next_position after all committed runs; None before the first."""
        last = self.last_committed()
        if last < 0:
            return None
        plan = self.spark.read.parquet(f"{self.path}/plans/{last}")
        done = after(F.col("last_position"), plan.schema["last_position"].dataType)
        # a split's position never goes back in the log itself, even if a run was told to read again
        return plan.select("split_id", (F.greatest(done, "kept_position") if "kept_position" in plan.columns else done).alias("next_position"))


def once_per_position(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One record per split_id and record_position; with `columns` only these come out, which lets equal rows collapse before the shuffle."""
    if columns is not None:
        records = records.select("split_id", "record_position", *[c for c in columns if c not in ("split_id", "record_position")])
    return records.dropDuplicates(["split_id", "record_position"])


class Sink:
    """Records by run in a folder, each split and position once, whatever runs are told to read.

    A run that is replayed overwrites its own folder. Where a plan begins before what the log has committed for a split, records of
    that split may be here already; only then, and only for these splits, is the sink read, and what it has is refused.
    """

    def __init__(self, log: RunLog, path: str) -> None:
        self.log, self.path = log, path.rstrip("/")

    def _runs(self) -> list[str]:
        fs, at = filesystem(self.log.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return [f"{self.path}/{n}" for n in names if n.startswith("run=") and int(n[4:]) <= self.log.last_committed()]

    def read(self) -> DataFrame | None:
        """The records of all committed runs; None before the first."""
        runs = self._runs()
        return self.log.spark.read.option("basePath", self.path).parquet(*runs).drop("run") if runs else None

    def write(self, run: int, plan: DataFrame, due: DataFrame) -> DataFrame:
        """Delivers a run's records, of which `due` may hold several for a position; returns those that were taken."""
        held, known = self.read(), self.log.positions()
        if held is not None and known is not None:
            again = plan.join(known, "split_id").where("first_position < next_position").select("split_id", "first_position")
            if not again.isEmpty():
                old = held.join(again, "split_id").where("record_position >= first_position").select("split_id", "record_position")
                due = due.join(old, ["split_id", "record_position"], "left_anti")
        due.write.mode("overwrite").parquet(f"{self.path}/run={run}")
        return self.log.spark.read.schema(due.schema).parquet(f"{self.path}/run={run}")


def run_once(records: DataFrame, positions: DataFrame, log: RunLog, sink: str | None = None, ends: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """One whole run; returns its records, all columns of them or those named.

    With `sink` they are delivered to that folder (Sink) and the run is committed. Without one the caller delivers them and commits.
    """
    run, plan = log.plan(plan_intervals(records, positions, ends))
    due = once_per_position(read_intervals(records, plan), columns)
    if sink is None:
        return due
    taken = Sink(log, sink).write(run, plan, due)
    log.commit(run)
    return taken


def read_sink(spark: SparkSession, sink: str, log: RunLog | None = None) -> DataFrame:
    """Everything delivered so far, once per split and position; of a log's committed runs only, if it is named."""
    if log is not None and (held := Sink(log, sink).read()) is not None:
        return held
    return spark.read.option("basePath", sink).parquet(sink)
