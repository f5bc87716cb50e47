"""Folders published all at once: a table in named parts, each version of which replaces some of them.

A version's parts are written to a folder of its own. It becomes visible through its manifest, one file that says where each
part of the table lies now, parts of older versions included. Manifests are numbered, and the one with the highest number
holds; a manifest appears whole, by a rename that fails where the number is taken, so of two writers one is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from weirflow.runtime import filesystem


class Versions:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.at = filesystem(spark, self.path)

    def _under(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        folder = self._under("manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, number: int) -> dict:
        stream = self.fs.open(self._under(f"manifests/{number:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict, dict[str, str]]:
        """(number, what was noted with it, part -> folder); (-1, {}, {}) before the first version."""
        numbers = self.numbers()
        if not numbers:
            return -1, {}, {}
        held = self._read(numbers[-1])
        return numbers[-1], held["notes"], held["parts"]

    def folder(self) -> str:
        """A name for a new version's folder."""
        return f"v-{uuid.uuid4().hex}"

    def subfolders(self, folder: str, column: str) -> dict[str, str]:
        """value -> folder of what was written below `folder` with partitionBy(column)."""
        at = self._under(folder)
        if not self.fs.exists(at):
            return {}
        names = [s.getPath().getName() for s in self.fs.listStatus(at) if s.isDirectory()]
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names if n.startswith(f"{column}=")}

    def publish(self, after: int, parts: dict[str, str], notes: dict | None = None) -> int:
        """Makes `parts` the version after number `after`; FileExistsError if another writer was first."""
        number = after + 1
        waiting, named = self._under(f"manifests/.{uuid.uuid4().hex}"), self._under(f"manifests/{number:012d}")
        out = self.fs.create(waiting, True)
        out.write(bytearray(json.dumps({"notes": notes or {}, "parts": parts}).encode()))
        out.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(waiting, named, none)
        except Exception as e:
            self.fs.delete(waiting, False)
            if self.fs.exists(named):
                raise FileExistsError(f"{self.path}: version {number} is there already") from e
            raise
        return number

    def read(self, parts: dict[str, str], schema: str, only: set[str] | None = None) -> DataFrame:
        """The rows of these parts, or of those named in `only`; a part that isn't there has none."""
        folders = sorted({f"{self.path}/{f}" for p, f in parts.items() if only is None or p in only})
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the `keep` newest, and folders none of these names; returns how many folders. Readers of older versions lose them,
        as do writers at work, so a table's writer calls it between runs."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self.fs.delete(self._under(f"manifests/{n:012d}"), False)
        wanted = {f for n in numbers[-keep:] for f in self._read(n)["parts"].values()}
        used, inner = {f.split("/")[0] for f in wanted}, {"/".join(f.split("/")[:2]) for f in wanted}
        gone = 0
        for version in self.fs.listStatus(self.at) if self.fs.exists(self.at) else []:
            name = version.getPath().getName()
            if not name.startswith("v-") or name in wanted:
                continue
            parts = [version] if name not in used else [p for p in self.fs.listStatus(version.getPath()) if p.isDirectory() and f"{name}/{p.getPath().getName()}" not in inner]
            for p in parts:
                self.fs.delete(p.getPath(), True)
                gone += 1
        return gone
