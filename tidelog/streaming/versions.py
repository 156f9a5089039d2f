"""A small table kept current by a stream, as runs that are merged by size.

Every trigger adds a run of the rows that changed.  The last two runs are
merged as long as the older one is not twice as large, so there are only
logarithmically many, and together they hold at most about twice the rows of
the table.  A manifest per trigger names the runs that count; what the last
two manifests do not name is removed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

KEPT_MANIFESTS = 2
VERSION = "_version"


class Run(NamedTuple):
    name: str
    rows: int


class VersionedTable:
    """Rows by key, of which the newest version counts."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str]) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        context = spark.sparkContext
        self._place = context._jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(context._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._place(f"{self.path}/{folder}")
        if not self._files.exists(place):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(place))

    def _manifests(self) -> list[int]:
        found = [re.fullmatch(r"(\d+)\.json", name) for name in self._names("manifests")]
        return sorted(int(match[1]) for match in found if match)

    def _manifest(self, number: int):
        return self._place(f"{self.path}/manifests/{number:012d}.json")

    def _runs(self, number: int) -> list[Run]:
        stream = self._files.open(self._manifest(number))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(*run) for run in json.loads(text)]

    def _keep(self, runs: list[Run], number: int) -> None:
        """Write a manifest, which gets its name when it is complete."""
        draft = self._place(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        try:
            stream.write(bytearray(json.dumps(runs).encode()))
        finally:
            stream.close()
        self._files.rename(draft, self._manifest(number))

    def _read(self, runs: Sequence[Run]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/runs/{run.name}" for run in runs])

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = Window.partitionBy(*self.key).orderBy(F.col(VERSION).desc())
        return rows.withColumn("_age", F.row_number().over(last)).where("_age = 1").drop("_age")

    def _write(self, rows: DataFrame, number: int) -> Run:
        name, seen = f"run-{number:012d}-{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count("*").alias("rows")).write.parquet(f"{self.path}/runs/{name}")
        return Run(name, seen.get["rows"])

    def add(self, changed: DataFrame, number: int) -> None:
        """Add the rows changed by a trigger; a trigger that was added before is left out."""
        manifests = self._manifests()
        if manifests and manifests[-1] >= number:
            return
        runs = self._runs(manifests[-1]) if manifests else []
        runs.append(self._write(changed.withColumn(VERSION, F.lit(number).cast("bigint")), number))
        while len(runs) > 1 and runs[-2].rows < 2 * runs[-1].rows:
            merged = self._newest(self._read(runs[-2:]))
            runs[-2:] = [self._write(merged, number)]
        self._keep(runs, number)
        self._tidy()

    def _tidy(self) -> None:
        manifests = self._manifests()
        kept = manifests[-KEPT_MANIFESTS:]
        named = {run.name for number in kept for run in self._runs(number)}
        for name in self._names("runs"):
            if name not in named:
                self._files.delete(self._place(f"{self.path}/runs/{name}"), True)
        for number in manifests[:-KEPT_MANIFESTS]:
            self._files.delete(self._manifest(number), False)

    def rows(self) -> DataFrame | None:
        """The table as of the newest manifest; ``None`` before the first one."""
        manifests = self._manifests()
        if not manifests:
            return None
        return self._newest(self._read(self._runs(manifests[-1]))).drop(VERSION)
