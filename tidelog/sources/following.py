"""Recordings as a stream: files that appear and grow are read exactly once.

An offset says, per file, how many bytes and records are done; it always lies
between two records.  A micro-batch takes at most a given number of messages of
each stream, as a recorder fetches them.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from tidelog.sources import packing, recordings

MOST_PER_STREAM = 100_000
# Past plans that are kept beside the newest one.
KEPT_PLANS = 3


@dataclass
class _Range(InputPartition):
    path: str
    name: str
    start: int
    end: int
    pos: int


class Follower(DataSourceStreamReader):
    """Plans batches by passing over the records that have come since the last plan.

    The plan of a batch is written to ``plans`` before Spark hears of it, so
    that a restarted query goes on from the last one.  Spark commits a batch
    once it has taken over the next plan; where that is not known of the last
    plan, a restarted query offers it first as it is.  Only the first batch of
    all may so get twice its size.  A broken file ends at its last complete
    record; one that shrinks is read no further.
    """

    def __init__(self, path: str, columns: list[str], plans: str, most: int, recursive: bool) -> None:
        self.path, self.columns, self.most, self.recursive = path, columns, most, recursive
        self.plans = plans
        self.planned: dict | None = None
        # Name and path of the file in which the last planned batch ended.
        self.ended_in = ("", "")

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        if self.planned is None:
            self.planned, taken_over = self._last_plan()
            if not taken_over:
                return self.planned
        done = json.loads(self.planned["files"])
        further = self._further(done)
        if further != done:
            self.planned = {"files": json.dumps(further, sort_keys=True)}
            self._keep_plan(self.planned)
        return self.planned

    def _further(self, done: dict[str, list]) -> dict[str, list]:
        """Where a batch ends: it takes file after file until a stream has its share.

        The next batch begins with the file after that, so no file waits for
        another one that goes on growing, and a batch opens few files however
        many have records left.
        """
        taken: Counter[str | None] = Counter()
        further = dict(done)
        scan = recordings._Scan(self.path, self.columns, recordings.SPLIT_BYTES, self.recursive)
        files = sorted((name, path, size) for path, name, size in scan._files())
        first = bisect_right(files, self.ended_in, key=lambda file: file[:2])
        for name, path, size in files[first:] + files[:first]:
            at, pos, _ = done.get(path, (0, 0, name))
            if size > at:
                at, pos, full = self._passed(path, at, pos, size, taken)
                if at:
                    further[path] = [at, pos, name]
                if full:
                    self.ended_in = (name, path)
                    break
        return further

    def _passed(self, path: str, at: int, pos: int, size: int, taken: Counter) -> tuple[int, int, bool]:
        """End and number of the records that a batch takes, and whether its share ends them."""
        system, inner = recordings.filesystem(path)
        with system.open_input_file(inner) as file:
            try:
                for ends, run, value in packing.stretches(file, at, size, packing.without_fields, 512):
                    for after, stream in zip(ends, packing.streams(run, value), strict=True):
                        if taken[stream] == self.most:
                            return at, pos, True
                        taken[stream] += 1
                        at, pos = after, pos + 1
            except packing.Corrupt:
                pass
        return at, pos, False

    def _plans(self, kind: str = "json") -> dict[int, str]:
        """Plans, or marks of committed ones, by number in order."""
        system, folder = recordings.filesystem(self.plans)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        named = {f.path: re.fullmatch(rf"(\d{{12}})\.{kind}", f.base_name) for f in found}
        return dict(sorted((int(match[1]), path) for path, match in named.items() if match))

    def _last_plan(self) -> tuple[dict, bool]:
        """The last plan, and whether Spark has taken it over."""
        found = self._plans()
        if not found:
            return self.initialOffset(), True
        number = max(found)
        return self._plan(found[number]), number == 1 or number - 1 in self._plans("done")

    def _plan(self, path: str) -> dict:
        with recordings.filesystem(self.plans)[0].open_input_file(path) as file:
            return json.loads(file.read())

    def _write(self, name: str, content: bytes) -> None:
        """Write a small file; its name appears when it is complete."""
        system, folder = recordings.filesystem(self.plans)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/.{name}") as file:
            file.write(content)
        system.move(f"{folder}/.{name}", f"{folder}/{name}")

    def _keep_plan(self, plan: dict) -> None:
        found = self._plans()
        number = max(found, default=0) + 1
        self._write(f"{number:012d}.json", json.dumps(plan).encode())
        system, _ = recordings.filesystem(self.plans)
        for kind in ("json", "done"):
            for old, path in self._plans(kind).items():
                if old <= number - KEPT_PLANS:
                    system.delete_file(path)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        done = json.loads(start["files"])
        made = []
        for path, (stop, _, name) in json.loads(end["files"]).items():
            at, pos, _ = done.get(path, (0, 0, name))
            if stop > at:
                made.append(_Range(path, name, at, stop, pos))
        return made

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows = recordings._rows(
            partition.path, partition.name, partition.start, partition.end, partition.pos, "fields" in self.columns
        )
        for batch in rows:
            kept = batch.filter(pc.is_null(batch[recordings.CORRUPT]))
            if kept.num_rows:
                yield kept.select(self.columns)

    def commit(self, end: dict) -> None:
        """Mark the plan: the batch is done, and Spark has taken over the next one."""
        for number, path in self._plans().items():
            if self._plan(path) == end:
                self._write(f"{number:012d}.done", b"")

    def stop(self) -> None:
        """Nothing is held open."""
