"""Reading and writing recording files as message logs.

Files have no sync marks, and one file may hold most of the data, so large
files are read in cuts, whose places :mod:`tidelog.sources.chains` finds.  A
recording with a sidecar index (:mod:`tidelog.sources.zones`) needs no search,
and only its blocks that may hold wanted messages are opened.  A folder written
by this library has a commit log that names the files of each call in order;
other files in it do not count.
"""

from __future__ import annotations

import json
import logging
import os
import re
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from posixpath import basename
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tidelog.functions.ids import MAX_PART, MessageID, check_bounds, format_id, in_range
from tidelog.plans.storage import stored
from tidelog.schema import MESSAGE_LOG, require_columns, stream_keys
from tidelog.sources import chains, packing, zones
from tidelog.sources.sinks import refuse_own_input

CORRUPT = "_corrupt_record"
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 4_096
# Records of a run that are decoded together.
RUN_ROWS = 16
MAX_TASKS = 100_000
# The folder of commit entries beside the files they name.
COMMITS = ".commits"

_SCHEMA = T.StructType([*MESSAGE_LOG.fields, T.StructField(CORRUPT, T.StringType())])
_SCHEMA_NULLABLE = T.StructType([T.StructField(f.name, f.dataType) for f in _SCHEMA])
_ARROW = pa.schema(
    [
        ("stream_name", pa.string()),
        ("ms", pa.int64()),
        ("seq", pa.int64()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("recording", pa.string()),
        ("pos", pa.int64()),
        (CORRUPT, pa.string()),
    ]
)

log = logging.getLogger(__name__)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    path = re.sub("^s3[an]://", "s3://", path)
    if path.startswith("file:"):
        path = re.sub(r"^file:/*", "/", path)
    elif "://" not in path:
        path = os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def _rows(
    path: str,
    name: str,
    start: int,
    stop: int,
    pos: int,
    with_fields: bool = True,
    record: Callable = packing.record,
) -> Iterator[pa.RecordBatch]:
    """Decode the objects of a byte range that ends with one, numbered from ``pos``."""
    system, inner = filesystem(path)
    take = packing.unpack if with_fields else packing.without_fields
    rows = _Columns(name, pos)
    with system.open_input_file(inner) as file:
        try:
            most = BATCH_ROWS if record is packing.record else 0
            for _, run, value in packing.stretches(file, start, stop, take, most, whole=True):
                made = rows.of_run(run) if len(run) >= RUN_ROWS else None
                if made is not None:
                    if rows.ms:
                        yield rows.taken()
                    yield rows.placed(made)
                    continue
                for one in map(packing.run_value, run) if run else (value,):
                    try:
                        rows.add(*record(one))
                    except ValueError as problem:
                        rows.add(None, None, None, None, str(problem))
                    if len(rows.ms) == BATCH_ROWS:
                        yield rows.taken()
        except packing.Corrupt as problem:
            log.warning("%s ends early: %s; the records before that are read", path, problem)
    if rows.ms:
        yield rows.taken()


class _Columns:
    """Records of one recording, gathered column by column."""

    def __init__(self, recording: str, pos: int) -> None:
        self.recording, self.pos = recording, pos
        self._begin()

    def _begin(self) -> None:
        self.streams, self.ms, self.seq, self.problems = [], [], [], []
        self.starts, self.keys, self.values = [], [], []

    def add(
        self,
        stream: str | None,
        ms: int | None,
        seq: int | None,
        fields: dict[str, str | None] | None,
        problem: str | None = None,
    ) -> None:
        self.streams.append(stream)
        self.ms.append(ms)
        self.seq.append(seq)
        self.problems.append(problem)
        if fields is None:
            self.starts.append(None)
        else:
            self.starts.append(len(self.keys))
            self.keys.extend(fields)
            self.values.extend(fields.values())

    def taken(self) -> pa.RecordBatch:
        """The records added since the last time."""
        starts = pa.array([*self.starts, len(self.keys)], pa.int32())
        texts = [pa.array(x, pa.string()) for x in (self.keys, self.values)]
        made = [
            pa.array(self.streams, pa.string()),
            pa.array(self.ms, pa.int64()),
            pa.array(self.seq, pa.int64()),
            pa.MapArray.from_arrays(starts, *texts),
            pa.array(self.problems, pa.string()),
        ]
        self._begin()
        return self.placed(made)

    def placed(self, columns: list[pa.Array]) -> pa.RecordBatch:
        """The next records, of which all but their places is given."""
        *values, problems = columns
        count = len(problems)
        recording = pa.repeat(pa.scalar(self.recording, pa.string()), count)
        numbers = pa.array(np.arange(self.pos, self.pos + count))
        self.pos += count
        return pa.record_batch([*values, recording, numbers, problems], schema=_ARROW)

    @staticmethod
    def of_run(run: list[tuple]) -> list[pa.Array] | None:
        """Columns of a run; ``None`` if one of its records may be malformed or repeats a field."""
        names, ms, seq, *fields = zip(*run, strict=True)
        kinds = [set(keys) for keys in fields[::2]]
        width = len(kinds)
        if sum(map(len, kinds)) != len(set().union(*kinds)):
            return None
        try:
            numbers = [pa.array(x, pa.binary()).cast(pa.string()).cast(pa.int64()) for x in (ms, seq)]
            if all(len(kind) == 1 for kind in kinds):
                keys = _short_texts(run[0][3::2]).take(pa.array(np.tile(np.arange(width), len(run))))
            else:
                keys = _short_texts(list(chain.from_iterable(row[3::2] for row in run)))
            values = _short_texts(list(chain.from_iterable(zip(*fields[1::2], strict=True))))
            starts = pa.array(np.arange(len(run) + 1) * width, pa.int32())
            made = [_short_texts(names), numbers[0], numbers[1].fill_null(0)]
            made.append(pa.MapArray.from_arrays(starts, keys, values))
        except pa.ArrowInvalid:
            return None
        return [*made, pa.nulls(len(run), pa.string())]


def _short_texts(raw: Sequence[bytes]) -> pa.Array:
    """Texts that come with a head of one byte."""
    return pc.binary_slice(pa.array(raw, pa.binary()), 1, 32).cast(pa.string())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


# ---- commits ----------------------------------------------------------------


def _entries(system: fs.FileSystem, folder: str) -> list[str]:
    """The commit entries of a folder, in the order of the calls."""
    found = system.get_file_info(fs.FileSelector(f"{folder}/{COMMITS}", allow_not_found=True))
    return sorted(e.path for e in found if re.fullmatch(r"\d{10}(-\w+)?\.json", e.base_name))


def _committed(system: fs.FileSystem, folder: str) -> dict[str, str] | None:
    """Committed files of a folder and their names in order; ``None`` without a commit log."""
    entries = _entries(system, folder)
    if not entries:
        return None
    names = {}
    for call, entry in enumerate(entries, 1):
        with system.open_input_file(entry) as file:
            for part, name in enumerate(json.loads(file.read())["files"]):
                names[name] = f"part-{call:010d}-{part:08d}.msgpack"
    return names


def _commit(system: fs.FileSystem, folder: str, files: list[str], job: str) -> None:
    """Add the next entry to the commit log.

    The number of an entry is taken by creating it, which fails if another
    call was first; then the next number is tried.  A store that cannot create
    a file exclusively keeps entries of one number apart, and in order, by the
    names of their jobs.
    """
    content = json.dumps({"job": job, "files": files}).encode()
    log_folder = f"{folder}/{COMMITS}"
    system.create_dir(log_folder, recursive=True)
    entries = _entries(system, folder)
    number = 1 + (int(basename(entries[-1])[:10]) if entries else 0)
    if not isinstance(system, fs.LocalFileSystem):
        with system.open_output_stream(f"{log_folder}/{number:010d}-{job}.json") as file:
            file.write(content)
        return
    draft = f"{log_folder}/.{job}"
    with open(draft, "wb") as file:
        file.write(content)
    try:
        while True:
            try:
                os.link(draft, f"{log_folder}/{number:010d}.json")
                return
            except FileExistsError:
                number += 1
    finally:
        os.remove(draft)


# ---- places of records ------------------------------------------------------

_RANGES = "path string, name string, size bigint, start bigint, end bigint, pos bigint, placed boolean"
_RANGES_ARROW = pa.schema(
    [("path", pa.string()), ("name", pa.string())]
    + [(c, pa.int64()) for c in ("size", "start", "end", "pos")]
    + [("placed", pa.bool_())]
)
_CHAINS = "path string, name string, size bigint, cut int, chains string"
_CHAINS_ARROW = pa.schema(
    [("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("cut", pa.int32()), ("chains", pa.string())]
)


def open_index(path: str, size: int) -> zones.Index | None:
    """The sidecar index of a recording, if there is one for just these bytes."""
    system, inner = filesystem(path)
    place = zones.sidecar(inner)
    info = system.get_file_info(place)
    if info.type != fs.FileType.File:
        return None
    return zones.opened(system.open_input_file(place), info.size, size)


def _ranges_of(
    path: str, name: str, size: int, wanted: zones.Wanted, split_bytes: int
) -> Iterator[tuple]:
    """Byte ranges of a recording that may hold wanted messages.

    A small recording without index is one range; of a large one nothing is
    known yet, and its row says so.
    """
    small = size <= split_bytes
    index = None if small and wanted.everything else open_index(path, size)
    if index is not None:
        with index.file:
            for start, end, pos in index.runs(wanted, split_bytes):
                yield path, name, size, start, end, pos, True
    else:
        yield path, name, size, 0, size, 0, small


def _ranges(files: DataFrame, root: str, wanted: zones.Wanted, split_bytes: int) -> DataFrame:
    """The committed recordings among ``files`` as byte ranges."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders: dict[str, dict[str, str] | None] = {}
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                folder, _, name = row["path"].rpartition("/")
                if folder not in folders:
                    system, inner = filesystem(unquote(folder))
                    folders[folder] = _committed(system, inner)
                names = folders[folder]
                called = name if names is None else names.get(unquote(name))
                if called is not None:
                    below = _below(f"{folder}/{called}", root)
                    found += _ranges_of(unquote(row["path"]), below, row["size"], wanted, split_bytes)
            if found:
                yield _batch(found, _RANGES_ARROW)

    return files.mapInArrow(find, _RANGES)


def _spread(ranges: DataFrame, count: int, *order: str) -> DataFrame:
    """One task per row, up to ``MAX_TASKS``; by range, which spreads them evenly."""
    return ranges.repartitionByRange(max(1, min(count, MAX_TASKS)), *order)


def _found(files: DataFrame, split_bytes: int) -> DataFrame:
    """Ranges of large files without index: all cuts parsed, then their maps composed."""
    last_cut = F.call_function("div", F.col("size") - 1, F.lit(split_bytes)).cast("int")
    cuts = files.select("path", "name", "size", F.explode(F.sequence(F.lit(0), last_cut)).alias("cut"))

    def opened(path: str, size: int, low: int, number: int):
        system, inner = filesystem(path)
        return system.open_input_file(inner), size, low, (number + 1) * split_bytes

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, *place = opened(row["path"], row["size"], row["cut"] * split_bytes, row["cut"])
                with file:
                    row["chains"] = json.dumps(chains.Cut(file, *place).chains())
                yield pa.RecordBatch.from_pylist([row], schema=_CHAINS_ARROW)

    def reopened(cut: chains.Known, at: int) -> chains.Chain:
        file, *place = opened(cut.path, cut.size, at, cut.cut)
        with file:
            return chains.Cut(file, *place).chain(at)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, str] = {}

        def known() -> Iterator[chains.Known]:
            for batch in batches:
                for row in batch.to_pylist():
                    names[row["path"]] = row["name"]
                    maps = [chains.Chain(*chain) for chain in json.loads(row["chains"])]
                    yield chains.Known(row["path"], row["size"], row["cut"], maps)

        made: list[tuple] = []
        for place in chains.placed(known(), split_bytes, reopened):
            made.append(
                (place.path, names[place.path], place.size, place.start, place.end, place.pos, True)
            )
            if len(made) == BATCH_ROWS:
                yield _batch(made, _RANGES_ARROW)
                made = []
        if made:
            yield _batch(made, _RANGES_ARROW)

    parsed = _spread(cuts, cuts.count(), "path", "cut").mapInArrow(parse, _CHAINS)
    return parsed.repartition("path").sortWithinPartitions("path", "cut").mapInArrow(compose, _RANGES)


def _places(files: DataFrame, root: str, wanted: zones.Wanted, split_bytes: int) -> tuple[DataFrame, int]:
    ranges = stored(_ranges(files, root, wanted, split_bytes), "recording-ranges")
    unknown = ranges.where(~F.col("placed"))
    if not unknown.isEmpty():
        found = stored(_found(unknown.select("path", "name", "size"), split_bytes), "recording-places")
        ranges = ranges.where("placed").unionByName(found)
    return ranges, ranges.count()


def _listed(spark: SparkSession, path: str) -> DataFrame | None:
    """Path and size of the recordings under a path."""
    try:
        found = spark.read.format("binaryFile").load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no recording at %s", path)
        return None
    hidden = F.col("path").rlike(rf"/(\{COMMITS}|\{zones.FOLDER})/[^/]*$")
    return found.select("path", F.col("length").alias("size")).where(~hidden & (F.col("size") > 0))


def read_recordings(
    spark: SparkSession,
    path: str,
    mode: str = "DROPMALFORMED",
    split_bytes: int = SPLIT_BYTES,
    from_id: MessageID | str | bytes | None = None,
    to_id: MessageID | str | bytes | None = None,
    streams: Iterable[str | dict] | None = None,
    typed: bool = False,
) -> DataFrame:
    """All recordings under a path (file, folder or glob) as one message log.

    ``recording`` is the file's path below ``path`` (for a glob: below its last
    folder without a wildcard), ``pos`` the number of the record in the file.
    An incomplete tail is left out; a missing path gives no rows.  For a record
    that is malformed, ``DROPMALFORMED`` drops it, ``PERMISSIVE`` keeps its
    place with the reason in ``_corrupt_record``, ``FAILFAST`` raises.

    Given bounds (both included) and streams, only messages within them are
    returned; of recordings with an index only blocks that may hold such
    messages are opened, so that malformed records elsewhere are not noticed.

    ``typed`` keeps the types of field values: ``fields`` then maps names to
    VARIANT instead of text.
    """
    mode = _checked_mode(mode)
    low, high = check_bounds(from_id, to_id)
    names = None if streams is None else stream_keys(streams)
    wanted = zones.Wanted(
        low or zones.LOWEST, high or zones.HIGHEST, None if names is None else frozenset(names)
    )
    files = _listed(spark, path)
    if files is None:
        return _by_mode(_with_types(spark.createDataFrame([], _SCHEMA_NULLABLE), typed), mode)
    places, count = _places(files, _root(path), wanted, split_bytes)

    record = packing.typed_record if typed else packing.record

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = (row["start"], row["end"], row["pos"])
                yield from _rows(row["path"], row["name"], *place, record=record)

    rows = _spread(places, count, "path", "start").mapInArrow(decode, _SCHEMA_NULLABLE)
    inside = in_range(low, high) if low or high else F.lit(True)
    if names is not None:
        inside = inside & F.col("stream_name").isin(names)
    found = _by_mode(_with_types(rows, typed), mode)
    return found if wanted.everything else found.where(inside)


def _with_types(rows: DataFrame, typed: bool) -> DataFrame:
    if not typed:
        return rows
    return rows.withColumn("fields", F.transform_values("fields", lambda _, v: F.parse_json(v)))


def index_recordings(
    spark: SparkSession,
    path: str,
    split_bytes: int = SPLIT_BYTES,
    block_bytes: int = zones.BLOCK_BYTES,
) -> int:
    """Write the missing sidecar indexes of the recordings under a path; how many.

    Records are read once (in a large file their places are found before, by
    a pass over the heads of values), without building fields; the blocks of
    a file meet in one task as a stream of small rows.
    """
    files = _listed(spark, path)
    if files is None:
        return 0

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                index = open_index(unquote(row["path"]), row["size"])
                if index is None:
                    rows.append(row)
                else:
                    index.file.close()
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    missing = stored(files.mapInArrow(lacking, "path string, size bigint"), "recordings-to-index")
    places, count = _places(missing, "", zones.Wanted(), split_bytes)
    numbers = ["start", "end", "pos", "records", "ms", "seq", "last_ms", "last_seq", "streams"]
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), *[(c, pa.int64()) for c in numbers]])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = [
                    (row["path"], row["size"], *zone[:4], *zone.first, *zone.last, _signed(zone.streams))
                    for zone in _zones_of(row["path"], row["start"], row["end"], row["pos"], block_bytes)
                ]
                if made:
                    yield _batch(made, schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(row.values()) for batch in batches for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            path, size = row[:2]
            after: list[tuple | None] = [None]

            def blocks(row=row, path=path, after=after) -> Iterator[zones.Zone]:
                while row is not None and row[0] == path:
                    yield zones.Zone.unpacked((*row[2:10], row[10] & _WORD))
                    row = next(rows, None)
                after[0] = row

            _write_index(path, blocks(), size)
            yield pa.record_batch([[path]], ["path"])
            row = after[0]

    columns = ", ".join(f"{c} bigint" for c in ["size", *numbers])
    found = _spread(places, count, "path", "start").mapInArrow(summarise, f"path string, {columns}")
    ordered = found.repartition("path").sortWithinPartitions("path", "start")
    return ordered.mapInArrow(write, "path string").count()


_WORD = (1 << 64) - 1


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _zones_of(path: str, start: int, end: int, pos: int, block_bytes: int) -> Iterator[zones.Zone]:
    summary = zones.Summary(start, pos, block_bytes)
    system, inner = filesystem(path)
    at = start
    with system.open_input_file(inner) as file:
        try:
            for after, value in packing.objects(file, start, end, packing.without_fields, whole=True):
                try:
                    name, ms, seq, _ = packing.record(value)
                except ValueError:
                    name = ms = seq = None
                full = summary.add(after - at, name, ms, seq)
                at = after
                if full is not None:
                    yield full
        except packing.Corrupt:
            pass  # reading ends there too
    last = summary.finish()
    if last is not None:
        yield last


def _write_index(path: str, blocks: Iterable[zones.Zone], size: int) -> None:
    """Write a sidecar under a name of its own and give it its place when complete."""
    system, inner = filesystem(path)
    place = zones.sidecar(inner)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as file:
        zones.write_index(file, blocks, size)
    system.move(draft, place)


def _plain(path: str) -> str:
    """A path without scheme and authority."""
    return re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", path)


def _root(path: str) -> str:
    """The part of a path before its first wildcard, in whole folders."""
    plain = _plain(path)
    if "://" not in path and not path.startswith("file:"):
        plain = os.path.abspath(plain)
    plain = plain.rstrip("/")
    wild = re.search(r"[*?\[{]", plain)
    return plain[: wild.start()].rpartition("/")[0] if wild else plain


def _below(path: str, root: str) -> str:
    plain = unquote(_plain(path))
    below = plain.removeprefix(root).strip("/") if plain.startswith(f"{root}/") else ""
    return below or basename(plain)


def _checked_mode(mode: str) -> str:
    if mode.upper() not in ("DROPMALFORMED", "PERMISSIVE", "FAILFAST"):
        raise ValueError(f"unknown mode {mode!r}")
    return mode.upper()


def _by_mode(rows: DataFrame, mode: str) -> DataFrame:
    if mode == "PERMISSIVE":
        return rows
    if mode == "DROPMALFORMED":
        return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    reason = F.concat("recording", F.lit(" record "), "pos", F.lit(": "), CORRUPT)
    checked = F.when(
        F.col(CORRUPT).isNotNull(), F.raise_error(reason).cast("string")
    ).otherwise(F.col("recording"))
    return rows.withColumn("recording", checked).drop(CORRUPT)


# ---- the data source --------------------------------------------------------


class RecordingSource(DataSource):
    """``spark.read.format("recording")`` and ``df.write.format("recording")``.

    :func:`register` makes it known to a session.  A schema
    of some of the columns may be given; without ``fields`` no map is built.
    :func:`recording_table` also takes filters: bounds of ``ms`` and lists of
    streams reach the blocks that are opened.
    A large file without an index is one partition: index it first.  The path
    is a file or a folder; ``recursiveFileLookup`` takes the folders below it.
    """

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> T.StructType:
        return T.StructType([f for f in _SCHEMA_NULLABLE if f.name != CORRUPT])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        unknown = [f.name for f in schema if f not in _SCHEMA_NULLABLE.fields]
        if unknown:
            raise ValueError(f"a recording has no such columns: {unknown}")
        pushing = self._option("pushdown")
        split_bytes = int(self.options.get("split_bytes", SPLIT_BYTES))
        scan = _PushingScan if pushing else _Scan
        return scan(self.options["path"], schema.names, split_bytes, self._option("recursiveFileLookup"))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        from tidelog.sources.following import MOST_PER_STREAM, Follower

        most = int(self.options.get("maxMessagesPerStream", MOST_PER_STREAM))
        if most < 1:
            raise ValueError("maxMessagesPerStream must be greater than 0")
        recursive = self._option("recursiveFileLookup")
        return Follower(self.options["path"], schema.names, self.options["plans"], most, recursive)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("recordings are append-only; use mode('append')")
        return _Writer(self.options["path"])

    def _option(self, name: str) -> bool:
        return self.options.get(name, "false").lower() == "true"


_registered: set[tuple[str, str]] = set()
_registering = threading.Lock()


def register(spark: SparkSession) -> None:
    """Make ``recording`` known to a session, once, so that running calls keep it.

    Spark looks sources up in the thread's active session, which making any
    DataFrame of local rows sets.
    """
    spark.createDataFrame([], "nothing int")
    session = (spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID())
    with _registering:
        if session not in _registered:
            spark.dataSource.register(RecordingSource)
            _registered.add(session)


def recording_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Recordings as a table whose filters reach the blocks that are opened.

    Needs ``spark.sql.python.filterPushdown.enabled``.  Spark keeps what the
    last pushed filters selected for a loaded source, and would reuse it for a
    query without any; so the table comes with a filter that is always true.
    """
    register(spark)
    names = [*(columns or MESSAGE_LOG.names), *([] if columns is None or "pos" in columns else ["pos"])]
    schema = T.StructType([f for name in names for f in _SCHEMA_NULLABLE if f.name == name])
    read = spark.read.format("recording").option("pushdown", "true").schema(schema).load(path)
    return read.where("pos >= 0").select(*(columns or MESSAGE_LOG.names))


def follow_recordings(
    spark: SparkSession, path: str, plans: str, max_per_stream: int | None = None
) -> DataFrame:
    """The recordings of a folder as a stream; ``plans`` is a folder of its own.

    A micro-batch takes at most ``max_per_stream`` messages of every stream.
    Planning it reads the new records once, on the driver, which that limit
    bounds; the tasks read them again.  The offset names every file.
    """
    register(spark)
    reader = spark.readStream.format("recording").option("plans", plans)
    if max_per_stream is not None:
        reader = reader.option("maxMessagesPerStream", max_per_stream)
    return reader.load(path)


@dataclass
class _Ranges(InputPartition):
    ranges: list[tuple]


class _Scan(DataSourceReader):
    """Plans ranges on the driver and decodes them in tasks; malformed records are dropped."""

    def __init__(self, path: str, columns: list[str], split_bytes: int, recursive: bool) -> None:
        self.path, self.columns, self.split_bytes, self.recursive = path, columns, split_bytes, recursive
        self.wanted = zones.Wanted()

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges, small ones together, up to ``split_bytes`` a partition."""
        made: list[_Ranges] = []
        room = 0
        for path, name, size in self._files():
            for row in _ranges_of(path, name, size, self.wanted, self.split_bytes):
                length = row[4] - row[3]
                if not made or length > room:
                    made.append(_Ranges([]))
                    room = self.split_bytes
                made[-1].ranges.append(row)
                room -= length
        return made or [_Ranges([])]

    def _files(self) -> Iterator[tuple[str, str, int]]:
        system, inner = filesystem(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            yield self.path, info.base_name, info.size
            return
        selected = fs.FileSelector(inner, allow_not_found=True, recursive=self.recursive)
        logs: dict[str, dict[str, str] | None] = {}
        for file in sorted(system.get_file_info(selected), key=lambda file: file.path):
            below = file.path.removeprefix(inner).strip("/")
            if file.type != fs.FileType.File or not file.size or re.search(r"(^|/)[._]", below):
                continue
            folder = file.path.rpartition("/")[0]
            if folder not in logs:
                logs[folder] = _committed(system, folder)
            name = file.base_name if logs[folder] is None else logs[folder].get(file.base_name)
            if name is not None:
                scheme = self.path.removesuffix(inner) if self.path.endswith(inner) else ""
                yield f"{scheme}{file.path}", f"{below.rpartition('/')[0]}/{name}".lstrip("/"), file.size

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        with_fields = "fields" in self.columns
        for path, name, _, start, end, pos, _ in partition.ranges:
            for batch in _rows(path, name, start, end, pos, with_fields):
                kept = batch.filter(self._mask(batch))
                if kept.num_rows:
                    yield kept.select(self.columns)

    def _mask(self, batch: pa.RecordBatch) -> pa.Array:
        mask = pc.is_null(batch[CORRUPT])
        low, high, streams = self.wanted
        if low != zones.LOWEST:
            mask = pc.and_(mask, pc.greater_equal(batch["ms"], low.ms))
        if high != zones.HIGHEST:
            mask = pc.and_(mask, pc.less_equal(batch["ms"], high.ms))
        if streams is not None:
            mask = pc.and_(mask, pc.is_in(batch["stream_name"], pa.array(sorted(streams), pa.string())))
        return pc.fill_null(mask, False)


class _PushingScan(_Scan):
    """A scan that Spark tells of filters; it applies those of ``ms`` and ``stream_name``."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for found in filters:
            if not self._taken(found):
                yield found

    def _taken(self, found: Filter) -> bool:
        low, high, streams = self.wanted
        column = getattr(found, "attribute", None)
        value = getattr(found, "value", None)
        if column == ("ms",) and isinstance(value, int):
            first = last = None
            if isinstance(found, EqualTo):
                first = last = value
            elif isinstance(found, GreaterThanOrEqual):
                first = value
            elif isinstance(found, GreaterThan):
                first = value + 1
            elif isinstance(found, LessThanOrEqual):
                last = value
            elif isinstance(found, LessThan):
                last = value - 1
            else:
                return False
            if first is not None:
                low = max(low, MessageID(first, -1))
            if last is not None:
                high = min(high, MessageID(last, MAX_PART))
        elif column == ("stream_name",) and isinstance(found, (EqualTo, In)):
            names = found.value if isinstance(found, In) else (found.value,)
            names = frozenset(name for name in names if name is not None)
            streams = names if streams is None else streams & names
        else:
            return False
        self.wanted = zones.Wanted(low, high, streams)
        return True


# ---- writing ----------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str


class _Writer(DataSourceArrowWriter):
    """One file per task, with its index, which counts once the job commits.

    Columns are ``stream_name``, ``ms``, ``seq`` and the record's bytes.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        context = TaskContext.get()
        system, inner = filesystem(self.path)
        system.create_dir(inner, recursive=True)
        part = context.partitionId()
        name = f"part-{self.job}-{part:08d}-{context.taskAttemptId()}.msgpack"
        summary, blocks, size = zones.Summary(), [], 0
        with system.open_output_stream(f"{inner}/{name}") as file:
            for batch in iterator:
                stream, ms, seq, record = batch.columns
                if record.null_count:
                    raise ValueError("a message without an ID cannot be recorded")
                record = record.cast(pa.large_binary())
                at = record.offset
                ends = np.frombuffer(record.buffers()[1], np.int64)[at : at + len(record) + 1]
                if len(record):
                    file.write(record.buffers()[2][int(ends[0]) : int(ends[-1])])
                    size += int(ends[-1] - ends[0])
                blocks += summary.add_all(np.diff(ends), stream, ms, seq)
        last = summary.finish()
        if size:
            _write_index(f"{inner}/{name}", blocks + [last] * (last is not None), size)
        return _Written(part, name)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inner = filesystem(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        _commit(system, inner, [m.name for m in done], self.job)

    def abort(self, messages: list[_Written | None]) -> None:
        system, inner = filesystem(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(f"{inner}/{message.name}")


def _size_hex(size: Column, short: int, limit: int, wide: dict[int, int]) -> Column:
    """Hexadecimal head of a sized value: the short form, or the narrowest that fits."""

    def digits(value: Column, bytes_: int) -> Column:
        return F.lpad(F.hex(value), 2 * bytes_, "0")

    head = F.when(size < limit, digits(size + short, 1))
    for code, width in sorted(wide.items()):
        head = head.when(size < 1 << (8 * width), F.concat(F.lit(f"{code:02X}"), digits(size, width)))
    return head.otherwise(F.raise_error(F.lit("too large to record")).cast("string"))


def _text_hex(text: Column) -> Column:
    head = _size_hex(F.octet_length(text).cast("bigint"), 0xA0, 32, packing.TEXT)
    return F.when(text.isNull(), F.lit("C0")).otherwise(F.concat(head, F.hex(text)))


def record_bytes() -> Column:
    """The record of a message, built without leaving the JVM; a NULL map is nil."""
    fields = F.col("fields")
    pairs = F.transform(
        F.map_entries(fields), lambda e: F.concat(_text_hex(e["key"]), _text_hex(e["value"]))
    )
    head = _size_hex(F.size(fields).cast("bigint"), 0x80, 16, packing.MAP)
    body = F.when(fields.isNull(), F.lit("C0")).otherwise(F.concat(head, F.array_join(pairs, "")))
    message_id = format_id(F.col("ms"), F.col("seq"))
    start = F.lit(packing.RECORD_START.hex())
    return F.unhex(F.concat(start, _text_hex(F.col("stream_name")), _text_hex(message_id), body))


def write_recordings(messages: DataFrame, path: str) -> None:
    """Append a log as recording files, in arrival order within and across files.

    The call becomes visible as a whole, by one entry in the folder's commit
    log, which also orders the calls; files that no entry names do not count.
    Every file gets its index.
    """
    require_columns(messages, MESSAGE_LOG.names)
    refuse_own_input(messages, path)
    register(messages.sparkSession)
    order = ["recording", "pos"]
    (
        messages.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("stream_name", "ms", "seq", record_bytes().alias("record"))
        .write.format("recording")
        .mode("append")
        .save(path)
    )
