"""Web archives: WARC records from pages, and an index merged from sorted runs.

Pages become ``response`` and ``revisit`` records in gzip files that Spark
writes and commits.  Reading them back gives one locally sorted run of
captures per file; runs are dealt to ranges of (URL key, time) and each range
is merged by a loser tree, so that the ranges in order are the capture history
of every URL.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType

from tidelog.functions.clock import format_utc
from tidelog.llm.common import blocks_of, fields, staged
from tidelog.plans.scan import broadcast_if_small
from tidelog.plans.storage import new_table

# Payloads from this size on are stored once.
MIN_REVISIT_BYTES = 1000
# Uncompressed bytes of an archive file, and index rows of a range, about.
FILE_BYTES = 32 << 20
RANGE_ROWS = 50_000

# Fixed values of the format.
VERSION = "WARC/1.1"
LINE = "\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "ffffffff-0000-0000-0000-000000000000"
GZIP = b"\x1f\x8b"
_OWN_ID = re.compile("<urn:uuid:00000000-0000-0000-([0-9a-f]{4}-[0-9a-f]{12})>")
# Bytes in which the head of a response is looked for at first.
HTTP_HEAD = 4096

CAPTURE = fields(
    url_key=StringType(),
    captured_at=StringType(),
    page_id=LongType(),
    url=StringType(),
    payload_bytes=LongType(),
    payload_digest=StringType(),
    record_type=StringType(),
    refers_to=LongType(),
    intact=BooleanType(),
    file=StringType(),
    offset=LongType(),
    inside=LongType(),
)
_ORDER = 3  # url_key, captured_at, page_id


def _uuid(id_: Column) -> Column:
    digits = F.lower(F.lpad(F.hex(id_), 16, "0"))
    made = F.concat(
        F.lit("00000000-0000-0000-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 12)
    )
    return F.concat(F.lit("<urn:uuid:"), F.coalesce(made, F.lit(NO_ID)), F.lit(">"))


def _header(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE)), F.lit(""))


def records(
    pages: DataFrame,
    captured_ms: Column,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """One column ``record``: the WARC record of every page, without its end mark.

    Of equal payloads of ``min_bytes`` or more, those with the largest id are
    responses, the others revisit it.  Only digests and ids are shuffled if
    the repeated payloads are few; otherwise pages are joined by digest.
    """
    page = pages.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.regexp_replace(
            F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A"
        ).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
        F.coalesce(captured_ms, F.lit(0)).cast("bigint").alias("ms"),
    ).withColumns(
        {
            "bytes": F.octet_length("payload").cast("bigint"),
            "digest": F.sha1(F.col("payload").cast("binary")),
        }
    )
    repeated = (
        page.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("last"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "last")
    )
    page = page.join(broadcast_if_small(repeated), "digest", "left")
    revisit = F.coalesce(
        (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("last")) & F.col("last").isNotNull(),
        F.lit(False),
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}"),
        _header("Content-Length", F.col("bytes")),
        F.lit(LINE),
    )
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    head = F.concat(
        F.lit(VERSION + LINE),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _uuid(F.col("id"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.concat(F.translate(format_utc(F.col("ms")), " ", "T"), F.lit("Z"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(_header("WARC-Profile", PROFILE), _header("WARC-Refers-To", _uuid(F.col("last")))),
        ).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{LINE}"),
        _header("Content-Length", F.octet_length("block")),
        F.lit(LINE),
    )
    return (
        page.withColumn("http", http)
        .withColumn("block", block)
        .select(F.concat(head, F.col("block")).alias("record"))
    )


def write_archive(pages: DataFrame, path: str, captured_ms: Column, **options) -> None:
    """Write the records of ``pages`` as gzip files into the new folder ``path``.

    Works on any store that Spark can write; files appear when the job commits.
    """
    html = F.col(options.get("html_col", "html"))
    size = pages.agg(
        F.sum(F.octet_length(html).cast("bigint")).alias("bytes"), F.count("*").alias("rows")
    ).first()
    mean = max(1, (size["bytes"] or 0) // max(1, size["rows"]) + 600)
    (
        records(pages, captured_ms, **options)
        .write.option("compression", "gzip")
        .option("lineSep", RECORD_END)
        .option("maxRecordsPerFile", max(1, FILE_BYTES // mean))
        .text(path)
    )


def url_key(url: str | None) -> str | None:
    """A key that sorts URLs by host from the top domain down, then by path."""
    if url is None:
        return None
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){(parts.path or '/')}{query}".lower()


def _number(record_id: str | None) -> int | None:
    """The page of a record id that this module made."""
    found = _OWN_ID.fullmatch(record_id or "")
    if found is None:
        return None
    value = int(found[1].replace("-", ""), 16)
    return value - (1 << 64) if value >> 63 else value


def members(data: bytes, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """The gzip members of a file and where they begin; of other files all of it.

    A file is read once, chunk by chunk; zeros between members are filling.
    """
    if data[:2] != GZIP:
        yield 0, data
        return
    at = 0
    while at < len(data):
        if data[at : at + 2] != GZIP:
            if data[at:].strip(b"\0"):
                raise ValueError(f"no gzip member at byte {at}")
            return
        start, unpacked, content = at, zlib.decompressobj(31), []
        while not unpacked.eof:
            part = data[at : at + chunk]
            if not part:
                raise ValueError(f"the gzip member at byte {start} is incomplete")
            content.append(unpacked.decompress(part))
            at += len(part) - len(unpacked.unused_data)
        yield start, b"".join(content)


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    """First line, and header values by lower-case name."""
    first, *lines = raw.decode("utf-8", "replace").split(LINE)
    pairs = (line.split(":", 1) for line in lines if ":" in line)
    return first, {name.strip().lower(): value.strip() for name, value in pairs}


def _digest(text: str | None) -> str | None:
    """A SHA-1 digest in hexadecimal, also from base 32; ``None`` for another kind."""
    kind, _, value = (text or "").rpartition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower()


def parsed(data: bytes, file: str) -> Iterator[tuple]:
    """The captures of one archive file, in file order, found by their lengths.

    Records that are no response or revisit are passed over.  Archives of other
    writers have no page ids, may lack digests, and may begin a gzip member
    with every record; ``offset`` is where the member begins in the file.
    """
    for offset, content in members(data):
        at = 0
        while at < len(content):
            end = content.find(b"\r\n\r\n", at)
            version, header = _headers(content[at:end]) if end >= 0 else ("", {})
            if not version.startswith("WARC/") or "content-length" not in header:
                raise ValueError(f"{file}: no record at byte {at} of the member at {offset}")
            first = end + 4
            last = first + int(header["content-length"])
            if last > len(content):
                raise ValueError(f"{file}: the record at byte {at} of the member at {offset} is cut off")
            if header.get("warc-type") in ("response", "revisit"):
                yield (*_capture(header, memoryview(content)[first:last]), file, offset, at)
            at = last + len(RECORD_END)


def _capture(header: dict[str, str], block: memoryview) -> tuple:
    raw = bytes(block[: HTTP_HEAD])
    body = raw.find(b"\r\n\r\n")
    if body < 0 and len(block) > HTTP_HEAD:
        body = bytes(block).find(b"\r\n\r\n")
    body = len(block) if body < 0 else body + 4
    declared = _headers(bytes(block[:body]))[1].get("content-length")
    length = int(declared) if declared and declared.isdigit() else None
    digest = _digest(header.get("warc-payload-digest"))
    intact = True
    if header["warc-type"] == "response":
        found = hashlib.sha1(block[body:]).hexdigest()
        intact = length in (None, len(block) - body) and digest in (None, found)
        length, digest = (len(block) - body if length is None else length), digest or found
    url = header.get("warc-target-uri")
    return (
        url_key(url),
        header.get("warc-date"),
        _number(header.get("warc-record-id")),
        url,
        length,
        digest,
        header["warc-type"],
        _number(header.get("warc-refers-to")),
        intact,
    )


def _key(row: tuple) -> tuple:
    """Sorts nulls first."""
    return tuple((value is not None, value) for value in row[:_ORDER])


def _columns(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


class LoserTree:
    """Merges sorted runs; every inner node keeps the loser of its match."""

    _END = ((2,),)

    def __init__(self, runs: Sequence[Iterator[tuple]]):
        self.runs = [iter(run) for run in runs]
        self.size = 1
        while self.size < len(self.runs):
            self.size *= 2
        self.heads = [self._next(i) for i in range(self.size)]
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _next(self, run: int):
        row = next(self.runs[run], None) if run < len(self.runs) else None
        return (self._END, None) if row is None else (_key(row), row)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.heads[b][0] < self.heads[a][0]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while True:
            best = self.winner
            row = self.heads[best][1]
            if row is None:
                return
            yield row
            self.heads[best] = self._next(best)
            node = (best + self.size) // 2
            while node:
                other = self.losers[node]
                if self.heads[other][0] < self.heads[best][0]:
                    self.losers[node], best = best, other
                node //= 2
            self.winner = best


def sorted_runs(rows: Sequence[tuple]) -> list[list[tuple]]:
    """Cut rows where their order breaks; each stretch is a sorted run."""
    runs: list[list[tuple]] = []
    last = None
    for row in rows:
        key = _key(row)
        if last is None or key < last:
            runs.append([])
        runs[-1].append(row)
        last = key
    return runs


def capture_index(
    spark: SparkSession, path: str, range_rows: int = RANGE_ROWS, files: str = "part-*"
) -> DataFrame:
    """All captures of an archive in the order of URL key, time and id.

    ``files`` is a glob; archives may come from other writers, see
    :func:`parsed`.  A record is found again at ``inside`` bytes of the gzip
    member that begins at ``offset`` of its ``file``.

    One task per archive file makes a sorted run; one task per range merges
    what the runs hold of it.  ``range_no`` and ``place`` give the global
    order.  Raises for a file that is no archive; ``intact`` tells whether a
    response's payload has the recorded length and digest.
    """
    arrow = to_arrow_schema(CAPTURE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = sorted(parsed(content.as_py(), file.as_py()), key=_key)
                yield _columns(rows, arrow)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path)
    runs = staged(archives.select("path", "content").mapInArrow(read, CAPTURE), "runs")
    ranges = blocks_of(runs.count(), range_rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [
            tuple(row)
            for batch in batches
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)
        ]
        number = TaskContext.get().partitionId()
        merged = list(LoserTree(sorted_runs(rows))) if rows else []
        made = _columns(merged, arrow)
        yield pa.RecordBatch.from_arrays(
            [
                *made.columns,
                pa.array([number] * len(merged), pa.int32()),
                pa.array(range(len(merged)), pa.int64()),
            ],
            [*arrow.names, "range_no", "place"],
        )

    return runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id").mapInArrow(
        merge, f"{_ddl()}, range_no int, place bigint"
    )


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CAPTURE)


def archive(pages: DataFrame, captured_ms: Column, path: str | None = None, **options) -> DataFrame:
    """Write the archive of ``pages`` and return the index read back from it.

    One capture per page, repeated rows too.  A null page is an empty payload;
    a null URL is left out of its record and sorts first; a null id names no
    record, so equal payloads refer to one with an id if there is one; other
    columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or new_table(spark, "archive")
    write_archive(pages, path, captured_ms, **options)
    return capture_index(spark, path)
