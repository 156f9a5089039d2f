"""Capture jobs: any streaming DataFrame of messages into a Parquet table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import (
    QueryIdleEvent,
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
)

from tidelog.functions.ids import MessageID
from tidelog.operators.arrival import message_bytes
from tidelog.operators.select import (
    KEPT,
    SET_ASIDE,
    dropped_streams,
    include_streams,
    judged,
    newer_than,
)
from tidelog.operators.stats import across_recordings, describe, recording_stats
from tidelog.schema import require_positive, stream_keys
from tidelog.sources.sinks import rotation, rotation_at
from tidelog.streaming.versions import VersionedTable

# The name under which a capture reports its counts.
COUNTS = "capture_counts"


def table_stream(
    spark: SparkSession,
    folder: str,
    name: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The Parquet files ``name`` (a glob) of a folder as a stream.

    ``files_per_trigger`` caps what one micro-batch takes.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger is not None:
        require_positive(files_per_trigger=files_per_trigger)
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def start_after(
    messages: DataFrame,
    last_ids: DataFrame | Mapping[str, MessageID | str] | str,
    missing: str = "earliest",
) -> DataFrame:
    """Messages after each stream's last ID; ``'earliest'`` takes all history.

    For "only what is new", pass what :func:`tidelog.operators.stats.last_ids`
    gives at the start: a stream that is not in it has no history yet, so it is
    captured from its first message on (``missing='skip'`` leaves it out).
    """
    if isinstance(last_ids, str):
        if last_ids != "earliest":
            raise ValueError(f"last_ids must be IDs or 'earliest', got {last_ids!r}")
        return messages
    return newer_than(messages, last_ids, missing)


def start_capture(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    streams: Iterable[str | dict] | None = None,
    once: bool = True,
    rotate_ms: int | None = None,
    rotate_at: DataFrame | Sequence[int] | None = None,
) -> StreamingQuery:
    """Append messages of the listed streams to a Parquet table, exactly once.

    ``once`` captures what is there and ends; otherwise the job keeps running.
    ``rotate_ms`` starts a new ``rotation`` folder for every such interval of
    message time, ``rotate_at`` at every given moment.  Offsets live in ``checkpoint``, so a restarted capture goes
    on where the last one stopped.
    """
    if streams is not None:
        names = list(streams)
        messages = _counted(messages, names)
        messages = include_streams(messages, names)
    else:
        messages = messages.observe(COUNTS, F.count("*").alias("kept"), F.lit(0).alias("dropped"))
    if rotate_ms is not None and rotate_at is not None:
        raise ValueError("give either rotate_ms or rotate_at")
    if rotate_ms is not None:
        messages = rotation(messages, rotate_ms)
    elif rotate_at is not None:
        messages = rotation_at(messages, rotate_at)
    if "rotation" in messages.columns:
        # A micro-batch adds one file to a rotation, not one per task.
        messages = messages.hint("rebalance", "rotation")
    writer = messages.writeStream.format("parquet").outputMode("append")
    if "rotation" in messages.columns:
        writer = writer.partitionBy("rotation")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start(path)


def start_judged_capture(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    streams: Iterable[str | dict] | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Decode raw messages and write all of them, good ones and those set aside, in one pass.

    The table has a folder per ``status``; the reasons are those of
    :func:`tidelog.operators.select.judged`.  Every message is in it exactly
    once, and the pass counts ``kept`` and ``dropped`` ones.
    """
    found = judged(raw, streams)
    kept = F.col("status") == KEPT
    counted = found.observe(
        COUNTS, F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped")
    )
    writer = counted.writeStream.format("parquet").outputMode("append").partitionBy("status")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start(path)


def kept_messages(spark: SparkSession, path: str) -> DataFrame:
    """The message log of :func:`start_judged_capture`; folders of other rows are not read."""
    rows = spark.read.parquet(path).where(F.col("status") == KEPT)
    return rows.drop("raw", "reason", "status")


def set_aside(spark: SparkSession, path: str) -> DataFrame:
    """The messages that :func:`start_judged_capture` set aside, as they came, with reasons."""
    rows = spark.read.parquet(path).where(F.col("status") == SET_ASIDE)
    return rows.drop(*("stream_name", "ms", "seq", "fields"), "status")


def _counted(messages: DataFrame, names: list[str | dict]) -> DataFrame:
    """Count listed and other messages in the pass that writes them."""
    listed = F.coalesce(F.col("stream_name").isin(stream_keys(names)), F.lit(False))
    return messages.observe(
        COUNTS, F.count_if(listed).alias("kept"), F.count_if(~listed).alias("dropped")
    )


class _LimitReached(Exception):
    """Ends a capture before the micro-batch at hand is written."""


@dataclass
class CaptureResult:
    """What a limited capture did: why it ended, elapsed time, messages of this run."""

    reason: str
    seconds: float
    kept: int = 0
    dropped: int = 0


def capture_with_limits(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    streams: Iterable[str | dict],
    max_size_mb: float | None = None,
    max_duration: float | None = None,
    once: bool = True,
    report: Callable[[str], None] | None = None,
) -> CaptureResult:
    """Capture in generations until a size or a duration is reached.

    Every micro-batch replaces its own ``generation=<n>`` folder, so a batch
    run again after a failure leaves no duplicates.  Before a batch is written
    the bytes kept so far are compared with the limit; the batch at which the
    capture ends is not committed and comes first when it is resumed.  Sizes are
    kept in ``<path>-sizes``, counts of unlisted streams in ``<path>-dropped``.
    """
    require_positive(max_size_mb=max_size_mb, max_duration=max_duration)
    limit = None if max_size_mb is None else int(max_size_mb * 1024 * 1024)
    wanted = list(streams)
    started = time.monotonic()
    reason: list[str] = []
    totals = {"kept": 0, "dropped": 0}

    def stop(why: str) -> None:
        reason.append(why)
        raise _LimitReached(why)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if max_duration is not None and time.monotonic() - started >= max_duration:
            stop("max_duration")
        before = _captured_bytes(spark, path, number)
        if limit is not None and before >= limit:
            stop("max_size_mb")
        batch = batch.persist()  # read twice below, from the source once
        try:
            seen = Observation()
            wanted_rows = include_streams(batch, wanted).observe(
                seen,
                F.coalesce(F.sum(message_bytes()), F.lit(0)).alias("bytes"),
                F.count("*").alias("kept"),
            )
            wanted_rows.write.mode("overwrite").parquet(f"{path}/generation={number}")
            others = Observation()
            dropped = dropped_streams(batch, wanted).observe(
                others, F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")
            )
            dropped.write.mode("overwrite").parquet(f"{path}-dropped/generation={number}")
        finally:
            batch.unpersist()
        new = seen.get["bytes"]
        sizes = spark.createDataFrame([(new, before + new)], "bytes bigint, total bigint")
        sizes.write.mode("overwrite").parquet(f"{path}-sizes/generation={number}")
        totals["kept"] += seen.get["kept"]
        totals["dropped"] += others.get["dropped"]
        if report is not None:
            report(f"generation {number} after {time.monotonic() - started:.1f}s")

    writer = messages.writeStream.foreachBatch(write)
    if once:
        writer = writer.trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint).start()
    try:
        while query.isActive:
            done = query.awaitTermination(1)
            late = max_duration is not None and (
                time.monotonic() - started >= max_duration
            )
            if not done and late:
                query.stop()
                reason.append("max_duration")
        query.awaitTermination()
    except StreamingQueryException:
        if not reason:
            raise
    return CaptureResult(
        reason[0] if reason else "end of input", time.monotonic() - started, **totals
    )


def _captured_bytes(spark: SparkSession, path: str, number: int) -> int:
    """Recording bytes before a generation: the running total of the one before it."""
    if number == 0:
        return 0
    return spark.read.parquet(f"{path}-sizes/generation={number - 1}").first().total


_LIVE_KEY = ["stream_name", "recording"]


def start_live_stats(
    messages: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Keep the per-stream statistics of a running capture current in a table.

    State holds one row per stream and recording.  Every trigger adds only the
    rows that it changed; :func:`live_stats` reads the table, whose files do
    not grow in number with the triggers.
    """

    def publish(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, path, _LIVE_KEY).add(batch, number)

    writer = (
        recording_stats(messages, ["ms", "seq"])
        .writeStream.outputMode("update")
        .foreachBatch(publish)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()


def live_stats(spark: SparkSession, path: str) -> DataFrame:
    """The newest statistics :func:`start_live_stats` has published."""
    current = VersionedTable(spark, path, _LIVE_KEY).rows()
    if current is None:
        raise ValueError(f"no statistics have been published to {path} yet")
    return describe(across_recordings(current, ["ms", "seq"]))


class CaptureStatus(StreamingQueryListener):
    """Messages that running captures kept and dropped, by the id of their query.

    Register it with ``spark.streams.addListener`` before
    :func:`start_capture`.  ``counts`` holds ``kept`` and ``dropped`` as the
    writing pass saw them, ``ended`` the queries that are over.
    """

    def __init__(self) -> None:
        self.counts: dict[str, dict[str, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.counts[str(event.id)] = {"kept": 0, "dropped": 0}

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        seen = event.progress.observedMetrics.get(COUNTS)
        if seen is not None:
            own = self.counts[str(event.progress.id)]
            for name in own:
                own[name] += seen[name]

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.ended.add(str(event.id))
