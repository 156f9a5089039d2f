"""Arrival numbers, arrival batches, and capture limits that follow arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidelog.functions.ids import format_id
from tidelog.functions.payload import recorded_bytes
from tidelog.plans.scan import BUCKET_ROWS, carried_in_blocks, div, number_by_arrival
from tidelog.schema import require_positive


def batches(
    log: DataFrame, batch_size: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add ``arrival`` (0, 1, 2, … in arrival order) and ``batch``."""
    require_positive(batch_size=batch_size)
    numbered = number_by_arrival(log, "arrival", bucket_rows)
    return numbered.withColumn("batch", div(F.col("arrival"), batch_size))


def message_bytes() -> Column:
    """Bytes the row takes in a recording file."""
    message_id = format_id(F.col("ms"), F.col("seq"))
    return recorded_bytes(F.col("stream_name"), message_id, F.col("fields"))


def bounded_capture(
    log: DataFrame,
    max_size_mb: float | None = None,
    max_duration: float | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """What a capture keeps that stops at a size or at a duration.

    The message with which the size limit is reached is the last.  The duration counts from the
    first arrival in message time (seconds); the first message at or past it,
    and all after it, are left out.  Finding where a limit falls runs a job.
    """
    require_positive(max_size_mb=max_size_mb, max_duration=max_duration)
    kept = log
    if max_duration is not None:
        kept = _until(kept, _first_late(log, int(max_duration * 1000)), inclusive=False)
    if max_size_mb is not None:
        limit = int(max_size_mb * 1024 * 1024)
        last = _last_within_size(log, limit, bucket_rows)
        kept = _until(kept, last, inclusive=True)
    return kept


def _until(log: DataFrame, position: Row | None, inclusive: bool) -> DataFrame:
    """Rows up to an arrival position; all rows when there is none.

    The position enters as literals, so nothing is shuffled and later parts of
    the log need not be read.
    """
    if position is None:
        return log
    recording, pos = F.col("recording"), F.col("pos")
    near = pos <= position.pos if inclusive else pos < position.pos
    return log.where(
        (recording < position.recording) | ((recording == position.recording) & near)
    )


def _first_late(log: DataFrame, duration_ms: int) -> Row | None:
    """Position of the first arrival ``duration_ms`` or more after the first one."""
    per_recording = log.groupBy("recording").agg(F.min_by("ms", "pos").alias("ms"))
    first_ms = per_recording.agg(F.min_by("ms", "recording")).first()[0]
    if first_ms is None:
        return None
    late = log.where(F.col("ms") >= first_ms + duration_ms)
    per_recording = late.groupBy("recording").agg(F.min("pos").alias("pos"))
    return per_recording.agg(F.min(F.struct("recording", "pos"))).first()[0]


def _last_within_size(log: DataFrame, limit: int, bucket_rows: int) -> Row | None:
    """Position of the last message captured before the size limit stops it.

    Bucket totals find the one bucket in which the limit falls; only that
    bucket is ordered.
    """
    placed = log.withColumn("_bucket", div(F.col("pos"), bucket_rows))
    per_bucket = placed.groupBy("recording", "_bucket").agg(
        F.sum(message_bytes()).alias("_bytes")
    )
    totals = carried_in_blocks(per_bucket, "_bucket", sums=["_bytes"], within=["recording"])
    totals = totals.select(
        "recording",
        "_bucket",
        "_bytes_before",
        (F.col("_bytes_before") + F.col("_bytes")).alias("_bytes_after"),
    )
    by_pos = Window.partitionBy("recording", "_bucket").orderBy("pos")
    earlier = by_pos.rowsBetween(Window.unboundedPreceding, -1)

    # Totals rise along the buckets, so at most one bucket meets the condition.
    at_limit = F.broadcast(
        totals.where((F.col("_bytes_before") < limit) & (F.col("_bytes_after") >= limit))
    )
    total = F.col("_bytes_before") + F.coalesce(
        F.sum("_bytes").over(earlier), F.lit(0)
    )
    kept = (
        placed.join(at_limit, ["recording", "_bucket"])
        .withColumn("_bytes", message_bytes())
        .withColumn("_total", total)
        .where(F.col("_total") < limit)
    )
    return kept.agg(F.max(F.struct("recording", "pos"))).first()[0]
