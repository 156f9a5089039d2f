"""Per-stream and whole-log statistics.

"First" and "last" follow arrival order ``(recording, pos)``.  The row-level
aggregates keep only numbers as buffers, so they run as hash aggregates with
map-side partials; strings and structs appear in the small second step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ids import MessageID, format_id, in_range
from tidelog.operators.arrival import batches
from tidelog.plans.scan import BUCKET_ROWS

# More than the largest sequence number.
ID_STEP = 10**19


def recording_stats(log: DataFrame, columns: list[str]) -> DataFrame:
    """Count, position bounds and arrival-first/last values per stream and recording.

    Works on batch and streaming logs alike.
    """
    return log.groupBy("stream_name", "recording").agg(
        F.count("*").alias("messages"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        *[F.min_by(c, "pos").alias(f"first_{c}") for c in columns],
        *[F.max_by(c, "pos").alias(f"last_{c}") for c in columns],
    )


def across_recordings(per_recording: DataFrame, columns: list[str]) -> DataFrame:
    """Fold :func:`recording_stats` into one row per stream."""
    start = F.struct("recording", "first_pos")
    end = F.struct("recording", "last_pos")
    return per_recording.groupBy("stream_name").agg(
        F.sum("messages").alias("messages"),
        *[F.min_by(f"first_{c}", start).alias(f"first_{c}") for c in columns],
        *[F.max_by(f"last_{c}", end).alias(f"last_{c}") for c in columns],
    )


def _first_and_last(log: DataFrame, columns: list[str]) -> DataFrame:
    return across_recordings(recording_stats(log, columns), columns)


def stream_stats(log: DataFrame) -> DataFrame:
    """Messages, first and last ID by arrival, and duration of every stream."""
    return describe(_first_and_last(log, ["ms", "seq"]))


def describe(streams: DataFrame) -> DataFrame:
    """IDs as text and durations, sorted by stream."""
    duration = F.col("last_ms") - F.col("first_ms")
    return streams.select(
        "stream_name",
        "messages",
        format_id(F.col("first_ms"), F.col("first_seq")).alias("first_id"),
        format_id(F.col("last_ms"), F.col("last_seq")).alias("last_id"),
        duration.alias("duration_ms"),
        (duration / 1000).alias("duration_s"),
    ).orderBy("stream_name")


def log_totals(log: DataFrame) -> DataFrame:
    """Number of streams and of messages."""
    per_stream = log.groupBy("stream_name").agg(F.count("*").alias("_n"))
    return per_stream.agg(
        F.count("*").alias("streams"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("messages"),
    )


def file_bytes(df: DataFrame) -> DataFrame:
    """Bytes of the distinct files behind a file-based DataFrame."""
    files = df.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
    )
    per_file = files.groupBy("path").agg(F.max("size").alias("size"))
    return per_file.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def timeline_streams(log: DataFrame) -> DataFrame:
    """Count and first/last milliseconds by arrival of every stream."""
    return _first_and_last(log, ["ms"]).orderBy("stream_name")


def timeline_global(streams: DataFrame) -> DataFrame:
    """One row: earliest first, latest last and total; zeros for an empty log."""
    return streams.agg(
        F.coalesce(F.min("first_ms"), F.lit(0)).alias("first_ms"),
        F.coalesce(F.max("last_ms"), F.lit(0)).alias("last_ms"),
        F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
    )


def auto_start_id(log: DataFrame) -> DataFrame:
    """One row: the latest of the streams' arrival-first IDs (NULL when empty)."""
    firsts = _first_and_last(log, ["ms", "seq"])
    latest = firsts.agg(F.max(F.struct("first_ms", "first_seq")).alias("_id"))
    return latest.select(
        F.col("_id.first_ms").alias("ms"), F.col("_id.first_seq").alias("seq")
    )


def last_ids(log: DataFrame) -> DataFrame:
    """The largest ID of every stream, the point from which to resume.

    Both parts of an ID make one number of at most 38 digits, whose maximum is
    a hash aggregate; the maximum of a struct would sort the rows.
    """
    step = F.lit(str(ID_STEP)).cast("decimal(20,0)")
    whole = F.col("ms").cast("decimal(19,0)") * step + F.col("seq").cast("decimal(19,0)")
    newest = log.groupBy("stream_name").agg(F.max(whole).alias("_id"))
    parts = newest.select("stream_name", "_id", F.call_function("div", F.col("_id"), step).alias("ms"))
    seq = (F.col("_id") - F.col("ms").cast("decimal(19,0)") * step).cast("bigint")
    return parts.select("stream_name", "ms", seq.alias("seq"))


def field_keys(log: DataFrame) -> DataFrame:
    """Every field name that occurs in the log, sorted."""
    keys = log.select(F.explode(F.map_keys("fields")).alias("field_key"))
    return keys.distinct().orderBy("field_key")


def estimate_window(streams: DataFrame, left_ms: int, right_ms: int) -> DataFrame:
    """One row: messages expected between two times, from the timeline alone.

    Streams are taken as evenly spread.  A stream without extent counts fully
    when it lies inside the window; any other overlap counts at least one.
    """
    left = F.lit(left_ms).cast("bigint")
    right = F.lit(right_ms).cast("bigint")
    span = F.col("last_ms") - F.col("first_ms")
    overlap = F.least(right, F.col("last_ms")) - F.greatest(left, F.col("first_ms"))
    inside = (F.col("first_ms") >= left) & (F.col("last_ms") <= right)
    share = F.bround(F.col("messages") * (overlap / span), 0).cast("bigint")
    estimate = (
        F.when((span <= 0) | (F.col("messages") <= 0), F.when(inside, F.col("messages")))
        .when(overlap > 0, F.greatest(share, F.lit(1).cast("bigint")))
        .otherwise(0)
    )
    return streams.agg(F.coalesce(F.sum(estimate), F.lit(0)).alias("estimated"))


def truncate_counts(
    log: DataFrame, low: MessageID | None, high: MessageID | None
) -> DataFrame:
    """One row: messages a truncation writes and skips, in a single pass."""
    inside = in_range(low, high)
    return log.agg(
        F.count_if(inside).alias("written"), F.count_if(~inside).alias("skipped")
    )


def batch_summary(
    log: DataFrame, batch_size: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Messages per stream in every arrival batch."""
    return (
        batches(log, batch_size, bucket_rows)
        .groupBy("batch", "stream_name")
        .agg(F.count("*").alias("messages"))
    )
