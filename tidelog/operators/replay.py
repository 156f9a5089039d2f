"""Replay order, delays and due times of a log, as data.

A replay cuts the surviving messages into arrival batches and sorts each
batch by ID; batches stay in arrival order.  Rows are grouped into chunks that
follow this order and fill one window group each, so one shuffle by chunk
serves the sort, the gap to the previous message and the running sums.

Usually a chunk is a number of whole batches.  Batches too large for that are
range-partitioned by their unique sort key into chunks of a table, written
once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.clock import format_utc_day_first
from tidelog.operators.arrival import batches
from tidelog.operators.select import exclude_streams, rename_streams
from tidelog.plans.scan import BUCKET_ROWS, carried, carried_in_blocks, div
from tidelog.plans.storage import new_table
from tidelog.schema import require_positive


# Batches a chunk must hold for the copies of its last one to stay cheap.
MIN_BATCHES = 4
# Range chunks, each a task and a file of its own, before they grow towards BUCKET_ROWS rows.
MANY_CHUNKS = 512


def _in_replay_order() -> Window:
    return Window.partitionBy("_chunk").orderBy("batch", "ms", "seq", "arrival")


def _row_in_chunk() -> Column:
    return F.row_number().over(_in_replay_order()).cast("bigint")


def _surviving(
    log: DataFrame, batch_size: int, exclude: Iterable[str], bucket_rows: int
) -> DataFrame:
    return batches(exclude_streams(log, exclude), batch_size, bucket_rows)


def replay_order(
    log: DataFrame,
    batch_size: int = 1000,
    exclude: Iterable[str] = (),
    rename: Mapping[str, str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``arrival``, ``batch`` and ``replay_no``, the position in the replay.

    Excluded streams leave before batching; renaming comes after.
    """
    rows = _surviving(log, batch_size, exclude, bucket_rows)
    per_chunk = bucket_rows // batch_size
    if per_chunk < MIN_BATCHES:
        ordered = _placed_by_range(rows, bucket_rows).drop("prev_ms")
    else:
        # All batches but the last are full, so a chunk's first number is known.
        number = F.col("_chunk") * (per_chunk * batch_size) + _row_in_chunk() - 1
        chunked = rows.withColumn("_chunk", div(F.col("batch"), per_chunk))
        ordered = chunked.withColumn("replay_no", number)
    return rename_streams(ordered.drop("_chunk"), rename or {})


def _placed(rows: DataFrame, batch_size: int, bucket_rows: int) -> DataFrame:
    """Add ``replay_no``, ``prev_ms`` and the chunk the row stays grouped by."""
    per_chunk = bucket_rows // batch_size
    if per_chunk < MIN_BATCHES:
        return _placed_by_range(rows, bucket_rows)
    return _placed_by_batch(rows, batch_size, per_chunk)


def _placed_by_batch(rows: DataFrame, batch_size: int, per_chunk: int) -> DataFrame:
    """Chunks of whole batches.

    The last batch of a chunk is also given, without its payload, to the next
    chunk, where it supplies the message before the first.
    """
    is_last = F.pmod(F.col("batch"), F.lit(per_chunk)) == per_chunk - 1
    here, ahead = F.lit(0), F.lit(1)
    copies = F.when(is_last, F.array(here, ahead)).otherwise(F.array(here))
    spread = rows.withColumn("_ahead", F.explode(copies))
    is_copy = F.col("_ahead") == 1
    chunk = (div(F.col("batch"), per_chunk) + F.col("_ahead")).alias("_chunk")
    payload = [
        F.when(~is_copy, F.col(c)).alias(c) if c == "fields" else F.col(c)
        for c in rows.columns
    ]
    # Copies sort before the chunk's own rows, because their batch is earlier.
    copied = F.when(F.col("_chunk") > 0, F.lit(batch_size)).otherwise(F.lit(0))
    number = F.col("_chunk") * (per_chunk * batch_size) + _row_in_chunk() - 1 - copied
    placed = spread.select(*payload, "_ahead", chunk).select(
        "*",
        number.alias("replay_no"),
        F.lag("ms").over(_in_replay_order()).alias("prev_ms"),
    )
    return placed.where(~is_copy).drop("_ahead")


def _range_chunks(count: int, bucket_rows: int) -> int:
    wanted = -(-count // bucket_rows)
    return max(1, min(wanted, max(MANY_CHUNKS, -(-count // BUCKET_ROWS))))


def _placed_by_range(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Chunks of about ``bucket_rows`` consecutive rows of batches of any size.

    Where that makes more than ``MANY_CHUNKS``, chunks hold more rows, up to
    ``BUCKET_ROWS``: the driver hears of every chunk from every step.  The
    chunks are stored, because a range partitioning may come out
    differently when it is computed again.
    """
    spark = rows.sparkSession
    chunks = _range_chunks(rows.count(), bucket_rows)
    path = new_table(spark, "replay-chunks")
    (
        rows.repartitionByRange(chunks, "batch", "ms", "seq", "arrival")
        .withColumn("_chunk", F.spark_partition_id().cast("bigint"))
        .write.parquet(path)
    )
    numbered = spark.read.parquet(path).select(
        "*",
        _row_in_chunk().alias("_row"),
        F.lag("ms").over(_in_replay_order()).alias("_prev"),
    )
    edges = numbered.groupBy("_chunk").agg(
        F.count("*").alias("_rows"), F.max_by("ms", "_row").alias("_last")
    )
    edges = carried(edges, ["_chunk"], sums=["_rows"]).select(
        "_chunk",
        "_rows_before",
        F.lag("_last").over(Window.orderBy("_chunk")).alias("_last_before"),
    )
    return numbered.join(edges, "_chunk").select(
        *rows.columns,
        "_chunk",
        (F.col("_rows_before") + F.col("_row") - 1).alias("replay_no"),
        F.coalesce(F.col("_prev"), F.col("_last_before")).alias("prev_ms"),
    )


def _delays(
    log: DataFrame,
    speed: float,
    max_delay: float,
    batch_size: int,
    exclude: Iterable[str],
    bucket_rows: int,
) -> DataFrame:
    """Rows in their place, with ``delay_us`` and whether a flush group starts."""
    require_positive(speed=speed, max_delay=max_delay, batch_size=batch_size)
    rows = _surviving(log, batch_size, exclude, bucket_rows)
    gap = F.col("ms") - F.col("prev_ms")
    capped = F.least(gap * 1000.0 / F.lit(float(speed)), F.lit(max_delay * 1e6))
    delay = F.when(gap > 0, F.round(capped).cast("bigint")).otherwise(F.lit(0))
    first_of_batch = F.pmod(F.col("replay_no"), F.lit(batch_size)) == 0
    starts = F.when((gap > 0) | first_of_batch, F.lit(1)).otherwise(F.lit(0))
    return _placed(rows, batch_size, bucket_rows).select(
        "*",
        delay.cast("bigint").alias("delay_us"),
        starts.cast("bigint").alias("_flush"),
    )


def replay_delay(
    log: DataFrame,
    speed: float = 1.0,
    max_delay: float = 60.0,
    batch_size: int = 1000,
    exclude: Iterable[str] = (),
    rename: Mapping[str, str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Replay order plus the wait before each message, in microseconds.

    The gap is taken to the previous message in replay order, across batches;
    a gap of zero or less means no wait.
    """
    delayed = _delays(log, speed, max_delay, batch_size, exclude, bucket_rows)
    return rename_streams(delayed.drop("_chunk", "_flush"), rename or {})


def _scheduled(delayed: DataFrame) -> DataFrame:
    """Add running totals: due time and flush group, chunk by chunk."""
    per_chunk = delayed.groupBy("_chunk").agg(
        F.sum("delay_us").alias("delay"), F.sum("_flush").alias("flush")
    )
    starts = carried(per_chunk, ["_chunk"], sums=["delay", "flush"])
    so_far = (
        Window.partitionBy("_chunk")
        .orderBy("replay_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = delayed.select(
        "*",
        F.sum("delay_us").over(so_far).alias("_due"),
        F.sum("_flush").over(so_far).alias("_group"),
    )
    return running.join(starts, "_chunk").select(
        *delayed.columns,
        (F.col("delay_before") + F.col("_due")).alias("due_us"),
        (F.col("flush_before") + F.col("_group") - 1).alias("flush_group"),
    )


def replay_schedule(
    log: DataFrame,
    speed: float = 1.0,
    max_delay: float = 60.0,
    batch_size: int = 1000,
    exclude: Iterable[str] = (),
    rename: Mapping[str, str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The whole schedule: order, delay, due time and flush group.

    ``due_us`` counts from the start of the replay.  Messages of one
    ``flush_group`` go out together: a wait, or a new batch, starts a group.
    """
    delayed = _delays(log, speed, max_delay, batch_size, exclude, bucket_rows)
    added = ["arrival", "batch", "replay_no", "prev_ms", "delay_us", "due_us"]
    scheduled = _scheduled(delayed).select(*log.columns, *added, "flush_group")
    return rename_streams(scheduled, rename or {})


def replay_reissue(
    log: DataFrame,
    base_ms: int,
    speed: float = 1.0,
    max_delay: float = 60.0,
    batch_size: int = 1000,
    exclude: Iterable[str] = (),
    rename: Mapping[str, str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The schedule with the IDs the target gives: ``new_ms`` and ``new_seq``.

    A message sent ``due_us`` after ``base_ms`` gets that millisecond, and the
    next free sequence number of its (renamed) stream in it.  New times never
    fall along the replay, so a stream's run of one millisecond can cross a
    chunk border only through the chunk's first or last millisecond; just
    those are counted and carried.
    """
    delayed = _delays(log, speed, max_delay, batch_size, exclude, bucket_rows)
    issued = rename_streams(_scheduled(delayed), rename or {}).withColumn(
        "new_ms", F.lit(base_ms).cast("bigint") + div(F.col("due_us"), 1000)
    )
    whole = Window.partitionBy("_chunk")
    issued = issued.withColumn("_edge", F.min("new_ms").over(whole))
    is_first = F.col("new_ms") == F.col("_edge")
    is_last = F.col("new_ms") == F.max("new_ms").over(whole)
    runs = (
        issued.withColumn("_is_edge", is_first | is_last)
        .where("_is_edge")
        .groupBy("_chunk", "stream_name", "new_ms")
        .agg(F.count("*").alias("_n"))
    )
    earlier = (
        Window.partitionBy("stream_name", "new_ms")
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One map per chunk, of the streams whose run goes on: it has no more
    # entries than the chunk has rows, and joins by chunk without a shuffle.
    entry = F.struct("stream_name", "_start")
    continued = (
        runs.withColumn("_start", F.sum("_n").over(earlier))
        .where(F.col("_start") > 0)
        .groupBy("_chunk")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("_starts"))
    )
    in_run = Window.partitionBy("_chunk", "stream_name", "new_ms").orderBy("replay_no")
    start = F.when(is_first, F.try_element_at("_starts", F.col("stream_name")))
    added = ["replay_no", "due_us", "new_ms", "new_seq"]
    return (
        issued.withColumn("_row", F.row_number().over(in_run).cast("bigint") - 1)
        .join(continued, "_chunk", "left")
        .withColumn("new_seq", F.coalesce(start, F.lit(0)) + F.col("_row"))
        .select(*log.columns, *added)
    )


def replay_batches(
    log: DataFrame,
    batch_size: int = 1000,
    exclude: Iterable[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Progress after each batch: size, bounds, elapsed and total milliseconds.

    ``first_ms`` is the smallest of batch 0, ``last_ms`` the largest so far,
    ``total_ms`` at least 1.
    """
    per_batch = (
        batches(exclude_streams(log, exclude), batch_size, bucket_rows)
        .groupBy("batch")
        .agg(
            F.count("*").alias("messages"),
            F.min("ms").alias("_lo"),
            F.max("ms").alias("top"),
        )
    )
    first = per_batch.where(F.col("batch") == 0).select("_lo").scalar()
    seen = carried_in_blocks(per_batch, "batch", sums=["messages"], maxes=["top"])
    last = F.greatest(F.col("top"), F.col("top_before"), F.lit(0).cast("bigint"))
    return (
        seen.withColumn("first_ms", first)
        .withColumn("last_ms", last)
        .select(
            "batch",
            "messages",
            (F.col("messages_before") + F.col("messages")).alias("replayed"),
            "first_ms",
            "last_ms",
            (F.col("top") - F.col("first_ms")).alias("elapsed_ms"),
            F.greatest(
                F.col("last_ms") - F.col("first_ms"), F.lit(1).cast("bigint")
            ).alias("total_ms"),
            format_utc_day_first(F.col("top")).alias("current_utc"),
            format_utc_day_first(F.col("last_ms")).alias("last_utc"),
        )
    )
