"""The registered queries: every operator over the whole benchmark tables.

``E`` is the events log, ``O`` the orders log, whose arrival order is far from
its time order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import clock, ids
from tidelog.operators import arrival, flatten, replay, select, stats
from tidelog.plans.scan import div, number_by_arrival
from tidelog.plans.storage import new_table, stored
from tidelog.sources import adapters, sinks
from tidelog.sources.recordings import (
    follow_recordings,
    read_recordings,
    recording_table,
    write_recordings,
)
from tidelog.streaming import capture

Query = Callable[[SparkSession, str], DataFrame]

# The parameters the queries and their SQL counterparts share.
WEEK_START = ids.MessageID(1704672000000, 0)
WEEK_END = ids.MessageID(1705276800000, 5)
DAY_MS = 86_400_000
EVENT_STREAMS = ["events:click", "events:view"]
SKIPPED_STREAM = "orders:5-LOW"
NEW_STREAM = "events:click"
RENAMED = {
    "events:click": "web",
    "events:view": "web",
    "events:error": "ops:error",
}
RENAMED_ORDERS = {"orders:1-URGENT": "fast", "orders:2-HIGH": "fast"}
BATCH_SIZE = 1000
SPEED = float(2**21)
MAX_DELAY = 60.0
REISSUE_BASE_MS = 1_700_000_000_000
CAPTURE_MB = 0.25
CAPTURE_SECONDS = 200_000
FETCH_ROWS = 100
MANY_ROWS = 5000
# Buckets, cuts and lists so small or long that even small tables fill many.
SMALL_BUCKET = 5000
SMALL_CUT = 1 << 17
LARGE_RECORD_TEXTS = 500
FOLLOWED_AT_ONCE = 4000
BAD_IDS = 101
LIMIT_PARTS = 6
ALL_EVENT_STREAMS = [f"events:{kind}" for kind in ("click", "error", "purchase", "signup", "view")]
ROTATE_EVERY = 2003
MANY_NAMES = [*(f"other:{n}" for n in range(300)), *EVENT_STREAMS]

REPLAY = {"batch_size": BATCH_SIZE, "exclude": [SKIPPED_STREAM]}
TIMED = {"speed": SPEED, "max_delay": MAX_DELAY, **REPLAY}


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.events_arrivals(adapters.table(spark, folder, "events"))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.orders_arrivals(adapters.table(spark, folder, "orders"))


def _field(name: str, kind: str) -> Column:
    return F.try_element_at("fields", F.lit(name)).cast(kind).alias(name)


def _with_event_fields(log: DataFrame) -> DataFrame:
    return log.select(
        "stream_name",
        "ms",
        "seq",
        "pos",
        _field("user_id", "bigint"),
        _field("value", "double"),
        _field("k", "bigint"),
    )


# ---- slicing ----------------------------------------------------------------


def truncate_range(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.events_log(spark, folder, WEEK_START.ms, WEEK_END.ms)
    return _with_event_fields(select.truncate(log, WEEK_START, WEEK_END))


def truncate_from(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.events_log(spark, folder, from_ms=WEEK_START.ms)
    return _with_event_fields(select.truncate(log, from_id=WEEK_START))


def truncate_to(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.events_log(spark, folder, to_ms=WEEK_END.ms)
    return _with_event_fields(select.truncate(log, to_id=WEEK_END))


def truncate_auto_start(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    return select.truncate(log, auto_start=True).select(
        "stream_name", "ms", "seq", "pos"
    )


def auto_start_id(spark: SparkSession, folder: str) -> DataFrame:
    return stats.auto_start_id(adapters.orders_log(spark, folder))


def truncate_time(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    left, right = 820_454_400_000, 946_684_800_000
    slices = [
        select.truncate_by_time(log, left, right, end).select(
            F.lit(end).alias("end_mode"), "stream_name", "ms", "seq", "pos"
        )
        for end in ("parity", "whole_ms")
    ]
    return slices[0].unionByName(slices[1])


def truncate_counts(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.events_log(spark, folder)
    return stats.truncate_counts(log, WEEK_START, WEEK_END)


# ---- statistics -------------------------------------------------------------


def stream_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.stream_stats(adapters.orders_log(spark, folder))


def log_totals(spark: SparkSession, folder: str) -> DataFrame:
    return stats.log_totals(_events(spark, folder))


def volume_totals(spark: SparkSession, folder: str) -> DataFrame:
    lines = adapters.table(spark, folder, "lineitem")
    return stats.log_totals(adapters.lineitem_arrivals(lines))


def timeline_streams(spark: SparkSession, folder: str) -> DataFrame:
    return stats.timeline_streams(_orders(spark, folder))


def timeline_global(spark: SparkSession, folder: str) -> DataFrame:
    return stats.timeline_global(stats.timeline_streams(_orders(spark, folder)))


def estimate_window(spark: SparkSession, folder: str) -> DataFrame:
    timeline = stats.timeline_streams(_events(spark, folder))
    return stats.estimate_window(timeline, WEEK_START.ms, WEEK_END.ms)


def field_keys(spark: SparkSession, folder: str) -> DataFrame:
    both = _events(spark, folder).unionByName(_orders(spark, folder))
    return stats.field_keys(both)


def last_ids(spark: SparkSession, folder: str) -> DataFrame:
    return stats.last_ids(adapters.orders_log(spark, folder))


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.batch_summary(_orders(spark, folder), BATCH_SIZE)


# ---- message IDs and text ---------------------------------------------------


def _text_ids(spark: SparkSession, folder: str) -> DataFrame:
    """E with text IDs, every 97th spoilt and every 5th without its sequence."""
    log = adapters.events_log(spark, folder)
    number = F.col("pos")
    raw = (
        F.when(number % 97 == 0, F.concat(F.lit("bad-"), F.col("ms").cast("string")))
        .when(number % 5 == 0, F.col("ms").cast("string"))
        .otherwise(ids.format_id(F.col("ms"), F.col("seq")))
    )
    return log.select("stream_name", "pos", raw.alias("raw_id"))


def parse_message_id(spark: SparkSession, folder: str) -> DataFrame:
    return select.parse_ids(_text_ids(spark, folder), "raw_id", "PERMISSIVE")


def drop_malformed(spark: SparkSession, folder: str) -> DataFrame:
    return select.parse_ids(_text_ids(spark, folder), "raw_id", "DROPMALFORMED")


def format_message_id(spark: SparkSession, folder: str) -> DataFrame:
    message_id = ids.format_id(F.col("ms"), F.col("seq")).alias("message_id")
    return adapters.orders_log(spark, folder).select("pos", message_id)


def stringify_fields(spark: SparkSession, folder: str) -> DataFrame:
    numbers = F.create_map(
        F.lit("user_id"), F.col("user_id"), F.lit("event_id"), F.col("event_id")
    )
    typed = adapters.table(spark, folder, "events").select(
        F.col("event_id").alias("pos"), numbers.alias("fields")
    )
    text = select.stringify_fields(typed)
    return text.select("pos", _field("user_id", "string"), _field("event_id", "string"))


def drop_undecodable(spark: SparkSession, folder: str) -> DataFrame:
    """E as raw bytes, with the name, the ID or a value spoilt in some rows."""
    kept = select.drop_undecodable(_raw_events(adapters.events_log(spark, folder)))
    return kept.select("stream_name", "id", "pos", _field("user_id", "bigint"))


def _raw_events(log: DataFrame, bad_ids: int | None = None) -> DataFrame:
    """E as raw bytes; every ``bad_ids``-th ID is none."""
    spoilt = F.lit(b"\xff\xfe")
    text = ids.format_id(F.col("ms"), F.col("seq"))
    if bad_ids is not None:
        text = F.when(F.col("pos") % bad_ids == 0, F.lit("none")).otherwise(text)
    raw_fields = F.transform_values(
        "fields",
        lambda key, value: F.when(
            (key == "k") & (F.col("pos") % 83 == 0), spoilt
        ).otherwise(value.cast("binary")),
    )
    return log.select(
        F.when(F.col("pos") % 89 == 0, spoilt)
        .otherwise(F.col("stream_name").cast("binary"))
        .alias("stream_name"),
        F.when(F.col("pos") % 97 == 0, spoilt).otherwise(text.cast("binary")).alias("id"),
        raw_fields.alias("fields"),
        "recording",
        "pos",
    )


# ---- streams ----------------------------------------------------------------


def include_streams(spark: SparkSession, folder: str) -> DataFrame:
    kept = select.include_streams(_events(spark, folder), EVENT_STREAMS)
    return kept.select("stream_name", "ms", "pos")


def exclude_streams(spark: SparkSession, folder: str) -> DataFrame:
    kept = select.exclude_streams(_events(spark, folder), EVENT_STREAMS)
    return kept.select("stream_name", "ms", "pos")


def dropped_streams(spark: SparkSession, folder: str) -> DataFrame:
    return select.dropped_streams(_events(spark, folder), EVENT_STREAMS)


def rename_streams(spark: SparkSession, folder: str) -> DataFrame:
    renamed = select.rename_streams(_events(spark, folder), RENAMED)
    return renamed.select("stream_name", "ms", "pos")


def read_after(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    seen = stats.last_ids(select.truncate(log, to_id="915148800000-2"))
    new = select.read_after(log, seen, FETCH_ROWS)
    return new.select("stream_name", "ms", "seq", "pos")


# ---- tables and exports -----------------------------------------------------


def flatten_fields(spark: SparkSession, folder: str) -> DataFrame:
    events = adapters.events_log(spark, folder)
    both = events.unionByName(adapters.orders_log(spark, folder))
    path = new_table(spark, "export-parquet")
    sinks.export(both, path, "parquet")
    return spark.read.parquet(path).select(
        *["stream_name", "message_id", "timestamp_ms", "custkey", "k", "status"],
        F.col("totalprice").cast("double").alias("totalprice"),
        "user_id",
        F.col("value").cast("double").alias("value"),
    )


def flatten_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of whole numbers, others, truth values and a mix, each in its type."""
    events = adapters.table(spark, folder, "events")
    user = F.col("user_id")
    mixed = F.when(user % 3 == 0, user.cast("variant")).when(
        user % 3 == 1, (user % 2 == 0).cast("variant")
    ).otherwise(F.col("event_type").cast("variant"))
    number = F.when(user % 2 == 0, user.cast("variant")).otherwise(F.col("value").cast("variant"))
    entries = {
        "user_id": user.cast("variant"),
        "even": (user % 2 == 0).cast("variant"),
        "mixed": mixed,
        "number": number,
        "value": F.col("value").cast("variant"),
    }
    pairs = [F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in entries.items()]
    log = events.select(
        F.concat(F.lit("events:"), F.col("event_type")).alias("stream_name"),
        clock.epoch_ms(F.col("ts")).alias("ms"),
        F.lit(0).cast("bigint").alias("seq"),
        F.map_from_entries(F.array(*pairs)).alias("fields"),
    )
    return flatten.flatten_typed(log)


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "export-csv")
    keys = ["k", "user_id", "value"]
    sinks.export(adapters.events_log(spark, folder), path, "csv", keys=keys)
    columns = ["stream_name", "message_id", "timestamp_ms", *keys]
    back = sinks.read_csv_export(spark, path, columns)
    return back.withColumn("value", F.col("value").cast("double"))


def recording_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "recordings")
    write_recordings(adapters.events_log(spark, folder), path)
    return _with_event_fields(read_recordings(spark, path)).drop("pos")


def append_union(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "log")
    sinks.write_log(adapters.events_log(spark, folder), path)
    sinks.write_log(adapters.orders_log(spark, folder), path, by_time=True)
    return spark.read.parquet(path).select(
        "stream_name", "ms", "seq", "recording", "pos"
    )


def rotate_by_time(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "rotated")
    sinks.write_rotated(_events(spark, folder), path, DAY_MS)
    rotated = spark.read.parquet(path)
    return rotated.groupBy(F.col("rotation").cast("bigint").alias("rotation")).agg(
        F.count("*").alias("messages"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
    )


# ---- replay -----------------------------------------------------------------


def replay_order(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    ordered = replay.replay_order(log, rename=RENAMED_ORDERS, **REPLAY)
    return ordered.select("replay_no", "batch", "stream_name", "ms", "seq", "pos")


def replay_delay(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    return replay.replay_delay(log, **TIMED).select(
        "replay_no", "ms", "prev_ms", "delay_us", "pos"
    )


def replay_due(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    return replay.replay_schedule(log, **TIMED).select(
        "replay_no", "stream_name", "ms", "seq", "pos", "due_us"
    )


def flush_groups(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    scheduled = replay.replay_schedule(log, **TIMED)
    return scheduled.groupBy("flush_group").agg(
        F.count("*").alias("messages"),
        F.min("replay_no").alias("first_no"),
        F.max("replay_no").alias("last_no"),
        F.max("due_us").alias("due_us"),
    )


def replay_reissue(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    issued = replay.replay_reissue(
        log, REISSUE_BASE_MS, rename=RENAMED_ORDERS, **TIMED
    )
    return issued.select("stream_name", "pos", "replay_no", "new_ms", "new_seq")


def replay_batches(spark: SparkSession, folder: str) -> DataFrame:
    return replay.replay_batches(_orders(spark, folder), **REPLAY)


def bounded_capture(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.events_log(spark, folder)
    kept = arrival.bounded_capture(log, max_size_mb=CAPTURE_MB)
    return kept.select("stream_name", "ms", "seq", "pos")


def bounded_duration(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.events_log(spark, folder)
    kept = arrival.bounded_capture(log, max_duration=CAPTURE_SECONDS)
    return kept.select("stream_name", "ms", "seq", "pos")


# ---- clocks -----------------------------------------------------------------


def fmt_hms(spark: SparkSession, folder: str) -> DataFrame:
    offset = F.col("ms") - WEEK_START.ms
    text = clock.format_duration(offset).alias("duration")
    return _events(spark, folder).select("pos", text)


def fmt_utc(spark: SparkSession, folder: str) -> DataFrame:
    text = clock.format_utc(F.col("ms")).alias("utc")
    return _events(spark, folder).select("pos", text)


def fmt_utc_dmy(spark: SparkSession, folder: str) -> DataFrame:
    text = clock.format_utc_day_first(F.col("ms")).alias("utc")
    return _events(spark, folder).select("pos", text)


def parse_hms(spark: SparkSession, folder: str) -> DataFrame:
    text = F.substring(clock.format_utc(F.col("ms")), 12, 12)
    shown = (
        F.when(F.col("pos") % 5 == 0, text)
        .when(F.col("pos") % 5 == 1, F.substring(text, 4, 7))
        .when(F.col("pos") % 5 == 2, F.concat(F.lit("  "), F.substring(text, 1, 8)))
        .when(F.col("pos") % 5 == 3, F.concat(text, F.lit("99")))
        .otherwise(F.concat(F.lit("1:"), text))
    )
    rows = _events(spark, folder).select("pos", shown.alias("shown"))
    return rows.withColumn("ms", clock.parse_duration(F.col("shown")))


def parse_utc(spark: SparkSession, folder: str) -> DataFrame:
    text = clock.format_utc(F.col("ms"))
    shown = (
        F.when(F.col("pos") % 3 == 0, text)
        .when(F.col("pos") % 3 == 1, F.substring(text, 1, 10))
        .otherwise(F.replace(text, F.lit("2024-01"), F.lit("2024-13")))
    )
    rows = _events(spark, folder).select("pos", shown.alias("shown"))
    none = F.lit(0).cast("bigint")
    return rows.withColumn("ms", clock.parse_utc(F.col("shown"), none, none))


def parse_utc_inferred(spark: SparkSession, folder: str) -> DataFrame:
    # Each row's range is the 12 hours from its own time on, so that clock
    # times fall on the same day, on the next one, or outside.
    text = F.substring(clock.format_utc(F.col("ms") + 6 * 3_600_000), 12, 12)
    shown = F.when(F.col("pos") % 3 == 0, F.lit("12:00:00.5")).otherwise(text)
    rows = _events(spark, folder).select("pos", "ms", shown.alias("shown"))
    last = F.col("ms") + 12 * 3_600_000
    found = clock.parse_utc(F.col("shown"), F.col("ms"), last)
    return rows.withColumn("found_ms", found)


# ---- streaming --------------------------------------------------------------


def _events_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = adapters.table(spark, folder, "events").schema
    files = capture.table_stream(spark, folder, "events.parquet", schema, 1)
    return adapters.events_arrivals(files)


def stream_capture(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "capture")
    capture.start_capture(
        _events_stream(spark, folder), path, f"{path}-offsets", EVENT_STREAMS
    ).awaitTermination()
    captured = adapters.with_sequence(spark.read.parquet(path))
    return _with_event_fields(captured)


def _events_in_files(
    spark: SparkSession, folder: str, parts: int = 6
) -> tuple[DataFrame, DataFrame]:
    """E as several files: a stream of one file per micro-batch, and the whole."""
    path = new_table(spark, "events")
    log = adapters.events_log(spark, folder)
    log.repartitionByRange(parts, "pos").write.parquet(path)
    whole = spark.read.parquet(path)
    return capture.table_stream(spark, path, "*.parquet", whole.schema, 1), whole


def stream_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Only what is new; one stream has no history before the start."""
    path = new_table(spark, "resumed")
    messages, log = _events_in_files(spark, folder)
    early = log.where((F.col("ms") < WEEK_START.ms) & (F.col("stream_name") != NEW_STREAM))
    new = capture.start_after(messages, stats.last_ids(early))
    capture.start_capture(new, path, f"{path}-offsets").awaitTermination()
    return spark.read.parquet(path).select("stream_name", "ms", "seq", "pos")


def stream_stats_live(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "live-stats")
    messages, _ = _events_in_files(spark, folder)
    capture.start_live_stats(messages, path, f"{path}-offsets").awaitTermination()
    return capture.live_stats(spark, path)


def capture_restart(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of one capture; the second finds more files."""
    inbox, path = new_table(spark, "inbox"), new_table(spark, "captured")
    log = adapters.events_log(spark, folder)
    for half in (F.col("pos") % 2 == 0, F.col("pos") % 2 == 1):
        log.where(half).repartition(3, "pos").write.mode("append").parquet(inbox)
        schema = spark.read.parquet(inbox).schema
        messages = capture.table_stream(spark, inbox, "*.parquet", schema, 1)
        capture.start_capture(messages, path, f"{path}-offsets").awaitTermination()
    return _with_event_fields(spark.read.parquet(path))


def capture_rotated(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "captured")
    messages, _ = _events_in_files(spark, folder)
    capture.start_capture(
        messages, path, f"{path}-offsets", rotate_ms=DAY_MS
    ).awaitTermination()
    rotated = spark.read.parquet(path)
    return rotated.groupBy(F.col("rotation").cast("bigint").alias("rotation")).agg(
        F.count("*").alias("messages"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
    )


def capture_limits(spark: SparkSession, folder: str) -> DataFrame:
    """A capture that ends at once by its duration, then, resumed, at a size."""
    inbox, path = new_table(spark, "inbox"), new_table(spark, "captured")
    log = stored(adapters.events_log(spark, folder), "events")
    step = log.count() // LIMIT_PARTS + 1
    for part in range(LIMIT_PARTS):
        rows = log.where((F.col("pos") >= part * step) & (F.col("pos") < (part + 1) * step))
        rows.repartition(1).write.mode("append").parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    for limits in ({"max_duration": 1e-6}, {"max_size_mb": CAPTURE_MB}):
        messages = capture.table_stream(spark, inbox, "*.parquet", schema, 1)
        capture.capture_with_limits(messages, path, f"{path}-offsets", ALL_EVENT_STREAMS, **limits)
    return spark.read.parquet(path).select("stream_name", "ms", "seq", "pos")


def log_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of all recordings of a folder, and the messages in them."""
    path = new_table(spark, "recordings")
    write_recordings(adapters.events_log(spark, folder), path)
    size = stats.file_bytes(spark.read.format("binaryFile").load(path))
    counted = stats.log_totals(read_recordings(spark, path))
    return counted.join(F.broadcast(size), F.lit(True))


def capture_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Raw messages decoded, judged and written in the one pass of a capture."""
    path = new_table(spark, "judged")
    messages, _ = _events_in_files(spark, folder)
    raw = _raw_events(messages, BAD_IDS)
    capture.start_judged_capture(raw, path, f"{path}-offsets", EVENT_STREAMS).awaitTermination()
    kept = capture.kept_messages(spark, path).withColumn("reason", F.lit(None).cast("string"))
    aside = capture.set_aside(spark, path).withColumn("ms", F.lit(None).cast("bigint"))
    return kept.select("pos", "ms", "reason").unionByName(aside.select("pos", "ms", "reason"))


def _rotation_times(spark: SparkSession, folder: str) -> DataFrame:
    events = adapters.table(spark, folder, "events").where(F.col("event_id") % ROTATE_EVERY == 0)
    return events.select(clock.epoch_ms(F.col("ts")).alias("ms"))


def rotate_at(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "rotated")
    sinks.write_rotated_at(_events(spark, folder), path, _rotation_times(spark, folder))
    return _per_rotation(spark.read.parquet(path))


def capture_rotated_at(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "captured")
    messages, _ = _events_in_files(spark, folder)
    times = _rotation_times(spark, folder)
    capture.start_capture(messages, path, f"{path}-offsets", rotate_at=times).awaitTermination()
    return _per_rotation(spark.read.parquet(path))


def _per_rotation(rotated: DataFrame) -> DataFrame:
    return rotated.groupBy(F.col("rotation").cast("bigint").alias("rotation")).agg(
        F.count("*").alias("messages"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
    )


def capture_status(spark: SparkSession, folder: str) -> DataFrame:
    """What a capture with limits kept and dropped over many micro-batches."""
    path = new_table(spark, "captured")
    messages, _ = _events_in_files(spark, folder)
    done = capture.capture_with_limits(messages, path, f"{path}-offsets", EVENT_STREAMS)
    return spark.createDataFrame([(done.kept, done.dropped)], "kept bigint, dropped bigint")


# ---- the same operators over many buckets, cuts, names ----------------------


def replay_order_many(spark: SparkSession, folder: str) -> DataFrame:
    ordered = replay.replay_order(
        adapters.orders_log(spark, folder),
        rename=RENAMED_ORDERS,
        bucket_rows=SMALL_BUCKET,
        **REPLAY,
    )
    return ordered.select("replay_no", "batch", "stream_name", "ms", "seq", "pos")


def replay_order_big_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of more rows than a bucket."""
    ordered = replay.replay_order(
        adapters.orders_log(spark, folder), batch_size=MANY_ROWS, bucket_rows=MANY_ROWS // 4
    )
    return ordered.select("replay_no", "batch", "stream_name", "ms", "seq", "pos")


def replay_delay_many(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    return replay.replay_delay(log, bucket_rows=SMALL_BUCKET, **TIMED).select(
        "replay_no", "ms", "prev_ms", "delay_us", "pos"
    )


def replay_due_many(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    return replay.replay_schedule(log, bucket_rows=SMALL_BUCKET, **TIMED).select(
        "replay_no", "stream_name", "ms", "seq", "pos", "due_us"
    )


def flush_groups_many(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    scheduled = replay.replay_schedule(log, bucket_rows=SMALL_BUCKET, **TIMED)
    return scheduled.groupBy("flush_group").agg(
        F.count("*").alias("messages"),
        F.min("replay_no").alias("first_no"),
        F.max("replay_no").alias("last_no"),
        F.max("due_us").alias("due_us"),
    )


def batch_summary_many(spark: SparkSession, folder: str) -> DataFrame:
    return stats.batch_summary(_orders(spark, folder), BATCH_SIZE, SMALL_BUCKET)


def format_message_id_many(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.with_sequence(_orders(spark, folder), SMALL_BUCKET)
    message_id = ids.format_id(F.col("ms"), F.col("seq")).alias("message_id")
    return log.select("pos", message_id)


def read_after_many(spark: SparkSession, folder: str) -> DataFrame:
    log = adapters.orders_log(spark, folder)
    seen = stats.last_ids(select.truncate(log, to_id="800000000000-0"))
    new = select.read_after(log, seen, MANY_ROWS, bucket_ms=30 * DAY_MS)
    return new.select("stream_name", "ms", "seq", "pos")


def _partly_named(spark: SparkSession, folder: str) -> DataFrame:
    name = F.when(F.col("pos") % 101 != 0, F.col("stream_name"))
    return _events(spark, folder).withColumn("stream_name", name)


def include_streams_many(spark: SparkSession, folder: str) -> DataFrame:
    kept = select.include_streams(_partly_named(spark, folder), MANY_NAMES)
    return kept.select("stream_name", "ms", "pos")


def exclude_streams_many(spark: SparkSession, folder: str) -> DataFrame:
    kept = select.exclude_streams(_partly_named(spark, folder), MANY_NAMES)
    return kept.select("stream_name", "ms", "pos")


def rename_streams_many(spark: SparkSession, folder: str) -> DataFrame:
    names = {**{name: "unused" for name in MANY_NAMES}, **RENAMED}
    renamed = select.rename_streams(_partly_named(spark, folder), names)
    return renamed.select("stream_name", "ms", "pos")


def truncate_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Counts taken by the pass that writes the rows."""
    log = adapters.events_log(spark, folder)
    kept, counts = select.truncate_observed(log, WEEK_START, WEEK_END)
    kept.write.format("noop").mode("overwrite").save()
    found = [(counts.get["written"], counts.get["skipped"])]
    return spark.createDataFrame(found, "written bigint, skipped bigint")


def recording_order(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends to one folder, numbered by arrival."""
    path = new_table(spark, "recordings")
    write_recordings(adapters.events_log(spark, folder), path)
    write_recordings(adapters.orders_log(spark, folder), path)
    log = read_recordings(spark, path)
    numbered = number_by_arrival(log, "arrival", SMALL_BUCKET, store_counts=True)
    return numbered.select("arrival", "stream_name", "ms", "seq")


def recording_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Long texts in many scripts, as one recording file read in many cuts."""
    path = new_table(spark, "recordings")
    docs = adapters.table(spark, folder, "documents").select(
        F.concat(F.lit("documents:"), F.col("source")).alias("stream_name"),
        F.col("doc_id").alias("ms"),
        F.lit(0).cast("bigint").alias("seq"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text")).alias("fields"),
        F.lit("documents").alias("recording"),
        F.col("doc_id").alias("pos"),
    )
    write_recordings(docs, path)
    back = read_recordings(spark, path, split_bytes=SMALL_CUT)
    text = F.try_element_at("fields", F.lit("text"))
    return back.select(
        "stream_name", F.col("ms").alias("doc_id"), _field("lang", "string"), F.md5(text).alias("text_md5")
    )


def recording_range(spark: SparkSession, folder: str) -> DataFrame:
    """A week of some streams, from the blocks of a recording that may hold it."""
    path = new_table(spark, "recordings")
    write_recordings(adapters.events_log(spark, folder), path)
    found = read_recordings(
        spark, path, from_id=WEEK_START, to_id=WEEK_END, streams=EVENT_STREAMS
    )
    return _with_event_fields(found).drop("pos")


def recording_source(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the data source, by filters that Spark pushes into it."""
    path = new_table(spark, "recordings")
    write_recordings(adapters.events_log(spark, folder), path)
    session = spark.newSession()
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    log = recording_table(session, path)
    found = select.include_streams(select.truncate(log, WEEK_START, WEEK_END), EVENT_STREAMS)
    return _with_event_fields(found).drop("pos")


def recording_large_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of many texts each, most of them larger than the cuts they are read in."""
    path = new_table(spark, "recordings")
    docs = adapters.table(spark, folder, "documents")
    block = div(F.col("doc_id"), LARGE_RECORD_TEXTS)
    entry = F.struct(F.col("doc_id").cast("string"), "text")
    log = docs.groupBy("source", block.alias("ms")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("fields")
    )
    messages = log.select(
        F.concat(F.lit("documents:"), F.col("source")).alias("stream_name"),
        "ms",
        F.lit(0).cast("bigint").alias("seq"),
        "fields",
        F.lit("documents").alias("recording"),
        F.xxhash64("source", "ms").alias("pos"),
    )
    write_recordings(messages, path)
    back = read_recordings(spark, path, split_bytes=SMALL_CUT)
    return back.select("stream_name", F.explode("fields").alias("doc_id", "text")).select(
        "stream_name", F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5")
    )


def stream_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings that come while a stream follows them, which is restarted between."""
    path, inbox = new_table(spark, "captured"), new_table(spark, "recordings")
    log = adapters.events_log(spark, folder)
    for part in range(2):
        write_recordings(log.where(F.col("pos") % 2 == part), inbox)
        followed = follow_recordings(spark, inbox, f"{path}-plans", FOLLOWED_AT_ONCE)
        query = capture.start_capture(followed, path, f"{path}-offsets", once=False)
        query.processAllAvailable()
        query.stop()
    return _with_event_fields(spark.read.parquet(path)).drop("pos")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in [
        truncate_range,
        truncate_from,
        truncate_to,
        truncate_auto_start,
        auto_start_id,
        truncate_time,
        truncate_counts,
        stream_stats,
        log_totals,
        volume_totals,
        timeline_streams,
        timeline_global,
        estimate_window,
        field_keys,
        last_ids,
        batch_summary,
        parse_message_id,
        drop_malformed,
        format_message_id,
        stringify_fields,
        drop_undecodable,
        include_streams,
        exclude_streams,
        dropped_streams,
        rename_streams,
        read_after,
        flatten_fields,
        flatten_typed,
        csv_roundtrip,
        recording_roundtrip,
        append_union,
        rotate_by_time,
        rotate_at,
        replay_order,
        replay_delay,
        replay_due,
        flush_groups,
        replay_reissue,
        replay_batches,
        bounded_capture,
        fmt_hms,
        fmt_utc,
        fmt_utc_dmy,
        parse_hms,
        parse_utc,
        parse_utc_inferred,
        stream_capture,
        stream_resume,
        stream_stats_live,
        capture_restart,
        capture_rotated,
        capture_status,
        capture_quarantine,
        capture_limits,
        log_bytes,
        capture_rotated_at,
        bounded_duration,
        replay_order_many,
        replay_order_big_batch,
        replay_delay_many,
        replay_due_many,
        flush_groups_many,
        batch_summary_many,
        format_message_id_many,
        read_after_many,
        include_streams_many,
        exclude_streams_many,
        rename_streams_many,
        truncate_observed,
        recording_order,
        recording_cuts,
        recording_range,
        recording_source,
        recording_large_records,
        stream_recordings,
    ]
}

# Queries whose tasks run Python code of this package.
PYTHON_WORKERS = {name for name in QUERIES if "recording" in name} | {"log_bytes"}
