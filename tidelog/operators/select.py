"""Choosing messages: by ID, by time, by stream, by position in a stream."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidelog.functions.clock import clamp
from tidelog.functions.ids import (
    MAX_PART,
    MessageID,
    bound,
    check_bounds,
    id_ms,
    id_seq,
    in_range,
    is_valid_id,
    strictly_after,
)
from tidelog.functions.payload import is_text, is_text_map, stringify
from tidelog.operators.stats import auto_start_id, timeline_global, timeline_streams
from tidelog.plans.scan import BUCKET_ROWS, broadcast_if_small, div
from tidelog.plans.storage import stored
from tidelog.schema import require_positive, stream_keys

# Name lists up to this length become literals, which reach the scan; longer
# ones are sent to all tasks as a table.  The rows are the same.
MAX_LITERALS = 200
# Width of the time buckets whose counts tell how far a stream is read.
READ_BUCKET_MS = 60_000
# Parts of a bucket that is too large to be ordered.
PARTS = 1024


# ---- by ID and time ---------------------------------------------------------


def truncate(
    log: DataFrame,
    from_id: MessageID | str | bytes | None = None,
    to_id: MessageID | str | bytes | None = None,
    auto_start: bool = False,
) -> DataFrame:
    """Messages with ``from_id <= ID <= to_id``; either bound may be absent.

    ``auto_start`` takes as lower bound the latest of the streams' first IDs,
    so that every stream has started; an explicit ``from_id`` overrides it.
    Finding that one ID runs a job.
    """
    low = bound(from_id)
    if auto_start and low is None:
        low = _computed_start(log)
    return log.where(in_range(*check_bounds(low, to_id)))


def _computed_start(log: DataFrame) -> MessageID | None:
    """The auto-start ID, fetched so that it can reach the scan as a literal."""
    start = auto_start_id(log).first()
    return None if start.ms is None else MessageID(start.ms, start.seq)


def truncate_observed(
    log: DataFrame,
    from_id: MessageID | str | bytes | None = None,
    to_id: MessageID | str | bytes | None = None,
) -> tuple[DataFrame, Observation]:
    """:func:`truncate`, with ``written`` and ``skipped`` counted by the same pass.

    The counts are there once an action has run on the returned rows.
    """
    inside = in_range(*check_bounds(from_id, to_id))
    counts = Observation()
    seen = log.observe(
        counts,
        F.count_if(inside).alias("written"),
        F.count_if(~inside).alias("skipped"),
    )
    return seen.where(inside), counts


def truncate_by_time(
    log: DataFrame, left_ms: int, right_ms: int, end: str = "parity"
) -> DataFrame:
    """Messages between two times, each first clamped to the log's timeline.

    ``end='parity'`` closes the range at ``right_ms-0``, which cuts later
    messages of that millisecond; ``end='whole_ms'`` keeps them.  Finding the
    timeline runs a job.
    """
    if end not in ("parity", "whole_ms"):
        raise ValueError(f"end must be 'parity' or 'whole_ms', got {end!r}")
    span = timeline_global(timeline_streams(log)).first()
    left = clamp(left_ms, span.first_ms, span.last_ms)
    right = clamp(right_ms, span.first_ms, span.last_ms)
    last_seq = 0 if end == "parity" else MAX_PART
    return log.where(in_range(MessageID(left), MessageID(right, last_seq)))


# ---- by stream --------------------------------------------------------------


def _listed(log: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join with a list the caller holds in memory, so it can be sent to all tasks."""
    listed = log.sparkSession.createDataFrame([(n,) for n in names], "stream_name string")
    return log.join(F.broadcast(listed), "stream_name", how).select(*log.columns)


def include_streams(log: DataFrame, streams: Iterable[str | dict]) -> DataFrame:
    """Messages of the listed streams; a message without a stream name is in no list."""
    names = stream_keys(streams)
    if len(names) > MAX_LITERALS:
        return _listed(log, names, "left_semi")
    return log.where(F.col("stream_name").isin(names))


def exclude_streams(log: DataFrame, streams: Iterable[str | dict]) -> DataFrame:
    """Messages of all other streams, and those without a stream name."""
    names = stream_keys(streams)
    if not names:
        return log
    if len(names) > MAX_LITERALS:
        return _listed(log, names, "left_anti")
    return log.where(~F.coalesce(F.col("stream_name").isin(names), F.lit(False)))


def dropped_streams(log: DataFrame, streams: Iterable[str | dict]) -> DataFrame:
    """The streams an allow-list leaves out, each once, with its message count."""
    return (
        exclude_streams(log, streams)
        .groupBy("stream_name")
        .agg(F.count("*").alias("dropped"))
    )


def rename_streams(log: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """New stream names; unlisted streams keep theirs, merged ones share one."""
    if not names:
        return log
    if len(names) > MAX_LITERALS:
        mapping = log.sparkSession.createDataFrame(
            list(names.items()), "stream_name string, _renamed string"
        )
        joined = log.join(F.broadcast(mapping), "stream_name", "left")
        renamed = joined.withColumn(
            "stream_name", F.coalesce(F.col("_renamed"), F.col("stream_name"))
        )
        return renamed.select(*log.columns)
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(lookup, F.col("stream_name"))
    return log.withColumn("stream_name", F.coalesce(found, F.col("stream_name")))


# ---- by position in a stream ------------------------------------------------


def newer_than(
    messages: DataFrame,
    last_ids: DataFrame | Mapping[str, MessageID | str],
    missing: str = "earliest",
) -> DataFrame:
    """Messages after their stream's last ID.

    A stream without a last ID has no history that was read, so all of it is
    new; ``missing='skip'`` leaves such streams out.  ``last_ids`` is a mapping
    or a DataFrame ``(stream_name, ms, seq)`` with one row per stream.
    """
    if missing not in ("earliest", "skip"):
        raise ValueError(f"missing must be 'earliest' or 'skip', got {missing!r}")
    if not isinstance(last_ids, DataFrame):
        parsed = [(name, *bound(value)) for name, value in last_ids.items()]
        last_ids = messages.sparkSession.createDataFrame(
            parsed, "stream_name string, ms bigint, seq bigint"
        )
    seen = broadcast_if_small(
        last_ids.select(
            "stream_name", F.col("ms").alias("_ms"), F.col("seq").alias("_seq")
        )
    )
    new = strictly_after(F.col("_ms"), F.col("_seq"))
    if missing == "earliest":
        new = F.col("_ms").isNull() | new
    how = "left" if missing == "earliest" else "inner"
    return messages.join(seen, "stream_name", how).where(new).select(*messages.columns)


def read_after(
    log: DataFrame,
    last_ids: DataFrame | Mapping[str, MessageID | str],
    count: int,
    missing: str = "earliest",
    bucket_ms: int = READ_BUCKET_MS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Per stream, the first ``count`` messages after that stream's last ID.

    ``last_ids`` and ``missing`` are those of :func:`newer_than`; messages
    without a stream name belong to no stream.  Where a stream is cut is found
    by counting: first per ``bucket_ms`` of message time, then, as long as the
    bucket with the last message holds more than ``bucket_rows``, in 1024 parts
    of that bucket alone, by ``(ms, seq, recording, pos)``.  Only the rows of
    the last bucket are shuffled and ordered.  Finding the cuts runs jobs.
    """
    require_positive(count=count, bucket_ms=bucket_ms, bucket_rows=bucket_rows)
    new = newer_than(log, last_ids, missing).where("stream_name is not null")
    cuts = _cuts(new, count, bucket_ms, bucket_rows)
    cut = broadcast_if_small(cuts)
    joined = new.join(cut, "stream_name", "left")
    sure = joined.where(F.col("_rows").isNull() | _before_cut()).select(*log.columns)
    by_id = Window.partitionBy("stream_name").orderBy("ms", "seq", "recording", "pos")
    last = (
        new.join(cut, "stream_name")
        .where(_in_cut())
        .withColumn("_rank", F.row_number().over(by_id))
        .where(F.col("_before") + F.col("_rank") <= count)
        .select(*log.columns)
    )
    return sure.unionByName(last)


_BOUNDED = ("ms", "seq", "pos")


def _bounds() -> list[Column]:
    """Aggregates of a bucket: its rows, and what its rows' keys lie between."""
    made = [F.count("*").alias("_rows")]
    for key in _BOUNDED:
        made += [F.min(key).alias(f"_{key}_low"), F.max(key).alias(f"_{key}_high")]
    return made


def _in_cut() -> Column:
    """Rows of the bucket that holds a stream's last message."""
    inside = F.col("_recording").isNull() | (F.col("recording") == F.col("_recording"))
    for key in _BOUNDED:
        inside = inside & F.col(key).between(F.col(f"_{key}_low"), F.col(f"_{key}_high"))
    return inside


def _single(key: str) -> Column:
    return F.col(f"_{key}_low") == F.col(f"_{key}_high")


def _before_cut() -> Column:
    """Rows before that bucket, in the order of ``(ms, seq, recording, pos)``."""
    chosen = F.col("_recording").isNotNull()
    by_pos = (F.col("recording") == F.col("_recording")) & (F.col("pos") < F.col("_pos_low"))
    by_recording = chosen & ((F.col("recording") < F.col("_recording")) | by_pos)
    same_seq = _single("seq") & (F.col("seq") == F.col("_seq_low")) & by_recording
    same_ms = _single("ms") & (F.col("ms") == F.col("_ms_low"))
    return (F.col("ms") < F.col("_ms_low")) | (
        same_ms & ((F.col("seq") < F.col("_seq_low")) | same_seq)
    )


def _holding(counts: DataFrame, order: list[str], count: int) -> DataFrame:
    """Of the buckets of each stream, the one that its last message falls into.

    ``_before`` counts what lies before the buckets; streams with less than
    ``count`` messages have none.
    """
    earlier = Window.partitionBy("stream_name").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    return counts.withColumn("_before", before).where(
        (F.col("_before") < count) & (F.col("_before") + F.col("_rows") >= count)
    )


def _cuts(new: DataFrame, count: int, bucket_ms: int, bucket_rows: int) -> DataFrame:
    """Per stream that is cut, the bucket of at most ``bucket_rows`` to be ordered."""
    columns = ["stream_name", "_before", "_rows", "_recording"]
    columns += [f"_{key}_{end}" for key in _BOUNDED for end in ("low", "high")]
    counts = new.groupBy("stream_name", div(F.col("ms"), bucket_ms).alias("_bucket")).agg(*_bounds())
    first = counts.withColumn("_before", F.lit(0).cast("bigint")).withColumn(
        "_recording", F.lit(None).cast("string")
    )
    state = stored(_holding(first, ["_bucket"], count).select(*columns), "cuts")
    done = []
    while True:
        large = state.where(F.col("_rows") > bucket_rows)
        if large.isEmpty():
            return _all_of([*done, state])
        done.append(state.where(F.col("_rows") <= bucket_rows))
        state = stored(_holding(_refined(new, large), ["_part", "_name"], count).select(*columns), "cuts")


def _all_of(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.unionByName(more)
    return whole


def _refined(new: DataFrame, large: DataFrame) -> DataFrame:
    """Counts of the parts of buckets that are too large.

    A bucket is parted by the first key in which its rows differ; of a
    recording's name every value is a part.
    """

    def part(key: str) -> Column:
        low, high = F.col(f"_{key}_low"), F.col(f"_{key}_high")
        width = F.call_function("div", high - low, F.lit(PARTS)) + 1
        return F.call_function("div", F.col(key) - low, width)

    open_name = F.col("_recording").isNull()
    numbered = (
        F.when(~_single("ms"), part("ms"))
        .when(~_single("seq"), part("seq"))
        .when(~open_name, part("pos"))
        .otherwise(F.lit(0).cast("bigint"))
    )
    by_name = _single("ms") & _single("seq") & open_name
    name = F.when(by_name, F.col("recording")).otherwise(F.col("_recording"))
    return (
        new.join(broadcast_if_small(large), "stream_name")
        .where(_in_cut())
        .groupBy("stream_name", numbered.alias("_part"), name.alias("_name"), "_before")
        .agg(*_bounds())
        .withColumn("_recording", F.col("_name"))
    )


# ---- malformed and foreign input --------------------------------------------


def parse_ids(df: DataFrame, raw: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """Turn a text ID column into ``ms`` and ``seq``.

    ``DROPMALFORMED`` drops rows with an invalid ID, ``PERMISSIVE`` keeps them
    with NULL parts and the text in ``_corrupt_record``, ``FAILFAST`` raises.
    """
    mode = mode.upper()
    text = F.col(raw)
    parsed = df.withColumn("ms", id_ms(text)).withColumn("seq", id_seq(text))
    if mode == "DROPMALFORMED":
        return parsed.where(is_valid_id(text))
    if mode == "PERMISSIVE":
        return parsed.withColumn(
            "_corrupt_record", F.when(~F.coalesce(is_valid_id(text), F.lit(False)), text)
        )
    if mode == "FAILFAST":
        message = F.concat(F.lit("invalid message ID: "), F.coalesce(text, F.lit("NULL")))
        return parsed.withColumn(
            "ms",
            F.when(is_valid_id(text), F.col("ms")).otherwise(
                F.raise_error(message).cast("bigint")
            ),
        )
    raise ValueError(f"unknown mode {mode!r}")


def drop_undecodable(
    df: DataFrame, name: str = "stream_name", raw_id: str = "id", fields: str = "fields"
) -> DataFrame:
    """Keep messages whose name, ID and every field are UTF-8, as text columns."""
    good = df.where(is_text(F.col(name)) & is_text(F.col(raw_id)) & is_text_map(F.col(fields)))
    return (
        good.withColumn(name, F.col(name).cast("string"))
        .withColumn(raw_id, F.col(raw_id).cast("string"))
        .withColumn(fields, stringify(F.col(fields)))
    )


# Why a raw message is set aside, in the order in which a recorder would find out.
NO_NAME, UNLISTED, NO_ID_TEXT, NO_FIELDS, NO_ID = (
    "stream name",
    "unlisted stream",
    "message ID text",
    "fields",
    "message ID",
)
KEPT, SET_ASIDE = "kept", "set_aside"


def judged(
    raw: DataFrame,
    streams: Iterable[str | dict] | None = None,
    name: str = "stream_name",
    raw_id: str = "id",
    fields: str = "fields",
) -> DataFrame:
    """All raw messages, decoded, with a ``status`` and the ``reason`` of those set aside.

    ``kept`` messages have the columns of a message log.  Of the others
    ``stream_name``, ``ms``, ``seq`` and ``fields`` are NULL and ``raw`` holds
    what came.  Other columns stay as they are.  A NULL map is kept.
    """

    def fails(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    text = F.col(name).cast("string")
    reason = F.when(fails(is_text(F.col(name))), NO_NAME)
    if streams is not None:
        reason = reason.when(fails(text.isin(stream_keys(streams))), UNLISTED)
    reason = (
        reason.when(fails(is_text(F.col(raw_id))), NO_ID_TEXT)
        .when(fails(F.col(fields).isNull() | is_text_map(F.col(fields))), NO_FIELDS)
        .when(fails(is_valid_id(F.col(raw_id))), NO_ID)
    )
    others = [c for c in raw.columns if c not in (name, raw_id, fields)]
    kept = F.col("reason").isNull()
    found = raw.withColumn("reason", reason)
    values = {
        "stream_name": text,
        "ms": id_ms(F.col(raw_id)),
        "seq": id_seq(F.col(raw_id)),
        "fields": stringify(F.col(fields)),
    }
    return found.select(
        *[F.when(kept, value).alias(column) for column, value in values.items()],
        *others,
        F.when(~kept, F.struct(name, raw_id, fields)).alias("raw"),
        "reason",
        F.when(kept, KEPT).otherwise(SET_ASIDE).alias("status"),
    )


def stringify_fields(log: DataFrame) -> DataFrame:
    return log.withColumn("fields", stringify(F.col("fields")))
