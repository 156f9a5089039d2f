"""The message-log table and the argument checks shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_LOG = T.StructType(
    [
        T.StructField("stream_name", T.StringType(), False),
        T.StructField("ms", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("recording", T.StringType(), False),
        T.StructField("pos", T.LongType(), False),
    ]
)

# The names of the columns an export adds before the fields,
# and the export formats.
EXPORT_COLUMNS = ["stream_name", "message_id", "timestamp_ms"]
EXPORT_FORMATS = ["csv", "parquet"]


def message_log(
    df: DataFrame,
    stream_name: Column | str = "stream_name",
    ms: Column | str = "ms",
    seq: Column | str = "seq",
    fields: Column | str = "fields",
    recording: Column | str = "recording",
    pos: Column | str = "pos",
) -> DataFrame:
    """Project any DataFrame onto the message-log columns.

    A missing recording name becomes ``''`` so that it can be a join key.
    """

    def as_column(value: Column | str) -> Column:
        return F.col(value) if isinstance(value, str) else value

    return df.select(
        as_column(stream_name).cast("string").alias("stream_name"),
        as_column(ms).cast("bigint").alias("ms"),
        as_column(seq).cast("bigint").alias("seq"),
        as_column(fields).alias("fields"),
        F.coalesce(as_column(recording).cast("string"), F.lit("")).alias("recording"),
        as_column(pos).cast("bigint").alias("pos"),
    )


def require_positive(**values: float | int | None) -> None:
    """Raise ``ValueError`` for any given value that is not above zero."""
    for name, value in values.items():
        if value is not None and not value > 0:
            raise ValueError(f"{name} must be greater than 0, got {value!r}")


def require_format(fmt: str) -> str:
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"format must be one of {EXPORT_FORMATS}, got {fmt!r}")
    return fmt


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def stream_keys(streams: Iterable[str | dict]) -> list[str]:
    """Stream names from plain strings or ``{"key": name}`` entries, in order."""
    names = []
    for item in streams:
        if isinstance(item, str):
            name = item
        elif isinstance(item, dict) and isinstance(item.get("key"), str):
            name = item["key"]
        else:
            raise TypeError(f"cannot read a stream name from {item!r}")
        if name not in names:
            names.append(name)
    return names
