"""The free-form ``fields`` map: text values, UTF-8 checks, encoded size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stringify(fields: Column) -> Column:
    """Every key and value of a map as text."""
    as_text = F.transform_values(fields, lambda _, value: value.cast("string"))
    return F.transform_keys(as_text, lambda key, _: key.cast("string"))


def is_text(raw: Column) -> Column:
    """True when BINARY (or STRING) content is valid UTF-8."""
    return F.is_valid_utf8(raw.cast("string"))


def is_text_map(fields: Column) -> Column:
    """True when every key and every value of a map is valid UTF-8."""
    return F.forall(F.map_keys(fields), is_text) & F.forall(
        F.map_values(fields), lambda value: value.isNull() | is_text(value)
    )


def _text_size(text: Column) -> Column:
    size = F.octet_length(text)
    # Header bytes of a string in the recording format by length;
    # a missing value is one byte.
    header = (
        F.when(size < 32, 1)
        .when(size < 256, 2)
        .when(size < 65536, 3)
        .otherwise(F.when(size.isNull(), 1).otherwise(5))
    )
    return (header + F.coalesce(size, F.lit(0))).cast("bigint")


def recorded_bytes(stream_name: Column, message_id: Column, fields: Column) -> Column:
    """Bytes one message takes in a recording file."""
    entries = F.coalesce(F.size(fields), F.lit(0))
    # Header bytes of a map in the recording format by entries
    # (a missing map is one byte).
    header = F.when(entries < 16, 2).when(entries < 65536, 4).otherwise(6)
    payload = F.aggregate(
        F.map_entries(fields),
        F.lit(0).cast("bigint"),
        lambda total, entry: total + _text_size(entry.key) + _text_size(entry.value),
    )
    return (
        header
        + _text_size(stream_name)
        + _text_size(message_id)
        + F.coalesce(payload, F.lit(0))
    )
