"""One column per field name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.ids import format_id
from tidelog.schema import EXPORT_COLUMNS

MAX_KEYS = 10_000


def discover_keys(log: DataFrame, max_keys: int = MAX_KEYS) -> list[str]:
    """The field names of the log; runs a job, and refuses an unbounded schema."""
    return keys_or_none(log, max_keys) or []


def keys_or_none(log: DataFrame, max_keys: int = MAX_KEYS) -> list[str] | None:
    """The field names, or None for a log without messages; one pass tells both."""
    names = log.select(F.explode_outer(F.map_keys("fields")).alias("field_key"))
    found = [row.field_key for row in names.distinct().limit(max_keys + 2).collect()]
    keys = sorted(key for key in found if key is not None)
    if len(keys) > max_keys:
        raise ValueError(
            f"more than {max_keys} field names; pass the keys you need or raise max_keys"
        )
    return keys if found else None


def flatten_fields(
    log: DataFrame,
    keys: Sequence[str] | None = None,
    prefix_reserved: bool = False,
    max_keys: int = MAX_KEYS,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """``stream_name, message_id, timestamp_ms`` and one column per field.

    Without ``keys`` the field names are discovered first, ``max_keys`` at most.
    ``types`` gives fields a type other than text; a value that is not of it
    becomes NULL.  A field named like
    one of the base columns is refused, or prefixed with ``field_`` on request.
    """
    keys = sorted(discover_keys(log, max_keys) if keys is None else set(keys))
    names = [_column_name(key, prefix_reserved) for key in keys]
    _refuse_case_twins([*EXPORT_COLUMNS, *names])
    types = types or {}

    def value(key: str) -> Column:
        text = F.try_element_at("fields", F.lit(key))
        return text.try_cast(types[key]) if key in types else text

    return log.select(
        "stream_name",
        format_id(F.col("ms"), F.col("seq")).alias("message_id"),
        F.col("ms").alias("timestamp_ms"),
        *[
            value(key).alias(name)
            for key, name in zip(keys, names, strict=True)
        ],
    )


# Types of values that become types of columns; others become text.
KEPT_TYPES = ("BIGINT", "DOUBLE", "BOOLEAN", "DECIMAL")


def field_types(log: DataFrame) -> DataFrame:
    """``field_key`` and ``type``: the least type that holds all values of a field.

    ``fields`` maps names to VARIANT values.  Whole numbers and others make
    DOUBLE; kinds without a common type make STRING, as do objects, arrays and
    fields that are always NULL.  One aggregate over the log, with partial
    results per task; the result is sorted.
    """
    values = log.select(F.explode("fields").alias("field_key", "value"))
    merged = values.groupBy("field_key").agg(F.schema_of_variant_agg("value").alias("type"))
    kept = F.regexp_extract("type", r"^[A-Z]+", 0).isin(*KEPT_TYPES)
    return merged.select(
        "field_key", F.when(kept, F.col("type")).otherwise("STRING").alias("type")
    ).orderBy("field_key")


def flatten_typed(
    log: DataFrame, prefix_reserved: bool = False, max_keys: int = MAX_KEYS
) -> DataFrame:
    """:func:`flatten_fields` of VARIANT values, each column of the type its values have.

    Finding names and types runs one job, which refuses more than ``max_keys``
    fields.  A value in a column of text is written as JSON unless it is text.
    """
    found = field_types(log).limit(max_keys + 1).collect()
    if len(found) > max_keys:
        raise ValueError(f"more than {max_keys} field names; drop some or raise max_keys")
    names = [_column_name(row.field_key, prefix_reserved) for row in found]
    _refuse_case_twins([*EXPORT_COLUMNS, *names])
    columns = [
        F.try_variant_get(F.try_element_at("fields", F.lit(row.field_key)), "$", row.type).alias(name)
        for row, name in zip(found, names, strict=True)
    ]
    return log.select(
        "stream_name",
        format_id(F.col("ms"), F.col("seq")).alias("message_id"),
        F.col("ms").alias("timestamp_ms"),
        *columns,
    )


def _column_name(key: str, prefix_reserved: bool) -> str:
    if key.lower() not in EXPORT_COLUMNS:
        return key
    if not prefix_reserved:
        raise ValueError(f"field {key!r} has the name of a base column")
    return f"field_{key}"


def _refuse_case_twins(names: Sequence[str]) -> None:
    seen: dict[str, str] = {}
    for name in names:
        twin = seen.setdefault(name.lower(), name)
        if twin is not name:
            raise ValueError(f"columns {twin!r} and {name!r} differ only by case")
