"""Durations and UTC times as text, with no use of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.binding import let

# The text forms accepted and produced here.
DAY_MS = 86_400_000
CLOCK_PATTERN = r"^[0-9]+(:[0-9]+){0,2}\z"
FRACTION_PATTERN = r"^[0-9]{3}\z"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
BLANKS = " \t\n\r\x0b\x0c"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _two(value: Column) -> Column:
    return F.format_string("%02d", value)


def _millis(ms: Column) -> Column:
    return F.format_string("%03d", F.pmod(ms, F.lit(1000)))


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since the epoch of a TIMESTAMP_NTZ, rounded down."""
    since = (ts - F.expr(EPOCH)).cast("interval second")
    return F.floor(since.cast("decimal(20,6)") * 1000).cast("bigint")


def format_duration(ms: Column) -> Column:
    """``HH:MM:SS.mmm``; negative durations show as zero, hours may exceed 99."""
    ms = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    seconds = _div(ms, 1000)
    return F.concat(
        _two(_div(seconds, 3600)),
        F.lit(":"),
        _two(_div(seconds, 60) % 60),
        F.lit(":"),
        _two(seconds % 60),
        F.lit("."),
        _millis(ms),
    )


def _utc_text(ms: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` of whole seconds."""
    seconds = (_div(ms - F.pmod(ms, F.lit(1000)), 1000)).cast("decimal(18,6)")
    zero = F.lit(0)
    moment = F.expr(EPOCH) + F.make_dt_interval(zero, zero, zero, seconds)
    return moment.cast("string")


def format_utc(ms: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS.mmm`` in UTC."""
    ms = ms.cast("bigint")
    return F.concat(_utc_text(ms), F.lit("."), _millis(ms))


def format_utc_day_first(ms: Column) -> Column:
    """``DD-MM-YYYY HH:MM:SS`` in UTC."""
    text = _utc_text(ms.cast("bigint"))
    return F.concat(
        F.substring(text, 9, 2),
        F.lit("-"),
        F.substring(text, 6, 2),
        F.lit("-"),
        F.substring(text, 1, 4),
        F.substring(text, 11, 9),
    )


def parse_duration(text: Column) -> Column:
    """``HH:MM:SS[.f]``, ``MM:SS[.f]`` or ``SS[.f]`` to milliseconds, else NULL."""

    def split_fraction(text: Column) -> Column:
        # Without a dot, the part after the last dot is the whole text.
        tail = F.substring_index(text, ".", -1)
        dot = F.length(text) - F.length(tail)
        whole = F.when(dot > 0, F.substring(text, F.lit(1), dot - 1)).otherwise(text)
        fraction = F.when(dot > 0, tail).otherwise(F.lit(""))
        return F.struct(
            whole.alias("whole"), F.rpad(fraction, 3, "0").alias("fraction")
        )

    def total(clock: Column) -> Column:
        whole, fraction = clock["whole"], clock["fraction"]
        value = let(F.split(whole, ":"), lambda parts: _clock_ms(parts, fraction))
        valid = whole.rlike(CLOCK_PATTERN) & fraction.rlike(FRACTION_PATTERN)
        return F.when(valid, value)

    return let(F.btrim(text, F.lit(BLANKS)), lambda t: let(split_fraction(t), total))


def _clock_ms(parts: Column, fraction: Column) -> Column:
    def part(back: int, unit_ms: int) -> Column:
        number = F.try_element_at(parts, F.lit(-back)).try_cast("bigint")
        value = F.try_multiply(number, F.lit(unit_ms).cast("bigint"))
        return F.when(F.size(parts) >= back, value).otherwise(F.lit(0))

    return F.try_add(
        F.try_add(part(3, 3_600_000), part(2, 60_000)),
        F.try_add(part(1, 1000), fraction.try_cast("bigint")),
    )


def parse_utc(text: Column, first_ms: Column, last_ms: Column) -> Column:
    """UTC text to epoch milliseconds, else NULL.

    A text without a date takes its day from the log: the first day of
    ``[first_ms, last_ms]``, the day after or the day before, whichever first
    puts the time inside that range; failing all three, the first day.
    """

    def parse(text: Column) -> Column:
        dated = (
            (F.length(text) >= 10)
            & (F.substring(text, 5, 1) == "-")
            & (F.substring(text, 8, 1) == "-")
        )
        midnight = first_ms - F.pmod(first_ms, F.lit(DAY_MS))
        undated = let(
            F.try_add(midnight, parse_duration(text)),
            lambda same_day: _nearest_day(same_day, first_ms, last_ms),
        )
        return F.when(dated, _parse_dated(text)).otherwise(undated)

    return let(F.btrim(text, F.lit(BLANKS)), parse)


def _parse_dated(text: Column) -> Column:
    date_text = F.substring(text, 1, 10)
    clock = F.when(F.length(text) == 10, F.lit("00:00:00")).otherwise(
        F.substring(text, 12, 2**31 - 1)
    )
    day = F.when(
        date_text.rlike(DATE_PATTERN) & (date_text >= "0001"),
        F.try_to_date(date_text, "yyyy-MM-dd"),
    )
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")
    return F.try_add(days * DAY_MS, parse_duration(clock))


def _nearest_day(same_day: Column, first_ms: Column, last_ms: Column) -> Column:
    day = F.lit(DAY_MS).cast("bigint")

    def inside(candidate: Column) -> Column:
        return F.when((candidate >= first_ms) & (candidate <= last_ms), candidate)

    return F.coalesce(
        inside(same_day),
        inside(F.try_add(same_day, day)),
        inside(F.try_subtract(same_day, day)),
        same_day,
    )


def clamp(ms: int, low: int, high: int) -> int:
    return max(low, min(ms, high))
