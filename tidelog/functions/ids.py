"""Message IDs ``<ms>-<seq>`` as columns and as driver-side bounds."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text form of a message ID and the largest value of a part.
ID_TEXT = r"([0-9]+)(?:-([0-9]+))?"
MAX_PART = 2**63 - 1

_WHOLE_ID = rf"^{ID_TEXT}\z"


class MessageID(NamedTuple):
    """A bound given by the caller; orders by ``(ms, seq)``."""

    ms: int
    seq: int = 0

    def __str__(self) -> str:
        return f"{self.ms}-{self.seq}"


def bound(value: MessageID | str | bytes | None) -> MessageID | None:
    """Read a caller's bound; parts beyond BIGINT are clamped to its maximum."""
    if value is None or isinstance(value, MessageID):
        return value
    text = value.decode() if isinstance(value, bytes) else value
    found = re.fullmatch(ID_TEXT, text)
    if found is None:
        raise ValueError(f"invalid message ID: {text!r}")
    ms, seq = int(found.group(1)), int(found.group(2) or 0)
    return MessageID(ms, seq) if max(ms, seq) <= MAX_PART else _clamped(ms, seq)


def _clamped(ms: int, seq: int) -> MessageID:
    return MessageID(MAX_PART, MAX_PART) if ms > MAX_PART else MessageID(ms, MAX_PART)


def id_ms(raw: Column) -> Column:
    """Milliseconds of a text ID; NULL when the ID is invalid."""
    return F.when(_valid(raw), _part(raw, 1))


def id_seq(raw: Column) -> Column:
    """Sequence number of a text ID, 0 when absent; NULL when the ID is invalid."""
    written = F.regexp_extract(raw.cast("string"), _WHOLE_ID, 2)
    return F.when(_valid(raw), F.when(written == "", F.lit(0)).otherwise(_part(raw, 2)))


def is_valid_id(raw: Column) -> Column:
    """True when both parts parse and fit into BIGINT."""
    return id_ms(raw).isNotNull() & id_seq(raw).isNotNull()


def _valid(raw: Column) -> Column:
    return raw.cast("string").rlike(_WHOLE_ID)


def _part(raw: Column, group: int) -> Column:
    return F.regexp_extract(raw.cast("string"), _WHOLE_ID, group).try_cast("bigint")


def format_id(ms: Column, seq: Column) -> Column:
    return F.concat_ws("-", ms.cast("string"), seq.cast("string"))


def at_or_after(low: MessageID) -> Column:
    """``(ms, seq) >= low`` in the form that reaches the Parquet scan."""
    ms, seq = F.col("ms"), F.col("seq")
    return (ms >= low.ms) & ((ms > low.ms) | (seq >= low.seq))


def at_or_before(high: MessageID) -> Column:
    """``(ms, seq) <= high`` in the form that reaches the Parquet scan."""
    ms, seq = F.col("ms"), F.col("seq")
    return (ms <= high.ms) & ((ms < high.ms) | (seq <= high.seq))


def check_bounds(
    from_id: MessageID | str | bytes | None, to_id: MessageID | str | bytes | None
) -> tuple[MessageID | None, MessageID | None]:
    low, high = bound(from_id), bound(to_id)
    if low is not None and high is not None and low > high:
        raise ValueError(f"empty range: it would begin at {low} and end at {high}")
    return low, high


def in_range(low: MessageID | None, high: MessageID | None) -> Column:
    """``low <= (ms, seq) <= high`` with either end open when ``None``."""
    condition = F.lit(True)
    if low is not None:
        condition = condition & at_or_after(low)
    if high is not None:
        condition = condition & at_or_before(high)
    return condition


def strictly_after(ms: Column, seq: Column) -> Column:
    """``(ms, seq)`` of the row comes after the given ID columns."""
    return (F.col("ms") >= ms) & ((F.col("ms") > ms) | (F.col("seq") > seq))
