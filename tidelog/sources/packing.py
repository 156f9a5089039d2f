"""The recording format: back-to-back packed arrays ``[stream, "ms-seq", {fields}]``.

A small codec for the part of the public MessagePack format that recordings
use.  It works on one buffer and knows nothing about files or Spark.
"""

from __future__ import annotations

import functools
import json
import math
import re
import struct
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

from tidelog.functions.ids import ID_TEXT, MAX_PART

# Type bytes of the format, as struct codes and size widths.
NUMBERS = {
    0xCA: ">f",
    0xCB: ">d",
    0xCC: ">B",
    0xCD: ">H",
    0xCE: ">I",
    0xCF: ">Q",
    0xD0: ">b",
    0xD1: ">h",
    0xD2: ">i",
    0xD3: ">q",
}
CONSTANTS = {0xC0: None, 0xC2: False, 0xC3: True}
BINARY = {0xC4: 1, 0xC5: 2, 0xC6: 4}
TEXT = {0xD9: 1, 0xDA: 2, 0xDB: 4}
ARRAY = {0xDC: 2, 0xDD: 4}
MAP = {0xDE: 2, 0xDF: 4}
EXTENSION = {0xC7: 1, 0xC8: 2, 0xC9: 4}
FIXED_EXTENSION = {0xD4: 1, 0xD5: 2, 0xD6: 4, 0xD7: 8, 0xD8: 16}
RECORD_START = b"\x93"
NIL = b"\xc0"
# Bytes that tell the kind and size of a value.
HEAD_BYTES = 5

READ_BYTES = 1 << 20
# Digits of a number that surely fits into BIGINT.
SAFE_DIGITS = 18
_ID = re.compile(ID_TEXT)


class Short(Exception):
    """The buffer ends inside the value."""


class Corrupt(ValueError):
    """The bytes are not in the format; nothing after them can be read."""


class Foreign:
    """A value of a type that recordings do not use."""


def _heads() -> list[tuple[str, int, int] | None]:
    """For every type byte: kind, size when fixed, width of a size that follows."""
    table: list[tuple[str, int, int] | None] = [None] * 256
    for code in range(256):
        if code <= 0x7F or code >= 0xE0 or code in CONSTANTS:
            table[code] = ("constant", 0, 0)
        elif code <= 0x8F:
            table[code] = ("map", code & 0x0F, 0)
        elif code <= 0x9F:
            table[code] = ("array", code & 0x0F, 0)
        elif code <= 0xBF:
            table[code] = ("text", code & 0x1F, 0)
        elif code in NUMBERS:
            table[code] = ("number", struct.calcsize(NUMBERS[code]), 0)
        elif code in FIXED_EXTENSION:
            table[code] = ("foreign", FIXED_EXTENSION[code] + 1, 0)
    sized = {"text": TEXT, "map": MAP, "array": ARRAY, "binary": BINARY}
    for kind, widths in sized.items():
        for code, width in widths.items():
            table[code] = (kind, 0, width)
    for code, width in EXTENSION.items():
        table[code] = ("foreign", 1, width)
    return table


_HEADS = _heads()


def head(buf: bytes, at: int) -> tuple[str, int, int]:
    """Kind, size and content offset of the value at ``at``.

    The size counts bytes for ``number``, ``text``, ``binary`` and ``foreign``
    and entries for ``array`` and ``map``.
    """
    if at >= len(buf):
        raise Short
    found = _HEADS[buf[at]]
    if found is None:
        raise Corrupt(f"type byte {buf[at]:#x}")
    kind, size, width = found
    at += 1
    if not width:
        return kind, size, at
    end = at + width
    if end > len(buf):
        raise Short
    return kind, size + int.from_bytes(buf[at:end], "big"), end


def skip(buf: bytes, at: int) -> tuple[None, int]:
    """The offset after the value, without building it."""
    pending = 1
    while pending:
        kind, size, at = head(buf, at)
        pending -= 1
        if kind == "array":
            pending += size
        elif kind == "map":
            pending += 2 * size
        else:
            at += size
            if at > len(buf):
                raise Short
    return None, at


def unpack(buf: bytes, at: int) -> tuple[Any, int]:
    """The value at ``at`` and the offset after it.

    Text that is not UTF-8 stays bytes; a repeated map key keeps the last value.
    """
    kind, size, start = head(buf, at)
    if kind == "text":
        end = start + size
        if end > len(buf):
            raise Short
        raw = buf[start:end]
        try:
            return raw.decode(), end
        except UnicodeDecodeError:
            return raw, end
    if kind == "map":
        pairs = {}
        for _ in range(size):
            key, start = unpack(buf, start)
            value, start = unpack(buf, start)
            pairs[key if isinstance(key, (str, bytes)) else str(key)] = value
        return pairs, start
    if kind == "array":
        items = []
        for _ in range(size):
            item, start = unpack(buf, start)
            items.append(item)
        return items, start
    end = start + size
    if end > len(buf):
        raise Short
    if kind == "number":
        return struct.unpack_from(NUMBERS[buf[at]], buf, start)[0], end
    if kind == "binary":
        return buf[start:end], end
    if kind == "foreign":
        return Foreign(), end
    code = buf[at]
    if code in CONSTANTS:
        return CONSTANTS[code], end
    return (code if code <= 0x7F else code - 0x100), end


def _texts(content: bytes = b".{%d}") -> bytes:
    """A pattern of texts with heads of one byte; ``content`` takes the size that the head tells."""
    return b"|".join(bytes((0xA0 + size,)) + content % size for size in range(32))


@functools.cache
def _usual(count: int, with_fields: bool) -> re.Pattern[bytes]:
    """A record of short texts with ``count`` fields: stream, both parts of the ID, names and values.

    Texts come with their heads; without fields they are only passed over.
    """
    fields = re.escape(bytes((0x80 | count,)))
    message_id = _texts(b"(?=[0-9-]{%d}" + fields + b")")
    text = b"(" + _texts() + b")"
    rest = (text if with_fields else b"(?:" + _texts() + b")") * (2 * count)
    parts = [RECORD_START, text, b"(?:", message_id, b")", ID_TEXT.encode(), fields, rest]
    return re.compile(b"".join(parts), re.DOTALL)


# The head of a record of short texts, up to the number of its fields.
_USUAL_START = re.compile(
    RECORD_START + b"(?:" + _texts() + b")(?:" + _texts() + rb")([\x80-\x8f])", re.DOTALL
)


def _run(buf: bytes, at: int, stop: int, most: int, with_fields: bool) -> tuple[list[int], list[tuple]]:
    """Offsets after neighbouring records of short texts and equally many fields, and their parts."""
    ends: list[int] = []
    rows: list[tuple] = []
    found = _USUAL_START.match(buf, at) if most else None
    if found is not None:
        match = _usual(found[1][0] & 0x0F, with_fields).match
        while at < stop and len(rows) < most:
            found = match(buf, at)
            if found is None:
                break
            at = found.end()
            ends.append(at)
            rows.append(found.groups())
    return ends, rows


def _as_unpacked(text: bytes) -> str | bytes:
    try:
        return text[1:].decode()
    except UnicodeDecodeError:
        return text[1:]


def run_value(row: tuple) -> list:
    """The object that a row of a run stands for, as ``unpack`` gives it."""
    name, ms, seq, *fields = row
    message_id = ms.decode() if seq is None else f"{ms.decode()}-{seq.decode()}"
    texts = [_as_unpacked(text) for text in fields]
    return [_as_unpacked(name), message_id, dict(zip(texts[::2], texts[1::2], strict=True))]


def streams(run: list[tuple], value: Any) -> list[str | None]:
    """The streams of a stretch's records; ``None`` for a malformed one."""
    if not run:
        return [_stream(value)]
    names: dict[bytes, str | None] = {}
    made = []
    for name, ms, seq, *_ in run:
        if len(ms) > SAFE_DIGITS or (seq is not None and len(seq) > SAFE_DIGITS):
            made.append(_stream(run_value((name, ms, seq))))
            continue
        if name not in names:
            names[name] = _stream(run_value((name, ms, seq)))
        made.append(names[name])
    return made


def _stream(value: Any) -> str | None:
    try:
        return record(value)[0]
    except ValueError:
        return None


def stretches(
    file: BinaryIO,
    start: int,
    stop: int,
    take: Callable[[bytes, int], tuple[Any, int]],
    most: int,
    whole: bool = False,
) -> Iterator[tuple[list[int], list[tuple], Any]]:
    """Objects that begin in ``[start, stop)``: the offset after each, and what they are.

    Up to ``most`` neighbouring records of short texts come as rows, whose
    value :func:`run_value` gives; any other object comes alone with its value.
    Rows have no fields if ``take`` is :func:`without_fields`.
    """
    file.seek(start)
    buf, at, base, size = b"", 0, start, READ_BYTES
    while base + at < stop:
        ends, run = _run(buf, at, stop - base, most, take is not without_fields)
        if run:
            at = ends[-1]
            yield [base + end for end in ends], run, None
            continue
        try:
            value, after = take(buf, at)
        except Short:
            left = stop - base - len(buf) if whole else size
            more = file.read(min(size, left))
            if not more:
                return
            # A read that did not complete the object doubles the next one.
            size = READ_BYTES if at else size * 2
            buf, base, at = buf[at:] + more, base + at, 0
            continue
        at = after
        yield [base + at], run, value


def objects(
    file: BinaryIO,
    start: int,
    stop: int,
    take: Callable[[bytes, int], tuple[Any, int]],
    whole: bool = False,
) -> Iterator[tuple[int, Any]]:
    """Objects that begin in ``[start, stop)``: the offset after each, and its value.

    Memory is bounded by the largest object.  An incomplete object at the end
    of the file ends the walk.  With ``whole`` the last one is known to end at
    ``stop``, and nothing behind it is read.
    """
    for ends, _, value in stretches(file, start, stop, take, 0, whole):
        yield ends[0], value


def is_record_at(buf: bytes, at: int) -> bool:
    """Whether a complete record of the usual shape begins at ``at``."""
    if buf[at : at + 1] != RECORD_START:
        return False
    kind, size, start = head(buf, at + 1)
    if kind != "text":
        return False
    kind, size, start = head(buf, start + size)
    if kind != "text" or start + size > len(buf):
        return False
    try:
        text = buf[start : start + size].decode("ascii")
    except UnicodeDecodeError:
        return False
    fields = start + size
    return bool(_ID.fullmatch(text)) and (
        buf[fields : fields + 1] == NIL or head(buf, fields)[0] == "map"
    )


# ---- records ----------------------------------------------------------------


def _as_text(value: Any) -> str | None:
    """A field value as text: nil stays NULL, anything not text goes through str."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bytes):
        return value.decode()
    if isinstance(value, Foreign):
        raise ValueError("foreign value")
    return str(value)


def _as_json(value: Any) -> str | None:
    """A field value as JSON that tells its type; a float always has an exponent.

    A float that is no number is text, as JSON has none.
    """
    if isinstance(value, float):
        return f"{value!r}E0" if math.isfinite(value) and "e" not in repr(value) else json.dumps(
            value if math.isfinite(value) else str(value)
        )
    if isinstance(value, (bool, int)):
        return json.dumps(value)
    text = _as_text(value)
    return None if text is None else json.dumps(text)


def record(
    value: Any, as_field: Callable[[Any], str | None] = _as_text
) -> tuple[str, int, int, dict[str, str | None] | None]:
    """Stream, ms, seq and fields of a decoded object; ``ValueError`` if malformed.

    Nil in place of the fields is a message without a map.
    """
    if not isinstance(value, list) or len(value) != 3 or not isinstance(value[2], (dict, type(None))):
        raise ValueError("not a record of stream, ID and fields")
    name, raw_id = _as_text(value[0]), _as_text(value[1])
    found = _ID.fullmatch(raw_id or "")
    if name is None or found is None:
        raise ValueError(f"invalid message ID: {raw_id!r}")
    ms, seq = int(found.group(1)), int(found.group(2) or 0)
    if max(ms, seq) > MAX_PART:
        raise ValueError(f"message ID out of range: {raw_id!r}")
    if value[2] is None:
        return name, ms, seq, None
    return name, ms, seq, {_as_text(k): as_field(v) for k, v in value[2].items()}


def typed_record(value: Any) -> tuple[str, int, int, dict[str, str | None] | None]:
    """:func:`record` with field values as JSON, which keeps their types."""
    return record(value, _as_json)


def without_fields(buf: bytes, at: int) -> tuple[Any, int]:
    """Like ``unpack``, but the fields of a record are passed over, as nil.

    A malformed map is not noticed then.
    """
    kind, size, start = head(buf, at)
    if kind != "array" or size != 3:
        return unpack(buf, at)
    name, start = unpack(buf, start)
    message_id, start = unpack(buf, start)
    found = start
    end = skip(buf, found)[1]
    empty = buf[found : found + 1] == NIL or head(buf, found)[0] == "map"
    return [name, message_id, None if empty else False], end


def _sized(size: int, short: int, limit: int, wide: dict[int, int]) -> bytes:
    """Header of a sized value: the short form, or the narrowest that fits."""
    if size < limit:
        return bytes((short | size,))
    for code, width in wide.items():
        if size < 1 << (8 * width):
            return bytes((code,)) + size.to_bytes(width, "big")
    raise ValueError(f"{size} is too large to record")


def _pack_text(text: str | None) -> bytes:
    if text is None:
        return b"\xc0"
    raw = text.encode()
    return _sized(len(raw), 0xA0, 32, TEXT) + raw


def pack_record(name: str, message_id: str, fields: dict[str, str | None] | None) -> bytes:
    parts = [RECORD_START, _pack_text(name), _pack_text(message_id)]
    if fields is None:
        return b"".join([*parts, NIL])
    parts.append(_sized(len(fields), 0x80, 16, MAP))
    for key, value in fields.items():
        parts += (_pack_text(key), _pack_text(value))
    return b"".join(parts)
