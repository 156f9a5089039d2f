"""Message IDs, clocks and payload sizes, with literal expectations."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.functions import clock, ids, payload
from tidelog.sources import packing

ZONES = ["UTC", "America/New_York", "Asia/Kolkata"]


def evaluate(spark, value, kind, build):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build(F.col("v"))).first()[0]


def evaluate_all(spark, values, kind, build):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[1] for r in df.select("i", build(F.col("v"))).orderBy("i").collect()]


# ---- message IDs ----


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("1709312000000-5", (1709312000000, 5)),
        ("1709312000000", (1709312000000, 0)),
        (b"1709312000000-5", (1709312000000, 5)),
    ],
)
def test_bound(raw, expected):
    assert ids.bound(raw) == expected


@pytest.mark.parametrize("raw", ["not-a-number", "17-abc", "", "-1", "1-", " 1", "1_0", "1\n"])
def test_invalid_bound(raw):
    with pytest.raises(ValueError, match="invalid message ID"):
        ids.bound(raw)


def test_bounds_order_and_text():
    assert ids.MessageID(100, 0) < ids.MessageID(100, 1) < ids.MessageID(200, 0)
    assert str(ids.MessageID(7)) == "7-0"


def test_too_large_bound_is_clamped():
    assert ids.bound("99999999999999999999-3") == (ids.MAX_PART, ids.MAX_PART)
    assert ids.bound("3-99999999999999999999") == (3, ids.MAX_PART)


RAW = ["1709312000000-5", "1709312000000", "not-a-number", "1-abc", " 1", "1-", "1\n"]
RAW += ["99999999999999999999-0", "1-99999999999999999999", "100--5", "1_000", None]


def test_parse_columns(spark):
    assert evaluate_all(spark, RAW, "string", ids.id_ms)[:2] == [1709312000000] * 2
    assert evaluate_all(spark, RAW, "string", ids.id_seq)[:2] == [5, 0]
    valid = evaluate_all(spark, RAW, "string", ids.is_valid_id)
    assert valid == [True, True] + [False] * 10


def test_format_id(spark):
    assert evaluate(spark, 12, "bigint", lambda v: ids.format_id(v, v + 1)) == "12-13"


# ---- clocks ----

def clock_text(ms):
    """Hours, minutes, seconds and milliseconds, by repeated division."""
    rest, millis = divmod(max(ms, 0), 1000)
    rest, seconds = divmod(rest, 60)
    hours, minutes = divmod(rest, 60)
    return f"{hours:02}:{minutes:02}:{seconds:02}.{millis:03}"


# Around every carry, and far outside a day.
MOMENTS = [-9, 0, 7, 999, 1000, 59_999, 60_000, 61_042, 3_599_999, 3_600_000, 90_061_001, 777_777_777]
DURATIONS = {ms: clock_text(ms) for ms in MOMENTS}
PARSED = {
    **{text: ms for ms, text in DURATIONS.items() if ms >= 0},
    "7:08": 428_000,
    "2:03.25": 123_250,
    "41": 41_000,
    "41.7": 41_700,
    "0:9:1.98765": 541_987,
    "   00:10:00 ": 600_000,
    "\t8:15\n": 495_000,
    "6.": 6000,
    "3.4.5": None,
    "": None,
    "soon": None,
    "4:3:2:1": None,
    "2:-1": None,
    "2: 1": None,
    "88888888888888888888": None,
    str(2**63 - 1): None,
}


def test_format_duration(spark):
    found = evaluate_all(spark, list(DURATIONS), "bigint", clock.format_duration)
    assert found == list(DURATIONS.values())


def test_parse_duration(spark):
    found = evaluate_all(spark, list(PARSED), "string", clock.parse_duration)
    assert found == list(PARSED.values())


@pytest.mark.parametrize("zone", ZONES)
def test_utc_text(spark, in_zone, zone):
    in_zone(zone)
    moments = [1_645_000_000_042, 86_399_999, -5, 951_782_400_000, 4_102_444_800_000]
    day = datetime(1970, 1, 1)
    there = [day + timedelta(milliseconds=ms) for ms in moments]
    assert evaluate_all(spark, moments, "bigint", clock.format_utc) == [
        t.isoformat(sep=" ", timespec="milliseconds") for t in there
    ]
    assert evaluate_all(spark, moments, "bigint", clock.format_utc_day_first) == [
        t.strftime("%d-%m-%Y %H:%M:%S") for t in there
    ]


def at(text):
    return int(datetime.fromisoformat(f"{text}+00:00").timestamp() * 1000)


EVENING = at("2022-05-07 22:00:00")
UTC = [
    ("2022-05-07 01:02:03.456", 0, 0, at("2022-05-07 01:02:03.456")),
    ("2022-05-07", 0, 0, at("2022-05-07")),
    # A short time after a date is minutes and seconds, as in durations.
    ("2022-05-07T05:00", 0, 0, at("2022-05-07 00:05:00")),
    ("2022-02-30", 0, 0, None),
    ("2022-05-07 ", 0, 0, at("2022-05-07")),
    ("2022-05-07 x", 0, 0, None),
    # A clock time takes the day on which it falls into the range.
    ("22:30:00.000", EVENING, EVENING + 3_600_000, at("2022-05-07 22:30:00")),
    ("01:30:00", EVENING, EVENING + 4 * 3_600_000, at("2022-05-08 01:30:00")),
    ("23:50:00", at("2022-05-08 00:00:00"), at("2022-05-08 00:20:00"), at("2022-05-08 23:50:00")),
    ("", 0, 0, None),
    ("tomorrow", 0, 0, None),
]


@pytest.mark.parametrize("zone", ZONES)
def test_parse_utc(spark, in_zone, zone):
    in_zone(zone)
    df = spark.createDataFrame(UTC, "t string, a bigint, b bigint, want bigint")
    found = df.select(
        "t", "want", clock.parse_utc(F.col("t"), F.col("a"), F.col("b")).alias("got")
    ).collect()
    assert {r.t: r.got for r in found} == {r.t: r.want for r in found}


@pytest.mark.parametrize("zone", ZONES)
def test_epoch_ms_rounds_down(spark, in_zone, zone):
    in_zone(zone)
    df = spark.sql(
        "SELECT stack(2, TIMESTAMP_NTZ'2024-03-01 16:53:20.123999',"
        " TIMESTAMP_NTZ'1969-12-31 23:59:59.9995') AS ts"
    )
    found = [r[0] for r in df.select(clock.epoch_ms(F.col("ts"))).collect()]
    assert sorted(found) == [-1, 1709312000123]


# ---- payload ----


def test_recorded_bytes_equal_the_written_size(spark):
    long = {"k" * 40: "é" * 200, "n": None, **{f"f{i}": "v" * i for i in range(40)}}
    cases = [({}, "s"), ({"a": "1"}, "s" * 31), ({"a": ""}, "s" * 32), (long, "é" * 20)]
    df = spark.createDataFrame(
        [(i, name, fields) for i, (fields, name) in enumerate(cases)],
        "i int, name string, fields map<string,string>",
    )
    size = payload.recorded_bytes(F.col("name"), F.lit("12-0"), F.col("fields"))
    found = [r[1] for r in df.select("i", size).orderBy("i").collect()]
    assert found == [len(packing.pack_record(n, "12-0", f)) for f, n in cases]


def test_text_checks(spark):
    df = spark.createDataFrame(
        [(1, b"ok", {b"k": b"v"}), (2, b"\xff", {}), (3, b"ok", {b"k": b"\xfe"})],
        "i int, raw binary, fields map<binary,binary>",
    )
    found = df.select(
        "i", payload.is_text(F.col("raw")), payload.is_text_map(F.col("fields"))
    ).orderBy("i")
    assert [tuple(r) for r in found.collect()] == [
        (1, True, True),
        (2, False, True),
        (3, True, False),
    ]


def test_stringify(spark):
    df = spark.sql("SELECT map(1, 2.5D, 2, CAST(NULL AS DOUBLE)) AS m")
    found = df.select(payload.stringify(F.col("m")).alias("m")).first().m
    assert found == {"1": "2.5", "2": None}
