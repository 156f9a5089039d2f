"""Rotation at given moments, and raw messages judged while they are captured."""

from __future__ import annotations

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from tidelog.operators import select
from tidelog.sources import sinks
from tidelog.streaming import capture


@pytest.mark.parametrize("count, literals", [(0, 10), (1, 10), (9, 10), (700, 1000), (700, 10), (700, 2), (64, 63)])
def test_rotation_against_bisection(spark, make_log, count, literals):
    draw = random.Random(count + literals)
    times = [draw.choice([draw.randint(-50, 3000), 7, 500 + draw.randint(0, 3)]) for _ in range(count)]
    moments = [draw.randint(-100, 3100) for _ in range(400)] + times[:50]
    log = make_log([("s", ms) for ms in moments])
    given = spark.createDataFrame([(t,) for t in [*times, *times[:3], None]], "ms bigint")
    found = sinks.rotation_at(log, given, literals)
    assert found.columns == [*log.columns, "rotation"]
    known = sorted(set(times))
    assert all(r.rotation == bisect_right(known, r.ms) for r in found.collect())
    assert found.count() == len(moments)


def test_rotation_of_messages_without_a_time(spark):
    log = spark.createDataFrame([("a", None), ("b", 5)], "stream_name string, ms bigint")
    for literals in (10, 1):
        found = sinks.rotation_at(log, [1, 5, 9], literals)
        assert {r.stream_name: r.rotation for r in found.collect()}["b"] == 2
        assert {r.stream_name: r.rotation for r in found.collect()}["a"] is None


def test_write_rotated_at(spark, make_log, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_rotated_at(make_log([("s", ms) for ms in (0, 999, 1000, 2500, 2999)]), path, [2500, 1000, 1000])
    found = spark.read.parquet(path).groupBy("rotation").count().collect()
    assert {tuple(r) for r in found} == {(0, 2), (1, 1), (2, 2)}
    with pytest.raises(ValueError, match="either"):
        capture.start_capture(make_log([("s", 1)]), path, path, rotate_ms=5, rotate_at=[1])


@pytest.mark.parametrize("rotations", [{"rotate_at": [100, 200, 300]}, {"rotate_ms": 100}])
def test_a_micro_batch_adds_one_file_to_a_rotation(spark, make_log, tmp_path, rotations):
    inbox, path = str(tmp_path / "inbox"), tmp_path / "out"
    make_log([("s", ms) for ms in range(400)]).repartition(8).write.parquet(inbox)
    messages = capture.table_stream(spark, inbox, "*.parquet", spark.read.parquet(inbox).schema)
    capture.start_capture(messages, str(path), f"{path}-offsets", **rotations).awaitTermination()
    found = spark.read.parquet(str(path)).groupBy("rotation").count().collect()
    assert {tuple(row) for row in found} == {(n, 100) for n in range(4)}
    assert len(list(path.glob("rotation=*/*.parquet"))) == 4


BAD = b"\xff\xfe"
RAW = [
    (b"a", b"1-0", {b"k": b"v"}, None),
    (b"a", b"2", {b"k": None}, None),
    (b"a", b"3-1", None, None),
    (BAD, BAD, {}, select.NO_NAME),
    (None, b"1-0", {}, select.NO_NAME),
    (b"x", BAD, {}, select.UNLISTED),
    (b"a", BAD, {BAD: b""}, select.NO_ID_TEXT),
    (b"a", None, {}, select.NO_ID_TEXT),
    (b"a", b"no", {b"k": BAD}, select.NO_FIELDS),
    (b"a", b"4-0", {BAD: b"v"}, select.NO_FIELDS),
    (b"a", b"5-x", {}, select.NO_ID),
    (b"a", b"99999999999999999999", {}, select.NO_ID),
]
SCHEMA = "stream_name binary, id binary, fields map<binary,binary>, pos bigint"


def test_judged_messages(spark):
    raw = spark.createDataFrame([(*r[:3], i) for i, r in enumerate(RAW)], SCHEMA)
    found = {r.pos: r for r in select.judged(raw, ["a"]).collect()}
    assert [found[i].reason for i in range(len(RAW))] == [r[3] for r in RAW]
    assert [(found[i].stream_name, found[i].ms, found[i].seq, found[i].fields) for i in range(3)] == [
        ("a", 1, 0, {"k": "v"}), ("a", 2, 0, {"k": None}), ("a", 3, 1, None),
    ]
    assert found[0].raw is None and found[0].status == "kept"
    assert (found[6].ms, found[6].status, bytes(found[6].raw.id)) == (None, "set_aside", BAD)
    unlisted = select.judged(raw).where("pos = 5").first()
    assert unlisted.reason == select.NO_ID_TEXT
    assert select.judged(raw.limit(0), ["a"]).count() == 0


def test_capture_reads_the_source_once(spark, tmp_path):
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    raw = spark.createDataFrame([(*r[:3], i) for i, r in enumerate(RAW)], SCHEMA)
    taken = 0
    for part in range(2):
        raw.where(F.col("pos") % 2 == part).coalesce(1).write.mode("append").parquet(inbox)
        messages = capture.table_stream(spark, inbox, "*.parquet", raw.schema, 1)
        query = capture.start_judged_capture(messages, out, f"{out}-offsets", ["a"])
        query.awaitTermination()
        taken += sum(p.numInputRows for p in query.recentProgress)
    assert taken == len(RAW)
    assert sorted(r.pos for r in capture.kept_messages(spark, out).collect()) == [0, 1, 2]
    aside = {r.pos: r.reason for r in capture.set_aside(spark, out).collect()}
    assert aside == {i: r[3] for i, r in enumerate(RAW) if r[3]}
    assert capture.kept_messages(spark, out).columns == ["stream_name", "ms", "seq", "fields", "pos"]
