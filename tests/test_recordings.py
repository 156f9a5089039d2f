"""Recording files: round trips, damage, foreign input, cuts at any size."""

from __future__ import annotations

import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.schema import MESSAGE_LOG
from tidelog.plans.scan import number_by_arrival
from tidelog.sources import chains, packing, recordings, zones
from tidelog.sources.recordings import read_recordings, write_recordings

SAMPLE = [
    ("sensor:imu", 1709312000000, 0, {"x": "1.0", "y": "2.0"}, "a", 0),
    ("sensor:gps", 1709312000100, 0, {"lat": "55.7558"}, "a", 1),
    ("sensor:imu", 1709312000200, 7, {}, "a", 2),
    ("sensor:camera", 1709312000300, 0, {"frame": "42", "note": 'a "q", é\n'}, "a", 3),
]


def rows(df):
    found = df.select("stream_name", "ms", "seq", "fields", "pos").collect()
    return sorted((r.pos, r.stream_name, r.ms, r.seq, r.fields) for r in found)


def packed(count):
    return [
        packing.pack_record(f"s{i % 3}", f"{1000 + i}-{i % 2}", {"v": str(i), "t": "x" * i})
        for i in range(count)
    ]


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "recordings"
    path.mkdir()
    return path


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    write_recordings(spark.createDataFrame(SAMPLE, MESSAGE_LOG), path)
    found = read_recordings(spark, path)
    assert [(r[1], r[2], r[3], r[4]) for r in rows(found)] == [r[:4] for r in SAMPLE]


def test_writing_again_appends(spark, tmp_path):
    path = str(tmp_path / "out")
    log = spark.createDataFrame(SAMPLE, MESSAGE_LOG)
    write_recordings(log, path)
    write_recordings(log, path)
    found = read_recordings(spark, path)
    assert found.count() == 2 * len(SAMPLE)
    assert all(name.startswith("part-") for name in os.listdir(path) if name[0] != ".")
    assert not [name for name in os.listdir(path) if name.startswith(".part")]
    with pytest.raises(Exception, match="append-only"):
        log.write.format("recording").mode("overwrite").save(path)


def test_missing_and_empty(spark, folder):
    assert read_recordings(spark, str(folder / "nothing.msgpack")).count() == 0
    (folder / "empty.msgpack").write_bytes(b"")
    assert read_recordings(spark, str(folder)).count() == 0


@pytest.mark.parametrize("split_bytes", [40, 1 << 20])
def test_file_cut_at_every_byte(spark, folder, split_bytes):
    records = packed(4)
    whole = b"".join(records)
    ends = [sum(map(len, records[: i + 1])) for i in range(len(records))]
    for size in range(1, len(whole) + 1):
        (folder / f"cut-{size:03d}.msgpack").write_bytes(whole[:size])
    found = {
        r.recording: r["count"]
        for r in read_recordings(spark, str(folder), split_bytes=split_bytes)
        .groupBy("recording")
        .count()
        .collect()
    }
    for size in range(1, len(whole) + 1):
        complete = sum(end <= size for end in ends)
        assert found.get(f"cut-{size:03d}.msgpack", 0) == complete


@pytest.mark.parametrize("split_bytes", [1, 7, 64, 300, 5000, 1 << 20])
def test_cuts_do_not_change_the_rows(spark, folder, split_bytes):
    (folder / "a.msgpack").write_bytes(b"".join(packed(60)))
    if split_bytes == 1:
        (folder / "a.msgpack").write_bytes(b"".join(packed(12)))
    expected = rows(read_recordings(spark, str(folder)))
    found = rows(read_recordings(spark, str(folder), split_bytes=split_bytes))
    assert found == expected
    assert [r[0] for r in found] == list(range(len(expected)))


@pytest.mark.parametrize("split_bytes", [50, 100, 400])
def test_payload_that_looks_like_records(spark, folder, split_bytes):
    inner = b"".join(packed(6)).decode("latin-1").encode("ascii", "ignore").decode()
    fake = b"".join(packed(8))
    record = b"\x93" + packing._pack_text("s") + packing._pack_text("5-0") + b"\x81"
    record += packing._pack_text("raw") + b"\xc5" + struct.pack(">H", len(fake)) + fake
    text = packing.pack_record("s", "6-0", {"inner": inner})
    (folder / "a.msgpack").write_bytes((record + text) * 4)
    found = read_recordings(spark, str(folder), "PERMISSIVE", split_bytes=split_bytes)
    kept = found.orderBy("pos").collect()
    assert [r.pos for r in kept] == list(range(8))
    assert {r.stream_name for r in kept if r._corrupt_record is None} == {"s"}
    assert [r.ms for r in kept if r._corrupt_record is None][-1] == 6


def test_break_ends_the_file_even_across_cuts(spark, folder):
    good, bad = packed(10), b"\xc1"
    (folder / "a.msgpack").write_bytes(b"".join(good) + bad + b"".join(packed(30)))
    for split_bytes in (40, 1 << 20):
        assert read_recordings(spark, str(folder), split_bytes=split_bytes).count() == 10


def foreign():
    float_value = b"\xcb" + struct.pack(">d", 1.5)
    typed = b"\x93" + packing._pack_text("s") + packing._pack_text("1")
    typed += b"\x84" + b"\xa1n" + b"\x07" + b"\xa1f" + float_value
    typed += b"\xa1t" + b"\xc3" + b"\xa1z" + b"\xc0"
    return {
        "typed": typed,
        "two elements": b"\x92\xa1s\xa31-0",
        "bad id": packing.pack_record("s", "abc", {}),
        "extension": b"\x93\xa1s\xa31-0\x81\xa1k\xd4\x01\x00",
        "not utf-8": b"\x93\xa1s\xa31-0\x81\xa1k\xa2\xff\xfe",
        "too large": packing.pack_record("s", "99999999999999999999-0", {}),
        "after": packing.pack_record("s", "2-0", {"a": "b"}),
    }


def test_malformed_records_are_set_aside(spark, folder):
    (folder / "a.msgpack").write_bytes(b"".join(foreign().values()))
    found = rows(read_recordings(spark, str(folder)))
    assert found == [
        (0, "s", 1, 0, {"n": "7", "f": "1.5", "t": "True", "z": None}),
        (6, "s", 2, 0, {"a": "b"}),
    ]
    everything = read_recordings(spark, str(folder), "PERMISSIVE")
    assert everything.count() == 7
    assert everything.where(F.col("_corrupt_record").isNotNull()).count() == 5
    with pytest.raises(Exception, match="not a record"):
        read_recordings(spark, str(folder), "FAILFAST").collect()


def test_repeated_key_keeps_the_last_value():
    raw = b"\x93\xa1s\xa31-0\x82\xa1k\xa11\xa1k\xa12"
    assert packing.record(packing.unpack(raw, 0)[0]) == ("s", 1, 0, {"k": "2"})


@pytest.mark.parametrize("size", [0, 31, 32, 255, 256, 65535, 65536])
def test_every_header_width(size):
    fields = {"k": "v" * size, **{str(i): None for i in range(size if size < 300 else 3)}}
    raw = packing.pack_record("n" * min(size + 1, 300), "1-2", fields)
    value, end = packing.unpack(raw, 0)
    assert end == len(raw) == packing.skip(raw, 0)[1]
    assert packing.record(value)[3] == fields


# ---- order across files and calls ----


def test_appends_keep_arrival_order(spark, make_log, tmp_path):
    """Several parts per call, and several calls: names sort as written."""
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for call in range(3):
            log = make_log([("s", call * 1000 + i) for i in range(200)])
            write_recordings(log, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = number_by_arrival(read_recordings(spark, path)).orderBy("arrival").collect()
    assert len({r.recording for r in rows}) > 3
    assert [r.ms for r in rows] == [call * 1000 + i for call in range(3) for i in range(200)]


def test_equal_file_names_in_two_folders(spark, make_log, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        data = b"".join(packing.pack_record(folder, f"{i}-0", {}) for i in range(3))
        (tmp_path / folder / "r.msgpack").write_bytes(data)
    for path in (str(tmp_path / "*"), f"file:{tmp_path}/[xy]"):
        found = read_recordings(spark, path)
        assert {r.recording for r in found.collect()} == {"x/r.msgpack", "y/r.msgpack"}
        assert found.select("recording", "pos").distinct().count() == 6
    one = read_recordings(spark, str(tmp_path / "x" / "r.msgpack")).first()
    assert one.recording == "r.msgpack"


def test_text_that_looks_like_a_huge_record(tmp_path):
    """A dash before a Persian letter reads like a record with a text of gigabytes."""
    text = "–ی" * 100
    record = packing.pack_record("s", "1-0", {"t": text})
    data = record * (24_000_000 // len(record))
    path = tmp_path / "big"
    path.write_bytes(data)

    class Counted:
        def __init__(self, file):
            self.file, self.read_bytes = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, count):
            got = self.file.read(count)
            self.read_bytes += len(got)
            return got

    size = 3_000_000
    with open(path, "rb") as file:
        seen = Counted(file)
        inside = record.index("–".encode()) + 10 * len(record)
        found = chains.Cut(seen, len(data), inside, inside + size).chains()
    real = [chain for chain in found if not chain.broken]
    assert real[0].starts[0] == 11 * len(record)
    assert all(start % len(record) == 0 for start in real[0].starts)
    assert seen.read_bytes <= size + 10 * chains.BEYOND


def _odd_and_usual_objects():
    text = packing._pack_text
    usual = [packing.pack_record(f"s{i % 3}", f"{10**12 + i}-{i % 5}", {"k": str(i), "v": "é" * (i % 9)}) for i in range(60)]
    varied = [packing.pack_record("s", str(i), {f"k{i % 4}": "x", "w": "y" * (i % 3)}) for i in range(40)]
    fields = b"\x82" + text("k") + text("a") + text("k") + text("b")
    odd = [
        b"\x93" + text("s") + text("1-1") + fields,  # a field given twice
        b"\x93\xa2\xff\xfe" + text("1-1") + b"\x80",  # no UTF-8
        b"\x93" + text("s") + text("1-1") + b"\x81" + text("k") + b"\xa1\xff",
        packing.pack_record("s", "99999999999999999999-1", {"k": "v", "v": "v"}),
        packing.pack_record("s", "9223372036854775807-9223372036854775807", {}),
        packing.pack_record("s", "9223372036854775808", {}),
        packing.pack_record("s", "1-", {"k": "v", "v": "v"}),
        packing.pack_record("s", "x1-2", {"k": "v"}),
        packing.pack_record("", "00012-003", {"": ""}),
        packing.pack_record("s", "5-5", {"k": None, "v": "v"}),
        packing.pack_record("s", "5-5", {"k": "long" * 200}),
        packing.pack_record("s" * 40, "5-5", {"k": "v"}),
        packing.pack_record("s", "5-5", None),
        packing.pack_record("s", "5-5", {str(i): "v" for i in range(20)}),
        b"\xc0",
        b"\x92" + text("s") + text("1-1"),
        b"\x93" + text("s") + text("1-1") + b"\x81" + b"\x05" + b"\xcb" + b"\0" * 8,
    ]
    for one in odd:
        yield from (usual + [one] * 20 + usual[:30] + [one] + usual[:7] + varied + [one])


def test_runs_of_usual_records_are_read_like_single_ones(tmp_path):
    data = b"".join(_odd_and_usual_objects())
    path = tmp_path / "r"
    path.write_bytes(data)
    expected, at, pos = [], 0, 5
    while at < len(data):
        value, at = packing.unpack(data, at)
        try:
            stream, ms, seq, fields = packing.record(value)
            expected.append((stream, ms, seq, fields, "r", pos, None))
        except ValueError as problem:
            expected.append((None, None, None, None, "r", pos, str(problem)))
        pos += 1
    for with_fields in (True, False):
        found = [
            tuple(row.values())
            for batch in recordings._rows(str(path), "r", 0, len(data), 5, with_fields)
            for row in batch.to_pylist()
        ]
        if with_fields:
            assert [(*r[:3], None if r[3] is None else dict(r[3]), *r[4:]) for r in found] == expected
            assert [len(r[3]) for r in found if r[3]] == [len(r[3]) for r in expected if r[3]]
        else:
            assert len(found) == len(expected)  # malformed fields are not noticed
            assert [r[1] for r, e in zip(found, expected) if e[1] is not None] == [
                e[1] for e in expected if e[1] is not None
            ]
    streams = []
    with open(path, "rb") as file:
        for ends, run, value in packing.stretches(file, 0, len(data), packing.without_fields, 64):
            assert len(ends) == max(1, len(run))
            streams += packing.streams(run, value)
    assert [s for s, e in zip(streams, expected) if e[0] is not None] == [e[0] for e in expected if e[0] is not None]


def test_usual_records_are_not_unpacked_one_by_one(tmp_path, monkeypatch):
    path = tmp_path / "r"
    path.write_bytes(b"".join(packing.pack_record("s", f"{i}-0", {"k": str(i)}) for i in range(50_000)))
    calls = []
    general = packing.unpack
    monkeypatch.setattr(packing, "unpack", lambda buf, at: calls.append(at) or general(buf, at))
    batches = list(recordings._rows(str(path), "r", 0, path.stat().st_size, 0))
    assert [n for b in batches for n in b["ms"].to_pylist()] == list(range(50_000))
    assert [n for b in batches for n in b["pos"].to_pylist()] == list(range(50_000))
    assert len(calls) < 20


def test_blocks_told_at_once_are_those_told_one_by_one():
    draw = random.Random(7)
    rows = [(draw.randint(1, 90), draw.choice("abc"), draw.randrange(50), draw.randrange(4)) for _ in range(500)]
    one, many = zones.Summary(block_bytes=300), zones.Summary(block_bytes=300)
    expected = [zone for row in rows if (zone := one.add(*row)) is not None]
    found = []
    for first in range(0, 500, 37):
        size, name, ms, seq = zip(*rows[first : first + 37])
        found += many.add_all(np.array(size), pa.array(name), pa.array(ms), pa.array(seq))
    assert found == expected
    assert many.finish() == one.finish()


def test_numbering_by_arrival_reads_the_log_twice(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).selectExpr("'r' AS recording", "id * 3 AS pos")
    log = rows.mapInArrow(seen, rows.schema)
    found = number_by_arrival(log, "arrival", 50, store_counts=True).collect()
    assert sorted((r.pos, r.arrival) for r in found) == [(3 * i, i) for i in range(1000)]
    assert reads.value == 2000
