"""Slicing, selecting and measuring small logs, with literal expectations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from readings import READINGS, START
from tidelog.operators import flatten, select, stats
from tidelog.operators.arrival import bounded_capture
from tidelog.schema import MESSAGE_LOG, message_log, require_positive, stream_keys
from tidelog.sources import packing

MS = START


def found_ms(df):
    return sorted(r.ms - MS for r in df.select("ms").collect())


# ---- truncation ----


def test_range_is_inclusive(sample):
    kept = select.truncate(sample, f"{MS + 40}-0", f"{MS + 90}-0")
    assert found_ms(kept) == [40, 75, 80, 90]


def test_open_ranges(sample):
    everything = [ms for _, ms, _ in READINGS]
    assert found_ms(select.truncate(sample, from_id=f"{MS + 90}-0")) == everything[4:]
    assert found_ms(select.truncate(sample, to_id=f"{MS + 75}-0")) == everything[:3]
    assert found_ms(select.truncate(sample)) == everything


def test_sequence_counts_in_bounds(make_log):
    log = make_log([("s", 5, 0), ("s", 5, 1), ("s", 5, 2), ("s", 6, 0)])
    kept = select.truncate(log, "5-1", "5-2").select("seq").collect()
    assert sorted(r.seq for r in kept) == [1, 2]


def test_auto_start(sample):
    """The pump starts last, at 90."""
    assert stats.auto_start_id(sample).first() == (MS + 90, 0)
    assert found_ms(select.truncate(sample, auto_start=True)) == [90, 120, 150]


def test_auto_start_with_end(sample):
    kept = select.truncate(sample, to_id=f"{MS + 130}-0", auto_start=True)
    assert found_ms(kept) == [90, 120]


def test_from_id_overrides_auto_start(sample):
    kept = select.truncate(sample, from_id=f"{MS + 80}-0", auto_start=True)
    assert found_ms(kept) == [80, 90, 120, 150]


def test_auto_start_uses_arrival_not_time(make_log):
    log = make_log([("a", 900), ("a", 100), ("b", 200)])
    assert stats.auto_start_id(log).first() == (900, 0)


def test_crossed_bounds(sample):
    with pytest.raises(ValueError, match="empty range"):
        select.truncate(sample, "200-0", "100-0")
    with pytest.raises(Exception, match="empty range"):
        select.truncate(sample, to_id=f"{MS}-0", auto_start=True).collect()


def test_empty_log(empty_log):
    assert select.truncate(empty_log, "1-0", "2-0").count() == 0
    assert select.truncate(empty_log, auto_start=True).count() == 0
    assert select.truncate(empty_log, to_id="9-0", auto_start=True).count() == 0
    assert stats.auto_start_id(empty_log).first() == (None, None)
    assert stats.timeline_global(stats.timeline_streams(empty_log)).first() == (0, 0, 0)
    assert stats.stream_stats(empty_log).count() == 0
    assert stats.log_totals(empty_log).first() == (0, 0)


def test_time_window_modes(make_log):
    log = make_log([("s", 10, 0), ("s", 20, 0), ("s", 20, 1), ("s", 30, 0)])
    assert select.truncate_by_time(log, 10, 20).count() == 2
    assert select.truncate_by_time(log, 10, 20, end="whole_ms").count() == 3
    assert select.truncate_by_time(log, -100, 9999).count() == 4
    with pytest.raises(ValueError, match="end must be"):
        select.truncate_by_time(log, 0, 1, end="other")


def test_counts(sample):
    low, high = select.check_bounds(f"{MS + 40}-0", f"{MS + 90}-0")
    assert stats.truncate_counts(sample, low, high).first() == (4, 3)
    kept, counts = select.truncate_observed(sample, low, high)
    assert kept.count() == 4
    assert counts.get == {"written": 4, "skipped": 3}


# ---- statistics ----


def test_stream_stats(sample):
    found = {r.stream_name: r for r in stats.stream_stats(sample).collect()}
    assert list(found) == ["climate", "door", "pump"]
    door = found["door"]
    assert (door.messages, door.first_id, door.last_id) == (2, f"{MS + 75}-0", f"{MS + 150}-0")
    assert (door.duration_ms, door.duration_s) == (75, 0.075)


def test_stats_across_recordings(make_log):
    rows = [("s", 50, 0, "b"), ("s", 10, 0, "b"), ("s", 70, 0, "a"), ("s", 60, 0, "a")]
    found = stats.stream_stats(make_log(rows)).first()
    assert (found.first_id, found.last_id, found.duration_ms) == ("70-0", "10-0", -60)


def test_timeline(sample):
    streams = stats.timeline_streams(sample)
    assert [tuple(r) for r in streams.where("stream_name = 'climate'").collect()] == [
        ("climate", 4, MS, MS + 120)
    ]
    assert stats.timeline_global(streams).first() == (MS, MS + 150, 7)


SPANS = [("even", 600, 0, 3000), ("short", 80, 1000, 1400), ("point", 7, 2500, 2500)]


@pytest.mark.parametrize(
    "window", [(0, 3000), (0, 1500), (1200, 2499), (2500, 2500), (2600, 2600), (4000, 9000), (-500, 10)]
)
def test_estimate(spark, window):
    """Against the rule written as a loop: shares of even streams, points whole or not."""
    streams = spark.createDataFrame(
        SPANS, "stream_name string, messages bigint, first_ms bigint, last_ms bigint"
    )
    expected = 0
    for _, count, first, last in SPANS:
        overlap = min(last, window[1]) - max(first, window[0])
        if first == last:
            expected += count if window[0] <= first and last <= window[1] else 0
        elif overlap > 0:
            expected += max(1, round(count * (overlap / (last - first))))
    assert stats.estimate_window(streams, *window).first().estimated == expected


def test_estimate_rounds_half_to_even_and_counts_at_least_one(spark):
    schema = "stream_name string, messages bigint, first_ms bigint, last_ms bigint"
    half = spark.createDataFrame([("a", 5, 0, 10)], schema)
    assert stats.estimate_window(half, 0, 5).first().estimated == 2
    tiny = spark.createDataFrame([("a", 2, 0, 1000)], schema)
    assert stats.estimate_window(tiny, 0, 1).first().estimated == 1


def test_file_bytes(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(1000).repartition(3).write.parquet(str(path))
    size = sum(f.stat().st_size for f in path.glob("*.parquet"))
    assert stats.file_bytes(spark.read.parquet(str(path))).first().bytes == size


def test_last_ids(make_log):
    log = make_log([("a", 5, 1), ("a", 5, 3), ("a", 4, 9), ("b", 1, 0)])
    assert {tuple(r) for r in stats.last_ids(log).collect()} == {("a", 5, 3), ("b", 1, 0)}
    top = 2**63 - 1
    log = make_log([("a", top, top), ("a", top, 0), ("a", 0, top), ("b", 0, top), ("c", top, 0)])
    found = {tuple(r) for r in stats.last_ids(log).collect()}
    assert found == {("a", top, top), ("b", 0, top), ("c", top, 0)}


# ---- streams ----


def test_include_exclude_and_dropped(sample):
    kept = select.include_streams(sample, ["door", {"key": "pump"}])
    assert kept.count() == 3
    assert select.exclude_streams(sample, ["climate"]).count() == 3
    assert select.exclude_streams(sample, []).count() == 7
    dropped = select.dropped_streams(sample, ["climate"]).collect()
    assert {tuple(r) for r in dropped} == {("door", 2), ("pump", 1)}


@pytest.mark.parametrize("extra", [0, select.MAX_LITERALS])
def test_long_lists_and_missing_names(sample, extra):
    """The same rows and columns whatever the length of the list."""
    name = F.when(F.col("pos") != 1, F.col("stream_name"))
    log = sample.select("ms", name.alias("stream_name"), "pos")
    many = ["climate"] + [f"other:{i}" for i in range(extra)]
    assert found_ms(select.include_streams(log, many)) == [0, 80, 120]
    assert found_ms(select.exclude_streams(log, many)) == [40, 75, 90, 150]
    renamed = select.rename_streams(log, {n: n.upper() for n in many})
    assert select.exclude_streams(log, many).columns == renamed.columns == log.columns
    names = sorted(r.stream_name or "" for r in renamed.collect())
    assert names == ["", "CLIMATE", "CLIMATE", "CLIMATE", "door", "door", "pump"]


def test_rename_can_merge(sample):
    renamed = select.rename_streams(sample, {"climate": "x", "door": "x"})
    assert renamed.where("stream_name = 'x'").count() == 6
    assert select.rename_streams(sample, {}) is sample


def test_read_after(make_log):
    log = make_log([("a", ms, seq) for ms in (1, 2, 3) for seq in (0, 1)] + [("b", 1)])
    new = select.read_after(log, {"a": "1-1"}, 3, "skip").select("ms", "seq").collect()
    assert sorted(tuple(r) for r in new) == [(2, 0), (2, 1), (3, 0)]
    # Stream b has no last ID, so all of it is new.
    assert select.read_after(log, {"a": "1-1"}, 3).count() == 4
    with pytest.raises(ValueError, match="missing"):
        select.read_after(log, {}, 1, missing="never")
    assert select.read_after(log, {"a": "0-0", "b": "0"}, 99).count() == 7
    with pytest.raises(ValueError, match="count"):
        select.read_after(log, {}, 0)


@pytest.mark.parametrize("count", [1, 5, 17, 1001, 3000])
def test_read_after_any_count(make_log, count):
    """Counts within, at and beyond buckets; one hot millisecond."""
    rows = [("a", i // 40 if i % 3 else 7, i) for i in range(1500)] + [("b", -i, 0) for i in range(30)]
    log = make_log(rows)
    found = select.read_after(log, {"a": "3-0"}, count, bucket_ms=5)
    expected = []
    for name, last in (("a", (3, 0)), ("b", (-99, 0))):
        own = sorted((ms, seq) for s, ms, seq in rows if s == name and (ms, seq) > last)
        expected += [(name, *x) for x in own[:count]]
    assert sorted((r.stream_name, r.ms, r.seq) for r in found.collect()) == sorted(expected)


@pytest.mark.parametrize("count", [1, 40, 530, 2000])
def test_read_after_refines_only_the_last_bucket(make_log, monkeypatch, count):
    """One hot millisecond, one hot ID in several recordings, one hot recording."""
    rows = [("a", 5, i % 90) for i in range(600)]
    rows += [("b", 9, 3, f"r{i % 7}") for i in range(500)] + [("b", 1, i) for i in range(30)]
    rows += [("c", 2, 0) for _ in range(400)] + [("d", i * 10**9, 2**62 - i) for i in range(650)]
    log = make_log(rows, step=10**12)
    monkeypatch.setattr(select, "PARTS", 4)
    found = select.read_after(log, {}, count, bucket_rows=16)
    kept = sorted((r.stream_name, r.ms, r.seq, r.recording, r.pos) for r in found.collect())
    expected = []
    for name in "abcd":
        own = sorted(tuple(r) for r in log.select("stream_name", "ms", "seq", "recording", "pos").collect() if r[0] == name)
        expected += own[:count]
    assert kept == expected
    cuts = select._cuts(log, count, select.READ_BUCKET_MS, 16).collect()
    assert all(r._rows <= 16 for r in cuts)


def test_read_after_leaves_out_nameless_messages(make_log):
    log = make_log([("a", 1), ("a", 2)])
    nameless = log.withColumn("stream_name", F.when(F.col("ms") > 1, F.col("stream_name")))
    assert [r.ms for r in select.read_after(nameless, {}, 5).collect()] == [2]
    assert select.read_after(log.limit(0), {"a": "0"}, 5).count() == 0


def test_read_after_walks_the_whole_stream(make_log):
    log = make_log([("a", i // 3, i % 3) for i in range(10)])
    seen, taken = {"a": "0-0"}, 1
    while rows := select.read_after(log, seen, 4).collect():
        taken += len(rows)
        last = max((r.ms, r.seq) for r in rows)
        seen = {"a": "{}-{}".format(*last)}
    assert taken == 10


def test_stream_keys():
    assert stream_keys(["a", {"key": "b"}, "a"]) == ["a", "b"]
    with pytest.raises(TypeError):
        stream_keys([7])


# ---- malformed input ----


def test_parse_modes(spark):
    raw = spark.createDataFrame([("1-2",), ("x",), (None,)], "id string")
    assert [tuple(r) for r in select.parse_ids(raw, "id").collect()] == [("1-2", 1, 2)]
    kept = select.parse_ids(raw, "id", "permissive").collect()
    assert [tuple(r) for r in kept] == [
        ("1-2", 1, 2, None),
        ("x", None, None, "x"),
        (None, None, None, None),
    ]
    with pytest.raises(Exception, match="invalid message ID"):
        select.parse_ids(raw, "id", "FAILFAST").collect()
    with pytest.raises(ValueError, match="unknown mode"):
        select.parse_ids(raw, "id", "other")


def test_drop_undecodable(spark):
    raw = spark.createDataFrame(
        [
            (b"s", b"1-0", {b"k": b"v"}),
            (b"\xff", b"1-0", {}),
            (b"s", b"\xff", {}),
            (b"s", b"1-0", {b"\xff": b"v"}),
            (b"s", b"1-0", {b"k": b"\xff"}),
            (b"s", b"2-0", {b"k": None}),
        ],
        "stream_name binary, id binary, fields map<binary,binary>",
    )
    found = select.drop_undecodable(raw)
    assert [tuple(r) for r in found.collect()] == [
        ("s", "1-0", {"k": "v"}),
        ("s", "2-0", {"k": None}),
    ]


def test_message_log_projection(spark):
    df = spark.createDataFrame(
        [("s", 1, 2, {"a": "b"}, None, 3)],
        "stream_name string, ms int, seq int, fields map<string,string>,"
        " recording string, pos int",
    )
    log = message_log(df)
    assert log.columns == MESSAGE_LOG.names
    assert log.first().recording == ""
    assert dict(log.dtypes)["ms"] == "bigint"


def test_require_positive():
    require_positive(a=1, b=None)
    with pytest.raises(ValueError, match="speed"):
        require_positive(speed=0)


# ---- flatten ----


def test_flatten(sample):
    flat = flatten.flatten_fields(sample)
    found = {key for _, _, fields in READINGS for key in fields}
    assert flat.columns == ["stream_name", "message_id", "timestamp_ms", *sorted(found)]
    pump = flat.where("stream_name = 'pump'").first()
    assert (pump.message_id, pump.note, pump.temp) == (f"{MS + 90}-0", "début", None)
    assert flatten.flatten_fields(sample, ["temp"]).columns[-1] == "temp"


def test_flatten_with_types(sample):
    flat = flatten.flatten_fields(sample, types={"temp": "double", "open": "boolean", "note": "int"})
    assert dict(flat.dtypes)["temp"] == "double"
    rows = flat.orderBy("timestamp_ms").collect()
    assert [r.temp for r in rows][:2] == [21.5, 21.6]
    assert [r.open for r in rows if r.stream_name == "door"] == [True, False]
    assert {r.note for r in rows} == {None}


def test_reserved_and_twin_names(make_log):
    reserved = make_log([("s", 1)], fields=[{"message_id": "m"}])
    with pytest.raises(ValueError, match="base column"):
        flatten.flatten_fields(reserved)
    kept = flatten.flatten_fields(reserved, prefix_reserved=True).first()
    assert (kept.message_id, kept.field_message_id) == ("1-0", "m")
    twins = make_log([("s", 1)], fields=[{"a": "1", "A": "2"}])
    with pytest.raises(ValueError, match="differ only by case"):
        flatten.flatten_fields(twins)


def test_key_discovery_is_bounded(make_log):
    log = make_log([("s", i) for i in range(5)], fields=[{f"k{i}": ""} for i in range(5)])
    with pytest.raises(ValueError, match="more than 3"):
        flatten.discover_keys(log, max_keys=3)
    assert flatten.discover_keys(log, max_keys=5) == [f"k{i}" for i in range(5)]


# ---- limits ----


def sizes(count):
    return [len(packing.pack_record("s", f"{i}-0", {"n": str(i)})) for i in range(count)]


@pytest.mark.parametrize("bucket_rows", [16, 1000])
@pytest.mark.parametrize("limit", [1, 14, 100, 400, 10_000])
def test_size_limit_like_a_loop(make_log, bucket_rows, limit):
    count, step = 40, 3
    written = taken = 0
    each = sizes(count)
    while taken < count and written < limit:
        written += each[taken]
        taken += 1
    log = make_log([("s", i) for i in range(count)], step=step)
    mb = (limit + 0.5) / 1024 / 1024
    kept = bounded_capture(log, mb, bucket_rows=bucket_rows)
    assert sorted(r.ms for r in kept.select("ms").collect()) == list(range(taken))


def test_duration_limit(make_log):
    rows = [("s", ms, 0, name) for name in "ab" for ms in (1000, 1400, 2100, 1200)]
    log = make_log(rows)
    assert [r.ms for r in bounded_capture(log, max_duration=1).collect()] == [1000, 1400]
    assert bounded_capture(log, max_duration=5).count() == 8
    both = bounded_capture(log, max_size_mb=5e-6, max_duration=1)
    assert both.count() == 1
    with pytest.raises(ValueError, match="max_duration"):
        bounded_capture(log, max_duration=0)


def test_limit_follows_arrival_not_row_order(make_log):
    log = make_log([("s", 9), ("s", 3), ("s", 5)]).orderBy(F.desc("pos"))
    assert [r.ms for r in bounded_capture(log, max_size_mb=1e-6).collect()] == [9]
