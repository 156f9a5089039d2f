"""Capture jobs: restart, limits, allow-list, live statistics, rotation, exports."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from tidelog.operators import stats
from tidelog.plans.storage import new_table, shared_folder
from tidelog.schema import MESSAGE_LOG
from tidelog.sources import packing, sinks
from tidelog.streaming import capture
from tidelog.streaming.versions import VersionedTable


@pytest.fixture
def inbox(tmp_path, make_log):
    """A folder that receives one file of messages at a time."""
    path = tmp_path / "inbox"
    path.mkdir()
    sent = []

    def deliver(rows):
        first = sum(sent)
        log = make_log(rows).withColumn("pos", F.col("pos") + first)
        log.coalesce(1).write.mode("append").parquet(str(path))
        sent.append(len(rows))

    deliver.path = str(path)
    return deliver


def stream(spark, inbox, files_per_trigger=1):
    return capture.table_stream(
        spark, inbox.path, "*.parquet", MESSAGE_LOG, files_per_trigger
    )


def rows(spark, path):
    return sorted((r.stream_name, r.ms, r.pos) for r in spark.read.parquet(path).collect())


def test_restart_neither_loses_nor_repeats(spark, inbox, tmp_path):
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    expected = []
    for part in range(3):
        new = [("a", part * 10 + i) for i in range(4)]
        inbox(new)
        expected += [("a", ms, len(expected) + i) for i, (_, ms) in enumerate(new)]
        capture.start_capture(stream(spark, inbox), out, offsets).awaitTermination()
        assert rows(spark, out) == sorted(expected)
    capture.start_capture(stream(spark, inbox), out, offsets).awaitTermination()
    assert rows(spark, out) == sorted(expected)


def test_only_listed_streams(spark, inbox, tmp_path):
    inbox([("a", 1), ("b", 2), ("a", 3)])
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    query = capture.start_capture(stream(spark, inbox), out, offsets, ["a"])
    query.awaitTermination()
    assert [r[1] for r in rows(spark, out)] == [1, 3]


def test_status_counts_all_triggers(spark, inbox, tmp_path):
    inbox([("a", 1), ("b", 2)])
    inbox([("a", 3)])
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    status = capture.CaptureStatus()
    spark.streams.addListener(status)
    try:
        query = capture.start_capture(stream(spark, inbox), out, offsets, ["a"])
        query.awaitTermination()
        deadline = time.monotonic() + 30
        while str(query.id) not in status.ended and time.monotonic() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(status)
    assert status.counts[str(query.id)] == {"kept": 2, "dropped": 1}


@pytest.mark.parametrize("missing", ["earliest", "skip"])
@pytest.mark.parametrize("as_table", [False, True])
def test_start_after(spark, inbox, tmp_path, as_table, missing):
    inbox([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 9)])
    last = {"a": "2-0", "b": "0-0"}
    if as_table:
        last = spark.createDataFrame(
            [("a", 2, 0), ("b", 0, 0)], "stream_name string, ms bigint, seq bigint"
        )
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    new = capture.start_after(stream(spark, inbox), last, missing)
    capture.start_capture(new, out, offsets).awaitTermination()
    late = [("c", 9)] if missing == "earliest" else []
    assert [r[:2] for r in rows(spark, out)] == [("a", 3), ("b", 1), *late]


def test_start_after_words(spark, inbox):
    messages = spark.createDataFrame([], MESSAGE_LOG)
    assert capture.start_after(messages, "earliest") is messages
    with pytest.raises(ValueError, match="earliest"):
        capture.start_after(messages, "newest")


def size(log_rows):
    return sum(
        len(packing.pack_record(name, f"{ms}-0", {"n": str(i)}))
        for i, (name, ms) in enumerate(log_rows)
    )


def test_size_limit_stops_and_can_be_resumed(spark, inbox, tmp_path):
    parts = [[("a", part * 10 + i) for i in range(5)] for part in range(4)]
    for part in parts:
        inbox(part)
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    limit = (size(parts[0]) + 1) / 1024 / 1024

    def run(mb):
        return capture.capture_with_limits(stream(spark, inbox), out, offsets, ["a"], mb)

    assert run(limit).reason == "max_size_mb"
    captured = spark.read.parquet(out)
    # The limit is checked before a batch, so the second batch overshoots it.
    assert captured.count() == 10
    assert spark.read.parquet(f"{out}-sizes").count() == 2
    assert run(None).reason == "end of input"
    assert spark.read.parquet(out).count() == 20
    assert spark.read.parquet(out).select("pos").distinct().count() == 20


def test_limited_capture_counts_dropped_streams(spark, inbox, tmp_path):
    inbox([("a", 1), ("x", 2), ("x", 3)])
    inbox([("x", 4), ("y", 5)])
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    lines = []
    done = capture.capture_with_limits(
        stream(spark, inbox), out, offsets, ["a"], report=lines.append
    )
    assert (done.kept, done.dropped) == (1, 4)
    dropped = spark.read.parquet(f"{out}-dropped").groupBy("stream_name").sum("dropped")
    assert {tuple(r) for r in dropped.collect()} == {("x", 3), ("y", 1)}
    assert len(lines) == 2
    assert spark.read.parquet(out).count() == 1


def test_duration_limit_ends_a_running_capture(spark, inbox, tmp_path):
    inbox([("a", 1)])
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    result = capture.capture_with_limits(
        stream(spark, inbox), out, offsets, ["a"], max_duration=8, once=False
    )
    assert result.reason == "max_duration"
    assert 8 <= result.seconds < 60
    assert spark.read.parquet(out).count() == 1


def test_live_stats_follow_the_capture(spark, inbox, tmp_path):
    table, offsets = str(tmp_path / "stats"), str(tmp_path / "offsets")
    for part in range(2):
        inbox([("a", 100 - part), ("b", part), ("a", 50 + part)])
        capture.start_live_stats(stream(spark, inbox), table, offsets).awaitTermination()
        now = capture.live_stats(spark, table).collect()
        assert now == stats.stream_stats(spark.read.parquet(inbox.path)).collect()
    assert [r.messages for r in now] == [4, 2]


def test_live_stats_stay_small(spark, inbox, tmp_path):
    """Fifty micro-batches, of which few change many rows."""
    table, offsets = tmp_path / "stats", str(tmp_path / "offsets")
    for part in range(50):
        names = [f"s{k}" for k in range(40)] if part % 20 == 0 else [f"s{part % 40}", "s0"]
        inbox([(name, part * 100 + i) for i, name in enumerate(names)])
    capture.start_live_stats(stream(spark, inbox), str(table), offsets).awaitTermination()
    assert len(os.listdir(table / "runs")) <= 12
    assert len([n for n in os.listdir(table / "manifests") if n.endswith(".json")]) <= 4
    kept = VersionedTable(spark, str(table), ["stream_name", "recording"])
    runs = kept._runs(kept._manifests()[-1])
    state = stats.recording_stats(spark.read.parquet(inbox.path), ["ms"]).count()
    assert sum(run.rows for run in runs) <= 2 * state
    expected = stats.stream_stats(spark.read.parquet(inbox.path)).collect()
    assert capture.live_stats(spark, str(table)).collect() == expected


def test_versions_of_a_trigger_count_once(spark, tmp_path):
    kept = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    assert kept.rows() is None

    def add(number, *rows):
        kept.add(spark.createDataFrame(rows, "k string, v int"), number)

    add(0, ("a", 1), ("b", 1), ("c", 1), ("d", 1), (None, 1))
    add(1, ("a", 2))
    add(1, ("a", 99))
    add(2, (None, 3))
    found = {(r.k, r.v) for r in kept.rows().collect()}
    assert found == {("a", 2), ("b", 1), ("c", 1), ("d", 1), (None, 3)}
    with pytest.raises(ValueError, match="published"):
        capture.live_stats(spark, str(tmp_path / "none"))


# ---- tables ----


def test_append_keeps_duplicates_and_refuses_its_own_input(spark, sample, tmp_path):
    path = str(tmp_path / "log")
    sinks.write_log(sample, path)
    sinks.write_log(sample, path, by_time=True)
    both = spark.read.parquet(path)
    assert both.count() == 14
    with pytest.raises(ValueError, match="is read by the rows"):
        sinks.write_log(both, path)


def test_rotation(spark, make_log, tmp_path):
    path = str(tmp_path / "rotated")
    log = make_log([("s", ms) for ms in (0, 999, 1000, 2500, 2999)])
    sinks.write_rotated(log, path, 1000)
    found = spark.read.parquet(path).groupBy("rotation").count().collect()
    assert {tuple(r) for r in found} == {(0, 2), (1, 1), (2, 2)}


def test_rotation_while_capturing(spark, inbox, tmp_path):
    inbox([("s", 10), ("s", 1500)])
    inbox([("s", 20), ("s", 2500)])
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    messages = stream(spark, inbox)
    capture.start_capture(messages, out, offsets, rotate_ms=1000).awaitTermination()
    found = spark.read.parquet(out).groupBy("rotation").count().collect()
    assert {tuple(r) for r in found} == {(0, 2), (1, 1), (2, 1)}


def test_export_of_nothing_writes_nothing(empty_log, tmp_path):
    assert sinks.export(empty_log, str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError, match="format"):
        sinks.export(empty_log, str(tmp_path / "none"), "xml")


TEXTS = ['say "hi"', "a,b", "two\nlines", "  padded  ", "back\\slash", "", None, '"', "\\", "é,\"\n"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export_keeps_every_text(spark, make_log, tmp_path, fmt):
    log = make_log([("s", i) for i in range(len(TEXTS))], fields=[{"t": t} for t in TEXTS])
    path = str(tmp_path / "out")
    assert sinks.export(log, path, fmt)
    if fmt == "csv":
        columns = ["stream_name", "message_id", "timestamp_ms", "t"]
        back = sinks.read_csv_export(spark, path, columns)
    else:
        back = spark.read.parquet(path)
    assert {r.message_id: r.t for r in back.collect()} == {
        f"{i}-0": text for i, text in enumerate(TEXTS)
    }


# ---- the shared folder ----


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_table(spark, "x") != new_table(spark, "x")
