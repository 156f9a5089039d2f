"""Recordings as a stream: growing files, restarts, the cap per stream."""

from __future__ import annotations

import json
from collections import Counter

import pytest

from tidelog.sources import packing
from tidelog.sources.following import Follower
from tidelog.sources.recordings import follow_recordings, register, write_recordings


def records(stream, first, count):
    return [packing.pack_record(stream, f"{i}-0", {"v": "x" * (i % 7)}) for i in range(first, first + count)]


def run(spark, folder, out, most):
    followed = follow_recordings(spark, str(folder), f"{out}/plans", most)
    query = (
        followed.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/offsets")
        .option("path", f"{out}/rows")
        .start()
    )
    query.processAllAvailable()
    batches = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    query.stop()
    return batches


def test_growing_files_and_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out = str(tmp_path)
    whole = records("a", 0, 30) + records("b", 30, 5)
    data = b"".join(whole)
    (folder / "one.msgpack").write_bytes(data[: len(data) // 2])
    assert sum(run(spark, folder, out, 8)) < len(whole)
    (folder / "one.msgpack").write_bytes(data)
    (folder / "two.msgpack").write_bytes(b"".join(records("a", 100, 9)) + b"\xc1" + whole[0])
    run(spark, folder, out, 8)
    with open(folder / "one.msgpack", "ab") as file:
        file.write(b"\x92\xa1s\xa31-0" + b"".join(records("c", 200, 3)))
    run(spark, folder, out, 8)
    assert run(spark, folder, out, 8) == []
    rows = spark.read.parquet(f"{out}/rows").collect()
    found = sorted((r.recording, r.pos, r.stream_name, r.ms) for r in rows)
    expected = [("one.msgpack", i, "a" if i < 30 else "b", i) for i in range(35)]
    expected += [("one.msgpack", 36 + i, "c", 200 + i) for i in range(3)]
    expected += [("two.msgpack", i, "a", 100 + i) for i in range(9)]
    assert found == expected


def test_batches_end_between_records_and_at_the_cap(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes(b"".join(records("hot", 0, 90) + records("cold", 90, 2)))
    (folder / "b").write_bytes(b"".join(records("cold", 0, 4) + records("hot", 60, 1)))
    columns = ["stream_name", "ms"]

    def follower():
        return Follower(str(folder), columns, str(tmp_path / "plans"), 20, False)

    one, at, seen = follower(), {"files": "{}"}, Counter()
    for step in range(12):
        if step == 1:  # a restart before Spark is known to have the second plan
            one = follower()
            lost = one.latestOffset()
            one = follower()
            assert one.latestOffset() == lost
            end = lost
        else:
            end = one.latestOffset()
        if step == 2:  # and one after it has taken the third over
            one.commit(at)
            one = follower()
            assert one.latestOffset() != end
            break
        taken = Counter()
        for part in one.partitions(at, end):
            for batch in one.read(part):
                assert batch.schema.names == columns
                taken.update(batch["stream_name"].to_pylist())
        assert max(taken.values()) <= 20
        seen += taken
        at = end
    one = follower()
    at, seen = {"files": "{}"}, Counter()
    one.planned = at
    while (end := one.latestOffset()) != at:
        for part in one.partitions(at, end):
            for batch in one.read(part):
                seen.update(batch["stream_name"].to_pylist())
        at = end
    assert seen == {"hot": 91, "cold": 6}
    assert {k.rsplit("/", 1)[1]: v[:2] for k, v in json.loads(at["files"]).items()} == {
        "a": [(folder / "a").stat().st_size, 92],
        "b": [(folder / "b").stat().st_size, 5],
    }
    assert len(list((tmp_path / "plans").glob("*.json"))) <= 4


def test_committed_folder(spark, make_log, tmp_path):
    path = str(tmp_path / "in")
    write_recordings(make_log([("s", i) for i in range(40)]), path)
    (tmp_path / "in" / "part-failed-0-0.msgpack").write_bytes(b"".join(records("lost", 0, 3)))
    run(spark, path, str(tmp_path), 1000)
    rows = spark.read.parquet(str(tmp_path / "rows")).orderBy("recording", "pos").collect()
    assert [r.ms for r in rows] == list(range(40))
    register(spark)
    reader = spark.readStream.format("recording").option("plans", str(tmp_path / "p"))
    with pytest.raises(Exception, match="maxMessagesPerStream"):
        reader.option("maxMessagesPerStream", 0).load(path).writeStream.format("noop").start().processAllAvailable()


def test_a_batch_opens_few_files_and_none_waits(tmp_path):
    """A batch ends in the file where a stream has its share; the next one begins after it."""
    folder = tmp_path / "in"
    folder.mkdir()
    for number in range(5):
        (folder / f"{number}").write_bytes(b"".join(records("cold", 0, 1) + records("hot", 0, 30)))
    one, at, seen, visited = Follower(str(folder), ["stream_name"], str(tmp_path / "plans"), 20, False), None, 0, []
    at = one.initialOffset()
    while (end := one.latestOffset()) != at:
        parts = one.partitions(at, end)
        visited.append([part.name for part in parts])
        taken = Counter()
        for part in parts:
            for batch in one.read(part):
                taken.update(batch["stream_name"].to_pylist())
        assert max(taken.values()) <= 20
        seen += taken.total()
        if len(visited) == 1:  # a file that goes on growing holds up no other
            with open(folder / "0", "ab") as file:
                file.write(b"".join(records("hot", 100, 30)))
        at = end
    assert seen == 5 * 31 + 30
    assert visited[:5] == [["0"], ["1"], ["2"], ["3"], ["4"]]
    assert max(map(len, visited)) <= 3
