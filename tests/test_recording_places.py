"""Places of records: cuts without sync marks, indexes, commits, the data source."""

from __future__ import annotations

import io
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidelog.functions.ids import MessageID
from tidelog.plans.scan import number_by_arrival
from tidelog.schema import MESSAGE_LOG
from tidelog.sources import chains, packing, recordings, zones
from tidelog.sources.recordings import (
    index_recordings,
    read_recordings,
    recording_table,
    register,
    write_recordings,
)


class Counted(io.BytesIO):
    """A file that counts the bytes read from it."""

    count = 0

    def read(self, size=-1):
        got = super().read(size)
        Counted.count += len(got)
        return got


# ---- cuts -------------------------------------------------------------------


def objects(draw, count, long):
    made = []
    for i in range(count):
        kind = draw.random()
        inner = b"".join(packing.pack_record("in", f"{k}-0", {"k": "v"}) for k in range(draw.randint(1, 9)))
        if kind < 0.6:
            made.append(packing.pack_record(f"s{i % 3}", f"{i}-1", {"t": "x" * draw.randint(0, 40)}))
        elif kind < 0.75:
            made.append(packing.pack_record("s", f"{i}", {"a": "–ی" * draw.randint(1, long), "b": None, "c": "d"}))
        elif kind < 0.85:
            raw = b"\xc5" + len(inner).to_bytes(2, "big") + inner
            made.append(b"\x93\xa1s\xa31-0\x81\xa3raw" + raw)
        elif kind < 0.92:
            made.append(packing.pack_record("s", f"{i}-0", None))
        else:
            made.append(draw.choice([b"\x92\xa1s\xa31-0", b"\xc0", b"\x07", b"\x93\xa1s\xa1x\x80", b"\xd9\x02ab"]))
    return made


def composed(data, split):
    def open_cut(low, number):
        return chains.Cut(Counted(data), len(data), low, (number + 1) * split)

    cuts = [
        chains.Known("f", len(data), n, open_cut(n * split, n).chains()) for n in range(-(-len(data) // split))
    ]
    again = []

    def reopened(cut, at):
        again.append(cut.cut)
        return open_cut(at, cut.cut).chain(at)

    found = list(chains.placed(cuts, split, reopened))
    assert len(again) == len(set(again))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_cuts_compose_to_the_whole(seed):
    draw = random.Random(seed)
    made = objects(draw, 80, draw.choice([5, 200]))
    if seed % 3 == 0:
        made.insert(50, b"\xc1")
    data = b"".join(made)
    if seed % 3 == 1:
        data = data[: -draw.randint(1, 5)]
    ends, at = [], 0
    try:
        for after, _ in packing.objects(io.BytesIO(data), 0, len(data), packing.skip):
            ends.append((at, after))
            at = after
    except packing.Corrupt:
        pass
    for split in (1, 3, 17, 64, 300, 1000, 5000, len(data)):
        found = composed(data, split)
        assert [p.pos for p in found] == [i for i, (start, _) in enumerate(ends) if start in {p.start for p in found}]
        covered = []
        for place in found:
            inside = [e for e in ends if place.start <= e[0] < place.end]
            assert inside[0][0] == place.start and inside[-1][1] == place.end
            assert all(e[0] // split == place.cut for e in inside)
            covered += inside
        assert covered == ends


@pytest.mark.parametrize("size", [3_000, 400_000, 5_000_000])
def test_bytes_read_are_bounded(size):
    """Finding and decoding the records reads a file twice, whatever their size."""
    draw = random.Random(4)
    text = "".join(draw.choices("abcdefgh –ی\x93", k=size // 2))
    data = b"".join(packing.pack_record("s", f"{i}-0", {"t": text, "u": str(i)}) for i in range(4_000_000 // size + 3))
    split = 100_000
    Counted.count = 0
    found = composed(data, split)
    beyond = 8 * chains.BEYOND * len(found)
    assert Counted.count <= len(data) + beyond
    records = 0
    for place in found:
        file = Counted(data)
        records += sum(1 for _ in packing.objects(file, place.start, place.end, packing.unpack, whole=True))
    assert records == 4_000_000 // size + 3
    assert Counted.count <= 2 * len(data) + beyond


# ---- indexes ----------------------------------------------------------------


def many_zones(count, seed=5):
    draw = random.Random(seed)
    made, at, pos = [], 0, 0
    for i in range(count):
        size, records = draw.randint(10, 99), draw.randint(1, 9)
        first = MessageID(draw.randint(0, 50) + i // 3, draw.randint(0, 3))
        last = max(first, MessageID(first.ms + draw.randint(0, 20), draw.randint(0, 3)))
        streams = zones.mask_of(draw.sample([f"s{k}" for k in range(30)], draw.randint(1, 4)))
        made.append(zones.Zone(at, at + size, pos, records, first, last, streams))
        at, pos = at + size, pos + records
    return made, at


@pytest.mark.parametrize("count", [1, 64, 65, 700, 5000])
def test_search_against_all_zones(count):
    made, size = many_zones(count)
    file = io.BytesIO()
    zones.write_index(file, made, size)
    data = file.getvalue()
    assert zones.opened(io.BytesIO(data), len(data), size + 1) is None
    assert zones.opened(io.BytesIO(data[:-3]), len(data) - 3, size) is None
    draw = random.Random(1)
    for _ in range(40):
        low = MessageID(draw.randint(0, count // 3 + 60), draw.randint(0, 2))
        streams = draw.choice([None, frozenset(["s1", "s7"]), frozenset(["other"]), frozenset()])
        wanted = zones.Wanted(low, MessageID(low.ms + draw.randint(0, 9)), streams)
        index = zones.opened(Counted(data), len(data), size)
        Counted.count = 0
        expected = [zone for zone in made if wanted.may_match(zone, wanted.mask)]
        assert list(index.search(wanted)) == expected
        assert Counted.count <= (len(expected) + 2 + count // 4096) * zones.FANOUT * zones.NODE.size * 2
        runs = list(index.runs(wanted, 200))
        assert sum(end - start for start, end, _ in runs) == sum(z.end - z.start for z in expected)
        assert all(any((start, pos) == (z.start, z.pos) for z in expected) for start, _, pos in runs)
    assert list(zones.opened(io.BytesIO(data), len(data), size).search(zones.Wanted())) == made


def test_only_matching_blocks_are_opened(spark, make_log, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    log = make_log(
        [(f"s{i // 2500}", 1000 + i) for i in range(10_000)], fields=[{"t": "x" * 300, "i": str(i)} for i in range(10_000)]
    )
    write_recordings(log.coalesce(1), path)
    for file in os.listdir(f"{path}/.zones"):
        os.remove(f"{path}/.zones/{file}")
    assert index_recordings(spark, path, block_bytes=20_000) == len([f for f in os.listdir(path) if f[0] != "."])
    assert index_recordings(spark, path) == 0

    def opened(wanted):
        made = 0
        for file in os.listdir(path):
            if file[0] != ".":
                size = os.path.getsize(f"{path}/{file}")
                ranges = recordings._ranges_of(f"{path}/{file}", file, size, wanted, 1 << 20)
                made += sum(row[4] - row[3] for row in ranges)
        return made

    whole = opened(zones.Wanted())
    narrow = zones.Wanted(MessageID(2000), MessageID(2099))
    assert whole > 3_000_000 and opened(narrow) < 100_000
    assert opened(zones.Wanted(streams=frozenset(["s3"]))) < whole / 3
    for bounds in ({"from_id": "2000", "to_id": "2099"}, {"streams": ["s3", "none"]}, {"to_id": "1400-0", "streams": ["s0"]}):
        found = read_recordings(spark, path, **bounds)
        expected = log
        if "from_id" in bounds:
            expected = expected.where("ms >= 2000")
        if "to_id" in bounds:
            expected = expected.where(F.col("ms") <= int(bounds["to_id"].split("-")[0]))
        if "streams" in bounds:
            expected = expected.where(F.col("stream_name").isin(bounds["streams"]))
        columns = ["stream_name", "ms", "seq", "fields"]
        assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))
    assert read_recordings(spark, path, streams=[]).count() == 0
    with pytest.raises(ValueError, match="empty range"):
        read_recordings(spark, path, from_id="2", to_id="1")


def test_index_of_foreign_files(spark, tmp_path):
    """Malformed records count for places, and a file that has grown has no index."""
    good = [packing.pack_record("s", f"{i}-0", {"v": str(i)}) for i in range(30)]
    data = b"".join(good[:10]) + b"\x92\xa1s\xa31-0" + b"".join(good[10:]) + good[0][:-1]
    file = tmp_path / "a.msgpack"
    file.write_bytes(data)
    (tmp_path / "bad.msgpack").write_bytes(b"\xc1")
    assert index_recordings(spark, str(tmp_path), split_bytes=50, block_bytes=40) == 1
    for bounds in ({}, {"from_id": "7", "to_id": "12"}):
        found = read_recordings(spark, str(tmp_path), split_bytes=50, **bounds).orderBy("pos").collect()
        kept = range(30) if not bounds else range(7, 13)
        assert [(r.ms, r.pos) for r in found] == [(i, i + (i >= 10)) for i in kept]
    everything = read_recordings(spark, str(tmp_path), "PERMISSIVE", split_bytes=50)
    assert everything.where("_corrupt_record is not null").collect()[0].pos == 10
    file.write_bytes(data[: len(data) - len(good[0]) + 1] + good[5])
    assert read_recordings(spark, str(tmp_path), from_id="5", to_id="5").count() == 2
    assert index_recordings(spark, str(tmp_path / "nothing")) == 0


# ---- commits ----------------------------------------------------------------


def test_null_maps_and_empty_logs(spark, empty_log, tmp_path):
    path = str(tmp_path / "out")
    rows = [("s", 1, 0, None, "r", 0), ("s", 2, 0, {}, "r", 1), ("é" * 40, 3, 4, {"k": None, "": "x" * 70_000}, "r", 2)]
    write_recordings(spark.createDataFrame(rows, MESSAGE_LOG), path)
    write_recordings(empty_log, path)
    found = read_recordings(spark, path).orderBy("pos").collect()
    assert [tuple(r)[:4] for r in sorted(found, key=lambda r: r.ms)] == [r[:4] for r in rows]


def test_parts_without_a_commit_do_not_count(spark, make_log, tmp_path):
    path = str(tmp_path / "out")
    write_recordings(make_log([("s", i) for i in range(20)]), path)
    lost = packing.pack_record("lost", "1-0", {})
    (tmp_path / "out" / "part-failed-00000000-7.msgpack").write_bytes(lost)
    register(spark)
    assert read_recordings(spark, path).where("stream_name = 'lost'").count() == 0
    assert read_recordings(spark, path + "/*").where("stream_name = 'lost'").count() == 0
    assert spark.read.format("recording").load(path).count() == 20
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "part-failed-00000000-7.msgpack").write_bytes(lost)
    assert read_recordings(spark, str(tmp_path / "*")).where("stream_name = 'lost'").count() == 1


def test_calls_at_the_same_time_get_an_order(spark, make_log, tmp_path):
    path = str(tmp_path / "out")
    logs = [make_log([(f"s{k}", k * 1000 + i) for i in range(50)]) for k in range(4)]
    threads = [threading.Thread(target=write_recordings, args=(log, path)) for log in logs]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    entries = sorted(os.listdir(f"{path}/.commits"))
    assert entries == [f"{n:010d}.json" for n in range(1, 5)]
    rows = number_by_arrival(read_recordings(spark, path)).orderBy("arrival").collect()
    calls = [r.ms // 1000 for r in rows]
    assert len(rows) == 200 and sum(a != b for a, b in zip(calls, calls[1:], strict=False)) == 3
    for k in range(4):
        assert [r.ms for r in rows if r.ms // 1000 == k] == [k * 1000 + i for i in range(50)]


# ---- the data source --------------------------------------------------------


@pytest.fixture
def pushing(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return session


def test_pushed_filters(spark, pushing, make_log, tmp_path):
    path = str(tmp_path / "out")
    for call in range(2):
        write_recordings(make_log([(f"s{i % 5}", call * 100 + i, i % 2) for i in range(300)]), path)
    found = recording_table(pushing, path)
    condition = "ms >= 50 and ms < 250 and ms > 60 and ms <= 240 and stream_name in ('s1', 's2') and seq = 1"
    kept = found.where(condition)
    plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    for part in ("GreaterThanOrEqual(ms,50)", "LessThan(ms,250)", "In(stream_name, [s1,s2])"):
        assert part in pushed
    expected = read_recordings(spark, path)
    assert sorted(map(str, kept.collect())) == sorted(map(str, expected.where(condition).collect()))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert found.where("stream_name = 's3'").count() == expected.where("stream_name = 's3'").count()
    assert found.where("stream_name = 's3' and ms = 8").count() == 1
    found.createOrReplaceTempView("recorded")
    assert pushing.sql("select count(*) n from recorded where ms = 7").first().n == 1
    assert pushing.sql("select count(*) n from recorded").first().n == 600
    few = recording_table(pushing, path, ["ms", "stream_name"])
    assert few.columns == ["ms", "stream_name"]
    assert few.groupBy("stream_name").count().count() == 5
    register(spark)
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("recording").schema("ms bigint, other string").load(path).collect()
    one = spark.read.format("recording").load(f"{path}/{next(f for f in os.listdir(path) if f[0] != '.')}")
    assert one.count() > 0


def test_source_of_odd_folders(spark, tmp_path):
    register(spark)
    assert spark.read.format("recording").load(str(tmp_path / "nothing")).count() == 0
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.msgpack").write_bytes(b"\x92\xa1s\xa31-0" + packing.pack_record("s", "1-0", None))
    (tmp_path / "empty.msgpack").write_bytes(b"")
    assert spark.read.format("recording").load(str(tmp_path)).count() == 0
    row = spark.read.format("recording").option("recursiveFileLookup", True).load(str(tmp_path)).collect()
    assert [(r.recording, r.pos, r.fields) for r in row] == [("sub/a.msgpack", 1, None)]
