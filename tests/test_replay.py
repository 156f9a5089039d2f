"""Replay schedules against literal cases and a plain-Python replay loop."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from readings import READINGS
from tidelog.operators import replay, stats
from tidelog.plans.scan import carried, carried_in_blocks, number_by_arrival, number_within


def order(df):
    return [r.stream_name for r in df.orderBy("replay_no").collect()]


def replayed(rows, batch_size):
    """Streams in replay order, by a plain loop: each batch sorted by time, ties by arrival."""
    out = []
    for first in range(0, len(rows), batch_size):
        out += [name for name, _ in sorted(rows[first : first + batch_size], key=lambda r: r[1])]
    return out


SHUFFLED = [("m", 70), ("k", 20), ("m", 50), ("k", 20), ("n", 90), ("n", 10), ("m", 15)]


@pytest.mark.parametrize("batch_size", [1, 2, 3, 7, 100])
def test_sorted_within_each_batch(make_log, batch_size):
    found = replay.replay_order(make_log(SHUFFLED), batch_size=batch_size)
    assert order(found) == replayed(SHUFFLED, batch_size)


def test_short_last_batch(make_log):
    log = make_log([("s", i * 7) for i in range(11)])
    sizes = Counter(r.batch for r in replay.replay_order(log, batch_size=4).collect())
    assert sizes == {0: 4, 1: 4, 2: 3}


def test_exclude_and_rename(make_log):
    log = make_log(SHUFFLED)
    kept = [row for row in SHUFFLED if row[0] != "n"]
    assert order(replay.replay_order(log, batch_size=2, exclude=["n"])) == replayed(kept, 2)
    renamed = replay.replay_order(log, batch_size=3, rename={"m": "other"})
    names = [("other" if name == "m" else name, ms) for name, ms in SHUFFLED]
    assert order(renamed) == replayed(names, 3)


def test_whole_sample(sample):
    assert replay.replay_schedule(sample).count() == len(READINGS)


def test_bad_arguments(sample):
    for bad in ({"speed": 0}, {"max_delay": -1}, {"batch_size": 0}):
        with pytest.raises(ValueError, match="greater than 0"):
            replay.replay_schedule(sample, **bad)


def test_tiny_speed_is_capped(make_log):
    log = make_log([("s", 0), ("s", 10**15)])
    found = replay.replay_delay(log, speed=1e-300, max_delay=60.0).orderBy("replay_no")
    assert [r.delay_us for r in found.collect()] == [0, 60_000_000]


def test_a_wait_too_short_to_show_still_flushes(make_log):
    log = make_log([("s", 0), ("s", 1), ("s", 1)])
    found = replay.replay_schedule(log, speed=1e9).orderBy("replay_no").collect()
    assert [(r.delay_us, r.flush_group) for r in found] == [(0, 0), (0, 1), (0, 1)]


# ---- against a plain loop ----


def wait(gap_ms, speed, max_delay):
    return math.floor(min(gap_ms * 1000 / speed, max_delay * 1e6) + 0.5)


def model(rows, batch_size, speed, max_delay, exclude, rename, base_ms):
    """Replay one message at a time, with delays in whole µs (halves go up)."""
    left = [row for row in rows if row[0] not in exclude]
    sent, previous, due, group = [], None, 0, -1
    numbers = Counter()
    for first in range(0, len(left), batch_size):
        batch = sorted(left[first : first + batch_size], key=lambda row: (row[1], row[2]))
        for place, (stream, ms, _seq, pos) in enumerate(batch):
            later = previous is not None and ms > previous
            delay = wait(ms - previous, speed, max_delay) if later else 0
            due += delay
            group += later or place == 0
            stream = rename.get(stream, stream)
            new_ms = base_ms + due // 1000
            new_seq = numbers[stream, new_ms]
            numbers[stream, new_ms] += 1
            sent.append((pos, stream, previous, delay, due, group, new_ms, new_seq))
            previous = ms
    return sent


def random_rows(seed, count):
    pick = random.Random(seed)
    hot = pick.choice([0.1, 0.5, 0.9])
    rows = []
    for pos in range(count):
        stream = "hot" if pick.random() < hot else pick.choice("abc")
        ms = pick.choice([pos // 7, pick.randrange(50), pick.randrange(10**5)])
        rows.append((stream, ms, pick.randrange(3), pos * 2))
    return rows


CASES = [
    (seed, count, batch_size, bucket_rows)
    for seed, (count, batch_size, bucket_rows) in enumerate(
        [(1, 3, 16), (60, 1, 4), (200, 7, 32), (333, 10, 40), (500, 64, 64), (120, 1000, 16)]
    )
]


@pytest.mark.parametrize(("seed", "count", "batch_size", "bucket_rows"), CASES)
@pytest.mark.parametrize("speed", [0.5, 64.0, 2.0**20])
def test_schedule_like_a_loop(make_log, seed, count, batch_size, bucket_rows, speed):
    rows = random_rows(seed, count)
    log = make_log([row[:3] for row in rows], step=2).repartition(3)
    options = {
        "speed": speed,
        "max_delay": 20.0,
        "batch_size": batch_size,
        "exclude": ["c"],
        "rename": {"a": "hot"},
        "bucket_rows": bucket_rows,
    }
    expected = model(rows, batch_size, speed, 20.0, {"c"}, {"a": "hot"}, 1000)
    found = replay.replay_schedule(log, **options).orderBy("replay_no").collect()
    assert [r.replay_no for r in found] == list(range(len(expected)))
    assert [
        (r.pos, r.stream_name, r.prev_ms, r.delay_us, r.due_us, r.flush_group) for r in found
    ] == [row[:6] for row in expected]
    delays = replay.replay_delay(log, **options).orderBy("replay_no").collect()
    assert [(r.pos, r.prev_ms, r.delay_us) for r in delays] == [
        (row[0], row[2], row[3]) for row in expected
    ]
    issued = replay.replay_reissue(log, 1000, **options).orderBy("replay_no").collect()
    assert [(r.pos, r.stream_name, r.new_ms, r.new_seq) for r in issued] == [
        (row[0], row[1], row[6], row[7]) for row in expected
    ]


@pytest.mark.parametrize("bucket_rows", [3, 10, 1000])
def test_progress_like_a_loop(make_log, bucket_rows):
    rows = random_rows(11, 97)
    log = make_log([row[:3] for row in rows], step=2)
    found = replay.replay_batches(log, 10, ["hot"], bucket_rows).orderBy("batch").collect()
    left = [row for row in rows if row[0] != "hot"]
    first, last, done = None, 0, 0
    for number, start in enumerate(range(0, len(left), 10)):
        times = sorted(row[1] for row in left[start : start + 10])
        first = times[0] if first is None else first
        last, done = max(last, times[-1]), done + len(times)
        progress = found[number]
        assert (progress.messages, progress.replayed) == (len(times), done)
        assert (progress.first_ms, progress.last_ms) == (first, last)
        assert progress.elapsed_ms == times[-1] - first
        assert progress.total_ms == max(last - first, 1)
    assert len(found) == -(-len(left) // 10)


def test_batch_summary(make_log):
    log = make_log([("a", 5), ("b", 4), ("a", 3), ("a", 2)])
    found = {tuple(r) for r in stats.batch_summary(log, 3).collect()}
    assert found == {(0, "a", 2), (0, "b", 1), (1, "a", 1)}


# ---- the ordered scan ----


@pytest.mark.parametrize("bucket_rows", [1, 5, 64, 10_000])
def test_arrival_numbers_across_recordings(make_log, bucket_rows):
    rows = [("s", i, 0, f"r{i % 3}") for i in range(100)]
    log = make_log(rows, step=5)
    numbered = number_by_arrival(log, "n", bucket_rows).collect()
    by_place = sorted(numbered, key=lambda r: (r.recording, r.pos))
    assert [r.n for r in by_place] == list(range(100))


@pytest.mark.parametrize("bucket_rows", [1, 5, 64, 10_000])
def test_numbers_within_hot_groups(make_log, bucket_rows):
    rows = random_rows(3, 150)
    log = make_log([row[:3] for row in rows], step=2)
    found = number_within(log, ["stream_name"], "n", bucket_rows).collect()
    seen = Counter()
    for row in sorted(found, key=lambda r: r.pos):
        assert row.n == seen[row.stream_name]
        seen[row.stream_name] += 1
    assert sum(seen.values()) == 150


@pytest.mark.parametrize("block_rows", [1, 4, 100])
def test_blocks_carry_like_one_partition(spark, block_rows):
    pick = random.Random(5)
    rows = [(key, pick.randrange(100), pick.randrange(100)) for key in range(0, 90, 3)]
    table = spark.createDataFrame(rows, "k bigint, a bigint, b bigint")
    plain = carried(table, ["k"], ["a"], ["b"]).orderBy("k").collect()
    blocks = carried_in_blocks(table, "k", ["a"], ["b"], block_rows).orderBy("k").collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in blocks]


@pytest.mark.parametrize("step", [1, 7, 300_000])
def test_arrival_numbers_with_sparse_positions(make_log, step):
    """Dense and sparse positions, many recordings, several carry blocks."""
    rows = [("s", i, 0, f"r{i % 13:02}") for i in range(130)]
    log = make_log(rows, step=step)
    numbered = number_by_arrival(log, bucket_rows=4).orderBy("arrival").collect()
    expected = sorted(range(130), key=lambda i: (rows[i][3], i))
    assert [r.arrival for r in numbered] == list(range(130))
    assert [r.ms for r in numbered] == expected


def test_many_range_chunks_grow_and_keep_the_order(make_log, monkeypatch):
    """Small buckets do not make a task per bucket without end."""
    assert replay._range_chunks(54_000_000, 1250) == replay.MANY_CHUNKS
    assert replay._range_chunks(10**12, 1250) == -(-(10**12) // replay.BUCKET_ROWS)
    assert replay._range_chunks(5000, 1250) == 4
    monkeypatch.setattr(replay, "MANY_CHUNKS", 3)
    rows = random_rows(5, 200)
    log = make_log([row[:3] for row in rows], step=2)
    found = replay.replay_delay(log, batch_size=100, bucket_rows=4).orderBy("replay_no").collect()
    expected = model(rows, 100, 1.0, 60.0, set(), {}, 1000)
    assert [(r.replay_no, r.pos, r.prev_ms) for r in found] == [
        (i, row[0], row[2]) for i, row in enumerate(expected)
    ]
