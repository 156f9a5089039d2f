"""Plans at cluster size: what reaches the scan, what is ordered where."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries
from tidelog.operators import replay, select, stats
from tidelog.operators.arrival import bounded_capture
from tidelog.plans import scan
from tidelog.sources import adapters, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def details(df):
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture
def stored(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    sinks.write_log(adapters.orders_log(spark, sf_dir), path, by_time=True)
    return spark.read.parquet(path)


@pytest.fixture
def no_small_sides(spark):
    """Plan as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_id_range_reaches_the_scan(stored):
    text = details(select.truncate(stored, "900000000000-1", "950000000000-2").select("ms", "seq"))
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "GreaterThanOrEqual(ms,900000000000)" in pushed
    assert "LessThanOrEqual(ms,950000000000)" in pushed
    assert "ReadSchema: struct<ms:bigint,seq:bigint>" in text


def test_computed_bounds_reach_the_scan(stored):
    for kept in (
        select.truncate(stored, auto_start=True),
        select.truncate_by_time(stored, 900000000000, 950000000000),
        bounded_capture(stored, max_duration=30 * 86400),
        bounded_capture(stored, max_size_mb=0.1),
    ):
        pushed = re.search(r"PushedFilters: (.*)", details(kept)).group(1)
        assert re.search(r"(ms|pos),\d+\)", pushed)


def test_stream_list_reaches_the_scan(stored):
    text = plan(select.include_streams(stored, ["orders:5-LOW", "orders:2-HIGH"]))
    assert "In(stream_name" in text.split("PushedFilters")[1]


def test_time_window_reaches_the_source_table(spark, sf_dir):
    text = plan(queries()["truncate_range"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts," in text.split("PushedFilters")[1]


def test_statistics_do_not_read_the_payload(stored):
    text = plan(stats.stream_stats(stored))
    assert "fields" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_row_level_statistics_are_hash_aggregates(stored):
    lines = [line for line in plan(stats.stream_stats(stored)).splitlines()]
    scans = [i for i, line in enumerate(lines) if "FileScan" in line]
    assert any("HashAggregate" in line and "partial_min_by" in line for line in lines[: scans[0]])
    assert "SortAggregate" not in plan(stats.last_ids(stored))


@pytest.mark.parametrize(
    "build",
    [
        lambda log: replay.replay_order(log, exclude=["orders:5-LOW"]),
        lambda log: replay.replay_schedule(log),
        lambda log: replay.replay_reissue(log, 0),
        lambda log: replay.replay_batches(log),
        lambda log: stats.batch_summary(log, 1000),
    ],
)
def test_no_single_partition_over_messages(stored, no_small_sides, build):
    """Below every single-partition exchange stands an aggregate per bucket."""
    lines = plan(build(stored)).splitlines()
    singles = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert singles
    for i in singles:
        below = next(line for line in lines[i + 1 :] if "Project" not in line)
        assert "HashAggregate" in below
        assert re.search(r"keys=\[[^\]]*(_bucket|_chunk|_block)", below)


@pytest.mark.parametrize(
    "build",
    [replay.replay_order, replay.replay_schedule, lambda log: replay.replay_reissue(log, 0)],
)
def test_messages_are_shuffled_once_by_bucket_and_once_by_chunk(stored, no_small_sides, build):
    """Joins with carry tables reuse the partitioning of the windows."""
    text = plan(build(stored))
    wide = [
        line
        for line, above in zip(text.splitlines()[1:], text.splitlines(), strict=False)
        if "Exchange hashpartitioning" in above and "fields#" in line
    ]
    assert len(wide) <= 2


def test_no_cross_joins(spark, sf_dir):
    for name in ("truncate_auto_start", "truncate_time", "bounded_capture", "read_after"):
        text = plan(queries()[name](spark, sf_dir))
        assert "NestedLoopJoin" not in text
        assert "CartesianProduct" not in text


def test_broadcast_only_after_a_size_check(spark):
    table = spark.range(50).toDF("k")
    small = scan.broadcast_if_small(table, 50)
    assert "broadcast" in small._jdf.queryExecution().logical().toString()
    assert scan.broadcast_if_small(table, 49) is table


@pytest.mark.parametrize("name", ["truncate_range", "fmt_utc", "parse_utc", "replay_due"])
def test_session_time_zone_does_not_matter(spark, sf_dir, in_zone, name):
    expected = sorted(map(tuple, queries()[name](spark, sf_dir).collect()), key=repr)
    in_zone("America/New_York")
    found = sorted(map(tuple, queries()[name](spark, sf_dir).collect()), key=repr)
    assert found == expected
