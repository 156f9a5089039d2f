"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest
from oracle import connect, spark_rows, spark_types, sql_rows, sql_types

from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from tidelog.functions.ids import format_id
from tidelog.operators import replay, stats
from tidelog.plans import queries as Q
from tidelog.sources import adapters


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, db, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    columns, rows = spark_rows(df)
    sql_columns, expected = sql_rows(db, oracle_sql()[name])
    assert columns == sql_columns
    assert spark_types(df) == sql_types(db, oracle_sql()[name])
    assert len(rows) == len(expected)
    assert rows == expected


def test_every_own_query_has_sql():
    assert set(Q.QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1


def _orders(spark, sf_dir):
    return adapters.orders_log(spark, sf_dir)


SMALL = 5000
IN_MANY_BUCKETS = {
    "replay_order": lambda s, d: replay.replay_order(
        _orders(s, d), rename=Q.RENAMED_ORDERS, bucket_rows=SMALL, **Q.REPLAY
    ).select("replay_no", "batch", "stream_name", "ms", "seq", "pos"),
    "replay_due": lambda s, d: replay.replay_schedule(
        _orders(s, d), bucket_rows=SMALL, **Q.TIMED
    ).select("replay_no", "stream_name", "ms", "seq", "pos", "due_us"),
    "replay_reissue": lambda s, d: replay.replay_reissue(
        _orders(s, d), Q.REISSUE_BASE_MS, rename=Q.RENAMED_ORDERS, bucket_rows=SMALL, **Q.TIMED
    ).select("stream_name", "pos", "replay_no", "new_ms", "new_seq"),
    "replay_batches": lambda s, d: replay.replay_batches(
        _orders(s, d), bucket_rows=SMALL, **Q.REPLAY
    ),
    "batch_summary": lambda s, d: stats.batch_summary(_orders(s, d), Q.BATCH_SIZE, SMALL),
    "format_message_id": lambda s, d: adapters.with_sequence(
        adapters.orders_arrivals(adapters.table(s, d, "orders")), SMALL
    ).select("pos", format_id(F.col("ms"), F.col("seq")).alias("message_id")),
}


WAYS = [(name, "by batch") for name in sorted(IN_MANY_BUCKETS)]
WAYS += [(name, "by range") for name in ("replay_order", "replay_due", "replay_reissue")]


@pytest.mark.parametrize(("name", "chunking"), WAYS)
def test_matches_sql_in_many_buckets(spark, db, sf_dir, monkeypatch, name, chunking):
    """The same results when the log fills many buckets, in both ways of chunking."""
    if chunking == "by range":
        monkeypatch.setattr(replay, "MIN_BATCHES", SMALL)
    columns, rows = spark_rows(IN_MANY_BUCKETS[name](spark, sf_dir))
    sql_columns, expected = sql_rows(db, oracle_sql()[name])
    assert columns == sql_columns
    assert rows == expected


def test_capture_limits_prepares_its_files_in_many_tasks(spark, monkeypatch):
    """A coalesced write would sort and join the whole log in one task."""

    def refused(*_):
        raise AssertionError("the log must not be computed in one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refused)
    folder = "/root/testdata/sf0.001"  # all of it is below the limit
    found = queries()["capture_limits"](spark, folder).count()
    assert found == spark.read.parquet(f"{folder}/events.parquet").count()
