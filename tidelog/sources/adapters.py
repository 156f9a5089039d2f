"""The benchmark tables read as message logs.

``*_arrivals`` carry everything but the sequence number and cost no shuffle;
``*_log`` add it.  A time window given here is applied to the table's own
timestamp column, so it reaches the Parquet scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.clock import epoch_ms
from tidelog.plans.scan import BUCKET_ROWS, number_within
from tidelog.schema import MESSAGE_LOG


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _instant(ms: int) -> Column:
    moment = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def within_ms(
    df: DataFrame, ts: str, from_ms: int | None, to_ms: int | None
) -> DataFrame:
    """Rows whose timestamp falls into whole milliseconds ``from_ms..to_ms``."""
    if from_ms is not None:
        df = df.where(F.col(ts) >= _instant(from_ms))
    if to_ms is not None:
        df = df.where(F.col(ts) < _instant(to_ms + 1))
    return df


def events_arrivals(events: DataFrame) -> DataFrame:
    """The events table (batch or streaming), one stream per event type.

    Fields are the user, the value and whatever keys ``props`` has.
    """
    return events.select(
        F.concat(F.lit("events:"), F.col("event_type")).alias("stream_name"),
        epoch_ms(F.col("ts")).alias("ms"),
        F.map_concat(
            F.create_map(
                F.lit("user_id"),
                F.col("user_id").cast("string"),
                F.lit("value"),
                F.col("value").cast("string"),
            ),
            F.coalesce(
                F.from_json("props", "map<string,string>"),
                F.create_map().cast("map<string,string>"),
            ),
        ).alias("fields"),
        F.lit("events").alias("recording"),
        F.col("event_id").alias("pos"),
    )


def orders_arrivals(orders: DataFrame) -> DataFrame:
    """The orders table, one stream per priority; arrival is not time order."""
    return orders.select(
        F.concat(F.lit("orders:"), F.col("o_orderpriority")).alias("stream_name"),
        epoch_ms(F.col("o_orderdate")).alias("ms"),
        F.create_map(
            F.lit("custkey"),
            F.col("o_custkey").cast("string"),
            F.lit("status"),
            F.col("o_orderstatus"),
            F.lit("totalprice"),
            F.col("o_totalprice").cast("string"),
        ).alias("fields"),
        F.lit("orders").alias("recording"),
        F.col("o_orderkey").alias("pos"),
    )


def lineitem_arrivals(lineitem: DataFrame) -> DataFrame:
    """Volume-only log of line items: no arrival position exists in the table."""
    return lineitem.select(
        F.concat(
            F.lit("lineitem:"), F.col("l_returnflag"), F.col("l_linestatus")
        ).alias("stream_name"),
        epoch_ms(F.col("l_shipdate")).alias("ms"),
        F.lit("lineitem").alias("recording"),
    )


def with_sequence(arrivals: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Give messages of one stream and millisecond the numbers 0, 1, 2, …"""
    numbered = number_within(arrivals, ["stream_name", "ms"], "seq", bucket_rows)
    return numbered.select(*MESSAGE_LOG.names)


def events_log(
    spark: SparkSession,
    folder: str,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    rows = within_ms(table(spark, folder, "events"), "ts", from_ms, to_ms)
    return with_sequence(events_arrivals(rows))


def orders_log(
    spark: SparkSession,
    folder: str,
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> DataFrame:
    rows = within_ms(table(spark, folder, "orders"), "o_orderdate", from_ms, to_ms)
    return with_sequence(orders_arrivals(rows))
