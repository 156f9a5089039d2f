"""Order-dependent results over a whole log without sorting it in one partition.

Rows are cut into buckets whose number follows the wanted order.  Inside a
bucket an ordinary window does the work; between buckets only one small row
per bucket is carried forward.  A bucket holds at most ``BUCKET_ROWS`` rows
whatever the data look like, so a hot stream or a hot timestamp is spread
over as many tasks as it fills buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.storage import stored

# Rows of a log one window group may hold.  10^12 messages make 4 million
# buckets, whose carry rows (a few numbers each) one task sorts in seconds.
BUCKET_ROWS = 262_144
# Rows per block when the bucket table is itself too long for one task.
BLOCK_ROWS = 65_536


def div(value: Column, by: int) -> Column:
    """Whole-number division (``/`` would go through DOUBLE)."""
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def broadcast_if_small(table: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A join side that is broadcast after its size has been checked.

    Runs a job that fetches at most ``max_rows + 1`` rows.  A larger table is
    returned as it is, for an ordinary shuffled join.
    """
    rows = table.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def carried(
    table: DataFrame,
    order: Sequence[str],
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
) -> DataFrame:
    """Add what lies before each row of a bucket table, in ``order``.

    ``<c>_before`` is the sum (0 at the start) or the maximum (NULL at the
    start) of column ``c`` over all earlier rows.  The table has one row per
    bucket, so it is ordered in one partition.
    """
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return table.select(
        "*",
        *[
            F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before")
            for c in sums
        ],
        *[F.max(c).over(earlier).alias(f"{c}_before") for c in maxes],
    )


def carried_in_blocks(
    table: DataFrame,
    key: str,
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    within: Sequence[str] = (),
) -> DataFrame:
    """:func:`carried` for a table that grows with the log, such as its batches.

    Blocks of consecutive keys are scanned side by side; only one row per
    block is carried in one partition.  ``within`` names columns that come
    before ``key`` in the order, such as the recording.
    """
    place = [*within, "_block"]
    blocked = table.withColumn("_block", div(F.col(key), block_rows))
    blocks = blocked.groupBy(*place).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes]
    )
    before = [f"{c}_before" for c in (*sums, *maxes)]
    blocks = carried(blocks, place, sums, maxes).select(
        *place, *[F.col(c).alias(f"_{c}") for c in before]
    )
    earlier = (
        Window.partitionBy(*place)
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return blocked.join(blocks, place).select(
        *table.columns,
        *[
            (
                F.col(f"_{c}_before") + F.coalesce(F.sum(c).over(earlier), F.lit(0))
            ).alias(f"{c}_before")
            for c in sums
        ],
        *[
            F.greatest(F.col(f"_{c}_before"), F.max(c).over(earlier)).alias(
                f"{c}_before"
            )
            for c in maxes
        ],
    )


def number_by_arrival(
    log: DataFrame,
    column: str = "arrival",
    bucket_rows: int = BUCKET_ROWS,
    store_counts: bool = False,
) -> DataFrame:
    """Number the rows 0, 1, 2, … in ``(recording, pos)`` order.

    The rows of the buckets are counted before the log is shuffled once.  The
    counts are used twice: ``store_counts`` runs a job that stores them, for a
    log that is dear to compute.  ``pos`` is unique within a recording, so a
    bucket of ``bucket_rows`` positions holds at most that many rows.  Sparse
    positions make many small buckets, which are carried in blocks.
    """
    bucketed = log.withColumn("_bucket", div(F.col("pos"), bucket_rows))
    counts = bucketed.groupBy("recording", "_bucket").agg(F.count("*").alias("_rows"))
    if store_counts:
        counts = stored(counts, "arrival-counts")
    starts = carried_in_blocks(
        counts, "_bucket", sums=["_rows"], within=["recording"]
    ).drop("_rows")
    inside = Window.partitionBy("recording", "_bucket").orderBy("pos")
    numbered = bucketed.withColumn("_local", F.row_number().over(inside))
    number = F.col("_rows_before") + F.col("_local") - 1
    return numbered.join(starts, ["recording", "_bucket"]).select(
        *log.columns, number.alias(column)
    )


def number_within(
    log: DataFrame,
    group: Sequence[str],
    column: str,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in arrival order; groups may be huge.

    A group is split by recording and position bucket.  Only groups that really span several
    buckets get a carried start, so the joined table stays small when groups
    are small.
    """
    group = list(group)
    bucketed = log.withColumn("_bucket", div(F.col("pos"), bucket_rows))
    place = ["recording", "_bucket"]
    counts = bucketed.groupBy(*group, *place).agg(F.count("*").alias("_rows"))
    earlier = (
        Window.partitionBy(*group)
        .orderBy(*place)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        *group, *place, F.sum("_rows").over(earlier).alias("_start")
    ).where(F.col("_start") > 0)
    inside = Window.partitionBy(*group, *place).orderBy("pos")
    numbered = bucketed.withColumn("_local", F.row_number().over(inside))
    number = F.coalesce(F.col("_start"), F.lit(0)) + F.col("_local") - 1
    return numbered.join(starts, [*group, *place], "left").select(
        *log.columns, number.alias(column)
    )
