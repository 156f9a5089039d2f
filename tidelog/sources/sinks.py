"""Writing logs: tables, exports and time-rotated captures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.flatten import MAX_KEYS, flatten_fields, flatten_typed, keys_or_none
from tidelog.plans.scan import carried, div
from tidelog.plans.storage import stored
from tidelog.schema import require_format, require_positive

# How CSV text must be quoted to come back unchanged, and a
# stand-in for NULL on reading that keeps an empty text apart from it.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
NO_VALUE = "\0"
# Moments of rotation that every task may search, and ranges of more of them.
MAX_TIMES = 4096


def write_log(log: DataFrame, path: str, by_time: bool = False) -> None:
    """Append a log to a Parquet table; existing rows stay, nothing is merged.

    Rows keep their recording and position, so recordings appended to one table
    need names of their own for arrival order to be defined across them.
    ``by_time`` lays the new rows out in ID order, so that ID and time ranges
    later skip most row groups.  The sort key ends in the unique row position:
    even one single hot millisecond is spread over many tasks.
    """
    refuse_own_input(log, path)
    if by_time:
        key = ["ms", "seq", "recording", "pos"]
        log = log.repartitionByRange(*key).sortWithinPartitions(*key)
    log.write.mode("append").parquet(path)


def refuse_own_input(log: DataFrame, path: str) -> None:
    """Raise if the rows are read from below the path they are to be written to."""
    jvm = log.sparkSession.sparkContext._jvm
    conf = log.sparkSession.sparkContext._jsc.hadoopConfiguration()

    def qualified(name: str) -> str:
        place = jvm.org.apache.hadoop.fs.Path(name)
        return place.getFileSystem(conf).makeQualified(place).toUri().getPath() + "/"

    target = qualified(path)
    inputs = {name.rsplit("/", 1)[0] for name in log.inputFiles()}
    if any((qualified(name) + "/").startswith(target) for name in inputs):
        raise ValueError(f"{path} is read by the rows to be written to it")


def export(
    log: DataFrame,
    path: str,
    fmt: str = "parquet",
    keys: Sequence[str] | None = None,
    prefix_reserved: bool = False,
    max_keys: int = MAX_KEYS,
    types: Mapping[str, str] | None = None,
) -> bool:
    """Write the flattened log as Parquet or CSV; no rows, no output.

    The other arguments are those of ``flatten_fields``; a log of VARIANT
    values gives columns of the types they have.  Returns whether anything was
    written.
    """
    require_format(fmt)
    refuse_own_input(log, path)
    if log.schema["fields"].dataType == T.MapType(T.StringType(), T.VariantType()):
        if keys is not None or types is not None:
            raise ValueError("the names and types of VARIANT values are found, not given")
        if log.isEmpty():
            return False
        _write_flat(flatten_typed(log, prefix_reserved, max_keys), path, fmt)
        return True
    if keys is None:
        keys = keys_or_none(log, max_keys)
        if keys is None:
            return False
    elif log.isEmpty():
        return False
    _write_flat(flatten_fields(log, keys, prefix_reserved, types=types), path, fmt)
    return True


def _write_flat(flat: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        flat.write.options(**CSV_OPTIONS).csv(path)
    else:
        flat.write.parquet(path)


def read_csv_export(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV export as text columns, with empty text and NULL kept apart."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    reader = spark.read.options(multiLine=True, nullValue=NO_VALUE, **CSV_OPTIONS)
    return reader.schema(schema).csv(path)


def rotation(log: DataFrame, interval_ms: int) -> DataFrame:
    """Add ``rotation``, the number of the time interval a message falls into."""
    require_positive(interval_ms=interval_ms)
    return log.withColumn("rotation", div(F.col("ms"), interval_ms))


def _position(sorted_values: Column, value: Column) -> Column:
    """How many values of a sorted array are at most ``value``, by halving."""
    size = F.size(sorted_values)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))

    def halve(ends: Column, _: Column) -> Column:
        middle = F.call_function("div", ends["low"] + ends["high"], F.lit(2)).cast("int")
        below = F.coalesce(F.get(sorted_values, middle) <= value, F.lit(False))
        active = ends["low"] < ends["high"]
        return F.struct(
            F.when(active & below, middle + 1).otherwise(ends["low"]).alias("low"),
            F.when(active & ~below, middle).otherwise(ends["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), size.alias("high"))
    return F.aggregate(steps, start, halve, lambda ends: ends["low"]).cast("bigint")


def rotation_at(
    log: DataFrame, times: DataFrame | Sequence[int], max_literals: int = MAX_TIMES
) -> DataFrame:
    """Add ``rotation``: how many of the given moments (``ms``) a message is not before.

    Equal moments count once, NULL ones not at all; a message without a time
    has no rotation.  Up to ``max_literals`` moments are searched by every
    task.  More are dealt into that many ranges: a message searches their
    bounds, and then the moments of one range, which a join brings to it.
    ``log`` may be a stream.  Fetching the moments, or their bounds, runs jobs.
    """
    if not isinstance(times, DataFrame):
        listed = [(int(ms),) for ms in times]
        times = log.sparkSession.createDataFrame(listed, "ms bigint")
    moments = times.select(F.col("ms").cast("bigint").alias("ms")).where("ms is not null").distinct()
    known = [row.ms for row in moments.limit(max_literals + 1).collect()]
    if len(known) <= max_literals:
        return log.withColumn("rotation", _found(sorted(known)))
    parts = max(2, max_literals)
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted({int(x) for x in moments.approxQuantile("ms", shares, 0.1 / parts)})
    ranges = moments.groupBy(_found(bounds).alias("_range")).agg(
        F.sort_array(F.collect_list("ms")).alias("_moments"), F.count("*").alias("_count")
    )
    ranges = carried(ranges, ["_range"], sums=["_count"]).select("_range", "_moments", "_count_before")
    ranges = stored(ranges, "rotation-ranges")
    total = ranges.agg(F.sum(F.size("_moments"))).first()[0]
    # Ranges without a moment have no row; all moments before them count.
    filled = _filled(ranges, len(bounds), total)
    number = F.col("_count_before") + F.coalesce(_position(F.col("_moments"), F.col("ms")), F.lit(0))
    joined = log.withColumn("_range", _found(bounds)).join(filled, "_range", "left")
    return joined.select(*log.columns, number.alias("rotation"))


def _found(values: Sequence[int]) -> Column:
    moments = F.array(*[F.lit(ms).cast("bigint") for ms in values]).cast("array<bigint>")
    return F.when(F.col("ms").isNotNull(), _position(moments, F.col("ms")))


def _filled(ranges: DataFrame, last: int, total: int) -> DataFrame:
    """A row for every range number; one without moments carries the count before it."""
    numbers = ranges.sparkSession.range(last + 1).select(F.col("id").alias("_range"))
    onward = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    known = numbers.join(ranges, "_range", "left")
    before = F.coalesce(
        "_count_before", F.first("_count_before", ignorenulls=True).over(onward), F.lit(total)
    )
    return known.select("_range", "_moments", before.alias("_count_before"))


def write_rotated(log: DataFrame, path: str, interval_ms: int) -> None:
    """Write one folder per time interval; see :func:`write_rotated_at`."""
    _write_rotated(log, rotation(log, interval_ms), path)


def write_rotated_at(log: DataFrame, path: str, times: DataFrame | Sequence[int]) -> None:
    """Write one folder per rotation, which begins at every given moment.

    Rows are gathered by interval, and AQE splits an interval that is too big
    for one task, so files are few without a hot interval stalling the job.
    """
    _write_rotated(log, rotation_at(log, times), path)


def _write_rotated(log: DataFrame, rotated: DataFrame, path: str) -> None:
    refuse_own_input(log, path)
    rotated = rotated.hint("rebalance", "rotation")
    rotated.write.mode("append").partitionBy("rotation").parquet(path)
