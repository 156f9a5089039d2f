"""What the corpus operators share: reading, per-text work in Arrow batches, staging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidelog.plans.storage import new_table

# ASCII bytes as the word rules see them: A-Z in lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# The same, and every ASCII byte but digits and letters is a space.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32
    for b in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage: later jobs survive lost executors without recomputing it.
    """
    path = new_table(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_of(rows: int, per_block: int) -> int:
    """How many blocks of at most about ``per_block`` rows hold ``rows``."""
    return max(1, -(-rows // per_block))


def annotated(
    df: DataFrame,
    text: str | Column,
    keep: Sequence[str | Column],
    outputs: StructType,
    work: Callable[[], Callable[[list[bytes | None]], Sequence]],
) -> DataFrame:
    """Columns derived from each whole text: ``row`` (the kept columns) and ``outputs``.

    ``work()`` runs once per task and returns a function from a list of UTF-8
    texts (``None`` for null) to one sequence per output column.  The kept
    columns travel in a struct, so that no name can clash.
    """
    packed = df.select(
        F.struct(*keep).alias("row"),
        (F.col(text) if isinstance(text, str) else text).cast("binary").alias("text"),
    )
    types = [packed.schema["row"], *outputs.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        derive = work()
        names = ["row", *[field.name for field in outputs.fields]]
        for batch in batches:
            if batch.num_rows:
                made = derive(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), *map(_array, made, arrow)], names
                )

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(field.dataType) for field in outputs.fields]
    return packed.mapInArrow(run, StructType(types))


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, kind)


def fields(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: int
) -> Iterator[tuple[tuple, list[pa.Table]]]:
    """Runs of equal leading columns in batches sorted by them.

    Yields the key and the group's rows as one Arrow table; a group may span
    batches, and only one group is held at a time.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for i in range(keys):
            column = batch.column(i).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(batch.column(i)[start].as_py() for i in range(keys))
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held)
