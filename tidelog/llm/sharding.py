"""Even shards of indivisible groups by best-fit-decreasing bin packing.

Documents with equal texts form a group that stays together.  Sorted by size,
each group enters the bin with the tightest remaining capacity that holds it,
found in a balanced tree.  The smallest capacity that needs no more than the
wanted number of bins makes the bins even.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import blocks_of

# Groups of at least this fraction of a shard are packed one by one.
GRAIN = 200
# Smaller groups are packed as parcels, this many for each shard.
PARCELS = 64
# Rows that one numbering window holds.
SLOT_ROWS = 50_000


class OpenBins:
    """Open bins in an AA tree ordered by (remaining capacity, bin)."""

    class Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    def tightest(self, size: int):
        """The bin with the least room that still holds ``size``; None if there is none."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def _add(self, node, key):
        if node is None:
            return self.Node(key)
        if key < node.key:
            node.left = self._add(node.left, key)
        else:
            node.right = self._add(node.right, key)
        return self._split(self._skew(node))

    def _remove(self, node, key):
        if node is None:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None:
            return node.right
        elif node.right is None:
            return node.left
        else:
            least = node.right
            while least.left:
                least = least.left
            node.key = least.key
            node.right = self._remove(node.right, least.key)
        lower = 1 + min(
            node.left.level if node.left else 0, node.right.level if node.right else 0
        )
        if lower < node.level:
            node.level = lower
            if node.right and node.right.level > lower:
                node.right.level = lower
        node = self._skew(node)
        node.right = self._skew(node.right)
        if node.right:
            node.right.right = self._skew(node.right.right)
        node = self._split(node)
        node.right = self._split(node.right)
        return node

    @staticmethod
    def _skew(node):
        if node and node.left and node.left.level == node.level:
            left = node.left
            node.left, left.right = left.right, node
            return left
        return node

    @staticmethod
    def _split(node):
        if node and node.right and node.right.right:
            if node.level == node.right.right.level:
                right = node.right
                node.right, right.left = right.left, node
                right.level += 1
                return right
        return node


def best_fit_decreasing(
    sizes: Sequence[int], capacity: int, most: int | None = None
) -> list[int] | None:
    """The bin of every item, in bins of ``capacity``; None if over ``most`` bins open.

    ``sizes`` must be in falling order and fit a bin each.
    """
    bins, tree, placed = 0, OpenBins(), []
    for size in sizes:
        room = tree.tightest(size)
        if room is None:
            if bins == most:
                return None
            room = (capacity, bins)
            bins += 1
        else:
            tree.remove(room)
        tree.add((room[0] - size, room[1]))
        placed.append(room[1])
    return placed


def even_bins(sizes: Sequence[int], shards: int) -> list[int]:
    """Best-fit-decreasing into ``shards`` bins of the smallest capacity that does.

    An item larger than an even share gets a bin of its own and the rest are
    shared out evenly.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    total, placed, free, first = sum(sizes), [0] * len(sizes), shards, 0
    while first < len(order) and free > 1 and sizes[order[first]] * free > total:
        placed[order[first]] = shards - free
        total -= sizes[order[first]]
        first, free = first + 1, free - 1
    rest = [sizes[i] for i in order[first:]]
    if not rest:
        return placed
    low, high = max(rest[0], -(-total // free)), total
    best = None
    step = max(1, low // 4096)
    while best is None or low < high:  # grow, then halve, the range of capacities
        capacity = min(low + step, high) if best is None else (low + high) // 2
        found = best_fit_decreasing(rest, capacity, free)
        if found is not None:
            best, high = found, capacity
        else:
            low, step = capacity + 1, step * 2
        if best is not None and high - low <= low >> 14:
            break
    for i, bin_no in zip(order[first:], best, strict=True):
        placed[i] = shards - free + bin_no
    return placed


def shard(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    grain: int = GRAIN,
    parcels: int = PARCELS,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Put every document into one of ``shards`` shards of near equal bytes.

    Returns ``id_col``, ``size`` (UTF-8 bytes of the text, 0 if null, plus 8),
    ``text_crc32`` (null for a null text), ``law`` ('bytes'), ``shard``,
    ``slot`` (0, 1, 2, … within the shard) and ``grown_shard`` (null: this law
    moves groups when a shard is added).  Documents of equal texts share a
    shard; null texts are one group, empty texts another.  Repeated rows count
    each; an empty table gives no rows; other columns are ignored.

    At most ``shards * grain`` groups can hold ``1 / grain`` of an even share,
    and only those reach the driver one by one, with ``shards * parcels`` sums
    of the others.  Texts are never shuffled.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_col, F.col(text_col).isNull()).alias("group"),
    )
    groups = sized.groupBy("group").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")
    )
    parcel = F.pmod("group", F.lit(shards * parcels)).cast("int")
    total = sized.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    least = max(1, -(-(total["bytes"] or 0) // (shards * grain)))
    large = groups.where(F.col("bytes") >= least).select("group", "bytes").collect()
    small = (
        groups.where(F.col("bytes") < least)
        .groupBy(parcel.alias("parcel"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()
    )
    items = sorted((row["bytes"], 0, row["group"]) for row in large)
    items += sorted((row["bytes"], 1, row["parcel"]) for row in small)
    bins = even_bins([item[0] for item in items], shards)
    by_group = [(key, b) for (_, kind, key), b in zip(items, bins, strict=True) if not kind]
    by_parcel = [(key, b) for (_, kind, key), b in zip(items, bins, strict=True) if kind]
    groups_to = spark.createDataFrame(by_group, "group bigint, group_shard int")
    parcels_to = spark.createDataFrame(by_parcel, "parcel int, parcel_shard int")
    buckets = blocks_of(total["rows"], shards * slot_rows)
    placed = (
        sized.withColumn("parcel", parcel)
        .join(F.broadcast(groups_to), "group", "left")
        .join(F.broadcast(parcels_to), "parcel", "left")
        .select(
            "id",
            "size",
            "text_crc32",
            F.coalesce("group_shard", "parcel_shard").alias("shard"),
            F.pmod(F.xxhash64("id", "group"), F.lit(buckets)).cast("int").alias("bucket"),
        )
    )
    before = (
        Window.partitionBy("shard")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("rows"))
        .select(
            "shard",
            "bucket",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
        )
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside))
        .join(starts, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("place") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
